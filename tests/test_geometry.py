import pytest
from hypothesis import given
from hypothesis import strategies as st

from shardloom.functions import geometry as g


def test_sizes():
    assert g.parse_bytes("1KB") == 1024 and g.parse_bytes(" 2 MiB ") == 2 << 20 and g.parse_bytes("10") == 10 and g.parse_bytes("1.5k") == 1536
    with pytest.raises(ValueError):
        g.parse_bytes("many")
    assert g.shard_rows(7, 1, 1) == 7 and g.shard_rows("1KB", 100 * 64, 100) == 16 and g.shard_rows("1B", 6400, 100) == 1 and g.shard_rows("1GB", 0, 0) == 1


def test_geometry():
    assert g.dense_geometry(10, 3, 10) == (3, 9) and g.dense_geometry(10, 5, 10) == (5, 10)
    assert g.sparse_geometry(5, 0, 64, 200) == (1, 1)
    with pytest.raises(ValueError):
        g.dense_geometry(0, 1, 1)
    with pytest.raises(ValueError):
        g.sparse_geometry(0, 0, 1, 1)


@given(st.integers(1, 5000), st.integers(0, 50000), st.integers(1, 300), st.integers(1, 3000))
def test_geometry_bounds(n, nnz, page, shard):
    for p, s, top in ((*g.dense_geometry(n, page, shard), n), (*g.sparse_geometry(n, nnz, page, shard), max(1, nnz))):
        assert 1 <= p <= s <= max(top, p) and s % p == 0


@given(st.integers(0, 1000), st.integers(1, 40))
def test_splits(n, k):
    parts = g.array_split(n, k)
    assert sum(parts) == n and max(parts) - min(parts) <= 1 and parts == sorted(parts, reverse=True)
    assert sum(g.fixed_split(n, k)) == n and all(x == k for x in g.fixed_split(n, k)[:-1])
    assert g.intervals(parts)[-1][1] == n


def test_masks_and_preload():
    assert g.resolve_mask(None, 5) == (0, 5) and g.resolve_mask(slice(2, 4), 5) == (2, 4)
    for bad in (slice(0, 4, 2), slice(-1, 3), slice(3, 3), slice(0, 9)):
        with pytest.raises(ValueError):
            g.resolve_mask(bad, 5)
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0), (2, 2, 5), (2, 2, 3)):
        with pytest.raises(ValueError):
            g.check_preload(*bad)


def test_types_and_names():
    assert g.promote("int", "float") == "double" and g.promote("smallint", "float") == "float" and g.promote("int", "bigint") == "bigint"
    with pytest.raises(TypeError):
        g.promote("string", "int")
    assert [g.delivery_type(t) for t in ("float", "double", "boolean", "smallint", "int")] == ["float", "double", "boolean", "float", "double"]
    assert g.dataset_number("dataset_12") == 12 and g.dataset_number("dataset=3") == 3 and g.dataset_number("data_1") is None
    assert g.lcm_group(9, 6) == 2 and g.sparse_row_bytes(0, 0) == 0 and g.dense_row_bytes((10, 5, 128, 128), "float") == 5 * 128 * 128 * 4
