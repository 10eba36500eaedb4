import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import census, index, matrix, ranks, shuffling


def test_hashed_and_prefix_rank(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "hot").otherwise(F.when(F.col("id") < 900, "b")))
    r = ranks.hashed_rank(df, ["g"], F.xxhash64("id"), "r", n_out="n").toPandas()
    for key, n in (("hot", 700), ("b", 200), (None, 100)):
        x = r[r.g == key] if key else r[r.g.isna()]
        assert sorted(x.r) == list(range(1, n + 1)) and set(x.n) == {n}
    p = ranks.prefix_rank(df, [], F.md5(F.col("id").cast("string").cast("binary")), "r", start=0).toPandas()
    import hashlib

    order = sorted(range(1000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert p.sort_values("r").id.tolist() == order


def test_dense_index(spark):
    df = spark.createDataFrame([(5,), (-3,), (900,), (7,)], "k bigint")
    assert {r.k: r.obs_idx for r in index.dense_index(df, "k").collect()} == {-3: 0, 5: 1, 7: 2, 900: 3}
    names = spark.createDataFrame([("b", 2), ("a", 9), ("c", 1)], "s string, t int")
    assert {r.s: r.obs_idx for r in index.dense_index_by(names, ["s", "t"]).collect()} == {"a": 0, "b": 1, "c": 2}
    assert index.dense_index(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        index.dense_index(spark.createDataFrame([(None,), (1,)], "k bigint"), "k")


def test_runs_over_block_edges(spark):
    v = ["a"] * 10 + ["b"] * 3 + [None] * 4 + ["b"] * 9 + ["a"]
    df = spark.createDataFrame(list(enumerate(v)), "i bigint, v string")
    want = [("a", 0, 10), ("b", 10, 13), (None, 13, 17), ("b", 17, 26), ("a", 26, 27)]
    for block in (1, 2, 5, 100):
        assert sorted([tuple(r) for r in index.runs(df, "i", "v", block).collect()], key=lambda x: x[1]) == want
    gaps = df.where("i NOT IN (4, 5, 20)")
    assert sorted(tuple(r) for r in index.coalesce_runs(gaps, "i").collect()) == [(0, 4), (6, 20), (21, 27)]
    assert index.runs(df.limit(0), "i", "v").count() == 0


def test_locate_and_expand(spark):
    df = spark.range(12).withColumnRenamed("id", "x")
    got = {r.x: (r.dataset, r.local_row) for r in index.locate(df, "x", {0: 3, 1: 0, 2: 5}).collect()}
    assert got[0] == (0, 0) and got[3] == (2, 0) and got[7] == (2, 4) and got[8] == (None, None)
    s = spark.createDataFrame([(0, 5, 8), (1, 2, 2)], "s int, start bigint, stop bigint")
    assert sorted((r.s, r.obs_idx) for r in index.expand(s).collect()) == [(0, 5), (0, 6), (0, 7)]


def test_block_plan_rules(spark):
    one = shuffling.block_plan(spark, 20, 10, dataset_size=10).toPandas()  # floor(10/10) <= 1: a single dataset
    assert set(one.dataset) == {0}
    many = shuffling.block_plan(spark, 600, 10, dataset_size=60).toPandas()
    assert many.groupby("dataset").size().tolist() == [6] * 10 and many.sort_values("rank").blk.tolist() != list(range(60))
    still = shuffling.block_plan(spark, 600, 10, shuffle=False, dataset_size=60).toPandas()
    assert (still.dataset == still.blk // 6).all()
    dealt = shuffling.block_plan(spark, 70, 10, n_datasets=3).toPandas()
    assert dealt.groupby("dataset").size().tolist() == [3, 2, 2]
    for bad in (dict(), dict(dataset_size=5), dict(n_datasets=9), dict(dataset_size=60, n_datasets=2)):
        with pytest.raises(ValueError):
            shuffling.block_plan(spark, 70, 10, **bad)


def test_sort_is_stable_with_nulls_last_in_category_order(spark):
    rows = [(i, 0, c) for i, c in enumerate(["b", None, "c", "a", "c", "zz", "b"])]
    df = spark.createDataFrame(rows, "obs_idx bigint, dataset int, k string")
    df = shuffling.with_codes(df, "k", ["c", "a", "b"])
    p = shuffling.place_rows(df, shuffle=False, groupby=["k_code"]).toPandas().sort_values("row")
    assert p.obs_idx.tolist() == [2, 4, 3, 0, 6, 1, 5]


def test_unique_names_with_collisions(spark):
    df = spark.createDataFrame(list(enumerate(["a", "a", "a-1", "b", "a", None, None])), "obs_idx bigint, obs_name string")
    got = [r.obs_name for r in shuffling.unique_names(df).orderBy("obs_idx").collect()]
    assert got[0] == "a" and got[2] == "a-1" and got[3] == "b" and got[5] is None and got[6] is None
    assert len({*got[:5]}) == 5 and {got[1], got[4]} == {"a-2", "a-3"}


def axis(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "var_idx int, var_name string")


def test_outer_features_and_remap(spark):
    a, b = axis(spark, ["x", "y"]), axis(spark, ["z", "y", "w"])
    ax = {r.name: (r.new_idx, r.n_sources) for r in matrix.feature_axis([a, b]).collect()}
    assert ax == {"x": (0, 1), "y": (1, 2), "z": (2, 1), "w": (3, 1)}
    with pytest.raises(ValueError):
        matrix.feature_axis([axis(spark, ["x", "x"])])
    rows = spark.createDataFrame([(1, [0, 1, 2], [5.0, 6.0, 7.0]), (2, [], []), (3, None, None)], "rec_id int, x_indices array<int>, x_values array<double>")
    m = spark.createDataFrame([(0, 9), (2, 4)], "old_idx int, new_idx int")
    got = {r.rec_id: (r.x_indices, r.x_values) for r in matrix.remap_rows(rows, m).collect()}
    assert got == {1: ([4, 9], [7.0, 5.0]), 2: ([], []), 3: (None, None)}
    d = spark.createDataFrame([([1.0, 2.0],)], "x array<double>").select(matrix.align_dense("x", [2, 0], 3).alias("x")).first().x
    assert d[0] == 2.0 and np.isnan(d[1]) and d[2] == 1.0


def test_merge_modes(spark):
    # three sources, three features; one golden for each mode
    s = [spark.createDataFrame([(f, v) for f, v in rows], "feature string, v bigint") for rows in ([("f", 1), ("g", 2)], [("f", 1), ("g", 3)], [("f", 1), ("h", 4)])]
    long = None
    for i, d in enumerate(s):
        x = d.select(F.lit(i).alias("src"), "feature", F.col("v").alias("value"))
        long = x if long is None else long.unionAll(x)
    by = lambda m: {r.feature: r.value for r in matrix.merge_by_feature(long, m, 3).collect()}
    assert by("same") == {"f": 1} and by("unique") == {"f": 1, "h": 4} and by("first") == {"f": 1, "g": 2, "h": 4} and by("only") == {"h": 4}
    src = [(d, "v") for d in s]
    assert matrix.merge_attribute(src, None) is None and matrix.merge_attribute(src, "same") is None and matrix.merge_attribute(src, "only") is None
    assert {r.feature: r.value for r in matrix.merge_attribute(src, "first").collect()} == {"f": 1, "g": 2, "h": 4}
    assert matrix.merge_attribute([src[0], (s[1], None), (s[2], None)], "only").count() == 2
    assert {r.feature: r.value for r in matrix.merge_attribute([src[0], src[0]], "same").collect()} == {"f": 1, "g": 2}
    with pytest.raises(ValueError):
        matrix.merge_attribute(src, "other")


def test_promotion_and_concat(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    b = spark.createDataFrame([(2, 2.5)], "k int, x float")
    u = matrix.union_promoted([a, b], "x")
    assert dict(u.dtypes)["x"] == "double"
    c = matrix.concat_rows([a, b.withColumn("extra", F.lit("e"))], ["p", "q"])
    assert {(r.k, r.extra, r.src_path) for r in c.collect()} == {(1, None, "p"), (2, "e", "q")}


def test_csr_export(spark):
    import pyarrow as pa

    i, v = pa.array([[0, 2], None, [], [1]], pa.list_(pa.int32())), pa.array([[1.0, 2.0], None, [], [3.0]], pa.list_(pa.float32()))
    data, ind, ptr, shape = matrix.csr_arrow(i, v, 3)
    assert data.tolist() == [1, 2, 3] and ind.tolist() == [0, 2, 1] and ptr.tolist() == [0, 2, 2, 2, 3] and shape == (4, 3)
    assert matrix.csr_arrow(i[2:3], v[2:3])[3] == (1, 0) and matrix.csr_arrow(i[3:], v[3:])[2].tolist() == [0, 1]
    assert matrix.csr_dense(data, ind, ptr, shape).tolist() == [[1, 0, 2], [0, 0, 0], [0, 0, 0], [0, 3, 0]]
    long = spark.createDataFrame([(1, 5, 2.0), (1, 3, 1.0), (1, 5, 1.0)], "obs int, feature int, value double")
    r = matrix.to_rows(long).first()
    assert r["indices"] == [3, 5] and r["values"] == [1.0, 3.0]


def test_census(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1,)], "k int")
    assert {r.key: r.n_sources for r in census.key_census({"a": a, "b": b}).collect()} == {"k": 2, "x": 1}
    with pytest.warns(UserWarning, match="x"):
        census.warn_missing({"a": a, "b": b})
    for bad in ("nowhere", "x"):
        with pytest.raises(ValueError):
            census.check_groupby({"a": a, "b": b}, [bad])
    with pytest.raises(ValueError):
        census.check_groupby({"a": a, "b": a}, ["k"], {"a": {"k": ["1", "2"]}, "b": {"k": ["2", "1"]}})
    with pytest.raises(ValueError):
        census.check_groupby({"a": a, "b": a}, ["k"], {"a": {"k": ["1"]}})
    for bad in ([], ["k", "k"]):
        with pytest.raises(ValueError):
            census.normalize_groupby(bad)
    census.same_features([axis(spark, ["x"]), axis(spark, ["x"])])
    with pytest.raises(ValueError):
        census.same_features([axis(spark, ["x"]), axis(spark, ["y"])])
    assert census.union_categories([["b", "a"], ["c", "a"]]) == ["b", "a", "c"]
