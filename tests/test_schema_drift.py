import json

import pytest

from shardloom.operators import schema_drift as d

SCHEMA = "file_id bigint, kind string, store_id bigint, written_at timestamp_ntz, line_no int, rec_key string, record string, received_at string"


def raw(spark, files, kind="obs"):
    """files: (file_id, store, day, [(key, object or text)])."""
    import datetime as dt

    rows = []
    for f, s, day, lines in files:
        for i, (k, o) in enumerate(lines):
            rows.append((f, kind, s, dt.datetime(2023, 1, 1) + dt.timedelta(days=day), i, k, o if isinstance(o, str) or o is None else json.dumps(o), "x"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    return {tuple(r) for r in d.changes(df).collect()}


def test_all_kinds_of_change(spark):
    df = raw(spark, [
        (7, 1, 0, [("a", {"x": 1, "n": "s", "gone": 5, "t": 1}), ("b", {"x": 2, "n": None, "t": 2})]),
        (3, 1, 40, [("a", {"y": 1, "n": "s", "new": True, "t": 1.5}), ("b", {"y": 2, "N": "q"}), ("c", '{"cut": 1, "o'), ("d", "[1]"), ("e", None)]),
        (9, 2, 5, [("a", {"x": 1})]),
    ])
    assert changes(df) == {(3, "renamed", "x", "y"), (3, "removed", "gone", ""), (3, "added", "", "new"), (3, "added", "", "N"), (3, "retyped", "t", "t")}
    assert changes(df.unionAll(df)) == changes(df)  # repeated rows


def test_rename_needs_evidence_without_exception(spark):
    one = lambda old, new: changes(raw(spark, [(1, 1, 0, old), (2, 1, 1, new)]))
    kept = {(2, "removed", "x", ""), (2, "added", "", "y")}
    assert one([("a", {"x": 1})], [("b", {"y": 1})]) == kept  # no record in both
    assert one([("a", {"x": 1}), ("b", {"x": 2})], [("a", {"y": 1}), ("b", {"y": 3})]) == kept
    assert one([("a", {"x": 1})], [("a", {"y": "1"})]) == kept  # another JSON type
    assert one([("a", {"x": None})], [("a", {"y": None})]) == kept  # all null
    assert one([("a", {"x": None}), ("b", {"x": [1, "q"]})], [("a", {"y": None}), ("b", {"y": [1, "q"]})]) == {(2, "renamed", "x", "y")}
    assert one([("a", {"x": "é ü"})], [("a", {"X ": "é ü"})]) == {(2, "renamed", "x", "X ")}


def test_ambiguous_evidence_is_settled_one_to_one(spark):
    got = changes(raw(spark, [(1, 1, 0, [("a", {"mean_expr": 4, "depth": 4})]), (2, 1, 1, [("a", {"meanExpr": 4, "depth_um": 4})])]))
    assert got == {(2, "renamed", "mean_expr", "meanExpr"), (2, "renamed", "depth", "depth_um")}


def test_types(spark):
    got = changes(raw(spark, [(1, 1, 0, [("a", {"i": 1, "n": None, "m": 1, "b": True})]), (2, 1, 1, [("a", {"i": 2, "n": 5, "m": "s", "b": 0}), ("b", {"i": 1.5, "m": 2})]), (3, 1, 2, [("z", "nothing")])]))
    assert got == {(2, "retyped", x, x) for x in "imb"} | {(3, "removed", x, "") for x in "inmb"}


def test_order_is_by_time_over_months(spark):
    f = [(i, 1, (i * 37) % 400, [("a", {f"f{(i * 37) % 400 // 40}": 1})]) for i in range(20)]
    seq = {r.file_id: r.prev_id for r in d.file_sequence(raw(spark, f)).collect()}
    order = [i for i, *_ in sorted(f, key=lambda x: x[2])]
    assert [seq[x] for x in order] == [None, *order[:-1]]


def test_flooding_prefers_the_alike():
    s = d.flood([("gene_len", "integer"), ("chrom", "string")], [("geneLength", "integer"), ("chr", "string")], {})
    assert s["gene_len", "geneLength"] > s["gene_len", "chr"] and s["chrom", "chr"] > s["chrom", "geneLength"]
    assert d.flood([], [("a", "string")], {}) == {}


def test_settled_table(spark):
    df = raw(spark, [(1, 1, 0, [("a", {"x": 1, "file_id": "q", "s": "t"})]), (2, 1, 1, [("a", {"y": 1, "s": 5}), ("b", {"y": 2.5})]), (3, 1, 2, [("b", "bad")])])
    t = d.settled_table(df, "obs")
    assert dict(t.dtypes)["x"] == "double" and "y" not in t.columns and "file_id_1" in t.columns
    assert {(r.file_id, r.rec_key): (r.x, r.s) for r in t.collect()} == {(1, "a"): (1.0, "t"), (2, "a"): (1.0, "5"), (2, "b"): (2.5, None)}
    more = raw(spark, [(1, 1, 0, [("a", {"x": 1})]), (2, 1, 1, [("a", {"y": 1})]), (3, 1, 2, [("a", {"y": 3, "x": 4})])])  # both names in a line
    assert {(r.file_id, r.x) for r in d.settled_table(more.unionAll(more), "obs").collect()} == {(1, 1), (2, 1), (3, 4)}
    assert d.settled_table(df, "var").columns == ["kind", "store_id", "file_id", "line_no", "rec_key"]
    with pytest.raises(ValueError):
        d.settled_table(df, "obs", max_columns=1)


def test_empty(spark):
    assert d.changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_decide_among_pairs_with_evidence():
    """Both new fields hold the old one's values: the names and types around decide, and
    without scores nothing is renamed."""
    old, new = [("mean_expr", "integer"), ("z", "string")], [("meanExpr", "integer"), ("q", "string"), ("z", "string")]
    ev = {("mean_expr", "meanExpr"): (3, 3, 3), ("mean_expr", "q"): (3, 3, 3)}
    assert d.select_renames(old, new, ev) == [("mean_expr", "meanExpr")]
    assert d.select_renames(old, new, ev, {}) == []
    other = d.flood(old, new, ev) | {("mean_expr", "q"): 2.0}
    assert d.select_renames(old, new, ev, other) == [("mean_expr", "q")]


def test_nesting_tells_equal_names_apart():
    """a.len and b.len become c.len and d.len, with the same values everywhere: what a and b
    themselves became decides."""
    old = [("a", "object"), ("b", "object"), ("a.len", "integer"), ("b.len", "integer")]
    new = [("c", "object"), ("d", "object"), ("c.len", "integer"), ("d.len", "integer")]
    all_ = {(f"{x}.len", f"{y}.len"): (5, 5, 5) for x in "ab" for y in "cd"}
    assert set(d.select_renames(old, new, all_ | {("a", "d"): (5, 5, 5), ("b", "c"): (5, 5, 5)})) == {("a", "d"), ("b", "c"), ("a.len", "d.len"), ("b.len", "c.len")}


def test_nested_renames(spark):
    df = raw(spark, [(1, 1, 0, [("a", {"m": {"len": 3, "u": "x"}, "k": 1}), ("b", {"m": {"len": 4}})]), (2, 1, 1, [("a", {"m": {"length": 3, "u": 2}, "k": 1}), ("b", {"m": {"length": 4}})])])
    assert changes(df) == set()
    assert {tuple(r) for r in d.changes(df, depth=2).collect()} == {(2, "renamed", "m.len", "m.length"), (2, "retyped", "m.u", "m.u")}


def test_table_of_all_kinds_keeps_every_readable_line(spark):
    obs = raw(spark, [(1, None, 0, [("a", {"x": 1}), ("n", {"x": None}), ("e", {})]), (2, None, 1, [("a", {"y": 1}), ("b", "cut {")])])
    var = raw(spark, [(5, 1, 0, [("g", {"x": 1.5, "v": True})])], kind="var")
    t = d.settled_table(obs.unionAll(var))
    assert dict(t.dtypes)["x"] == "double" and dict(t.dtypes)["v"] == "boolean"
    assert {(r.kind, r.file_id, r.rec_key, r.x) for r in t.collect()} == {("obs", 1, "a", 1.0), ("obs", 1, "n", None), ("obs", 1, "e", None), ("obs", 2, "a", 1.0), ("var", 5, "g", 1.5)}
