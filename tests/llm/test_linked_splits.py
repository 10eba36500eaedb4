import random

import pytest

from shardloom.llm import linked_splits as x

SCHEMA = "rec_id bigint, donor_id string, sample_id string, obs_name string, group string, root int"


def cells(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def components(edges):
    up = {}

    def f(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        up[f(a)] = f(b)
    out = {}
    for v in list(up):
        out.setdefault(f(v), set()).add(v)
    return {frozenset(s) for s in out.values()}


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops"])
def test_components(spark, kind):
    r = random.Random(4)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 200)], "random": [(r.randrange(150), r.randrange(150)) for _ in range(90)], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)]}[kind]
    df = spark.createDataFrame([*edges, (None, 5), (5, None)], "a bigint, b bigint")
    got = {}
    for row in x.components(df).collect():
        got.setdefault(row.root, set()).add(row.v)
    assert {frozenset(s) for s in got.values()} == components([e for e in edges if e[0] != e[1]])
    assert all(k in s for k, s in got.items())


def test_no_edges(spark):
    assert x.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


ROWS = [
    (1, "D-0000007", "S1", "cell_1"), (2, "donor_7", None, "14"), (3, "#07 (donor)", "s9 ", ""), (4, None, "\tS9", "14"),
    (5, "unknown", "", "14"), (6, "-", None, None), (7, "D-12", "S1 x", "Cell_1 "), (8, "D-99", None, "q"), (8, "D-99", None, "q"),
    (9, "D-500", "zz", None), (10, "D-501", "ZZ", None), (11, "n/a", "yy", None), (12, None, "yy", None), (None, "D-7", "S1", None),
]


def test_found(spark):
    got = {r.rec_id: r.group_donor for r in x.found(cells(spark, ROWS).repartition(3)).collect()}
    assert got == {1: 7, 2: 7, 3: 7, 4: 7, 7: 7, 9: 500, 10: 500, 11: None, 12: None}


def test_a_donor_with_a_third_of_the_rows(spark):
    rows = [(i, "D-7" if i % 3 == 0 else f"D-{1000 + i}", f"S{i // 2}", str(i)) for i in range(600)]
    g = x.linked_groups(cells(spark, rows)).toPandas()
    big = g.groupby("group").size().max()
    linked = {i for i in range(600) if i % 3 == 0} | {i ^ 1 for i in range(600) if i % 3 == 0}
    assert big == len(linked) and len(g) == 600


def test_splits_keep_groups_and_shares(spark):
    rows = [(i, f"D-{i // 4}", None, None) for i in range(4000)]
    s = x.assign_splits(cells(spark, rows)).toPandas()
    assert len(s) == 4000 and (s.groupby("group").split.nunique() == 1).all()
    share = s.groupby("split").size() / 4000
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["validation"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01
    again = x.assign_splits(cells(spark, rows).repartition(5)).toPandas()
    assert dict(zip(s.rec_id, s.split)) == dict(zip(again.rec_id, again.split))
    with pytest.raises(ValueError):
        x.assign_splits(cells(spark, rows), {"a": 0.5})


def test_empty(spark):
    assert x.found(cells(spark, [])).count() == 0 and x.assign_splits(cells(spark, [])).count() == 0
