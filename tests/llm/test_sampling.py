import pytest

from shardloom.llm import mixture, quota_sample as q

CELLS = "rec_id bigint, store_id bigint, label string, key string, h int, rank string"
PLANS = "plan_id bigint, store_id bigint, split_name string, sample_size bigint, label string, share_pm int, min_rows int, seats string"


def cells(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CELLS)


def plans(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], PLANS)


ROWS = [(i, 1, "arc neuron") for i in range(60)] + [(100 + i, 1, " ARC_-Neuron ") for i in range(40)] + [(200 + i, 1, "late") for i in range(5)] + [(300, 1, ""), (301, 1, None), (302, 1, " - "), (0, 1, "arc neuron"), (None, 1, "late"), (7, 2, "late")]


def test_found(spark):
    p = plans(spark, [(1, 1, "train", 100, "arc neuron", 950, 0), (1, 1, "train", 100, "late", 50, 0), (2, 1, "test", 101, "late", 50, 0), (2, 1, "test", 101, "arc neuron", 950, 3), (3, 1, "t", 5, "late", 0, 6), (3, 1, "t", 5, "none such", 1000, 0)])
    assert {tuple(r) for r in q.found(cells(spark, ROWS), p).collect()} == {(2, "test", "late"), (3, "t", "late"), (3, "t", "none such")}


def divisor(pool, share, floor, size):
    got = {k: min(pool[k], floor[k]) for k in pool}
    while sum(got.values()) < size:
        left = [((got[k] + 0.5) / share[k], k) for k in pool if got[k] < pool[k] and share[k]]
        if not left:
            break
        got[min(left)[1]] += 1
    return got


@pytest.mark.parametrize("size,share,floor", [(30, (600, 400), (0, 0)), (30, (990, 10), (0, 3)), (104, (500, 500), (0, 0)), (500, (900, 100), (0, 0)), (10, (1000, 0), (0, 2))])
def test_seats(spark, size, share, floor):
    p = plans(spark, [(1, 1, "t", size, "arc neuron", share[0], floor[0]), (1, 1, "t", size, "late", share[1], floor[1])])
    s = q.sample(cells(spark, ROWS), p).toPandas()
    want = divisor({"arc neuron": 100, "late": 5}, dict(zip(("arc neuron", "late"), share)), dict(zip(("arc neuron", "late"), floor)), size)
    assert s.groupby("label").size().to_dict() == {k: n for k, n in want.items() if n}
    assert not s.rec_id.duplicated().any() and set(s.rec_id) <= {r[0] for r in ROWS}


def test_draws_differ_and_repeat(spark):
    p = plans(spark, [(k, 1, "t", 20, "arc neuron", 1000, 0) for k in range(8)])
    a, b = (q.sample(cells(spark, ROWS).repartition(n), p).toPandas() for n in (1, 5))
    key = lambda d: {k: frozenset(v) for k, v in d.groupby("plan_id").rec_id}
    assert key(a) == key(b) and len(set(key(a).values())) > 4


def test_empty_sample(spark):
    p = plans(spark, [(1, 1, "t", 20, "late", 1000, 0)])
    assert q.sample(cells(spark, []), p).count() == 0 and q.found(cells(spark, []), p).count() == 1
    assert q.sample(cells(spark, ROWS), plans(spark, [])).count() == 0


DOCS = "doc_id bigint, text string, source string, mix_id string, copy_no int, key string"
MIX = "mix_id bigint, source string, weight_bp int, max_repeats int, budget_pct int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "k") for r in rows], DOCS)


def test_mixture(spark):
    rows = [(i, "x" * 100, "big" if i % 2 else " BIG ") for i in range(900)] + [(1000 + i, "é" * 50, "small") for i in range(100)] + [(2000, None, "small"), (2001, "", "small"), (2002, "zz", None)]
    t = spark.createDataFrame([(1, "big", 5000, 2, 100), (1, "small", 4000, 3, 100), (1, "absent", 1000, 9, 100), (2, "big", 9000, 1, 50), (2, "small", 1000, 1, 50)], MIX)
    d = docs(spark, rows)
    total = 900 * 100 + 100 * 100 + 2
    assert {tuple(r) for r in mixture.found(d, t).collect()} == {(1, "small"), (1, "absent")}
    rates = {(r.mix_id, r.source): r.rate for r in mixture.mixture_rates(d, t).collect()}
    assert rates[1, "small"] == 3 and rates[1, "absent"] == 0 and abs(rates[2, "big"] - 0.45 * total / 90000) < 1e-9
    m = mixture.mix(d, t).toPandas()
    assert "mix_id_doc" in m and "copy_no_doc" in m
    by = m.groupby(["mix_id", m.source.str.strip().str.lower()]).size()
    assert by[1, "small"] == 303 and abs(by[2, "big"] - 405) < 60 and m[(m.mix_id == 2)].copy_no.max() == 0
    again = mixture.mix(d.repartition(7), t).toPandas()
    assert sorted(zip(m.mix_id, m.doc_id, m.copy_no)) == sorted(zip(again.mix_id, again.doc_id, again.copy_no))
    r = mixture.mixture_report(d, t).toPandas()
    assert abs(r[r.mix_id == 2].share.sum() - 1) < 1e-9 and r[r.source == "absent"].reached.iloc[0] == 0


def test_target_met_exactly_is_no_case(spark):
    d = docs(spark, [(1, "a" * 100, "s"), (2, "b" * 100, "t")])
    t = spark.createDataFrame([(1, "s", 5000, 1, 100), (1, "t", 5000, 1, 101)], MIX)
    assert [tuple(r) for r in mixture.found(d, t).collect()] == [(1, "t")]
    assert mixture.found(docs(spark, []), t).count() == 0 and mixture.mix(docs(spark, []), t).count() == 0
