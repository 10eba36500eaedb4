import random

import pytest

from shardloom.llm import shared_spans as x

SCHEMA = "doc_id bigint, text string, h string, place string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)  # clashing extra columns


def brute(rows, span):
    texts = {}
    for d, t in rows:
        if d is not None and t is not None:
            texts[d] = t
    where = {}
    for d, t in texts.items():
        for i in range(len(t) - span + 1):
            where.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in texts.items():
        cov = [False] * len(t)
        for i in range(len(t) - span + 1):
            if len(where[t[i : i + span]]) > 1:
                cov[i : i + span] = [True] * span
        if any(cov):
            out[d] = sum(cov)
    return out


def noise(r, n):
    return "".join(r.choice("abcdefghij é\n😀") for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [noise(r, r.randint(30, 260)) for _ in range(8)] + ["ab" * 60, "z" * 130]
    rows = [(i, "".join(r.choice([r.choice(pool), noise(r, r.randint(0, 60)), r.choice(pool)[r.randint(0, 20) :]]) for _ in range(r.randint(0, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, rows[0][1] * 2), (104, "z" * 500), (None, pool[0])]
    got = {r.doc_id: r.shared_chars for r in x.shared_chars(docs(spark, rows).repartition(3), span=50, gram=12).collect()}
    assert got == brute(rows, 50)


def test_boundary_against_different_partners(spark):
    r = random.Random(5)
    head, a, b = noise(r, 150), noise(r, 60), noise(r, 300)
    rows = [(1, head + a + b), (2, noise(r, 80) + head + a + noise(r, 90)), (3, head[40:] + noise(r, 200)), (4, noise(r, 77) + a[5:] + b)]
    assert {r.doc_id: r.shared_chars for r in x.shared_chars(docs(spark, rows)).collect()} == brute(rows, 200)


def test_many_reaches_of_one_anchor_take_the_other_way(spark):
    r = random.Random(1)
    head = noise(r, 100)
    rows = [(i, noise(r, 40) + head + noise(r, 40) if i % 3 else head[:60] + noise(r, 50)) for i in range(60)]
    want = brute(rows, 50)
    d = docs(spark, rows)
    for block in (2, 10_000):
        f = x.shared_factors(d, 50, 12, block=block).collect()
        cov = {}
        for z in f:
            cov.setdefault(z.doc_id, set()).update(range(z.lo, z.hi))
        assert {k: len(v) for k, v in cov.items()} == want


def test_long_text_in_segments(spark, monkeypatch):
    r = random.Random(2)
    part = noise(r, 700)
    rows = [(1, noise(r, 9000) + part + noise(r, 5000)), (2, part[100:650]), (3, noise(r, 3000))]
    monkeypatch.setattr(x, "SEGMENT", 2048)
    f = list(x._find(iter([__import__("pandas").DataFrame(rows, columns=["doc_id", "text"])]), 200, 32))
    monkeypatch.setattr(x, "SEGMENT", 1 << 20)
    g = list(x._find(iter([__import__("pandas").DataFrame(rows, columns=["doc_id", "text"])]), 200, 32))
    cat = lambda z: sorted(map(tuple, __import__("pandas").concat(z).itertuples(index=False)))
    assert cat(f) == cat(g)


def test_report_repeats_and_empty(spark):
    t = "ab c" * 80
    d = docs(spark, [(1, t), (1, t), (2, "q" + t), (3, "short"), (4, "")])
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in x.report(d).collect()}
    assert got == {1: (320, 320), 2: (321, 320), 3: (5, 0), 4: (0, 0)}
    assert x.shared_chars(docs(spark, [(1, t), (1, t)])).count() == 0  # one document delivered twice
    assert x.shared_chars(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        x.shared_factors(d, 10, 32)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", (2, 4096))
def test_factors_stand_in_their_sources(spark, seed, block):
    """Factors are verbatim, of other documents, do not overlap, belong to matches of at least the
    span, and lead as far as any match from their source does."""
    r = random.Random(100 + seed)
    pool = [noise(r, r.randint(60, 260)) for _ in range(6)] + ["ab" * 60]
    rows = [(i, "".join(r.choice([r.choice(pool), noise(r, r.randint(0, 60)), r.choice(pool)[r.randint(0, 20) :]]) for _ in range(r.randint(0, 7)))) for i in range(30)]
    texts = dict(rows)
    f = x.parse(docs(spark, rows).repartition(3), 50, 12, block).toPandas().sort_values(["doc_id", "pos"])
    assert f.groupby("doc_id").length.sum().to_dict() == brute(rows, 50)
    for (d, pos, n, src, at, began), then in zip(f.itertuples(index=False), [*f.itertuples(index=False)][1:] + [None]):
        assert src != d and n > 0 and texts[d][pos : pos + n] == texts[src][at : at + n]
        assert began <= pos and pos + n - began >= 50 and texts[d][began : pos + n] == texts[src][at - (pos - began) : at + n]
        assert then is None or then[0] != d or then[1] >= pos + n


def test_a_whole_copy_is_one_factor(spark):
    r = random.Random(9)
    t = noise(r, 5000)
    f = x.parse(docs(spark, [(1, t), (2, "intro" + t), (3, noise(r, 900))])).toPandas().set_index("doc_id")
    assert f.loc[1].tolist() == [0, 5000, 2, 5, 0] and f.loc[2].tolist() == [5, 5000, 1, 0, 5] and len(f) == 2
