import random
import re

import pytest

from shardloom.llm import leakage as x

WORD = re.compile("[A-Za-z0-9]+")


def brute(docs, items, window):
    out = set()
    w = lambda t: [z.lower() for z in WORD.findall(t or "")]
    for d, t in docs:
        have = " " + " ".join(w(t)) + " "
        for i, q in items:
            q = w(q)
            n = min(window, len(q))
            if d is not None and n and any(" " + " ".join(q[a : a + n]) + " " in have for a in range(len(q) - n + 1)):
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def data():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([1, 2, 4, 5, 9, 24, 25, 26, 60, 90])] + [(20, None), (21, ""), (22, "!?"), (23, " ".join(["w1"] * 30))]
    docs = []
    for i in range(60):
        words = say(r.randint(0, 200))
        for _, t in r.sample(items[:10], 2):
            q = t.split()
            a = r.randint(0, len(q) - 1)
            words[r.randint(0, len(words)) :][:0] = []
            at = r.randint(0, len(words))
            words[at:at] = q[a : a + r.choice([23, 24, 25, 26, 90])]
        docs.append((i, r.choice([" ", "\n, ", "-É-"]).join(z.upper() if r.random() < 0.3 else z for z in words)))
    docs += [(100, None), (101, ""), (102, "W1 " * 40), (102, "W1 " * 40), (None, "w1")]
    return docs, items


def frames(spark, data):
    d = spark.createDataFrame([(a, b, "c", 1) for a, b in data[0]], "doc_id bigint, text string, item_id string, k int")
    return d, spark.createDataFrame([(a, b, "s", "t") for a, b in data[1]], "item_id bigint, text string, suite string, doc_id string")


@pytest.mark.parametrize("way", [x.MAX_INDEX, 1])
def test_equals_brute_force(spark, data, way):
    d, i = frames(spark, data)
    got = {(r.doc_id, r.item_id) for r in x.leaks(d.repartition(3), i, max_index=way).collect()}
    assert got == brute(*data, 25) and len(got) > 50


def test_depth_grows_with_the_document():
    assert [x.sketch_depth(n, 4) for n in (10, 63, 64, 1000, 20_000, 10**7)] == [1, 1, 1, 2, 3, 4]


def test_long_documents_need_all_of_the_sketch(spark):
    r = random.Random(8)
    q = [f"q{i}" for i in range(25)]
    long = [f"v{r.randint(0, 5000)}" for _ in range(30_000)]
    near = long[:9000] + q[:24] + long[9000:]
    hit = long[:5000] + q + long[5000:]
    d = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(hit))], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(q))], "item_id bigint, text string")
    assert [tuple(r) for r in x.leaks(d, i).collect()] == [(2, 7)]


def test_reports_and_empty(spark, data):
    d, i = frames(spark, data)
    bad = {a for a, _ in brute(*data, 25)}
    assert x.clean(d, i).where("doc_id IS NOT NULL").count() == sum(a is not None and a not in bad for a, _ in data[0])
    assert {r.item_id for r in x.item_report(d, i).collect()} == {b for _, b in brute(*data, 25)}
    assert x.leaks(d.limit(0), i).count() == 0 and x.leaks(d, i.limit(0)).count() == 0
    with pytest.raises(ValueError):
        x.leaks(d, i, window=3)
