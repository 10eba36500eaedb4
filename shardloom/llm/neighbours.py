"""The k most similar vectors of every vector, by additive quantisation.

*Codebooks.* ``books`` codebooks of full-dimensional codewords are fitted one after the
other to the residuals of a bounded sample: the rows of smallest content hash, 32 for each
word of the first book and at most ``sample``; so the sample is the same whatever the
partitioning. A vector's code is found by beam search over the codebooks: the ``beam``
best partial sums are extended by every codeword, not just the nearest. The code stands
for the sum of its codewords; the sum's norm is stored with it.

*Index.* Every vector is indexed. The first codebook's words are the cells, as many as four
times the square root of the number of vectors, fitted in two levels, so that cells next
to each other in number are near each other. A vector lies under the first word of its code.
Neighbouring cells make up a *unit* of work of about ``piece`` rows; a cell that has
more alone is cut into several, so a hot cell never meets in one task. A query goes once to
each unit that holds one of the ``probes`` cells nearest to it: the cells it is near to are a
number that does not depend on the collection, and a cell's rows grow with the square root.

*Search.* In a unit, a visiting query's inner products with all codewords are a table; the
score of every vector of the unit is the sum of ``books`` looked-up entries divided by its
stored norm, at every size. The ``rerank`` best scores of the unit that the query is nearest to, and ``rerank_far`` of
each other one, are compared exactly, in
double precision, with the vector itself, and each query keeps its best ``k`` over all units.

*Copies.* Vectors of one direction (unit components equal to 12 places, as cosines are
compared) are searched once. A class of copies offers its
``k + 1`` smallest ids as neighbours - no more can be among anyone's k nearest, as ties
go to the smaller id - and its result serves all members. Of classes that tie those with
the smallest ids are kept, at every cut.

Odd input: null, empty, all-zero, NaN- or infinity-holding embeddings, embeddings with
null components and null ids take no part; vectors of another length than most are
compared with their own kind only; a vec_id delivered twice with the same vector is one
(with different vectors, each is a vector under that id and itself is still no neighbour).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.hashing import u64
from shardloom.session import materialize

BOOKS = 8
WORDS = 256
SAMPLE = 1_000_000


class Quantiser:
    """Additive quantiser for unit vectors; ``books[0]`` has the cells."""

    def __init__(self, books: list[np.ndarray]):
        self.books = [b.astype(np.float32) for b in books]

    @staticmethod
    def fit(x: np.ndarray, cells: int, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        rest, out = x.astype(np.float32), []
        for b in range(books):
            c = _two_levels(rest, min(cells, len(rest)), rounds, rng) if b == 0 else _means(rest, min(words, len(rest)), rounds, rng)
            out.append(c)
            rest = rest - c[_nearest(rest, c)]
        return Quantiser(out)

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x books) by beam search and the norms of their sums."""
        n, d = x.shape
        sums, codes = np.zeros((n, 1, d), np.float32), np.zeros((n, 1, 0), np.int32)
        for c in self.books:
            w = sums.shape[1]
            rest = (x[:, None, :] - sums).reshape(n * w, d)
            far = ((c * c).sum(1)[None, :] - 2 * rest @ c.T + (rest * rest).sum(1)[:, None]).reshape(n, -1)
            keep = min(beam, far.shape[1])
            best = np.argpartition(far, keep - 1, axis=1)[:, :keep]
            o = np.argsort(np.take_along_axis(far, best, 1), axis=1)
            best = np.take_along_axis(best, o, 1)
            parent, word = best // len(c), (best % len(c)).astype(np.int32)
            r = np.arange(n)[:, None]
            sums = sums[r, parent] + c[word]
            codes = np.concatenate([codes[r, parent], word[:, :, None]], axis=2)
        return codes[:, 0], np.linalg.norm(sums[:, 0], axis=1)

    def best(self, u: np.ndarray, codes: np.ndarray, norms: np.ndarray, n: int) -> np.ndarray:
        """For each row of ``u`` the places, ascending, of the ``n`` codes of highest score, which
        is looked up in the row's table of inner products; ties go to the earlier place."""
        score = np.zeros((len(codes), len(u)), np.float32)
        for m, book in enumerate(self.books):
            used, code = np.unique(codes[:, m], return_inverse=True)
            score += (book[used] @ u.T)[code]
        score /= np.maximum(norms, 1e-9).astype(np.float32)[:, None]
        score = np.ascontiguousarray(score.T)
        n = min(n, len(codes))
        least = np.partition(score, len(codes) - n, axis=1)[:, len(codes) - n, None]
        over = score >= least
        if over.sum() > n * len(u):
            tie = score == least
            over ^= tie
            over |= tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= n - over.sum(1, keepdims=True))
        return (np.flatnonzero(over) % len(codes)).reshape(len(u), n)

    def cells_near(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` cells nearest to each row, nearest first."""
        c = self.books[0]
        far = (c * c).sum(1)[None, :] - 2 * x @ c.T
        p = min(probes, len(c))
        near = np.argpartition(far, p - 1, axis=1)[:, :p]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1), 1)

    def best(self, u: np.ndarray, codes: np.ndarray, norms: np.ndarray, n: int) -> np.ndarray:
        """For each row of ``u`` the places, ascending, of the ``n`` codes of highest score, which
        is looked up in the row's table of inner products; ties go to the earlier place."""
        score = np.zeros((len(codes), len(u)), np.float32)
        for m, book in enumerate(self.books):
            used, code = np.unique(codes[:, m], return_inverse=True)
            score += (book[used] @ u.T)[code]
        score /= np.maximum(norms, 1e-9).astype(np.float32)[:, None]
        score = np.ascontiguousarray(score.T)
        n = min(n, len(codes))
        least = np.partition(score, len(codes) - n, axis=1)[:, len(codes) - n, None]
        over = score >= least
        if over.sum() > n * len(u):
            tie = score == least
            over ^= tie
            over |= tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= n - over.sum(1, keepdims=True))
        return (np.flatnonzero(over) % len(codes)).reshape(len(u), n)

    def cells_near(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` cells nearest to each row, nearest first."""
        c = self.books[0]
        far = (c * c).sum(1)[None, :] - 2 * x @ c.T
        p = min(probes, len(c))
        return np.argpartition(far, p - 1, axis=1)[:, :p]


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` means of the rows; a mean that loses all its rows stays where it was."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        s = np.zeros((k, x.shape[1]), np.float64)
        o = np.argsort(near, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], near[o][1:] != near[o][:-1]]))
        s[near[o][cut]] = np.add.reduceat(x[o].astype(np.float64), cut)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def _two_levels(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """About ``k`` means: sqrt(k) of all rows, then each one's share of ``k`` among its rows."""
    near = _nearest(x, _means(x, max(1, round(k**0.5)), rounds, rng))
    return np.concatenate([_means(own, max(1, min(len(own), round(k * len(own) / len(x)))), rounds, rng) for own in (x[near == g] for g in np.unique(near))])


def _units(cell: np.ndarray, n: np.ndarray, words: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """By cell number: its first unit, and how many units it has (0: no rows). Cells that
    follow each other share a unit of up to about ``piece`` rows."""
    first, parts = np.zeros(words, np.int64), np.zeros(words, np.int64)
    unit, held = 0, 0
    for c, k in sorted(zip(cell.tolist(), n.tolist())):
        if held and held + k > piece:
            unit, held = unit + 1, 0
        first[c], parts[c] = unit, max(1, -(-k // piece))
        unit, held = (unit + parts[c], 0) if k > piece else (unit, held + k)
    return first, parts


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for a in range(0, len(x), 1024):
        out[a : a + 1024] = (x[a : a + 1024] @ c.T - half).argmax(1)
    return out


def _stack(col) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col]) if len(col) else np.zeros((0, 0))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, e (ARRAY<DOUBLE>) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)).where(~bad & F.exists("e", lambda x: x != 0))


def _direction(e: str) -> Column:
    """Equal for vectors that are multiples of each other, by unit components to 12 places."""
    top = F.array_max(F.transform(e, lambda x: F.abs(x.cast("double"))))
    # As a column of an array of one, each step is made once a vector, not once a component.
    scaled = F.transform(F.array(F.struct(F.col(e).alias("e"), top.alias("top"))), lambda s: F.transform(s["e"], lambda x: x.cast("double") / s["top"]))
    size = lambda z: F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(F.transform(scaled, lambda z: F.struct(z.alias("z"), size(z).alias("n"))), lambda s: F.transform(s["z"], lambda x: F.round(x / s["n"], 12)))
    return F.md5(F.concat_ws(",", F.transform(unit[0], lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string")))).cast("binary"))


def neighbours(vectors: DataFrame, k: int = 5, probes: int = 16, rerank: int = 224, rerank_far: int = 80, sample: int = SAMPLE, piece: int = 1024, beam: int = 4, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> DataFrame:
    """vec_id, neighbour, cos, rank (1..k) of every vector that takes part."""
    if k < 1 or probes < 1 or min(rerank, rerank_far) <= k:
        raise ValueError("k >= 1, probes >= 1, rerank and rerank_far > k")
    spark = vectors.sparkSession
    v = materialize(valid(vectors).withColumn("key", _direction("e")), "vectors")
    # A class of copies: its k + 1 smallest ids, found in two steps (a class may be huge).
    ids = v.select("key", "vec_id").distinct().withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    w1, w2 = Window.partitionBy("key", "s").orderBy("vec_id"), Window.partitionBy("key").orderBy("vec_id")
    lead = ids.withColumn("r", F.row_number().over(w1)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(w2)).where(F.col("r") <= k + 1)
    lead = lead.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most k + 1
    each = v.groupBy("key").agg(F.min("e").alias("e"))
    classes = materialize(each.join(lead, "key").withColumn("cid", F.xxhash64("key")).withColumn("dim", F.size("e")), "classes")
    empty = spark.createDataFrame([], "vec_id bigint, neighbour bigint, cos double, rank int")
    dims = [r["dim"] for r in classes.select("dim").distinct().limit(257).collect()]
    if len(dims) > 256:
        raise ValueError("vectors of more than 256 lengths")
    parts = []
    for dim in dims:
        part = classes.where(F.col("dim") == dim)
        parts.append(_search(part, k, probes, (rerank, rerank_far), sample, piece, beam, books, words, seed))
    if not parts:
        return empty
    best = parts[0]
    for p in parts[1:]:
        best = best.unionAll(p)
    # From classes to vectors: a class's candidates (with its own copies) serve every member.
    out = v.select("vec_id", "key").distinct().join(best, "key").select("vec_id", F.explode(F.filter("near", lambda x: x["id"] != F.col("vec_id"))).alias("n"))
    out = out.groupBy("vec_id").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("n.cos")).alias("far"), F.col("n.id").alias("id"))))), 1, k).alias("near"))
    out = out.select("vec_id", F.posexplode("near").alias("p", "n"))
    return out.select("vec_id", F.col("n.id").alias("neighbour"), (-F.col("n.far")).alias("cos"), (F.col("p") + 1).alias("rank"))


def _search(part: DataFrame, k: int, probes: int, rerank: tuple[int, int], sample: int, piece: int, beam: int, books: int, words: int, seed: int) -> DataFrame:
    """key, near (array of (id, cos), at least the class's k + 1 nearest ids) by class."""
    sc = part.sparkSession.sparkContext
    n = part.count()
    cells = min(n, 4 * math.isqrt(n))
    # The rows of smallest hash, exactly so many; a hash below twice their share is looked at.
    size = min(n, sample, 32 * max(cells, words))
    share = min(1.0, 2.0 * size / n + 1e-4)
    few = part.select("e", "key", u64(seed, F.col("key")).alias("h")).where(F.col("h") <= F.lit(min((1 << 63) - 1, int((2 * share - 1) * (1 << 63)))))
    few = few.orderBy("h", "key").limit(size).select("e").toPandas()  # at most ``sample`` rows
    x = _stack(few["e"]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    fitted = Quantiser.fit(x, cells, books, words, seed=seed)
    quantiser = sc.broadcast(fitted)  # books * words * dim floats

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = quantiser.value
        for b in batches:
            for a in range(0, len(b), 1024):
                z = b.iloc[a : a + 1024]
                e = _stack(z["e"])
                u = (e / np.linalg.norm(e, axis=1)[:, None]).astype(np.float32)
                codes, norms = q.encode(u, beam)
                near = q.cells_near(u, probes)
                yield pd.DataFrame({"cid": z["cid"].to_numpy(), "codes": list(codes), "norm": norms.astype(np.float64), "least": z["least"].to_numpy(), "near": list(near.astype(np.int32)), "e": z["e"].to_numpy()})

    coded = part.select("cid", "e", F.col("ids")[0].alias("least")).mapInPandas(encode, f"cid bigint, codes array<int>, norm double, least bigint, near array<int>, e {dict(part.dtypes)['e']}")
    coded = materialize(coded, "codes")
    # Cells to units; the cells' sizes are a row a cell, the square root of the vectors.
    count = coded.groupBy(F.col("codes")[0].alias("cell")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    units = sc.broadcast(_units(count["cell"].to_numpy(np.int64), count["n"].to_numpy(np.int64), len(fitted.books[0]), piece))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A vector's own row in its unit, and a row without code for each unit that it asks."""
        first, parts = units.value
        for b in batches:
            cell, cid = np.array([c[0] for c in b["codes"]], np.int64), b["cid"].to_numpy()
            home = first[cell] + (cid.view(np.uint64) % parts[cell].astype(np.uint64)).astype(np.int64)
            yield pd.DataFrame({"unit": home, "asks": 0, "cid": cid, "least": b["least"], "codes": b["codes"], "norm": b["norm"], "e": b["e"]})
            near = np.stack(b["near"].to_list()).astype(np.int64)
            place = np.tile(np.arange(near.shape[1]), len(b))
            who, near = np.repeat(np.arange(len(b)), near.shape[1]), near.ravel()
            full = parts[near] > 0
            who, near, place = who[full], near[full], place[full]
            n = parts[near]
            to = np.repeat(first[near], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, place = np.repeat(who, n), np.repeat(place, n)
            o = np.lexsort((place, to, who))
            o = o[np.concatenate([[True], (who[o][1:] != who[o][:-1]) | (to[o][1:] != to[o][:-1])])] if len(o) else o
            # A query's first unit is that of its nearest cell that has rows.
            least = np.full(len(b), near.size, np.int64)
            np.minimum.at(least, who, place)
            pair = np.stack([who[o], to[o]], 1)
            yield pd.DataFrame({"unit": pair[:, 1], "asks": np.where(place[o] == least[who[o]], 1, 2), "cid": cid[pair[:, 0]], "least": 0, "codes": None, "norm": 0.0, "e": b["e"].to_numpy()[pair[:, 0]]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by (unit, asks): a unit's vectors, then its visitors."""
        q = quantiser.value
        here: int | None = None
        home_rows: list[pd.DataFrame] = []
        ready: tuple | None = None

        def prepare():
            h = pd.concat(home_rows, ignore_index=True).sort_values("least", kind="stable")
            e = _stack(h["e"])
            return h["cid"].to_numpy(), h["least"].to_numpy(), np.stack(h["codes"].to_list()), h["norm"].to_numpy(), e / np.linalg.norm(e, axis=1)[:, None]

        for b in batches:
            unit, asks = b["unit"].to_numpy(), b["asks"].to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (asks[1:] != asks[:-1])]))
            for a, z in zip(cut, np.append(cut[1:], len(b))):
                if unit[a] != here:
                    here, home_rows, ready = unit[a], [], None
                if not asks[a]:
                    home_rows.append(b.iloc[a:z])
                    continue
                ready = ready or prepare()
                cid, least, codes, norm, own = ready
                for s in range(a, z, 256):
                    g = b.iloc[s : min(s + 256, z)]
                    e = _stack(g["e"])
                    u = e / np.linalg.norm(e, axis=1)[:, None]
                    best = q.best(u.astype(np.float32), codes, norm, rerank[asks[a] - 1])
                    cos = np.round(np.einsum("qd,qtd->qt", u, own[best]), 12)
                    keep = min(k + 1, best.shape[1])  # itself and k others
                    lead = np.argsort(-cos, axis=1, kind="stable")[:, :keep]
                    top = np.take_along_axis(best, lead, 1)
                    yield pd.DataFrame({"cid": np.repeat(g["cid"].to_numpy(), keep), "other": cid[top].ravel(), "least": least[top].ravel(), "cos": np.take_along_axis(cos, lead, 1).ravel()})

    kind = dict(part.dtypes)["e"]
    rows = coded.mapInPandas(place, f"unit bigint, asks int, cid bigint, least bigint, codes array<int>, norm double, e {kind}")
    rows = rows.repartition("unit").sortWithinPartitions("unit", "asks")
    hits = rows.mapInPandas(search, "cid bigint, other bigint, least bigint, cos double")
    w = Window.partitionBy("cid").orderBy(F.col("cos").desc(), "least", "other")  # k + 1 rows for each unit a class asks
    hits = hits.where("cid <> other").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    hits = materialize(hits, "hits")
    ids = part.select(F.col("cid").alias("other"), F.explode("ids").alias("id"))
    near = hits.join(ids, "other").select("cid", "id", "cos").unionAll(part.select("cid", F.explode("ids").alias("id"), F.lit(1.0).alias("cos")))
    near = near.groupBy("cid").agg(F.collect_list(F.struct("id", "cos")).alias("near"))  # at most (k + 1)^2
    return part.select("key", "cid").join(near, "cid").select("key", "near")


def found(vectors: DataFrame, k: int = 5) -> DataFrame:
    """p6_found(vec_a, vec_b), vec_a < vec_b: one is among the k nearest of the other."""
    n = neighbours(vectors, k)
    return n.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()
