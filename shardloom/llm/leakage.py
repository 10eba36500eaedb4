"""Evaluation texts leaking into training text: size-partitioned MinHash containment.

What must be found is a *passage*: ``window`` consecutive words of a test item, or the
whole item if it is shorter. A passage inside a document is a containment of 1: all its
shingles (five words, or as many as a shorter passage has) are among the document's.
So a passage's MinHash - its shingle of smallest hash - must itself be a shingle of the
document, and so must the next smallest, and so on: a sketch of the ``r`` smallest
shingles of a passage gives candidates without a single miss, whatever the size of the
document. Passages that slide over an item share most of their sketches, so the index
holds a tenth of its shingles.

Documents are partitioned by size (powers of two of their words), as a long document
holds a rare shingle by chance more often: ``r`` grows with the size class, which keeps
the candidates of long documents as few as those of short ones. Candidates are then
verified by exact containment: the document's words are compared with the passage's
around the place of its MinHash shingle.

The index of the test items is broadcast only while their texts are within ``max_index``
bytes (summed before; a text has fewer passages than bytes). Beyond that (``probe_by_join``, with the
same result) it stays a table, and of a document only those windows are sent to it whose own MinHash
shingle is among the passages' by a bitmap of bounded size; a window and a passage
then meet by the digest of all of their words. So neither texts nor shingles are shuffled, opening phrases that
many items share are one passage, and a key is as hot as the result asks for.

Words are maximal runs of ASCII letters and digits, compared ignoring (ASCII) case; all
between them is ignored. Null and empty texts and texts without words hold nothing and
are found nowhere; repeated rows add nothing; whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm._hash import BASE as _B
from shardloom.llm._hash import mix as _mix
from shardloom.llm._hash import powers as _pow
from shardloom.llm._hash import sliding_min
from shardloom.session import materialize

WINDOW = 25
SHINGLE = 5
MAX_INDEX = 2_000_000
CHUNK = 1 << 20

_U = np.uint64
_FOLD = np.zeros(256, np.uint8)  # 0: between words
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32


class Words:
    """Words of byte strings as 64-bit hashes."""

    def __init__(self):
        self.n = 0

    def _room(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.pow, self.inv = _pow(_B, self.n + 1), _pow(pow(_B, -1, 1 << 64), self.n + 1)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of every word."""
        b = _FOLD[np.frombuffer(data, np.uint8)]
        self._room(len(b))
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = b > 0
        lo = np.flatnonzero(inside[1:] & ~inside[:-1])
        hi = np.flatnonzero(~inside[1:] & inside[:-1])
        s = np.empty(len(b) + 1, _U)
        s[0] = 0
        np.cumsum(b.astype(_U) * self.pow[: len(b)], out=s[1:])
        return _mix((s[hi] - s[lo]) * self.inv[lo] + (hi - lo).astype(_U)), lo


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    if len(words) < k:
        return np.zeros(0, _U)
    h = np.zeros(len(words) - k + 1, _U)
    for i in range(k):
        h = h * _U(_B) + words[i : len(words) - k + 1 + i]
    return _mix(h)


def passages(items: list[tuple[int, str]], window: int = WINDOW, shingle: int = SHINGLE, depth: int = 4) -> pd.DataFrame:
    """The index rows of test items: one for each passage.

    item_id, k (words in a shingle), sketch (hashes of the ``depth`` smallest shingles,
    smallest first), at (word of the smallest shingle in the passage), words (hashes).
    """
    w = Words()
    out = []
    for item, text in items:
        ws, _ = w.of((text or "").encode("utf-8", "surrogatepass"))
        if not len(ws):
            continue
        n = min(window, len(ws))
        k = min(shingle, n)
        sh = shingles(ws, k)
        m = n - k + 1
        for a in range(len(ws) - n + 1):
            part = sh[a : a + m]
            o = np.argsort(part, kind="stable")
            out.append((item, k, part[o[np.minimum(np.arange(depth), m - 1)]].view(np.int64).tolist(), int(o[0]), ws[a : a + n].view(np.int64).tolist()))
    return pd.DataFrame(out, columns=["item_id", "k", "sketch", "at", "words"])


def sketch_depth(n_words: int, depth: int) -> int:
    """How many sketch entries a document of this size class must hold: one up to 63
    words, one more for each power of 16 beyond."""
    return min(depth, 1 + max(0, int(n_words).bit_length() - 6) // 4)


class Index:
    """Passages under their MinHash shingle."""

    def __init__(self, rows: pd.DataFrame):
        self.by_k = {}
        for k, g in rows.groupby("k"):
            sk = np.array(g["sketch"].tolist(), np.int64).view(_U)
            o = np.argsort(sk[:, 0], kind="stable")
            words = [np.array(g["words"].iloc[i], np.int64).view(_U) for i in o]
            self.by_k[int(k)] = (sk[o], g["at"].to_numpy()[o], words, g["item_id"].to_numpy()[o])

    def probe(self, ws: np.ndarray) -> set[int]:
        """The items of which the document (its word hashes) holds a passage."""
        return self._probe(ws, {k: shingles(ws, k) for k in self.by_k})

    def _probe(self, ws: np.ndarray, sh: dict[int, np.ndarray], only: dict[int, np.ndarray] | None = None) -> set[int]:
        hit: set[int] = set()
        for k, (sk, at, words, item) in self.by_k.items():
            s = sh[k]
            if not len(s):
                continue
            places = np.flatnonzero(np.isin(s, sk[:, 0])) if only is None else only[k]
            if not len(places):
                continue
            mine = None
            deep = sketch_depth(len(ws), sk.shape[1])
            first = np.searchsorted(sk[:, 0], s[places], "left")
            last = np.searchsorted(sk[:, 0], s[places], "right")
            for p, a, b in zip(places, first, last):
                for j in range(a, b):
                    if item[j] in hit:
                        continue
                    if deep > 1:
                        mine = set(s.tolist()) if mine is None else mine
                        if not all(int(x) in mine for x in sk[j, 1:deep]):
                            continue
                    lo, w = p - at[j], words[j]
                    if lo >= 0 and lo + len(w) <= len(ws) and np.array_equal(ws[lo : lo + len(w)], w):
                        hit.add(item[j])
        return hit


def _scan(batches: Iterator[pd.DataFrame], index: Index) -> Iterator[pd.DataFrame]:
    w = Words()
    keys = {k: np.unique(v[0][:, 0]) for k, v in index.by_k.items()}
    # A cheap filter before the search: one bit for each of 2^16 hash prefixes.
    bits = {}
    for k, v in keys.items():
        t = np.zeros(1 << 16, bool)
        t[(v >> _U(48)).astype(np.int64)] = True
        bits[k] = t

    def flush(docs: list, texts: list) -> pd.DataFrame:
        sizes = np.array([len(t) for t in texts]) + 1
        ends = np.cumsum(sizes)
        ws, lo = w.of(b"\n".join(texts) + b"\n")
        doc = np.searchsorted(ends, lo, side="right")
        edge = np.searchsorted(doc, np.arange(len(docs) + 1))
        busy: dict[int, dict[int, np.ndarray]] = {}
        for k in keys:
            s = shingles(ws, k)
            if not len(s):
                continue
            p = np.flatnonzero(bits[k][(s >> _U(48)).astype(np.int64)])
            f = np.searchsorted(keys[k], s[p])
            p = p[(f < len(keys[k])) & (keys[k][np.minimum(f, len(keys[k]) - 1)] == s[p])]
            p = p[doc[p] == doc[p + k - 1]]
            for d in np.unique(doc[p]):
                busy.setdefault(int(d), {})[k] = p[doc[p] == d] - edge[d]
        out = []
        for d, by in busy.items():
            own = ws[edge[d] : edge[d + 1]]
            only = {k: by.get(k, np.zeros(0, np.int64)) for k in index.by_k}
            out += [(docs[d], i) for i in index._probe(own, {k: shingles(own, k) for k in index.by_k}, only)]
        return pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

    docs, texts, size = [], [], 0
    for b in batches:
        for d, t in zip(b["doc_id"].to_numpy(), b["text"]):
            t = t.encode("utf-8", "surrogatepass")
            docs.append(d), texts.append(t)
            size += len(t)
            if size > CHUNK:
                yield flush(docs, texts)
                docs, texts, size = [], [], 0
    if docs:
        yield flush(docs, texts)


def windows(ws: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of ``n`` words: its MinHash shingle of ``k`` words, and two digests of all its words."""
    if len(ws) < n:
        return (np.zeros(0, _U),) * 3
    return sliding_min(shingles(ws, k), n - k + 1), shingles(ws, n), shingles(_mix(ws + _U(1)), n)


#: Bits of the filter of MinHash shingles, at most.
FILTER_BITS = 1 << 26


def _filter_bits(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes ``key``, put together by 64-bit words before it comes to the driver."""
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(key & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out


def probe_by_join(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The same as the broadcast probe for test items of any number and size."""
    sc = documents.sparkSession.sparkContext

    def passages_of(batches):
        w = Words()
        for b in batches:
            out = []
            for item, t in zip(b["item_id"].tolist(), b["text"]):
                ws, _ = w.of(t.encode("utf-8", "surrogatepass"))
                n = min(window, len(ws))
                if n:
                    out.append(pd.DataFrame(dict(zip(("key", "a", "b"), (x.view(np.int64) for x in windows(ws, n, min(shingle, n)))))).drop_duplicates().assign(n=n, item_id=item))
            if out:
                yield pd.concat(out)[["n", "key", "a", "b", "item_id"]]

    index = materialize(items.mapInPandas(passages_of, "n int, key bigint, a bigint, b bigint, item_id bigint"), "passages")
    sizes = [r["n"] for r in index.select("n").distinct().collect()]  # at most ``window`` values
    bits = FILTER_BITS
    rows = index.count()
    while bits > 1 << 16 and bits > 32 * rows:
        bits >>= 1
    shared = sc.broadcast(_filter_bits(index.select("key"), bits))

    def emit(batches):
        w, has = Words(), shared.value
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"].tolist(), b["text"]):
                ws, _ = w.of(t.encode("utf-8", "surrogatepass"))
                for n in sizes:
                    key, one, two = windows(ws, n, min(shingle, n))
                    at = key & _U(bits - 1)
                    hit = (has[(at >> _U(6)).astype(np.int64)].view(_U) >> (key & _U(63))) & _U(1) == 1
                    if hit.any():
                        out.append(pd.DataFrame({"n": n, "a": one[hit].view(np.int64), "b": two[hit].view(np.int64), "doc_id": d}).drop_duplicates())
            if out:
                yield pd.concat(out)

    have = documents.mapInPandas(emit, "n int, a bigint, b bigint, doc_id bigint")
    return have.join(index.select("n", "a", "b", "item_id"), ["n", "a", "b"]).select("doc_id", "item_id").distinct()


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, max_index: int = MAX_INDEX, depth: int = 4) -> DataFrame:
    """p7_found(doc_id, item_id): the document contains a passage of the item."""
    if not 1 <= shingle <= window:
        raise ValueError("1 <= shingle <= window")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")

    def index_rows(batches):
        for b in batches:
            for i in range(0, len(b), 64):
                z = b.iloc[i : i + 64]
                yield passages(list(zip(z["item_id"].tolist(), z["text"])), window, shingle, depth)

    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > max_index:
        return probe_by_join(docs, own, window, shingle)
    index = own.mapInPandas(index_rows, "item_id bigint, k int, sketch array<bigint>, at int, words array<bigint>")
    sc = documents.sparkSession.sparkContext
    rows = index.toPandas()
    if rows.empty:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    shared = sc.broadcast(rows)

    def scan(batches):
        yield from _scan(batches, Index(shared.value))

    return docs.mapInPandas(scan, "doc_id bigint, item_id bigint").distinct()


def item_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, n_docs: every test item that leaked and into how many documents."""
    n = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id", "suite").distinct().join(n, "item_id")


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that hold a passage; all columns are kept."""
    return documents.join(leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
