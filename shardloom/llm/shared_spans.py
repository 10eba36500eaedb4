"""Long exact spans shared between records, by relative Lempel-Ziv parsing.

The reference is what all documents hold, each piece of it once. It is cut into blocks, and
a document is factored against the blocks that can hold a factor of ``span`` characters or more;
which those are is decided without loss: a span of at least ``span`` characters that stands in two documents contains, in both
at the same place, an *anchor*: a ``gram``-character piece whose hash is the smallest of
some full window of ``span`` characters (winnowing; its choice depends on the window's
text alone). A block is all that stands around the occurrences of one anchor: the text up to
``span - gram`` characters to both sides of it (its *reach*), all that a window of
``span`` characters around it can touch. So a match of that length lies in
the blocks of the anchors inside it, and what lies further out belongs to the next anchor.

1. *Index.* A block's distinct reaches, by hash, each with its first and its last document and its place
   there (of copies, however many, two are enough to name another document's).
2. *Factors.* A reach that the block has from another document is copied whole, as one factor
   (place, length, source, place in the source). A reach that no other document has, in a block of several, holds a factor's
   beginning or end: only those are cut out as text, one per distinct reach, and factored
   against an index of all ``span``-character pieces of the block, each factor being the longest run
   of pieces from one source. Blocks are bounded; an anchor with more reaches than ``block`` has
   its pieces indexed by a distributed aggregation instead, with the same result.
3. *Parse.* Along a document, factors from one source at one distance are one match, as long as they
   touch. The text is parsed from left to right: at each place the match that leads furthest is
   taken, at its end the next one, which is looked for across the boundary, among all matches that
   began before it; where no match leads on, characters are literals up to the next match.
   The factors so chosen cover what is shared.

No pairs of documents are made at any point, whole texts are parsed in overlapping
segments so that memory does not grow with a text's length, and a span is shared only if
it stands in another doc_id (repeats within one document do not count).

Defined results: null, empty and shorter texts share nothing; rows repeated with the
same doc_id and text are one document; if one doc_id comes with different texts each is
parsed on its own under that doc_id (lengths are those of the union per text).
Characters are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm._hash import BASE as _B
from shardloom.llm._hash import mix as _mix
from shardloom.llm._hash import powers as _powers
from shardloom.llm._hash import sliding_min as _sliding_min
from shardloom.session import materialize

SPAN = 200
GRAM = 32
SEGMENT = 1 << 20
_U = np.uint64


class Hasher:
    """Hashes of any substring of a code point array, each in constant time."""

    def __init__(self, n: int):
        self.pow, self.inv = _powers(_B, n + 1), _powers(pow(_B, -1, 1 << 64), n + 1)

    def prefix(self, points: np.ndarray) -> np.ndarray:
        c = points.astype(_U)
        c *= _U(0xD6E8FEB86659FD93)
        c ^= c >> _U(32)
        c *= self.pow[: len(c)]
        s = np.empty(len(c) + 1, _U)
        s[0] = 0
        np.cumsum(c, out=s[1:])
        return s

    def of(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (prefix[hi] - prefix[lo]) * self.inv[lo]


def _anchors(points: np.ndarray, ends: np.ndarray, hasher: Hasher, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors in a concatenation of texts that end at ``ends``, the
    hashes of their grams, and the prefix sums."""
    n = len(points)
    prefix = hasher.prefix(points)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, _U), prefix
    g = prefix[gram:] - prefix[:-gram]
    g *= hasher.inv[: len(g)]
    g = _mix(g)
    bits = _U(21)
    packed = (g >> bits << bits) | np.arange(len(g), dtype=_U)  # ties go to the left
    m = _sliding_min(packed, span - gram + 1)
    ok = np.ones(len(m), bool)
    for e in ends[:-1]:  # windows that run over a text's end
        ok[max(0, e - span + 1) : e] = False
    m = m[ok[: len(m)]]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, _U), prefix
    m = m[np.concatenate([[True], m[1:] != m[:-1]])]
    at = np.unique((m & _U((1 << 21) - 1)).astype(np.int64))
    return at, g[at], prefix


def _find(batches: Iterator[pd.DataFrame], span: int, gram: int) -> Iterator[pd.DataFrame]:
    """doc_id, text -> rows h, reach, doc_id, place (position, characters left and right of
    the gram within the reach, packed)."""
    side = span - gram
    margin = 2 * span
    hasher = Hasher(SEGMENT + 2 * margin)

    def flush(parts: list[tuple]) -> pd.DataFrame:
        # parts: (doc, points, offset of the segment in its text, own from, own to)
        ends = np.cumsum([len(p[1]) for p in parts])
        starts = ends - [len(p[1]) for p in parts]
        pts = np.concatenate([p[1] for p in parts])
        at, h, prefix = _anchors(pts, ends, hasher, span, gram)
        i = np.searchsorted(ends, at, side="right")
        pos = at - starts[i]
        own = (pos >= np.array([p[3] for p in parts])[i]) & (pos < np.array([p[4] for p in parts])[i])
        at, h, i, pos = at[own], h[own], i[own], pos[own]
        lo, hi = np.maximum(at - side, starts[i]), np.minimum(at + gram + side, ends[i])
        left, right = (at - lo).astype(np.int64), (hi - at - gram).astype(np.int64)
        reach = _mix(hasher.of(prefix, lo, hi) + (left * 1024 + right).astype(_U) * _U(0x9FB21C651E98DF25))
        place = (pos + np.array([p[2] for p in parts], np.int64)[i]) << 20 | left << 10 | right
        docs = np.array([p[0] for p in parts], np.int64)
        return pd.DataFrame({"h": h.view(np.int64), "reach": reach.view(np.int64), "doc_id": docs[i], "place": place})

    parts: list[tuple] = []
    size = 0
    for b in batches:
        for doc, text in zip(b["doc_id"].to_numpy(), b["text"]):
            pts = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            n = len(pts)
            if n < span:
                continue
            if n <= SEGMENT:
                pieces = [(doc, pts, 0, 0, n)]
            else:
                pieces = []
                for a in range(0, n, SEGMENT):
                    lo, hi = max(0, a - margin), min(n, a + SEGMENT + margin)
                    pieces.append((doc, pts[lo:hi], lo, a - lo, min(a + SEGMENT, n) - lo))
            for p in pieces:
                if parts and size + len(p[1]) > SEGMENT:
                    yield flush(parts)
                    parts, size = [], 0
                parts.append(p)
                size += len(p[1])
    if parts:
        yield flush(parts)


def _matrix(texts: list[str], left: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Reaches as rows of code points, aligned at their anchors; 0xFFFFFFFF beyond their ends."""
    side = span - gram
    m = np.full((len(texts), 2 * side + gram), 0xFFFFFFFF, np.uint32)
    for r, (t, lt) in enumerate(zip(texts, left)):
        p = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        m[r, side - lt : side - lt + len(p)] = p
    return m


def _pieces(m: np.ndarray, hasher: Hasher, h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``span``-character pieces of each row (with its anchor), and which are real."""
    n, width = m.shape
    prefix = hasher.prefix(m.ravel())
    base = (np.arange(n) * width)[:, None] + np.arange(width - span + 1)[None, :]
    x = _mix((prefix[base + span] - prefix[base]) * hasher.inv[base] + h.view(_U)[:, None] * _U(0x9FB21C651E98DF25))
    gap = np.concatenate([np.zeros((n, 1), np.int32), np.cumsum(m == 0xFFFFFFFF, axis=1, dtype=np.int32)], axis=1)
    return x, gap[:, span:] == gap[:, : width - span + 1]


ROWS_A_BLOCK = 1024


def _factor(batches: Iterator[pd.DataFrame], span: int, gram: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by anchor -> doc_id, place, lo, hi of the shared pieces of the reaches
    that are ``alone``. An anchor's reaches may come in several batches."""
    side = span - gram
    hasher = Hasher((ROWS_A_BLOCK + 1) * (2 * side + gram))

    def block(b: pd.DataFrame) -> pd.DataFrame:
        xs, oks = [], []
        h, left = b["h"].to_numpy(), b["left"].to_numpy()
        for a in range(0, len(b), ROWS_A_BLOCK):
            z = slice(a, a + ROWS_A_BLOCK)
            x, ok = _pieces(_matrix(list(b["text"].iloc[z]), left[z], span, gram), hasher, h[z], span)
            xs.append(x), oks.append(ok)
        x, ok = np.concatenate(xs), np.concatenate(oks)
        row = np.repeat(np.arange(len(b)), x.shape[1]).reshape(x.shape)[ok]
        off = np.tile(np.arange(x.shape[1]), (len(b), 1))[ok]
        key = x[ok]
        doc, last = b["doc_id"].to_numpy(), b["last_doc"].to_numpy()
        o = np.lexsort((doc[row], key))
        cut = np.flatnonzero(np.concatenate([[True], key[o][1:] != key[o][:-1]]))
        times = np.diff(np.append(cut, len(key)))
        # A piece's first document, and its last with a row that has it.
        lo_at, hi_at = o[cut], np.lexsort((-last[row], key))[cut]
        lo_row, hi_row = row[lo_at], row[hi_at]
        pos, last_pos = b["pos"].to_numpy(), b["last_pos"].to_numpy()
        lo_place, hi_place = pos[lo_row] + off[lo_at], last_pos[hi_row] + off[hi_at]  # a piece may stand elsewhere around its anchor
        group = np.empty(len(key), np.int64)
        group[o] = np.repeat(np.arange(len(cut)), times)
        own = b["alone"].to_numpy()[row] & (doc[lo_row] != last[hi_row])[group]
        row, off, group = row[own], off[own], group[own]
        if not len(row):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc_id", "lo", "hi", "src", "src_lo")})
        other = doc[lo_row[group]] != doc[row]
        src = np.where(other, doc[lo_row[group]], last[hi_row[group]])
        at = np.where(other, lo_place[group], hi_place[group]) - off
        # Pieces next to each other from one source are one factor.
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1) | (src[1:] != src[:-1]) | (at[1:] != at[:-1])])
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(row)) - 1
        start = pos[row[first]] - side + off[first]
        return pd.DataFrame({"doc_id": doc[row[first]], "lo": start, "hi": pos[row[end]] - side + off[end] + span, "src": src[first], "src_lo": at[first] - side + off[first]})

    held: list[pd.DataFrame] = []
    count = 0
    for b in batches:
        held.append(b)
        count += len(b)
        if count < 4 * ROWS_A_BLOCK:
            continue
        all_ = pd.concat(held, ignore_index=True)
        tail = all_["h"].to_numpy() == all_["h"].iloc[-1]  # its anchor may go on
        if not tail.all():
            yield block(all_[~tail].reset_index(drop=True))
            held = [all_[tail].reset_index(drop=True)]
            count = len(held[0])
    if count:
        yield block(pd.concat(held, ignore_index=True))


def _piece_rows(batches: Iterator[pd.DataFrame], span: int, gram: int) -> Iterator[pd.DataFrame]:
    """The pieces of reaches as rows, for anchors with too many reaches for one block."""
    side = span - gram
    hasher = Hasher((ROWS_A_BLOCK + 1) * (2 * side + gram))
    for b in batches:
        for a in range(0, len(b), ROWS_A_BLOCK):
            z = b.iloc[a : a + ROWS_A_BLOCK]
            x, ok = _pieces(_matrix(list(z["text"]), z["left"].to_numpy(), span, gram), hasher, z["h"].to_numpy(), span)
            row = np.repeat(np.arange(len(z)), x.shape[1]).reshape(x.shape)[ok]
            off = np.tile(np.arange(x.shape[1]), (len(z), 1))[ok]
            start, last = (z[c].to_numpy()[row] - side + off for c in ("pos", "last_pos"))
            yield pd.DataFrame({"piece": x[ok].view(np.int64), "doc_id": z["doc_id"].to_numpy()[row], "last_doc": z["last_doc"].to_numpy()[row], "alone": z["alone"].to_numpy()[row], "lo": start, "last_lo": last})


def shared_factors(documents: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = 4096) -> DataFrame:
    """doc_id, lo, hi (half-open, code points), src, src_lo: factors of at least ``span`` characters that
    stand verbatim in the document src, from src_lo on. Factors of a document may overlap; every shared
    character is in one."""
    if not 8 <= gram <= span <= 1000:
        raise ValueError("8 <= gram <= span <= 1000")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= span))
    found = materialize(docs.mapInPandas(lambda it: _find(it, span, gram), "h bigint, reach bigint, doc_id bigint, place bigint"), "anchors")

    # The blocks of two documents or more; a reach with its first and last document.
    shared = found.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("h")
    under = found.join(shared, "h", "left_semi")
    at = F.struct("doc_id", "place")
    reaches = materialize(
        under.groupBy("h", "reach").agg(F.min(at).alias("at"), F.max(at).alias("last"), F.count(F.lit(1)).alias("places"))
        .select("h", "reach", F.col("at.doc_id").alias("doc_id"), F.col("at.place").alias("place"), F.col("last.doc_id").alias("last_doc"), F.col("last.place").alias("last_place"), "places"),
        "reaches",
    )
    pos, last_pos = F.shiftright("place", 20), F.shiftright("last_place", 20)
    left, right = F.shiftright("place", 10).bitwiseAND(F.lit(1023)), F.col("place").bitwiseAND(F.lit(1023))
    many = reaches.where("doc_id <> last_doc").select("h", "reach", F.col("doc_id").alias("d1"), pos.alias("p1"), F.col("last_doc").alias("d2"), last_pos.alias("p2"))
    other = F.col("d1") != F.col("doc_id")
    whole = found.join(many, ["h", "reach"]).select("doc_id", (pos - left).alias("lo"), (pos + gram + right).alias("hi"), F.when(other, F.col("d1")).otherwise(F.col("d2")).alias("src"), (F.when(other, F.col("p1")).otherwise(F.col("p2")) - left).alias("src_lo"))

    # Boundaries: reaches of one document, with all reaches of their block.
    here = reaches.select("h", "doc_id", "place", "last_doc", "last_place")
    again = reaches.where("doc_id = last_doc AND places > 1")
    if not again.isEmpty():  # one document has the reach at several places; each needs its factors
        more = found.join(again.select("h", "reach", F.col("place").alias("first")), ["h", "reach"]).where("place <> first")
        here = here.unionAll(more.select("h", "doc_id", "place", F.col("doc_id").alias("last_doc"), F.col("place").alias("last_place")))
    sizes = here.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") == F.col("last_doc")).alias("any")).where("n > 1 AND any").select("h", "n")
    cuts = here.join(sizes, "h").select("h", "doc_id", "last_doc", "n", pos.alias("pos"), last_pos.alias("last_pos"), left.cast("int").alias("left"), right.cast("int").alias("right"))
    cuts = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("h", "last_doc", "n", "pos", "last_pos", "left", "right")).alias("c"))  # as many as a document has anchors
    cut = docs.join(cuts, "doc_id").withColumn("c", F.explode("c"))
    cut = cut.select("doc_id", "c.*", F.expr(f"substring(text, cast(c.pos - c.left + 1 AS int), c.left + {gram} + c.right)").alias("text"))
    cut = cut.select("h", "doc_id", "last_doc", (F.col("doc_id") == F.col("last_doc")).alias("alone"), "n", "pos", "last_pos", "left", "text")
    cut = materialize(cut, "reach_texts")
    schema = "doc_id bigint, lo bigint, hi bigint, src bigint, src_lo bigint"
    small = cut.where(F.col("n") <= block).drop("n").repartition("h").sortWithinPartitions("h")
    edge = small.mapInPandas(lambda it: _factor(it, span, gram), schema)
    if not cut.where(F.col("n") > block).isEmpty():
        rows = cut.where(F.col("n") > block).drop("n").mapInPandas(lambda it: _piece_rows(it, span, gram), "piece bigint, doc_id bigint, last_doc bigint, alone boolean, lo bigint, last_lo bigint")
        both = rows.groupBy("piece").agg(F.min(F.struct("doc_id", "lo")).alias("p"), F.max(F.struct("last_doc", "last_lo")).alias("q")).where("p.doc_id <> q.last_doc")
        first = F.col("p.doc_id") != F.col("doc_id")
        edge = edge.unionAll(rows.where("alone").join(both, "piece").select("doc_id", "lo", (F.col("lo") + span).alias("hi"), F.when(first, F.col("p.doc_id")).otherwise(F.col("q.last_doc")).alias("src"), F.when(first, F.col("p.lo")).otherwise(F.col("q.last_lo")).alias("src_lo")))
    return whole.unionAll(edge)


def _matches(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, src: np.ndarray, src_lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """Factors that touch, from one source at one distance, as one match; sorted by (doc, lo)."""
    gap = src_lo - lo
    o = np.lexsort((hi, lo, gap, src, doc))
    doc, lo, hi, src, gap = doc[o], lo[o], hi[o], src[o], gap[o]
    same = (doc[1:] == doc[:-1]) & (src[1:] == src[:-1]) & (gap[1:] == gap[:-1])
    run = np.concatenate([[0], np.cumsum(~same)])
    # The furthest end so far within a (doc, source, distance), by lifting each above those before.
    lift = run * (int(hi.max(initial=0)) + 1)
    far = np.maximum.accumulate(hi + lift) - lift
    first = np.flatnonzero(np.concatenate([[True], ~same | (lo[1:] > far[:-1])]))
    end = far[np.append(first[1:], len(doc)) - 1]
    doc, lo, src, gap = doc[first], lo[first], src[first], gap[first]
    o = np.lexsort((src, -end, lo, doc))
    return doc[o], lo[o], end[o], src[o], gap[o]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id and its factors (as parallel arrays) -> doc_id, pos, length, src, src_pos, match_pos."""
    for b in batches:
        n = b["lo"].map(len).to_numpy()
        flat = [np.concatenate(b[c].to_list()).astype(np.int64) if n.sum() else np.zeros(0, np.int64) for c in ("lo", "hi", "src", "src_lo")]
        out = []
        here, at, best = None, 0, None
        m = [x.tolist() for x in _matches(np.repeat(b["doc_id"].to_numpy(), n), *flat)]
        # (where the match that leads furthest begins, its end, its source and distance); it is taken when the place is reached.
        for doc, lo, hi, src, gap in [*zip(*m), (None, 0, 0, 0, 0)]:
            while here is not None and best is not None and (doc != here or lo > at):
                if best[1] > at:
                    start = max(at, best[0])
                    out.append((here, start, best[1] - start, best[2], start + best[3], best[0]))
                    at = best[1]
                else:
                    best = None
            if doc != here:
                here, at, best = doc, lo, None
            if best is None:
                at = max(at, lo)
            if best is None or hi > best[1]:
                best = (lo, hi, src, gap)
        yield pd.DataFrame(out, columns=["doc_id", "pos", "length", "src", "src_pos", "match_pos"]).astype("int64")


def parse(documents: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = 4096) -> DataFrame:
    """The parse: doc_id, pos, length, src, src_pos, match_pos, a row a factor. The factor is ``length`` characters from pos on and
    stands in the document src from src_pos on. It is part of a match of at least ``span`` characters that
    began at match_pos, before pos where it crosses the end of the factor before. Factors do not overlap; the
    rest are literals."""
    f = shared_factors(documents, span, gram, block)
    per = f.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "src", "src_lo")).alias("f")).select("doc_id", "f.lo", "f.hi", "f.src", "f.src_lo")  # a document's factors
    return per.mapInPandas(_parse, "doc_id bigint, pos bigint, length bigint, src bigint, src_pos bigint, match_pos bigint")


def shared_chars(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """p9_found(doc_id, shared_chars): characters of the text that stand in shared spans, which are those of its factors."""
    return parse(documents, span, gram).groupBy("doc_id").agg(F.sum("length").alias("shared_chars"))


def report(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_chars, shared_chars, share for every document with a text."""
    n = documents.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("n_chars"))
    s = n.join(shared_chars(documents, span), "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return s.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
