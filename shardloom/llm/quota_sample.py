"""Samples that match target category proportions, by divisor-method priorities.

Every record gets a random rank within its (store, label); in a draw the k-th record
of a label with share ``s`` has priority (k - 0.5) / s. The first ``min_rows`` records
of each label come first, then the smallest priorities of the whole draw. A label
that runs out of records simply has no more priorities, so its seats go to the others.

Seats are settled before any record is touched: the priorities of a label form the
regular sequence (k - 0.5)/s, so how many of them lie below a threshold is known in closed
form. A draw's threshold is bisected over its labels (rows of the plan, a handful), ties
at it go by label, and a draw of any size costs the same.

Every draw has random ranks of its own, by a hash of (draw, record), so draws are
independent. A draw's records are joined by (store, label); those whose hash is clearly beyond the
seats are left out before anything is shuffled (where too few are left, the label is ranked whole),
and the rest are ranked in pieces of the hash, so a label that holds a third of all rows is
ranked by many tasks.

Odd input: labels are the same ignoring case, and runs of whitespace, hyphens and
underscores count as one blank and as none at the ends; an empty or null label is no
label. Equal rows of the plan are one; null shares and minima count as 0. A rec_id delivered twice is one record (rows of one rec_id that differ count
once per label they have). A share of 0 gets its floor only. If the floors exceed the
sample size all floors are kept. An empty plan or table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.hashing import md5_key
from shardloom.operators.ranks import prefix_rank
from shardloom.session import materialize

DRAW = ["plan_id", "split_name"]


def label_key(c: Column) -> Column:
    k = F.trim(F.regexp_replace(F.lower(c), r"(?U)[\s_-]+", " "))
    return F.when(k != "", k)


def pools(cells: DataFrame) -> DataFrame:
    """store_id, key, rec_id: distinct records by label."""
    return cells.select("store_id", label_key(F.col("label")).alias("key"), "rec_id").where("key IS NOT NULL AND rec_id IS NOT NULL AND store_id IS NOT NULL").distinct()


def targets_with_pools(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """The plan rows with ``h``, the number of distinct records of the label."""
    sizes = pools(cells).groupBy("store_id", "key").agg(F.count(F.lit(1)).alias("h"))
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    p = plans.select(*DRAW, "store_id", zero("sample_size"), "label", zero("share_pm"), zero("min_rows")).distinct().withColumn("key", label_key(F.col("label")))
    return p.join(sizes, ["store_id", "key"], "left").withColumn("h", F.coalesce("h", F.lit(0)))


def settle(size: int, share: np.ndarray, floor: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Seats of labels (in the order in which ties go): the floors, then the smallest priorities
    (k - 0.5) / share of k beyond the floor and up to ``have``, until there are ``size``."""
    got = floor.astype(np.int64)
    top = np.where(share > 0, have, floor).astype(np.int64)
    if got.sum() >= size or (top <= got).all():
        return got
    live = share > 0

    def below(limit: float) -> np.ndarray:
        k = np.floor(limit * share + 0.5)
        k += np.where(live, (k + 0.5) / np.where(live, share, 1) <= limit, 0)  # the division rounds
        k -= np.where(live, (k - 0.5) / np.where(live, share, 1) > limit, 0)
        return np.clip(k, got, top).astype(np.int64)

    lo, hi = 0.0, float(((top[live] + 1) / share[live]).max())
    if below(hi).sum() <= size:
        return below(hi)
    while (mid := (lo + hi) / 2) not in (lo, hi):
        lo, hi = (mid, hi) if below(mid).sum() <= size else (lo, mid)
    out = below(lo)
    for i in np.flatnonzero(below(hi) > out)[: size - out.sum()]:  # those that tie at the threshold
        out[i] += 1
    return out


def seats(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """The plan rows with ``h`` and ``seats``: how many records of the label the draw gets."""
    t = targets_with_pools(cells, plans)
    cols = ["key", "label", "share_pm", "min_rows", "h"]
    draws = t.groupBy(*DRAW, "store_id", "sample_size").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))  # a draw's labels

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for size, rows in zip(b["sample_size"], b["rows"]):
                share, low, h = (np.array([r[c] for r in rows], np.int64) for c in ("share_pm", "min_rows", "h"))
                got.append(settle(int(size), share.astype(float), np.clip(np.minimum(low, h), 0, None), h))
            n = [len(x) for x in got]
            flat = [r for rows in b["rows"] for r in rows]
            own = b.loc[b.index.repeat(n), [*DRAW, "store_id", "sample_size"]].reset_index(drop=True)
            yield own.assign(**{c: [r[c] for r in flat] for c in cols}, seats=np.concatenate(got) if got else [])

    kinds = dict(t.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*DRAW, "store_id", "sample_size", *cols])
    return draws.mapInPandas(each, f"{schema}, seats bigint")


def sample(cells: DataFrame, plans: DataFrame, seed: int = 7) -> DataFrame:
    """plan_id, split_name, label, rec_id of every draw, ranked by md5('seed:draw:plan:split:rec_id')."""
    pool = materialize(pools(cells), "pools")
    s = materialize(seats(cells, plans).where("seats > 0").withColumn("row", F.monotonically_increasing_id()), "seats")
    # The share of hashes that almost surely holds the seats: 8 standard deviations and some more.
    share = (F.col("seats") + 8 * F.sqrt(F.col("seats").cast("double")) + 40) / F.col("h")
    s = s.withColumn("upto", F.when(share >= 1, F.lit(1 << 32)).otherwise((share * (1 << 32)).cast("bigint")))
    d = s.join(pool, ["store_id", "key"]).select("row", *DRAW, "label", "rec_id", "seats", "upto", md5_key(seed, "draw", "plan_id", "split_name", "rec_id").alias("hash"))
    first = d.where(F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint") < F.col("upto"))
    first = materialize(prefix_rank(first.drop("upto"), ["row"], F.concat("hash", F.lpad(F.col("rec_id").cast("string"), 20, "0")), "rank").where("rank <= seats").drop("hash", "rank"), "drawn")
    short = s.join(first.groupBy("row").agg(F.count(F.lit(1)).alias("n")), "row", "left").where("coalesce(n, 0) < seats").select("row")
    short = materialize(short, "short")
    if short.isEmpty():
        return first.select(*DRAW, "label", "rec_id")
    again = d.join(short, "row", "left_semi").drop("upto")
    again = prefix_rank(again, ["row"], F.concat("hash", F.lpad(F.col("rec_id").cast("string"), 20, "0")), "rank").where("rank <= seats")
    return first.join(short, "row", "left_anti").select(*DRAW, "label", "rec_id").unionAll(again.select(*DRAW, "label", "rec_id"))


def found(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """p4_found(plan_id, split_name, label): labels of the settled draws whose target cannot be met."""
    t = seats(cells, plans)
    short = (F.col("h") * 1000 < F.col("share_pm") * F.col("sample_size")) | (F.col("h") < F.col("min_rows"))
    return t.where(short).select(*DRAW, "label").distinct()
