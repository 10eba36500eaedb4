"""Preshuffling: blocks of rows dealt over datasets, permuted and optionally sorted inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.hashing import md5_key
from shardloom.operators.index import range_positions
from shardloom.operators.ranks import prefix_rank

#: A block table of up to this many rows (24 bytes each) is broadcast; a longer one is joined by shuffle.
BROADCAST_BLOCKS = 1_000_000
#: Ordinals that one task ranks among the repeats of a name.
RANK_PIECE = 1 << 18


def block_plan(spark, n_obs: int, block: int, *, shuffle: bool = True, seed: int = 7, dataset_size: int | None = None, n_datasets: int | None = None) -> DataFrame:
    """blk, rank, dataset of each block of ``block`` consecutive rows.

    Exactly one of ``dataset_size`` (create: floor(size / block) blocks a dataset, one
    dataset in all if that is at most 1 or all rows fit) and ``n_datasets`` (append: the
    blocks dealt over exactly so many, the first ones getting one more).
    """
    if (dataset_size is None) == (n_datasets is None):
        raise ValueError("give either dataset_size or n_datasets")
    if block < 1:
        raise ValueError("a block has at least one row")
    n = -(-n_obs // block)
    b = spark.range(n).select(F.col("id").alias("blk"))
    if shuffle:
        b = prefix_rank(b, [], F.concat(md5_key(seed, "blk", "blk"), F.lpad(F.col("blk").cast("string"), 20, "0")), "rank", start=0)
    else:
        b = b.withColumn("rank", F.col("blk"))
    if dataset_size is not None:
        if block > dataset_size:
            raise ValueError(f"a block of {block} rows is larger than a dataset of {dataset_size}")
        k = dataset_size // block
        ds = F.lit(0) if n_obs <= dataset_size or k <= 1 else F.expr(f"rank div {k}")
    else:
        if n < n_datasets:
            raise ValueError(f"{n} blocks cannot reach {n_datasets} datasets")
        q, r = divmod(n, n_datasets)
        ds = F.when(F.col("rank") < r * (q + 1), F.expr(f"rank div {q + 1}")).otherwise(F.expr(f"{r} + (rank - {r * (q + 1)}) div {q}"))
    return b.withColumn("dataset", ds.cast("int"))


def assign_blocks(df: DataFrame, n_obs: int, block: int, *, idx: str = "obs_idx", **how) -> DataFrame:
    """Adds ``dataset`` to rows that carry their ordinal; no shuffle while the block table
    is small enough to broadcast."""
    plan = block_plan(df.sparkSession, n_obs, block, **how).select("blk", "dataset")
    plan = F.broadcast(plan) if -(-n_obs // block) <= BROADCAST_BLOCKS else plan
    return df.withColumn("blk", F.expr(f"`{idx}` div {block}")).join(plan, "blk").drop("blk")


def _row_order(df: DataFrame, idx: str, shuffle: bool, groupby: list[Column | str] | None, seed: int) -> list[Column]:
    base = [md5_key(seed, "row", idx), F.col(idx)] if shuffle else [F.col(idx)]
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in groupby or []] + base


def place_rows(df: DataFrame, *, idx: str = "obs_idx", shuffle: bool = True, groupby: list[Column | str] | None = None, seed: int = 7) -> DataFrame:
    """Adds ``row``, the 0-based place within the dataset: permuted by hash (else in
    ordinal order), then stably sorted by ``groupby`` with nulls last. One window a dataset,
    for datasets that a task holds; ``range_rows`` does the same for any size."""
    order = _row_order(df, idx, shuffle, groupby, seed)
    return df.withColumn("row", (F.row_number().over(Window.partitionBy("dataset").orderBy(*order)) - 1).cast("bigint"))


def range_rows(df: DataFrame, partitions: int, *, idx: str = "obs_idx", shuffle: bool = True, groupby: list[Column | str] | None = None, seed: int = 7) -> DataFrame:
    """``place_rows`` by ranges of (dataset, order): datasets of any size are split over
    partitions, each of which holds consecutive rows in their order."""
    d = range_positions(df, [F.col("dataset"), *_row_order(df, idx, shuffle, groupby, seed)], partitions)
    sizes = d.groupBy("dataset").agg(F.count(F.lit(1)).alias("__n")).select(F.col("dataset").alias("__d"), "__n")
    start = sizes.select("__d", (F.sum("__n").over(Window.orderBy("__d")) - F.col("__n")).alias("__s"))  # a row a dataset
    return d.join(F.broadcast(start), F.col("dataset") == F.col("__d")).withColumn("row", F.col("__at") - F.col("__s")).drop("__d", "__s", "__at")


def with_codes(df: DataFrame, column: str, categories: list[str], out: str | None = None) -> DataFrame:
    """Adds the place of a value in an ordered list of categories (null and unknown: null);
    the list is an array literal, looked up without a join."""
    cats = F.array(*[F.lit(c) for c in categories])
    pos = F.array_position(cats, F.col(column))
    return df.withColumn(out or f"{column}_code", F.when(pos > 0, (pos - 1).cast("int")))


def unique_names(df: DataFrame, name: str = "obs_name", idx: str = "obs_idx", max_rounds: int = 32, taken: DataFrame | None = None) -> DataFrame:
    """Names made unique: in ordinal order the first keeps its name, the k-th repeat becomes
    ``name-k``; a made name that exists already counts up further. Null names stay null.

    Names in ``taken`` (one column) are used already, and earlier. Only names that repeat are
    touched, so the work follows the repeats; a name that a third of all rows share is ranked
    by many tasks.
    """
    from shardloom.session import materialize

    repeated = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("__c"))
    if taken is not None:
        used = taken.select(F.col(taken.columns[0]).alias("__u")).where("__u IS NOT NULL").distinct()
        repeated = repeated.join(used, F.col(name) == F.col("__u"), "left").withColumn("__u", F.col("__u").isNotNull())
    else:
        repeated = repeated.withColumn("__u", F.lit(False))
    repeated = materialize(repeated.where("__c > 1 OR __u").select(F.col(name).alias("__name"), "__u"), "repeated")
    if repeated.isEmpty():
        return df
    hit = F.col(name) == F.col("__name")
    # Ranks by pieces of the ordinal, lifted by the pieces before.
    again = df.join(repeated, hit).withColumn("__b", F.expr(f"`{idx}` div {RANK_PIECE}"))
    sizes = again.groupBy("__name", "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select(F.col("__name").alias("__n2"), F.col("__b").alias("__b2"), (F.sum("__c").over(Window.partitionBy("__name").orderBy("__b")) - F.col("__c")).alias("__f"))
    k = F.row_number().over(Window.partitionBy("__name", "__b").orderBy(idx)) - 1
    d = again.withColumn("__r", k).join(before, (F.col("__name") == F.col("__n2")) & (F.col("__b") == F.col("__b2")))
    d = d.withColumn("__k", F.col("__r") + F.col("__f") + F.when(F.col("__u"), 1).otherwise(0)).drop("__name", "__u", "__b", "__r", "__n2", "__b2", "__f")
    alone = df.join(repeated, hit, "left_anti").withColumn("__k", F.lit(0).cast("bigint"))
    kept = alone.unionByName(d.where("__k = 0"))
    rest = materialize(d.where("__k > 0"), "repeats")
    used_names = kept.where(F.col(name).isNotNull()).select(F.col(name).alias("t"))
    taken = used_names if taken is None else used_names.unionAll(used.select(F.col("__u").alias("t")))
    done = None
    tail = rest.withColumn("__base", F.col(name))
    for _ in range(max_rounds):
        tail = tail.withColumn("__new", F.concat_ws("-", "__base", F.col("__k").cast("string")))
        w2 = Window.partitionBy("__new").orderBy(idx)
        tail = tail.join(taken.select(F.col("t").alias("__new"), F.lit(1).alias("__hit")), "__new", "left").withColumn("__dup", F.row_number().over(w2))
        tail = materialize(tail, "named")
        ok = tail.where("__hit IS NULL AND __dup = 1").withColumn(name, F.col("__new")).drop("__new", "__hit", "__dup", "__base")
        done = ok if done is None else done.unionByName(ok)
        taken = taken.unionAll(ok.select(F.col(name).alias("t")))
        tail = tail.where("__hit IS NOT NULL OR __dup > 1").drop("__new", "__hit", "__dup").withColumn("__k", F.col("__k") + 1)
        if tail.isEmpty():
            return kept.unionByName(done).drop("__k")
    raise RuntimeError("names are still not unique")
