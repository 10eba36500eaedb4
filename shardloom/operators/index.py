"""Dense row ordinals and computations along them, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.session import materialize


#: Rows that one task may rank without further cutting.
PIECE = 250_000


def dense_index(df: DataFrame, key: str, out: str = "obs_idx") -> DataFrame:
    """0-based ordinal of the rows by a unique BIGINT key. Null keys raise, as they have no
    place. More rows than one task may rank are ranged over partitions (``dense_index_by``)."""
    n, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    if nulls:
        raise ValueError(f"{key} has nulls")
    if n > PIECE:
        return dense_index_by(df, [key], out, n)
    return df.withColumn(out, (F.row_number().over(Window.orderBy(key)) - 1).cast("bigint"))


def partitions_for(df: DataFrame, n: int, row_bytes: float = 0, target: int = 128 << 20) -> int:
    """Partitions for ``n`` rows (of 512 bytes, if not known): ``target`` bytes each, and at
    least one a core where there are 10,000 rows for each."""
    row_bytes = row_bytes or 512
    cores = df.sparkSession.sparkContext.defaultParallelism
    return int(max(1, -(-n * row_bytes // target), min(cores, -(-n // 10_000))))


def range_positions(df: DataFrame, keys: list, partitions: int) -> DataFrame:
    """Rows in the order of ``keys``, written down, with ``__at``, the 0-based place of each in
    the whole. One shuffle by ranges and no window: a row knows its place in its
    partition, and partitions are lifted by their counts (a row a partition)."""
    d = df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    d = d.withColumn("__b", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    d = materialize(d, "ordered")
    sizes = d.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select(F.col("__b").alias("__p"), (F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).alias("__f"))
    return d.join(F.broadcast(before), F.col("__b") == F.col("__p")).withColumn("__at", F.col("__f") + F.col("__i")).drop("__b", "__i", "__p", "__f")


def dense_index_by(df: DataFrame, keys: list[str], out: str = "obs_idx", n: int | None = None, row_bytes: float = 0) -> DataFrame:
    """The same for any unique sort key. ``n`` and ``row_bytes`` (counted and 0 if not given)
    decide the number of partitions."""
    n = df.count() if n is None else n
    return range_positions(df, [F.col(k) for k in keys], partitions_for(df, n, row_bytes)).withColumnRenamed("__at", out)


def runs(df: DataFrame, idx: str, value: str, block: int = 1 << 16) -> DataFrame:
    """Run-length encoding along a dense ordinal: value, start, stop (half-open).

    Runs are found block by block; a block's first run is tied to the last of the block
    before where they hold the same value. Nulls are a value of their own.
    """
    d = df.select(F.col(idx).alias("i"), F.col(value).alias("v"), F.expr(f"`{idx}` div {block}").alias("b"))
    w = Window.partitionBy("b").orderBy("i")
    prev_i, prev_v = F.lag("i").over(w), F.lag("v").over(w)
    new = (prev_i.isNull() | (prev_i != F.col("i") - 1) | ~prev_v.eqNullSafe(F.col("v"))).cast("int")
    d = d.withColumn("n", new).withColumn("g", F.sum("n").over(w))
    local = d.groupBy("b", "g").agg(F.first("v").alias("v"), F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
    lead = Window.partitionBy("b").orderBy("g")
    firsts = local.where("g = 1")
    lasts = local.groupBy("b").agg(F.max_by(F.struct("v", "stop"), "g").alias("last")).select((F.col("b") + 1).alias("b"), F.col("last.v").alias("lv"), F.col("last.stop").alias("ls"))
    goes_on = firsts.join(lasts, "b").where((F.col("ls") == F.col("start")) & F.col("lv").eqNullSafe(F.col("v"))).select("b", F.lit(1).alias("g"), F.lit(1).alias("on"))
    local = local.join(goes_on, ["b", "g"], "left").withColumn("fresh", F.when(F.col("on").isNull(), 1).otherwise(0))
    per = local.groupBy("b").agg(F.sum("fresh").alias("f"))
    base = per.select("b", (F.sum("f").over(Window.orderBy("b")) - F.col("f")).alias("base"))  # one row a block
    local = local.join(base, "b").withColumn("run", F.col("base") + F.sum("fresh").over(lead))
    return local.groupBy("run").agg(F.first("v").alias(value), F.min("start").alias("start"), F.max("stop").alias("stop")).select(value, "start", "stop")


def coalesce_runs(df: DataFrame, idx: str) -> DataFrame:
    """Consecutive ordinals as (start, stop)."""
    return runs(df.select(idx, F.lit(0).alias("__one")), idx, "__one").select("start", "stop")


def offsets(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Half-open global ranges of datasets, in order of their numbers."""
    out, at = {}, 0
    for k in sorted(sizes):
        out[k] = (at, at + sizes[k])
        at += sizes[k]
    return out


def locate(df: DataFrame, idx: str, sizes: dict[int, int]) -> DataFrame:
    """Global ordinal -> (dataset, local_row); an ordinal out of range gives nulls.

    ``sizes`` comes from a manifest. The range of ordinals is cut into equal buckets, some
    four to a dataset, and each dataset is listed under those it touches: the lookup is an
    equi-join on the bucket with a few rows each, not a comparison with every dataset.
    """
    off = [(k, a, z) for k, (a, z) in offsets(sizes).items() if z > a]
    total = off[-1][2] if off else 0
    width = max(1, -(-total // max(1, 4 * len(off))))
    rows = [(b, k, a, z) for k, a, z in off for b in range(a // width, (z - 1) // width + 1)]
    table = df.sparkSession.createDataFrame(rows, "__b bigint, dataset int, __a bigint, __z bigint")
    hit = (F.expr(f"`{idx}` div {width}") == F.col("__b")) & (F.col(idx) >= F.col("__a")) & (F.col(idx) < F.col("__z"))
    return df.join(F.broadcast(table), hit, "left").withColumn("local_row", F.col(idx) - F.col("__a")).drop("__a", "__z", "__b")  # at most five rows a dataset


def expand(slices: DataFrame, start: str = "start", stop: str = "stop", out: str = "obs_idx") -> DataFrame:
    """Ranges to rows: ``offset`` and ``out``; empty ranges give nothing."""
    s = slices.where(F.col(stop) > F.col(start)).withColumn("offset", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(stop) - F.col(start) - 1)))
    return s.withColumn(out, F.col(start) + F.col("offset"))
