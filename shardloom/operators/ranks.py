"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_rank(df: DataFrame, keys: list[str], order: Column, out: str, buckets: int = 64, n_out: str | None = None) -> DataFrame:
    """1-based ``row_number`` within ``keys`` in the order of a 64-bit hash.

    The hash range is cut into ``buckets`` ordered pieces. Rows are ranked within
    (keys, piece) and lifted by the rows of the pieces before, so a group that
    holds a third of all rows is ranked by ``buckets`` tasks, not one. ``n_out``
    names an optional column with the size of the group. ``order`` must be a
    BIGINT that is unique within the group (ties are ranked in no fixed order).
    """
    h, b, c = "__h", "__b", "__c"
    d = df.withColumn(h, order).withColumn(b, F.floor((F.shiftright(F.col(h), 32) + F.lit(1 << 31)) * buckets / F.lit(1 << 32)).cast("int"))
    local = d.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, b).orderBy(h)))
    sizes = d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(c))
    w = Window.partitionBy(*keys).orderBy(b)
    sizes = sizes.withColumn("__before", F.sum(c).over(w) - F.col(c))
    if n_out:
        sizes = sizes.withColumn(n_out, F.sum(c).over(Window.partitionBy(*keys)))
    on = [*keys, b]
    s = sizes.select(*[F.col(k).alias(f"__s_{k}") for k in on], "__before", *([n_out] if n_out else []))
    cond = [local[k].eqNullSafe(s[f"__s_{k}"]) for k in on]
    return local.join(s, cond).withColumn(out, F.col("__r") + F.col("__before")).drop(h, b, "__r", "__before", *[f"__s_{k}" for k in on])


def prefix_rank(df: DataFrame, keys: list[str], order: Column, out: str, digits: int = 2, start: int = 1) -> DataFrame:
    """``row_number`` (from ``start``) within ``keys`` in the order of a hex digest.

    The digest's first ``digits`` hex digits cut a group into ordered pieces that are
    ranked apart and lifted by the pieces before, so even a whole table (no keys) is
    ranked by 16**digits tasks. Digests must be unique within a group, or ties are
    broken by the remaining columns' order as given in the digest (append the key).
    """
    d = df.withColumn("__o", order).withColumn("__b", F.substring("__o", 1, digits))
    local = d.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__o")))
    sizes = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("__b") if keys else Window.partitionBy(F.lit(0)).orderBy("__b")  # 16**digits rows a group
    sizes = sizes.withColumn("__before", F.sum("__c").over(w) - F.col("__c"))
    on = [*keys, "__b"]
    s = sizes.select(*[F.col(k).alias(f"__s_{k}") for k in on], "__before")
    j = local.join(s, [local[k].eqNullSafe(s[f"__s_{k}"]) for k in on])
    return j.withColumn(out, (F.col("__r") + F.col("__before") - F.lit(1 - start)).cast("bigint")).drop("__o", "__b", "__r", "__before", *[f"__s_{k}" for k in on])
