"""Consolidating many tiny CSR files into few files of good size.

One input row stands for one tiny file: parallel arrays ``obs_names``,
``indptr``, ``indices``, ``data``. Records are taken out of the files, copies are
left out (the earliest by (file_id, row_no) stays), and the rest is written
through an adaptive ``REBALANCE`` so that runtime statistics, not a guessed
count, decide how many files come out. The new files become visible only after
their multiset checksum equals that of the records meant to be written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import discard, materialize


def explode_files(files: DataFrame, carry: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """One row per record copy: file_id, row_no, obs_name, indices, values (non-zero
    entries, sorted by index, repeats of an index kept) and ``carry``.

    Row i covers ``indptr[i]-indptr[0] .. indptr[i+1]-indptr[0]``; the number of
    records is ``size(obs_names)`` bounded by ``size(indptr)-1`` (``n_obs`` is not
    trusted). A null or empty file has no records. Null values count as zero.
    """
    cols = ["file_id", *carry, "obs_names", "indptr", "indices", "data"]
    f = files.select(*cols).where(F.col("obs_names").isNotNull() & F.col("indptr").isNotNull())
    n = F.least(F.size("obs_names"), F.size("indptr") - 1)
    e = f.withColumn("__n", n).where("__n > 0").withColumn("row_no", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    e = e.withColumn("__a", F.expr("indptr[row_no] - indptr[0]")).withColumn("__l", F.expr("indptr[row_no + 1] - indptr[row_no]"))
    pairs = F.expr(
        "array_sort(filter(zip_with(slice(indices, __a + 1, greatest(__l, 0)), slice(data, __a + 1, greatest(__l, 0)),"
        " (i, v) -> struct(i AS i, v AS v)), p -> p.v != 0))"
    )
    e = e.withColumn("__p", F.coalesce(pairs, F.expr("cast(array() AS array<struct<i:int,v:float>>)")))
    return e.select(
        "file_id", F.col("row_no").cast("bigint").alias("row_no"), *carry, F.expr("obs_names[row_no]").alias("obs_name"),
        F.col("__p.i").alias("indices"), F.col("__p.v").alias("values"),
    )


def content_key(*cols: str) -> Column:
    """128-bit digest of a record's content; equal content, equal key."""
    return F.md5(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}).cast("binary"))


def copies_of(records: DataFrame, key: Column | None = None, salts: int = 8) -> DataFrame:
    """file_id, row_no, k (content digest) of the records whose name and content stand earlier by (file_id, row_no).

    Only digests and places are shuffled, never the records. The earliest place of each
    content is a minimum, which combines before the shuffle; only contents that occur
    more than once are joined back, and that join is salted, so a content that fills a
    third of all rows is spread over tasks; what is still large is split by skew handling.
    """
    k = content_key("obs_name", "indices", "values") if key is None else key
    r = records.select("file_id", "row_no", k.alias("k"))
    first = r.groupBy("k").agg(F.min(F.struct("file_id", "row_no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("k", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    salted = r.withColumn("s", F.pmod(F.xxhash64("file_id", "row_no"), F.lit(salts)).cast("int"))
    return salted.join(first, ["k", "s"]).where(F.struct("file_id", "row_no") != F.col("first")).select("file_id", "row_no", "k").distinct()


def mark_copies(records: DataFrame, key: Column | None = None, salts: int = 8) -> DataFrame:
    """Adds ``is_copy`` to the records; the copies are written down first, so that few of
    them are broadcast to the records, which then are not shuffled."""
    copies = materialize(copies_of(records, key, salts), "copies")
    c, hit = _matching(copies, key)
    return records.join(c, hit, "left").withColumn("is_copy", F.col("__f").isNotNull()).drop("__f", "__r", "__k")


def _matching(copies: DataFrame, key: Column | None = None) -> tuple[DataFrame, Column]:
    """``copies`` with other names, and the condition that a record is one of them."""
    c = copies.select(F.col("file_id").alias("__f"), F.col("row_no").alias("__r"), F.col("k").alias("__k"))
    k = content_key("obs_name", "indices", "values") if key is None else key
    return c, (F.col("file_id") == F.col("__f")) & (F.col("row_no") == F.col("__r")) & (k == F.col("__k"))


def delivered_once(files: DataFrame) -> DataFrame:
    """``files`` without repeated rows. Only file_ids that come more than once are compared."""
    more = materialize(files.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("file_id").alias("__more")), "repeated")
    again = F.col("file_id").eqNullSafe(F.col("__more"))
    return files.join(more, again, "left_anti").unionByName(files.join(more, again, "left_semi").dropDuplicates())


def checksum(df: DataFrame, cols: list[str]) -> tuple[int, int, int]:
    """Order-free multiset checksum: rows, and the sums of two independent hashes."""
    h = [F.xxhash64(F.lit(s), *[F.col(c) for c in cols]).cast("decimal(38,0)") for s in (1, 2)]
    row = df.select(F.count(F.lit(1)).alias("n"), F.sum(h[0]).alias("a"), F.sum(h[1]).alias("b")).first()
    return int(row["n"]), int(row["a"] or 0), int(row["b"] or 0)


def rebalanced(df: DataFrame, *keys: str) -> DataFrame:
    """``REBALANCE`` hint: runtime statistics merge or split output partitions."""
    return df.hint("rebalance", *keys)


def compact(spark: SparkSession, files: DataFrame, out: str, target_bytes: int = 256 << 20) -> dict:
    """Write the records of ``files`` to ``out`` as few files near ``target_bytes``, and the
    copies that were left out (file_id, row_no) to ``out/_copies``.

    The files go to a hidden staging folder, are read back and compared (multiset
    checksum) with what was to be written; then the manifest is put beside them and the
    folder is renamed into place, all at once. Rows of ``files`` with one file_id
    and the same records are one file delivered twice; with other records both are kept. A difference, a folder that is there already or a failed
    rename raises and leaves ``out`` as it was. Returns the manifest. An empty input
    makes an empty, readable table. The settings of the caller's session stay as they are.
    """
    files = files.select("file_id", "dataset", "obs_names", "indptr", "indices", "data")
    records = materialize(explode_files(delivered_once(files)), "records")
    copies = materialize(copies_of(records), "copies")
    kept = records.join(*_matching(copies), "left_anti")
    own = spark.newSession()  # its settings are its own
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    own.conf.set("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    out = out.rstrip("/")
    head, _, tail = out.rpartition("/")
    stage = f"{head}/.{tail}.stage-{uuid.uuid4().hex}"
    fs = path(stage).getFileSystem(hconf)
    if fs.exists(path(out)):
        raise FileExistsError(out)
    try:
        written = own.read.schema(records.schema).parquet(records._shardloom_path)
        left = own.read.schema(copies.schema).parquet(copies._shardloom_path)
        rebalanced(written.join(*_matching(left), "left_anti")).write.option("compression", "zstd").parquet(stage)
        want = checksum(kept, kept.columns)
        got = spark.read.schema(kept.schema).parquet(stage)
        have = checksum(got, kept.columns)
        if have != want:
            raise RuntimeError(f"checksum differs: wrote {have}, meant {want}")
        copies.select("file_id", "row_no").distinct().write.parquet(f"{stage}/_copies")
        info = {"rows": want[0], "checksum": [str(x) for x in want[1:]], "copies": copies.select("file_id", "row_no").distinct().count(), "files": len(got.inputFiles()) if want[0] else 0}
        stream = fs.create(path(f"{stage}/_manifest.json"), True)
        stream.write(bytearray(json.dumps(info).encode()))
        stream.close()
        if fs.exists(path(out)) or not fs.rename(path(stage), path(out)):
            raise FileExistsError(f"{out} could not be put into place")
    except BaseException:
        fs.delete(path(stage), True)
        raise
    discard(records, copies)
    return info


def left_out(spark: SparkSession, out: str) -> DataFrame:
    """file_id, row_no of the copies that a compaction to ``out`` left out."""
    return spark.read.schema("file_id bigint, row_no bigint").parquet(f"{out.rstrip('/')}/_copies")
