"""Sessions and the shared folder in which lineage is cut.

Executors may be lost at any time, so intermediate results that are read more
than once are *written* to a folder all executors share (``materialize``); no
block that exists once only, on one executor, is ever depended on.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Session settings that every plan in the package is written for.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A partition of more than 5 medians and 256 MB is split; sides below 10 MB are broadcast.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("shardloom").config("spark.driver.memory", memory)
    for k, v in CONF.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (a local
    test session) one is made below the temporary folder and remembered."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.shardloom.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.shardloom.dir", found)
    return found.rstrip("/")


_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, the
    work is done once, and the loss of an executor costs nothing. The folder is deleted
    by ``discard``, at the end of a ``scratch`` block, or when the program ends."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shardloom_path = path
    return out


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted with the others."""
    path = os.path.join(shared_dir(spark), "shardloom", uuid.uuid4().hex, tag)
    _written[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    _written.pop(path, None)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames; nothing may read them any more."""
    for df in frames:
        if (path := getattr(df, "_shardloom_path", None)) in _written:
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Everything that operators write down inside the block is deleted at its end; results
    must have been consumed or written by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            _delete(_written[path], path)


def _clean() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)


atexit.register(_clean)
