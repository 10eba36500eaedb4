"""Ingest from a stream: every micro-batch is appended to a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shardloom.sources.collection import Collection


def append_stream(stream: DataFrame, collection: Collection, checkpoint: str, stream_id: str | None = None, **add) -> StreamingQuery:
    """Append micro-batches by ``foreachBatch``; ``add`` goes to ``Collection.add``.

    The stream (``stream_id``, by default its checkpoint folder) and the batch's number are
    committed in the manifest together with the rows, so a batch that is run again, whenever the
    failure came, is appended once; streams with checkpoints of their own do not meet."""
    name = stream_id or checkpoint.rstrip("/")

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            collection.add([batch], token=(name, number), **add)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
