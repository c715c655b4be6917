"""A stream of changed files into the index: each micro-batch is one refresh of what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from granary.plans.index import RetrievalIndex


def index_stream(changes: DataFrame, index: RetrievalIndex, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Indexes a stream of (root, path, text, size, mtime); a batch delivered twice changes nothing.

    Content hashes make the batches idempotent: a repeated one finds all files unchanged.
    """

    def take(batch: DataFrame, _: int) -> None:
        index.index(batch)

    writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
