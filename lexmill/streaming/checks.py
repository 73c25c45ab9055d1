"""Checks over streams of documents.

Checks need windows over the tokens of a document, which a stream cannot have; each micro-batch is an ordinary table, so
the batch functions run on it as they are. A document is checked in the batch that brings it; there is no state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def check_stream(docs: DataFrame, check: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs check on every micro-batch of docs and writes its findings as Parquet, a folder a batch, so a batch that is run again replaces its own."""

    def batch(rows: DataFrame, epoch: int) -> None:
        check(rows).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()
