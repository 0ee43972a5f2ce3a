"""Continuous loading: a stream of records becomes one commit for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph


def ingest_stream(graph: Graph, records: DataFrame, checkpoint: str, branch: str = "main", mode: str = "merge", **trigger) -> StreamingQuery:
    """Load a streaming DataFrame (column value, a record a row) batch by batch.

    A batch's number is kept in its commit, so a batch that is run again after a failure
    is not loaded twice.
    """
    stream = checkpoint.rstrip("/")

    def load(batch: DataFrame, number: int) -> None:
        done = {"stream": stream, "batch": number}
        if not any(c.note.get("stream") == stream and c.note.get("batch") == number for c in graph.commits(branch)):
            graph.load(batch, mode, branch, note=done)

    return records.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
