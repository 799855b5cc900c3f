"""Structured Streaming into a graph.

The query model has no stream state, so a stream is a source of batches: each
micro-batch is added by the same checks and schema rules as any other input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..graph import PropertyGraph


def ingest_nodes(graph: PropertyGraph, stream: DataFrame, index: str, path: str, checkpoint: str, group=None, **options) -> StreamingQuery:
    """Append a stream of nodes; batches are kept in ``path`` so that the graph's
    lineage refers to stored tables, and a replayed batch overwrites itself."""

    def add(batch: DataFrame, number: int) -> None:
        stored = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(stored)
        graph.add_nodes((batch.sparkSession.read.schema(batch.schema).parquet(stored), index), group)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**options) if options else writer).start()


def ingest_edges(graph: PropertyGraph, stream: DataFrame, source: str, target: str, path: str, checkpoint: str, group=None, edge_id: str | None = None, **options) -> StreamingQuery:
    """Append a stream of edges in the same way."""

    def add(batch: DataFrame, number: int) -> None:
        stored = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(stored)
        graph.add_edges((batch.sparkSession.read.schema(batch.schema).parquet(stored), source, target), group, edge_id=edge_id)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**options) if options else writer).start()
