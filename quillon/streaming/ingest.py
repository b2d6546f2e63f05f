"""Structured Streaming forms: orphan state and document ingest, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.orphans import OrphanState

#: Columns of an event stream that carries all changes of the orphan state.
EVENTS = "kind string, id long, side string, target_table string, key string, at timestamp_ntz"


def follow_orphans(events: DataFrame, state: OrphanState, checkpoint: str, **trigger) -> StreamingQuery:
    """Advance ``state`` by every micro-batch of :data:`EVENTS`; ``kind`` is reference, parent, removal or deletion.

    The number of the last batch is part of the state's folder: opened on the same
    ``path`` after a restart, the state goes on where it was, and a batch that Spark
    replays is skipped.  Keep the checkpoint and the state's folder together.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            refs = batch.where("kind = 'reference'").selectExpr("id", "side", "target_table", "key", "at as created_at")
            parents = batch.where("kind in ('parent', 'removal')").selectExpr("target_table", "key", "at as seen_at", "if(kind = 'parent', 1, -1) as op")
            gone = batch.where("kind = 'deletion'").select("target_table", "key")
            state.advance(refs, parents, gone, batch=number)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def ingest_documents(documents: DataFrame, index: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append ``index`` of every micro-batch of new documents to the table at ``path``; a replayed batch overwrites its own part."""

    def step(batch: DataFrame, number: int) -> None:
        index(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
