"""Structured Streaming into a store: each micro-batch is one commit.

The manifest of a commit says which batch of which stream it holds, so a batch that
is repeated after a failure is not committed again.  A stream goes by the name of
its checkpoint.  Rows at or below the retention floor come too late to be read; they
are put in the store's ``late`` folder.  Compaction runs between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, compact_over: int | None = None, floor: int | None = None, **trigger) -> StreamingQuery:
    """Write a stream of changelog rows; ``trigger`` as in ``writeStream.trigger``.

    Rows may come in any order within a batch: reads choose by version.  After a
    batch that leaves more than ``compact_over`` hot rows the store is compacted.
    """

    def commit(batch: DataFrame, number: int) -> None:
        rows = batch.select(*store.names)
        store.append(lambda base: rows, stream=(checkpoint, number))
        if compact_over is not None and store.tier_stats()["hot"] > compact_over:
            store.compact(floor)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

