"""Current state kept up by Structured Streaming: micro-batches are appended to a keyed log.

Readers merge by the ordering tuple, so late and repeated events change nothing, and a batch
that runs again after a failure gives the same state.  A batch writes its own keys only,
whatever the size of the state; compaction rewrites a row a few times over its life.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from folioscope.sources.keyed_log import KeyedLog


def follow(events: DataFrame, table: KeyedLog, checkpoint: str, hooks: list[Callable[[DataFrame, int], None]] | None = None) -> list[str]:
    """Runs a stream of events into the table until its input is used up.

    Hooks run after a batch is taken in; their failures are returned and don't stop the stream.
    """
    failures: list[str] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, batch_id)
        table.compact()
        for hook in hooks or []:
            try:
                hook(batch, batch_id)
            except Exception as e:  # a hook is a side effect; the job goes on
                failures.append(f"{batch_id}: {e}")

    stream = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return failures
