"""Derived relations kept up to date by a stream of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import Materialized
from ..sources.facts import relation


def maintain(stream: DataFrame, pred: str, model: Materialized, checkpoint: str, **trigger) -> StreamingQuery:
    """Insert each micro-batch of the stream as facts of ``pred``; the rules follow semi-naively.

    Rows that are already known change nothing, so a batch that is repeated after a failure is harmless.
    """

    def each(batch: DataFrame, _: int) -> None:
        model.insert({pred: relation(batch)})

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
