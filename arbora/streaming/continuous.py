"""Queries over streams: each micro-batch is a collection, so any query of the language runs on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from arbora.engine import Engine


def continuous(engine: Engine, name: str, stream: DataFrame, query: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Starts the query over a stream registered as `name`; sink gets each batch's result and its number.

    Exactly once if the sink is idempotent in the number. Queries of filters and projections give the same rows as over
    the whole stream; groups and windows are of one batch.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        sink(Engine(df.sparkSession, engine.base).register(name, df).query(query), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
