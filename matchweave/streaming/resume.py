"""Resumable work as a stream: pairs arrive in files, each is worked on once, and a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from matchweave.sources.readers import append_new


def process_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Runs ``work`` over all rows that have come in since the last run and appends the results whose keys the sink lacks.

    The checkpoint keeps which files were read; the anti-join on the keys makes a repeated batch harmless.
    """

    def batch(rows: DataFrame, _: int) -> None:
        append_new(work(rows), sink, keys)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
