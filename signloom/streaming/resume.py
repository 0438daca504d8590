"""Incremental work on append logs: each landed row is handled once, however often the job is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from signloom.operators.joins import not_in


def run_available(spark: SparkSession, landing: str, schema: T.StructType, log: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Append the transformed new rows of a JSON landing folder to a parquet log, and stop; the checkpoint remembers what was read."""
    rows = spark.readStream.schema(schema).json(landing)
    return transform(rows).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(batch: DataFrame, log_rows: DataFrame | None, log: str, key: str) -> None:
    """For ``foreachBatch``: rows whose key the log lacks are appended; a key twice in a batch is kept once."""
    fresh = batch.dropDuplicates([key])
    (fresh if log_rows is None else not_in(fresh, log_rows, [key])).write.mode("append").parquet(log)


def replay(spark: SparkSession, log: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The transform over the whole log, without ingesting anything."""
    return transform(spark.read.parquet(log))
