"""Incremental runs: only rows without an answer go to a model, and each finished micro-batch is kept.

The stream reads a stage's files, takes what is there, and ends; its checkpoint remembers files done, each micro-batch appends its own
Parquet files under its number, so that a repeated micro-batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def pending(df: DataFrame, done: DataFrame | None, keys: list[str], answer: str) -> DataFrame:
    """Rows that have no answer yet, neither themselves nor in the checkpoint."""
    left = df.where(F.col(answer).isNull()) if answer in df.columns else df
    return left if done is None else left.join(done.where(F.col(answer).isNotNull()).select(*keys).distinct(), keys, "left_anti")


def run_available(spark: SparkSession, source: str, schema: StructType, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Apply step to all files of source that have not been done yet, then end."""

    def finish(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(finish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
