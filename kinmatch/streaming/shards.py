"""Resumable shard scoring: candidate files come as a stream, each is scored once, and ownership is settled at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.policy import DecisionPolicy, decide


def score_shards(spark: SparkSession, source: str, schema: str, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_a_batch: int = 8) -> None:
    """Scores the Parquet files below `source` that were not scored before; the checkpoint is what makes it resume."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    scorer(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def settle(spark: SparkSession, out: str, policy: DecisionPolicy = DecisionPolicy()) -> DataFrame:  # noqa: B008
    """Ownership is a reduction over all shards, so it stays a batch over what was scored."""
    return decide(spark.read.parquet(out), policy)
