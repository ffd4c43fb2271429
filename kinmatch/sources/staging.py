"""Tables written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own on a single machine; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share; set it")
        found = Path(tempfile.mkdtemp(prefix="kinmatch-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`df` written once and read back: cuts lineage and survives lost executors. `by` names columns that readers filter by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinmatch/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, where its files make fewer partitions than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
