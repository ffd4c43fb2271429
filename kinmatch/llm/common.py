"""Shared helpers: tables, staging in the shared folder, distributed running totals."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own on a single machine; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share; set it")
        found = Path(tempfile.mkdtemp(prefix="kinmatch-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinmatch/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of ids (a few numbers each) that are broadcast at most; more are joined by a shuffle.
MOST_IDS = 1_000_000


def counted(ids: DataFrame) -> DataFrame:
    """Staged rows of a few numbers, to be broadcast where their count allows."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def only(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `df` whose `keys` (numbers) are in the staged `ids`."""
    return df.join(counted(ids), keys, "left_semi")


def clean_text(col: Column | str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ranged(df: DataFrame, *keys: str, block: str = "_block", name: str = "ranged") -> DataFrame:
    """`df` staged in key ranges; `block` numbers the ranges in key order. Meant for narrow columns."""
    out = df.repartitionByRange(partitions(df.sparkSession), *keys).withColumn(block, F.spark_partition_id())
    return staged(out, name)


def running_start(df: DataFrame, key: str, value: str, out: str = "start", group: tuple[str, ...] = ()) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows of the same `group` with a smaller `key`.

    Two levels: totals of key ranges are summed in one short window (a row for
    each range and group), rows within a range in another, so no task sees more
    than one range. Ties of `key` are ordered arbitrarily. `df` should be narrow.
    """
    df = ranged(df, *group, key, name="running")
    g = [F.col(x) for x in group]
    sums = df.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*g).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*g, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # the null-safe form keeps rows whose group is null
    for x in group:
        sums = sums.withColumnRenamed(x, f"_g_{x}")
    on = F.col("_block") == F.col("_b")
    for x in group:
        on = on & F.col(x).eqNullSafe(F.col(f"_g_{x}"))
    joined = df.join(sums.withColumnRenamed("_block", "_b"), on, "left")
    total = (F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long")
    return joined.withColumn(out, total).drop("_block", "_b", "_before", *[f"_g_{x}" for x in group])


def gapless(df: DataFrame, group: str, order: tuple[str, ...], out: str, rows_a_block: int = 20_000) -> DataFrame:
    """Adds `out`, numbers gapless from 0 within each `group`, in no promised order.

    Rows of a group are dealt over blocks by a hash of `order`; blocks are
    counted first and then numbered apart, so that a group of any size is
    spread. `df` is read three times: stage it first.
    """
    blocks = max(16, df.count() // rows_a_block + 1)
    df = df.withColumn("_block", F.pmod(F.xxhash64(*[F.coalesce(c, F.lit(0)) for c in order]), F.lit(blocks)))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(group, "_block").orderBy(*order)
    numbered = df.join(counts, [group, "_block"])
    return numbered.withColumn(out, (F.col("_before") + F.row_number().over(within) - 1).cast("long")).drop("_block", "_before")


@functools.cache
def _trim():
    """The C library's call that returns freed memory, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def give_back() -> None:
    """Returns freed memory of a Python worker, which lives on after its task, to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run):
    """`run` over Arrow batches; what it freed goes back to the system at its end."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch: very long texts come in batches of bounded memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that is not read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_staged(df: DataFrame) -> None:
    """Deletes a staged table whose rows are not needed any more, and lets go of the shuffles behind it."""
    import gc

    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        forget(df.sparkSession, path)
    gc.collect()
    df.sparkSession._jvm.System.gc()
