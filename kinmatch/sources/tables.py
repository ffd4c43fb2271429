"""Readers of the Parquet tables."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context; nothing to do where it is installed as an archive."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_kinmatch_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="kinmatch-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(str(archive))  # the driver serves it to the executors
    context._kinmatch_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, by any path that Spark can open."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
