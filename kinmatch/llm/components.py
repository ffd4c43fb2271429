"""Connected components by alternating large-star and small-star rounds, with nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to its smallest one."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the smallest one."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return others.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (its smallest vertex) of every vertex with an edge (a, b) to another. Staged."""
    now = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    state = _state(now)
    while True:
        new = staged(_small(_large(now).distinct()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        drop_staged(now)
        now, before = new, state
        state = _state(now)
        if state == before:
            break
    out = staged(now.select(F.col("b").alias("vertex"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("vertex"), F.col("a").alias("component"))).distinct(), "components")
    drop_staged(now)
    return out
