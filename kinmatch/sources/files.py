"""Readers and writers of entity tables, id lists, link lists, postings and scores."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import ENTITY
from ..operators.validation import link_rows, require_empty, valid_id, valid_list


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A TSV file with a header that must name the columns; blanks are empty strings, never null."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("emptyValue", "").option("nullValue", "\0").csv(path)
    return df.na.fill("")


def read_entities(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """An entity table whose ids carry `prefix`; a row of another shape is an error."""
    df = read_tsv(spark, path, ENTITY)
    require_empty(df.where(~valid_id(F.col("entity_id"), prefix)), f"an id of {path} lacks the prefix {prefix}")
    return df


def selected(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """The entities of `ids` (s1); one missing or repeated is an error."""
    out = entities.join(ids.select(F.col("s1").alias("entity_id")), "entity_id", "left_semi")
    require_empty(ids.join(entities.select(F.col("entity_id").alias("s1")), "s1", "left_anti"), "a wanted id is missing")
    require_empty(out.groupBy("entity_id").count().where("count > 1"), "a wanted id is repeated")
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines are passed over and repeated ids are an error."""
    ids = spark.read.text(path).select(F.trim("value").alias("s1")).where(F.col("s1") != "")
    require_empty(ids.groupBy("s1").count().where("count > 1"), f"an id of {path} is repeated")
    return ids


def write_ids(ids: DataFrame, path: str) -> None:
    ids.select("s1").orderBy("s1").write.text(path)


def read_links(spark: SparkSession, path: str, columns: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> tuple[DataFrame, DataFrame]:
    """(universe, links) of a two-column table of comma lists."""
    rows = read_tsv(spark, path, f"{columns[0]} string, {columns[1]} string")
    require_empty(rows.groupBy(columns[0]).count().where("count > 1"), f"a row of {path} is repeated")
    require_empty(rows.where(~valid_list(F.col(columns[1]))), f"a list of {path} is malformed")
    return rows.select(F.col(columns[0]).alias("s1")), link_rows(rows, *columns)


def as_lists(links: DataFrame, universe: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row an entity: its targets sorted and comma-joined, blank without any."""
    by = links.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias(column))
    return universe.join(by, "s1", "left").na.fill("", [column])


def write_lists(links: DataFrame, universe: DataFrame, path: str, column: str = "matched_entity_ids") -> None:
    out = as_lists(links, universe, column).withColumnRenamed("s1", "source1_entity_id").orderBy("source1_entity_id")
    out.write.option("sep", "\t").option("header", True).option("compression", "gzip").option("emptyValue", "").csv(path)


def write_postings(postings: DataFrame, path: str) -> None:
    """The inverted index, partitioned so that a probe reads one source and kind."""
    postings.write.partitionBy("source", "kind").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.partitionBy("source").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` without the keys of `new`, and `new`."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append_experiment(log: DataFrame, row: DataFrame, allow_repeated: bool = False) -> DataFrame:
    """The log with one more row; a name that is there already is an error unless allowed."""
    if not allow_repeated:
        require_empty(log.join(row.select("experiment_name"), "experiment_name", "left_semi"), "this experiment is logged already")
    return log.unionByName(row, allowMissingColumns=True)


def write_json(path: str, payload: dict) -> None:
    """A small report, put in place at once."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, sort_keys=True)
    os.replace(f"{path}.new", path)
