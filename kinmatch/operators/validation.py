"""Validators of entity tables, id lists and submissions; each returns rows of (rule, n, examples)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_id(c: Column, prefix: str) -> Column:
    return c.rlike(rf"^{prefix}-\S+$")


def valid_list(c: Column) -> Column:
    """A comma list of distinct S2 and S3 ids; blank is the empty list."""
    items = F.split(c, ",")
    return (c == "") | ((F.size(F.array_distinct(items)) == F.size(items)) & F.forall(items, lambda e: e.rlike(r"^S[23]-\S+$")))


def parse_list(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def link_rows(lists: DataFrame, key: str, column: str) -> DataFrame:
    """s1, target from a table of comma lists."""
    return lists.select(F.col(key).alias("s1"), F.explode(parse_list(F.coalesce(F.col(column), F.lit("")))).alias("target"))


def offenders(bad: DataFrame, rule: str, key: str) -> DataFrame:
    """(rule, n, examples): distinct offenders and the first five of them. Only five rows are gathered."""
    ids = bad.select(F.col(key).cast("string").alias("id")).distinct()
    five = ids.orderBy("id").limit(5).agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return ids.agg(F.count("*").alias("n")).join(five, how="cross").select(F.lit(rule).alias("rule"), "n", "examples")


def union(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1")


def check_entities(entities: DataFrame, *prefixes: str) -> DataFrame:
    """Ids of a wrong shape (none of the prefixes, no tail, white space), and repeated ids."""
    return union([
        offenders(entities.where(~F.coalesce(valid_id(F.col("entity_id"), f"(?:{'|'.join(prefixes)})"), F.lit(False))), "bad_id", "entity_id"),
        offenders(repeated(entities, "entity_id"), "repeated_id", "entity_id"),
    ])


def check_lists(lists: DataFrame, universe: DataFrame, known: DataFrame | None = None, key: str = "s1", column: str = "targets") -> DataFrame:
    """Repeated rows, malformed lists, rows of no entity, entities without a row, and unknown targets."""
    text = F.coalesce(F.col(column), F.lit(""))
    out = [
        offenders(repeated(lists, key), "repeated_row", key),
        offenders(lists.where(~valid_list(text)), "bad_list", key),
        offenders(lists.join(universe.select(F.col("s1").alias(key)), key, "left_anti"), "unknown_s1", key),
        offenders(universe.join(lists.select(F.col(key).alias("s1")), "s1", "left_anti"), "missing_s1", "s1"),
    ]
    if known is not None:
        out.append(offenders(link_rows(lists, key, column).join(known.select(F.col("entity_id").alias("target")), "target", "left_anti"), "unknown_target", "target"))
    return union(out)


def check_submission(matches: DataFrame, candidates: DataFrame, universe: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Both lists, and matches that are no candidates."""
    loose = link_rows(matches, "s1", "targets").join(link_rows(candidates, "s1", "targets"), ["s1", "target"], "left_anti")
    tag = lambda df, t: df.withColumn("rule", F.concat(F.lit(f"{t}:"), F.col("rule")))
    return union([tag(check_lists(matches, universe, known), "matches"), tag(check_lists(candidates, universe, known), "candidates"), offenders(loose, "match_not_candidate", "target")])


def check_scores(scores: DataFrame) -> DataFrame:
    """One row: rows, repeated pairs, sources that differ from the target's prefix, scores out of range."""
    c = F.col
    flags = scores.agg(
        F.count("*").alias("rows"), F.count_if(~c("target").startswith(F.concat(c("source"), F.lit("-")))).alias("bad_source"),
        F.count_if(c("score").isNull() | F.isnan("score") | ~c("score").between(0, 1)).alias("bad_score"),
    )
    return flags.join(repeated(scores, "s1", "target").agg(F.count("*").alias("repeated")), how="cross")


def require_empty(bad: DataFrame, message: str) -> None:
    """Raises if `bad` has a row; reads no more than it needs."""
    if not bad.isEmpty():
        raise ValueError(message)
