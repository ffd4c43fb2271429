"""Logical relations over the driver's tables: link sets, scores, entities; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import nearest
from ..functions.text import LEGAL_SUFFIXES
from ..operators import records
from ..sources.staging import spread, staged
from ..sources.tables import table

CTE = {
    "u": "SELECT o_orderkey AS s1 FROM orders",
    "t": "SELECT DISTINCT l_orderkey AS s1, l_partkey AS target FROM lineitem WHERE l_returnflag = 'A'",
    "p": "SELECT DISTINCT l_orderkey AS s1, l_partkey AS target FROM lineitem WHERE l_linestatus = 'F' AND l_discount <= 0.05",
    "c": "SELECT DISTINCT l_orderkey AS s1, l_partkey AS target FROM lineitem WHERE l_quantity >= 10",
    "c2": "SELECT DISTINCT l_orderkey AS s1, l_partkey AS target FROM lineitem WHERE l_quantity >= 5 OR l_tax < 0.02",
    "m": "SELECT max(l_extendedprice) AS top FROM lineitem",
    "sc": "SELECT l_orderkey AS s1, l_partkey AS target, CASE WHEN l_partkey % 2 = 0 THEN 'S2' ELSE 'S3' END AS source, max(round(l_extendedprice / top * (2 - l_extendedprice / top), 6)) AS score FROM lineitem, m GROUP BY 1, 2, 3",
    "cu": "SELECT s_suppkey AS s1 FROM supplier",
    "ct": "SELECT DISTINCT l_suppkey AS s1, l_partkey AS target FROM lineitem WHERE l_returnflag = 'A'",
    "cs": "SELECT l_suppkey AS s1, l_partkey AS target, CASE WHEN l_partkey % 2 = 0 THEN 'S2' ELSE 'S3' END AS source, max(round(l_extendedprice / top * (2 - l_extendedprice / top), 6)) AS score FROM lineitem, m GROUP BY 1, 2, 3",
    # the frozen policy and its ownership
    "sel": "SELECT * FROM sc WHERE score >= CASE WHEN source = 'S2' THEN 0.93 ELSE 0.97 END",
    "own": "SELECT s1, target, source, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, s1) AS r FROM sel) WHERE r = 1",
}
_NEEDS = {"sc": ["m"], "cs": ["m"], "sel": ["m", "sc"], "own": ["m", "sc", "sel"]}


def with_cte(names: str, body: str) -> str:
    """`body` below the relations it names."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + body


def universe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("s1"))


def _links(spark: SparkSession, d: str, cond: str, s1: str = "l_orderkey") -> DataFrame:
    return table(spark, d, "lineitem").where(cond).select(F.col(s1).alias("s1"), F.col("l_partkey").alias("target")).distinct()


def truth(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, "l_returnflag = 'A'")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, "l_linestatus = 'F' and l_discount <= 0.05")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, "l_quantity >= 10")


def candidates_wider(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, "l_quantity >= 5 or l_tax < 0.02")


def source_of(c: str = "target") -> F.Column:
    return F.when(F.col(c) % 2 == 0, "S2").otherwise("S3")


def scores(spark: SparkSession, d: str, s1: str = "l_orderkey") -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col(s1).alias("s1"), F.col("l_partkey").alias("target"), "l_extendedprice")
    top = table(spark, d, "lineitem").agg(F.max("l_extendedprice").alias("top"))  # one row
    x = F.col("l_extendedprice") / F.col("top")
    return lines.join(F.broadcast(top), how="cross").groupBy("s1", "target", source_of().alias("source")).agg(F.max(nearest(x * (2 - x), 6)).alias("score"))


def crowded_universe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("s1"))


def crowded_truth(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, "l_returnflag = 'A'", "l_suppkey")


def crowded_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d, "l_suppkey")


def doc_entities(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entities of three sources: the whole text is the name."""
    return table(spark, d, "documents").select(
        F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.col("text").alias("business_name"),
        F.concat_ws(" ", F.col("n_chars").cast("string"), "source", F.lit("street,"), "lang", F.lit("district"), F.lpad((F.col("n_chars") % 100000).cast("string"), 5, "0")).alias("business_address"),
        F.col("lang").alias("country"),
    )


def part_entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entities of three sources; few names, so keys are frequent."""
    return table(spark, d, "part").select(
        F.concat(F.lit("S"), (1 + F.col("p_partkey") % 3).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("business_name"),
        F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", F.lit("road")).alias("business_address"),
        F.col("p_type").alias("country"),
    )


ENDS = "|".join(LEGAL_SUFFIXES)
DOC_CTE = rf"""
e0 AS (
  SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, 'S' || (1 + doc_id % 3) AS source, lang AS country,
    trim(regexp_replace(replace(replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '''', ''), '&', ' and '), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g')) AS basic,
    n_chars || ' ' || source || ' street, ' || lang || ' district ' || lpad((n_chars % 100000)::VARCHAR, 5, '0') AS address
  FROM documents
), e AS (
  SELECT *, regexp_replace(basic, '(?:(?:^| )(?:{ENDS}))+$', '') AS core, list_distinct(regexp_extract_all(address, '[0-9]+')) AS numbers,
    list_distinct(list_filter(string_split(trim(regexp_replace(address, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$'))) AS words
  FROM e0
)"""
PART_CTE = """
e AS (
  SELECT 'S' || (1 + p_partkey % 3) || '-' || p_partkey AS entity_id, 'S' || (1 + p_partkey % 3) AS source, lower(p_type) AS country,
    trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS basic,
    regexp_replace(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')), '(?:(?:^| )(?:""" + ENDS + r"""))+$', '') AS core,
    trim(regexp_replace(lower(p_size || ' ' || p_type || ' road'), '[^a-z0-9]+', ' ', 'g')) AS plain_address,
    list_distinct([p_size::VARCHAR]) AS numbers,
    list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_size || ' ' || p_type || ' road'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$'))) AS words
  FROM part
)"""


def queries_and_targets(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first source asks; the other two are asked. Records are normalised once, and their folded forms written by source."""
    df = records.derived(staged(records.folded(spread(entities)), "records", ("source",)))
    return df.where("source = 'S1'"), df.where("source <> 'S1'")
