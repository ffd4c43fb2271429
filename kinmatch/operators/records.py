"""Entity records: raw columns and normalised forms, computed once an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ENTITY = "entity_id string, business_name string, business_address string, country string"


def normalized(entities: DataFrame) -> DataFrame:
    """entity_id, source, country, basic, core, their tokens, address forms, numbers and postals.

    `name_tokens`, those of the index, are the tokens of the core name of three characters and more: legal forms are none.

    Postal codes of the US are cut to five digits and digits of postal codes
    are not numbers in the record view (`numbers`, `postals`); the index view
    (`all_numbers`, `all_postals`) keeps both whole.
    """
    return derived(folded(entities))


def folded(entities: DataFrame) -> DataFrame:
    """The forms that cost time to make; a name is held once (its core is the start of it). `derived` makes the rest, and is cheap."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = entities.select(
        "entity_id",
        F.substring("entity_id", 1, 2).alias("source"),
        T.normalize_text("country").alias("country"),
        T.nfkc_casefold(blank("business_name")).alias("_name"),
        T.nfkc_casefold(blank("business_address")).alias("_folded"),
        T.nfkc(blank("business_address")).alias("_raw"),
    )
    df = df.withColumn("basic", T.name_of_folded(F.col("_name")))
    return df.select(
        "entity_id", "source", "country", "basic", F.length(T.core_of_name(F.col("basic"))).alias("core_length"),
        T.address_of_folded(F.col("_folded")).alias("address"), T.standardize_folded(F.col("_folded")).alias("standard"),
        F.array_distinct(T.digit_runs(F.col("_raw"))).alias("all_numbers"), F.array_distinct(T.postal_of(F.col("_raw"), F.col("country"))).alias("all_postals"),
    )


def derived(df: DataFrame) -> DataFrame:
    """The records of `folded` forms."""
    df = df.withColumn("core", F.substring("basic", F.lit(1), F.col("core_length")))
    inside = F.flatten(F.transform("all_postals", lambda p: T.digit_runs(p)))
    cut = F.transform("all_postals", lambda p: F.when(F.col("country") == "us", F.substring(p, 1, 5)).otherwise(p))
    return df.select(
        "entity_id", "source", "country", "basic", "core", "address", "standard",
        F.array_distinct(F.filter(T.tokens(F.col("core")), lambda t: F.length(t) >= 3)).alias("name_tokens"),
        F.array_distinct(T.tokens(F.col("core"))).alias("core_tokens"),
        F.array_distinct(T.tokens(F.col("standard"))).alias("address_words"),
        T.strong_words(T.tokens(F.col("standard"))).alias("strong_words"),
        "all_numbers", "all_postals",
        F.array_except("all_numbers", inside).alias("numbers"),
        F.array_distinct(cut).alias("postals"),
    )
