"""Error analysis, audits, profiles and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import link_outcomes, share
from .policy import base_threshold, count_bin


def error_stages(truth: DataFrame, scores: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each true link with the first stage that lost it, or TP."""
    s = scores.select("s1", "target", "score", "source")
    p = predictions.select("s1", "target", F.lit(1).alias("told"))
    df = truth.select("s1", "target").join(s, ["s1", "target"], "left").join(p, ["s1", "target"], "left")
    stage = F.when(F.col("score").isNull(), "A_blocking_miss").when(F.col("score") < base_threshold(F.col("source")), "B1_below_threshold").when(F.col("told").isNull(), "B2_ownership_conflict").otherwise("TP")
    return df.withColumn("stage", stage)


def fp_category(score: Column, threshold: Column, candidates: Column, contested: Column) -> Column:
    return (
        F.when(score >= 0.99, "C1_high_confidence").when(score < threshold + 0.02, "C2_near_threshold").when(contested, "C3_target_conflict_related")
        .when(candidates > 500, "C4_crowded_candidate_set").otherwise("C5_other")
    )


def false_positives(truth: DataFrame, scores: DataFrame, predictions: DataFrame, selected: DataFrame) -> DataFrame:
    """Each wrong prediction with its category; `selected` are the pairs before ownership."""
    n = scores.withColumn("n", F.count("*").over(Window.partitionBy("s1", "source"))).select("s1", "target", "source", "score", "n")
    fought = selected.groupBy("target").agg((F.count("*") > 1).alias("contested"))
    wrong = predictions.select("s1", "target").join(truth.select("s1", "target"), ["s1", "target"], "left_anti")
    df = wrong.join(n, ["s1", "target"]).join(fought, "target")
    return df.withColumn("category", fp_category(F.col("score"), base_threshold(F.col("source")), F.col("n"), F.col("contested")))


# Where the bins of a score end, by source.
SCORE_EDGES = {"S2": (0.50, 0.80, 0.90, 0.93, 0.97, 0.99), "S3": (0.50, 0.80, 0.90, 0.95, 0.97, 0.99)}


def score_bin(score: Column, source: Column) -> Column:
    """Label of the half-open bin that holds the score of a pair of `source`; the first and the last are open."""

    def of(edges: tuple[float, ...]) -> Column:
        out = F.when(score < edges[0], f"<{edges[0]:.2f}")
        for low, high in zip(edges, edges[1:], strict=False):
            out = out.when(score < high, f"{low:.2f}-{high:.2f}")
        return out.when(score >= edges[-1], f">={edges[-1]:.2f}")

    out = F.lit(None).cast("string")
    for name, edges in SCORE_EDGES.items():
        out = F.when(source == name, of(edges)).otherwise(out)
    return out


def f05_bin(v: Column) -> Column:
    return F.when(v == 1.0, "1.00").when(v >= 0.75, "0.75-<1").when(v >= 0.50, "0.50-<0.75").when(v > 0, ">0-<0.50").otherwise("0")


def agreement_bucket(missing: Column, exact: Column, ratio: Column) -> Column:
    return F.when(missing, "missing").when(exact | (ratio >= 0.95), "exact_or_very_high").when(ratio >= 0.70, "medium").otherwise("weak")


def slice_dimensions() -> Column:
    """Seven (dimension, bucket) rows of a featured pair, to explode."""
    c = lambda n: F.col(n) > 0
    name_gone, address_gone = c("name_missing_left") | c("name_missing_right"), c("address_missing_left") | c("address_missing_right")
    values = {
        "name_condition": agreement_bucket(name_gone, c("name_basic_exact") | c("name_core_exact"), F.col("name_ratio")),
        "address_condition": agreement_bucket(address_gone, c("address_exact"), F.col("address_ratio")),
        "numeric": F.when(c("numeric_shared"), "shared").when(c("numeric_conflict"), "conflict").otherwise("neither"),
        "postal": F.when(c("postal_shared"), "shared").when(c("postal_conflict"), "conflict").otherwise("missing"),
        "country": F.when(c("country_equal"), "same").when(c("country_missing_left") | c("country_missing_right"), "missing").otherwise("conflict"),
        "completeness": F.when(name_gone, "name_missing").when(address_gone, "address_missing").otherwise("both_available"),
        "candidate_ambiguity": count_bin(F.col("candidate_count_source")),
    }
    return F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("bucket")) for k, v in values.items()])


def slice_report(featured: DataFrame) -> DataFrame:
    """Support, hits and shares by dimension and bucket; featured rows carry is_true, is_predicted, retrieved."""
    t, p, r = F.col("is_true"), F.col("is_predicted"), F.col("retrieved")
    cut = featured.select(t, p, r, F.explode(slice_dimensions()).alias("d")).select("is_true", "is_predicted", "retrieved", "d.*")
    out = cut.groupBy("dimension", "bucket").agg(
        F.count_if(t).alias("support"), F.count_if(t & r).alias("retrieved_truth"), F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp")
    )
    c = F.col
    return out.withColumns({"retrieval_recall": F.try_divide("retrieved_truth", "support"), "policy_recall": F.try_divide("tp", "retrieved_truth"), "precision": F.try_divide(c("tp"), c("tp") + c("fp"))})


def slice_metrics(truth: DataFrame, predictions: DataFrame, scores: DataFrame, universe: DataFrame) -> DataFrame:
    """Macro F0.5 of each source and candidate-count bin, over sets restricted to the source."""
    from .metrics import counts, f05

    src = scores.select("target", "source").distinct()
    links = link_outcomes(truth, predictions).join(src, "target")
    by = links.groupBy("s1", "source").agg(*counts())
    n = scores.groupBy("s1", "source").agg(F.count("*").alias("n"))
    every = universe.join(F.broadcast(scores.select("source").distinct()), how="cross")
    df = every.join(by, ["s1", "source"], "left").join(n, ["s1", "source"], "left").na.fill(0, ["tp", "fp", "fn", "n"])
    df = df.withColumns({"bin": count_bin(F.col("n")), "f": f05(F.col("tp"), F.col("fp"), F.col("fn"))})
    return df.groupBy("source", "bin").agg(F.count("*").alias("entities"), F.avg("f").alias("macro_f05"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


RANK_BINS = ("1", "2-3", "4-5", "6-10")


def rank_bin(rank: Column) -> Column:
    return F.when(rank == 1, "1").when(rank <= 3, "2-3").when(rank <= 5, "4-5").when(rank <= 10, "6-10")


def address_rank_distribution(ranked: DataFrame, truth: DataFrame, source_of: Column) -> DataFrame:
    """True links by rank bin of each source, with running totals; empty bins stay."""
    spark = ranked.sparkSession
    hits = ranked.join(truth.select("s1", "target"), ["s1", "target"]).groupBy("source", rank_bin(F.col("rank")).alias("rank_bin")).agg(F.count("*").alias("hits"))
    bins = spark.createDataFrame([(i, b) for i, b in enumerate(RANK_BINS)], "ord int, rank_bin string")
    total = truth.groupBy(source_of.alias("source")).agg(F.count("*").alias("links"))
    df = total.join(F.broadcast(bins), how="cross").join(hits, ["source", "rank_bin"], "left").na.fill(0, ["hits"])
    upto = F.sum("hits").over(Window.partitionBy("source").orderBy("ord"))
    df = df.withColumns({"cumulative_hits": upto, "_all": F.sum("hits").over(Window.partitionBy("source"))})
    c = F.col
    return df.select("source", "rank_bin", "hits", "cumulative_hits", share(c("hits"), c("_all")).alias("share_of_hits"), share(c("cumulative_hits"), c("links")).alias("cumulative_share_of_links"))


def ownership_summary(selected: DataFrame, predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row on targets that several entities claim: gaps, who was right, links removed."""
    w = Window.partitionBy("target").orderBy(F.desc("score"), "s1")
    true = truth.select("s1", "target", F.lit(True).alias("t"))
    kept = predictions.select("s1", "target", F.lit(True).alias("k"))
    df = selected.join(true, ["s1", "target"], "left").join(kept, ["s1", "target"], "left").na.fill(False, ["t", "k"])
    df = df.withColumns({"r": F.row_number().over(w), "gap": F.col("score") - F.lead("score").over(w)})
    first, lost = F.col("r") == 1, (F.col("r") > 1) & ~F.col("k")
    by = df.groupBy("target").agg(
        F.count("*").alias("n"), F.max(F.when(first, F.col("gap"))).alias("gap"), F.bool_or(first & F.col("t")).alias("win"), F.bool_or((F.col("r") > 1) & F.col("t")).alias("lose"),
        F.count_if(lost).alias("gone"), F.count_if(lost & F.col("t")).alias("gone_true"),
    ).where("n > 1")
    n = lambda cond, name: F.count_if(cond).alias(name)
    win, lose, gap = F.col("win"), F.col("lose"), F.col("gap")
    return by.agg(
        F.count("*").alias("conflicted_targets"), n(gap < 0.01, "tiny_gaps"), n(gap >= 0.05, "large_gaps"), n(win & lose, "both_true"), n(win & ~lose, "winner_true"), n(~win & lose, "loser_true"), n(~win & ~lose, "none_true"),
        F.coalesce(F.sum("gone"), F.lit(0)).alias("links_removed"), F.coalesce(F.sum("gone_true"), F.lit(0)).alias("tp_removed"), F.coalesce(F.sum(F.col("gone") - F.col("gone_true")), F.lit(0)).alias("fp_removed"),
        F.percentile("gap", 0.5).alias("gap_median"), F.percentile("gap", 0.95).alias("gap_p95"),
    )


def compare_findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Loss stages of two splits (finding, n): counts, shares of all losses, and whether they agree within .05."""
    f = lambda df, n: df.where("finding <> 'TP'").select("finding", F.col("n").alias(n))
    total = lambda df, n: df.where("finding <> 'TP'").agg(F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0))).alias(n))
    df = f(a, "tune_n").join(f(b, "validation_n"), "finding", "full").na.fill(0).join(total(a, "ta"), how="cross").join(total(b, "tb"), how="cross")
    x, y = F.col("tune_n") / F.col("ta"), F.col("validation_n") / F.col("tb")
    kind = F.when(F.abs(x - y) <= 0.05, "ROBUST").when(x > y, "TUNE_ONLY").otherwise("VALIDATION_ONLY")
    return df.select("finding", "tune_n", "validation_n", x.alias("tune_share"), y.alias("validation_share"), kind.alias("classification"))


def prediction_diff(old: DataFrame, new: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: entities unchanged and changed, links added and removed, entities that became or ceased to be alone."""
    both = link_outcomes(old, new)  # is_true: in old; is_predicted: in new
    by = both.groupBy("s1").agg(F.count_if("is_true").alias("o"), F.count_if("is_predicted").alias("n"), F.count_if(F.col("is_predicted") & ~F.col("is_true")).alias("plus"), F.count_if(F.col("is_true") & ~F.col("is_predicted")).alias("minus"))
    df = universe.join(by, "s1", "left").na.fill(0)
    c = F.col
    return df.agg(
        F.count_if((c("plus") == 0) & (c("minus") == 0)).alias("identical"), F.count_if((c("plus") > 0) | (c("minus") > 0)).alias("changed"), F.sum("plus").alias("added"), F.sum("minus").alias("removed"),
        F.count_if((c("o") > 0) & (c("n") == 0)).alias("became_alone"), F.count_if((c("o") == 0) & (c("n") > 0)).alias("no_longer_alone"),
    )


def route_exclusives(found: DataFrame) -> DataFrame:
    """Links found by one route only, by route; `found` has s1, target, route."""
    return found.groupBy("s1", "target").agg(F.collect_set("route").alias("r")).where(F.size("r") == 1).groupBy(F.col("r")[0].alias("route")).agg(F.count("*").alias("exclusive"))


def hashed_sample(rows: DataFrame, by: str, key: list[str], most: int, seed: str) -> DataFrame:
    """The `most` rows of each category of the smallest hash: a bounded review sample."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *key), 256)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(h, *key))).where(F.col("_r") <= most).drop("_r")


def membership_hash(pairs: DataFrame) -> DataFrame:
    """Rows and an order-free 64-bit hash of a pair set."""
    return pairs.agg(F.count("*").alias("pairs"), F.bit_xor(F.xxhash64("s1", "target")).alias("hash"))


def ids_digest(ids: DataFrame, key: str) -> DataFrame:
    """SHA-256 of the sorted ids, one a line. The ids become one value: for id lists that fit a row."""
    joined = F.concat(F.array_join(F.array_sort(F.collect_set(key)), "\n"), F.lit("\n"))
    return ids.agg(F.sha2(joined, 256).alias("digest"))
