"""Exact evaluation: link errors, macro F0.5 per entity, candidate diagnostics, binary metrics.

truth and predictions are link rows (s1, target) beside a universe of s1, so
that entities without links count. Shares of nothing are 0, as the rules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def link_outcomes(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """s1, target, is_true, is_predicted: the full outer join of the two link sets."""
    t = truth.select("s1", "target", F.lit(True).alias("is_true"))
    p = predictions.select("s1", "target", F.lit(True).alias("is_predicted"))
    out = t.join(p, ["s1", "target"], "full")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_true", "is_predicted")})


def counts() -> list[Column]:
    t, p = F.col("is_true"), F.col("is_predicted")
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")]


def f05(tp: Column, fp: Column, fn: Column) -> Column:
    """F0.5 of one entity; nothing true and nothing predicted is 1, no hit otherwise 0."""
    return F.when(tp + fp + fn == 0, 1.0).when(tp == 0, 0.0).otherwise(1.25 * tp / (1.25 * tp + fp + 0.25 * fn))


def entity_scores(truth: DataFrame, predictions: DataFrame, universe: DataFrame) -> DataFrame:
    """s1, tp, fp, fn, n_true, n_predicted, f05 of every entity of the universe."""
    by = link_outcomes(truth, predictions).groupBy("s1").agg(*counts())
    out = universe.select("s1").join(by, "s1", "left").na.fill(0, ["tp", "fp", "fn"])
    c = F.col
    return out.withColumns({"n_true": c("tp") + c("fn"), "n_predicted": c("tp") + c("fp"), "f05": f05(c("tp"), c("fp"), c("fn"))})


def macro_report(scores: DataFrame) -> DataFrame:
    """One row: macro F0.5, link precision and recall, singletons, and kinds of entities."""
    c = F.col
    alone = c("n_true") == 0
    out = scores.agg(
        F.count("*").alias("entities"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f05").alias("macro_f05"),
        F.count_if(alone).alias("true_singletons"), F.count_if(c("n_predicted") == 0).alias("predicted_singletons"),
        F.count_if(alone & (c("n_predicted") == 0)).alias("correct_singletons"), F.count_if(alone & (c("n_predicted") > 0)).alias("false_merges"),
        F.count_if(~alone & (c("fp") == 0) & (c("fn") == 0)).alias("perfect"), F.count_if(~alone & (c("tp") > 0) & (c("fp") + c("fn") > 0)).alias("partial"),
        F.count_if(~alone & (c("tp") == 0)).alias("missed"),
    )
    return out.withColumns({"precision": share(c("tp"), c("tp") + c("fp")), "recall": share(c("tp"), c("tp") + c("fn"))})


def macro_f05(truth: DataFrame, predictions: DataFrame, universe: DataFrame) -> DataFrame:
    return macro_report(entity_scores(truth, predictions, universe))


def link_counts(truth: DataFrame, predictions: DataFrame, by: Column) -> DataFrame:
    """Link errors, precision and recall for each value of `by` (of a target)."""
    out = link_outcomes(truth, predictions).groupBy(by.alias("source")).agg(*counts())
    c = F.col
    return out.withColumns({"precision": share(c("tp"), c("tp") + c("fp")), "recall": share(c("tp"), c("tp") + c("fn"))})


def coverage(universe: DataFrame, links: DataFrame) -> DataFrame:
    """Entities without a row, and rows of no entity."""
    told = links.select("s1").distinct()
    missing = universe.join(told, "s1", "left_anti").agg(F.count("*").alias("missing"))
    return missing.join(told.join(universe, "s1", "left_anti").agg(F.count("*").alias("extra")), how="cross")


def distribution(sizes: DataFrame, c: str = "n") -> DataFrame:
    """Mean, quantiles (linear), maximum, and shares of zero and of more than 1000."""
    q = lambda p: F.percentile(c, p)
    return sizes.agg(
        F.avg(c).alias("mean"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max(c).alias("max"),
        (F.count_if(F.col(c) == 0) / F.count("*")).alias("zero_share"), (F.count_if(F.col(c) > 1000) / F.count("*")).alias("over_1000_share"),
    )


def sizes(universe: DataFrame, links: DataFrame) -> DataFrame:
    """s1, n: candidates of each entity, none counted as 0."""
    return universe.join(links.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").na.fill(0, ["n"])


def candidate_diagnostics(truth: DataFrame, predictions: DataFrame, candidates: DataFrame, by: Column) -> DataFrame:
    """By source: true links, retrieved ones, blocking misses, and model misses (retrieved, not predicted)."""
    flag = lambda df, n: df.select("s1", "target", F.lit(True).alias(n)).distinct()
    df = truth.join(flag(candidates, "c"), ["s1", "target"], "left").join(flag(predictions, "p"), ["s1", "target"], "left")
    got, told = F.col("c").isNotNull(), F.col("p").isNotNull()
    out = df.groupBy(by.alias("source")).agg(F.count("*").alias("links"), F.count_if(got).alias("retrieved"), F.count_if(~got).alias("blocking_misses"), F.count_if(got & ~told).alias("model_misses"))
    return out.withColumn("candidate_recall", share(F.col("retrieved"), F.col("links")))


def compare_candidates(truth: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Misses of either candidate set, misses recovered and lost, and growth."""
    flag = lambda df, n: df.select("s1", "target", F.lit(True).alias(n)).distinct()
    df = truth.join(flag(old, "o"), ["s1", "target"], "left").join(flag(new, "n"), ["s1", "target"], "left")
    o, n = F.col("o").isNull(), F.col("n").isNull()
    out = df.agg(F.count_if(o).alias("old_misses"), F.count_if(n).alias("new_misses"), F.count_if(o & ~n).alias("recovered"), F.count_if(~o & n).alias("lost"))
    size = lambda df, name: df.agg(F.count("*").alias(name))
    out = out.join(size(old, "old_pairs"), how="cross").join(size(new, "new_pairs"), how="cross")
    return out.withColumn("growth", F.col("new_pairs") - F.col("old_pairs"))


def binary_metrics(scored: DataFrame, label: str = "label", score: str = "score", buckets: int = 4096) -> DataFrame:
    """Log loss, average precision and ROC area, with ties of a score taken together.

    Rows are counted by score first. Running totals over the distinct scores
    are then taken in two levels (ranges of scores, then within a range), so
    that no task holds them all.
    """
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = scored.agg(F.avg(F.when(F.col(label) > 0, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"), F.count("*").alias("rows"), F.sum(label).cast("long").alias("positives"))
    by = scored.groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("pos"), F.count("*").cast("double").alias("all"))
    by = by.withColumn("r", F.floor(F.col("s") * buckets))
    down = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` ranges of scores in 0..1
    heads = by.groupBy("r").agg(F.sum("pos").alias("rp"), F.sum("all").alias("ra"))
    heads = heads.withColumns({"hp": F.coalesce(F.sum("rp").over(down), F.lit(0.0)), "ha": F.coalesce(F.sum("ra").over(down), F.lit(0.0))}).select("r", "hp", "ha")
    within = Window.partitionBy("r").orderBy(F.desc("s"))
    run = by.join(heads, "r").withColumns({"tp": F.col("hp") + F.sum("pos").over(within), "n": F.col("ha") + F.sum("all").over(within)})
    areas = run.agg(
        F.sum(F.col("pos") * F.col("tp") / F.col("n")).alias("ap"),
        F.sum((F.col("all") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2)).alias("roc"), F.sum("pos").alias("P"), F.sum("all").alias("A"),
    )
    areas = areas.select((F.col("ap") / F.col("P")).alias("pr_auc"), (F.col("roc") / (F.col("P") * (F.col("A") - F.col("P")))).alias("roc_auc"))
    return loss.join(areas, how="cross")
