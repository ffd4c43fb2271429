"""Decision policies over scored pairs (s1, target, source, score).

Thresholds are inclusive. Ties go to the smaller s1 (ownership) or the smaller
target (rank). Policies of a grid are rows, joined by broadcast, so that one
pass over the scores serves all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE = {"S2": 0.93, "S3": 0.97}


@dataclass(frozen=True)
class DecisionPolicy:
    s2: float = BASE["S2"]
    s3: float = BASE["S3"]
    open: float | None = None
    conflict: str = "highest"
    margin: float | None = None


def base_threshold(source: Column) -> Column:
    return F.when(source == "S2", BASE["S2"]).otherwise(BASE["S3"])


def moved_threshold(source: Column, *moves: Column) -> Column:
    """The threshold of the source and what moves it, added as decimals: in doubles, .93 + .01 is more than .94, and a score of .94 stays out."""
    limit = F.when(source == "S2", decimal(BASE["S2"])).otherwise(decimal(BASE["S3"]))
    for m in moves:
        limit = limit + m
    return limit.cast("double")


def decimal(x: float) -> Column:
    return F.lit(Decimal(str(x)))


def count_bin(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n <= 25, "1-25").when(n <= 100, "26-100").when(n <= 500, "101-500").otherwise("501+")


def select_pairs(scores: DataFrame, policy: DecisionPolicy) -> DataFrame:
    """Pairs at or above the threshold of their source, of entities whose best score opens the gate."""
    df = scores
    if policy.open is not None:
        df = df.withColumn("_top", F.max("score").over(Window.partitionBy("s1"))).where(F.col("_top") >= policy.open).drop("_top")
    return df.where(F.col("score") >= F.when(F.col("source") == "S2", policy.s2).otherwise(policy.s3))


def resolve(selected: DataFrame, conflict: str = "highest", margin: float | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Ownership of targets: none, highest, or margin (the winner alone if it leads by the margin, else all stay)."""
    if conflict == "none":
        return selected
    w = Window.partitionBy(*within, "target").orderBy(F.desc("score"), "s1")
    df = selected.withColumn("_r", F.row_number().over(w))
    if conflict == "highest":
        return df.where(F.col("_r") == 1).drop("_r")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_gap", F.max("score").over(whole) - F.nth_value("score", 2).over(whole))
    return df.where((F.col("_r") == 1) | (F.col("_gap") < margin)).drop("_r", "_gap")


def decide(scores: DataFrame, policy: DecisionPolicy = DecisionPolicy()) -> DataFrame:  # noqa: B008
    return resolve(select_pairs(scores, policy), policy.conflict, policy.margin)


def with_counts(scores: DataFrame) -> DataFrame:
    return scores.withColumn("n", F.count("*").over(Window.partitionBy("s1", "source")))


def group_policy_a(scores: DataFrame, low: float, crowded: float, by_source: dict[str, float] | None = None) -> DataFrame:
    """Thresholds moved by `low` for up to 100 candidates and by `crowded` above, and by an offset of the source."""
    local = decimal(0.0)
    for s, d in (by_source or {}).items():
        local = F.when(F.col("source") == s, decimal(d)).otherwise(local)
    limit = moved_threshold(F.col("source"), F.when(F.col("n") <= 100, decimal(low)).otherwise(decimal(crowded)), local)
    limit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), limit))
    return resolve(with_counts(scores).where(F.col("score") >= limit).drop("n"))


def a_source_threshold(source: Column, n: Column) -> Column:
    return moved_threshold(source, F.when(n <= 100, decimal(-0.015)).otherwise(decimal(0.015)), F.when(source == "S2", decimal(-0.005)).otherwise(decimal(0.0)))


def group_policy_gap(scores: DataFrame, relax: float, gap: float) -> DataFrame:
    """Where the best of a group leads by `gap`, the whole group's threshold is relaxed."""
    w = Window.partitionBy("s1", "source").orderBy(F.desc("score"), "target")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.first("score").over(whole) - F.nth_value("score", 2).over(whole)
    df = scores.withColumn("_lead", lead)
    limit = moved_threshold(F.col("source"), F.when(F.col("_lead") >= gap, -decimal(relax)).otherwise(decimal(0.0)))
    return resolve(df.where(F.col("score") >= limit).drop("_lead"))


def group_policy_tail(scores: DataFrame, raised: float, crowd: int = 101) -> DataFrame:
    """In groups of `crowd` and more, all but the best must clear a raised threshold."""
    w = Window.partitionBy("s1", "source").orderBy(F.desc("score"), "target")
    df = with_counts(scores).withColumn("_r", F.row_number().over(w))
    limit = F.least(F.lit(1.0), moved_threshold(F.col("source"), F.when((F.col("n") >= crowd) & (F.col("_r") > 1), decimal(raised)).otherwise(decimal(0.0))))
    return resolve(df.where(F.col("score") >= limit).drop("n", "_r"))


# Grids, as rows.
COARSE = tuple((round(0.90 + 0.01 * i, 2), round(0.90 + 0.01 * i, 2)) for i in range(10))
SHARED_OFFSETS = tuple((low, crowded) for low in (-0.015, -0.010, -0.005, 0.0) for crowded in (0.0, 0.005, 0.010, 0.015, 0.020))
GAP_GRID = tuple((relax, gap) for relax in (0.005, 0.010, 0.020) for gap in (0.01, 0.02, 0.03, 0.05, 0.10))
TAIL_GRID = (0.005, 0.010, 0.015)


def sweep(scores: DataFrame, truth: DataFrame, universe: DataFrame, grid: tuple[tuple[float, float], ...] = COARSE) -> DataFrame:
    """Macro F0.5 and link counts of each (s2, s3) pair of thresholds with highest ownership."""
    spark = scores.sparkSession
    policies = F.broadcast(spark.createDataFrame([(float(a), float(b)) for a, b in grid], "s2 double, s3 double"))
    passed = scores.join(policies, F.col("score") >= F.when(F.col("source") == "S2", F.col("s2")).otherwise(F.col("s3")))
    owned = resolve(passed, within=("s2", "s3")).select("s2", "s3", "s1", "target")
    marked = owned.join(truth.select("s1", "target", F.lit(1).alias("hit")), ["s1", "target"], "left")
    by = marked.groupBy("s2", "s3", "s1").agg(F.count("hit").alias("tp"), F.count("*").alias("told"))
    true = universe.join(truth.groupBy("s1").agg(F.count("*").alias("n_true")), "s1", "left").na.fill(0, ["n_true"])
    scored = by.join(true, "s1")
    c = F.col
    gained = 1.25 * c("tp") / (0.25 * c("n_true") + c("told"))
    # an entity without a prediction scores 1 if nothing is true, else 0: told by the rest of the universe
    rest = true.agg(F.count("*").alias("entities"), F.count_if(c("n_true") == 0).alias("alone"), F.sum("n_true").alias("links"))
    out = scored.groupBy("s2", "s3").agg(F.sum(gained).alias("sum_f"), F.count_if(c("n_true") == 0).alias("merged"), F.sum("tp").alias("tp"), F.sum("told").alias("told"))
    out = policies.join(out, ["s2", "s3"], "left").na.fill(0).join(F.broadcast(rest), how="cross")
    return out.select("s2", "s3", "tp", (c("told") - c("tp")).alias("fp"), (c("links") - c("tp")).alias("fn"), ((c("sum_f") + c("alone") - c("merged")) / c("entities")).alias("macro_f05"))


def best(swept: DataFrame) -> DataFrame:
    """The policy of the highest F0.5, then precision, then the higher thresholds."""
    order = [F.desc("macro_f05"), F.desc(F.try_divide("tp", F.col("tp") + F.col("fp"))), F.desc("s2"), F.desc("s3")]
    return swept.orderBy(*order).limit(1)


def context_features(scores: DataFrame) -> DataFrame:
    """The list-wise features of each pair in its group (entity and source) and entity, 33 of 37; provenance flags join on."""
    c = F.col
    group, entity = Window.partitionBy("s1", "source"), Window.partitionBy("s1")
    ranked = group.orderBy(F.desc("score"), "target")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = lambda i: F.coalesce(F.nth_value("score", i).over(whole), F.lit(0.0))
    df = scores.withColumns({
        "candidate_count_source": F.count("*").over(group), "candidate_count_total": F.count("*").over(entity),
        "rank_source": F.row_number().over(ranked), "rank_total": F.row_number().over(entity.orderBy(F.desc("score"), "target")),
        "top_score_source": nth(1), "second_score_source": nth(2), "third_score_source": nth(3),
        "_previous": F.coalesce(F.lag("score").over(ranked), c("score")), "_next": F.coalesce(F.lead("score").over(ranked), c("score")),
        **{f"count_ge_{t}": F.count_if(c("score") >= int(t) / 100).over(group) for t in ("050", "080", "090", "093", "095", "097", "099")},
        # added up by rank: in the order of arrival, the last bits of a mean and what is rounded after it would differ from run to run
        "_mean": F.avg("score").over(whole), "_median": F.percentile("score", 0.5).over(group), "_sd": F.stddev_pop("score").over(whole),
    })
    n, held = c("candidate_count_source"), F.greatest(c("score"), F.lit(1e-6)) / F.greatest(1 - c("score"), F.lit(1e-6))
    out = {
        "base_score": c("score"), "base_logit": F.log(held), "source_s3": (c("source") == "S3"),
        "candidate_count_source": n, "candidate_count_total": c("candidate_count_total"), "log1p_count_source": F.log1p(n.cast("double")), "log1p_count_total": F.log1p(c("candidate_count_total").cast("double")),
        "rank_source": c("rank_source"), "rank_total": c("rank_total"), "rank_fraction_source": c("rank_source") / n,
        "top_score_source": c("top_score_source"), "second_score_source": c("second_score_source"), "third_score_source": c("third_score_source"),
        "top_minus_second_source": c("top_score_source") - c("second_score_source"), "top_minus_current_source": c("top_score_source") - c("score"),
        "current_minus_next": c("score") - c("_next"), "current_minus_previous": c("score") - c("_previous"),
        **{f"count_ge_{t}": c(f"count_ge_{t}") for t in ("050", "080", "090", "093", "095", "097", "099")},
        "score_minus_mean": c("score") - c("_mean"), "score_minus_median": c("score") - c("_median"), "score_z": F.when(c("_sd") > 1e-6, (c("score") - c("_mean")) / c("_sd")).otherwise(0.0),
        "passes_baseline": c("score") >= base_threshold(c("source")), "passes_a_source": c("score") >= a_source_threshold(c("source"), n),
        "bin_1_25": n <= 25, "bin_26_100": n.between(26, 100), "bin_101_500": n.between(101, 500), "bin_501_plus": n > 500,
    }
    return df.select("s1", "target", "source", *[v.cast("double").alias(k) for k, v in out.items()])


def with_provenance(context: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds from_v1, from_address, from_both and address_rank, 0 where unknown."""
    df = context.join(evidence.select("s1", "target", "from_v1", "from_address", "address_rank"), ["s1", "target"], "left").na.fill(0, ["from_v1", "from_address", "address_rank"])
    return df.withColumn("from_both", (F.col("from_v1") * F.col("from_address")).cast("double"))


def frontier(reranked: Column, score: Column, n: Column, accept: float = 0.795) -> tuple[Column, Column]:
    """The reranked value (0 below .5; 1 from .99 on in small groups) and whether it is accepted."""
    value = F.when((score >= 0.99) & (n <= 25), 1.0).when(score < 0.5, 0.0).otherwise(reranked)
    return value, value >= accept


def prefix_policy(calibrated: DataFrame, expected: DataFrame, fallback: float, most: int = 10) -> DataFrame:
    """Chooses, for each entity, how many of the best pairs of each source to take, by expected F0.5.

    `calibrated` has s1, target, source, score and probability; `expected` has
    bin2, bin3 (count bins) and m, the expected number of true links. All pairs
    (k2, k3) of prefixes up to `most` are compared: at most 121 an entity.
    """
    w = Window.partitionBy("s1", "source").orderBy(F.desc("score"), "target")
    df = calibrated.withColumns({"_r": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("s1", "source"))})
    tops = df.where(F.col("_r") <= most).withColumn("upto", F.sum("probability").over(w))
    steps = tops.groupBy("s1").agg(*[F.array_sort(F.collect_list(F.when(F.col("source") == s, F.struct(F.col("_r").alias("k"), F.col("upto").alias("p"))))).alias(s) for s in ("S2", "S3")], *[F.coalesce(F.max(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(f"n{s}") for s in ("S2", "S3")])
    none = F.array(F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("p")))
    bins = steps.withColumns({"bin2": count_bin(F.col("nS2")), "bin3": count_bin(F.col("nS3"))})
    bins = bins.join(F.broadcast(expected), ["bin2", "bin3"], "left").withColumn("m", F.coalesce("m", F.lit(float(fallback))))
    grid = bins.select("s1", "m", F.explode(F.concat(none, "S2")).alias("a"), "S3").select("s1", "m", "a", F.explode(F.concat(none, "S3")).alias("b"))
    k, tp = F.col("a.k") + F.col("b.k"), F.col("a.p") + F.col("b.p")
    bottom = tp + 0.25 * F.col("m") + 0.75 * k
    value = F.when((k == 0) & (F.col("m") <= 0), 1.0).when(bottom == 0, 0.0).otherwise(1.25 * tp / bottom)
    pick = grid.groupBy("s1").agg(F.max_by(F.struct(F.col("a.k").alias("k2"), F.col("b.k").alias("k3")), F.struct(value, -k, -F.col("a.k"))).alias("best")).select("s1", "best.*")
    taken = df.join(pick, "s1").where(F.col("_r") <= F.when(F.col("source") == "S2", F.col("k2")).otherwise(F.col("k3")))
    return resolve(taken.select("s1", "target", "source", "score"))
