"""Queries over link sets and scores: evaluation, policies, samples, error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import nearest
from ..operators import analysis as A
from ..operators import metrics as M
from ..operators import policy as P
from ..operators import sampling as S
from ..operators import validation as V
from ..sources import files
from . import relations as R
from .relations import with_cte

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df, *columns, digits=8):
    return df.withColumns({c: nearest(F.col(c), digits) for c in columns})


F05 = "CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + fp + 0.25 * fn) END"
ENTITY = """, j AS (
  SELECT coalesce(t.s1, p.s1) AS s1, coalesce(t.target, p.target) AS target, t.s1 IS NOT NULL AS is_true, p.s1 IS NOT NULL AS is_predicted
  FROM t FULL JOIN p ON t.s1 = p.s1 AND t.target = p.target
), g AS (
  SELECT u.s1, count(*) FILTER (is_true AND is_predicted) AS tp, count(*) FILTER (NOT is_true AND is_predicted) AS fp, count(*) FILTER (is_true AND NOT is_predicted) AS fn
  FROM u LEFT JOIN j ON u.s1 = j.s1 GROUP BY u.s1
)"""


def entity_sql(body: str, t: str = "t", p: str = "p", u: str = "u", extra: str = "") -> str:
    """`body` over g (s1, tp, fp, fn) of truth `t` and predictions `p`."""
    head = with_cte(f"{u} {t} {p} {extra}".strip(), "").strip()
    renamed = ENTITY
    if (t, p, u) != ("t", "p", "u"):
        renamed = renamed.replace("FROM t FULL JOIN p ON", f"FROM {t} t FULL JOIN {p} p ON").replace("FROM u LEFT JOIN", f"FROM {u} u LEFT JOIN")
    return head + renamed + "\n" + body


def scored(spark, d):
    return M.entity_scores(R.truth(spark, d), R.predictions(spark, d), R.universe(spark, d))


@query("f05_macro", entity_sql(f"""SELECT count(*) AS entities, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg({F05}), 8) AS macro_f05,
  count(*) FILTER (tp + fn = 0) AS true_singletons, count(*) FILTER (tp + fp = 0) AS predicted_singletons, count(*) FILTER (tp + fn + fp = 0) AS correct_singletons,
  count(*) FILTER (tp + fn = 0 AND fp > 0) AS false_merges, count(*) FILTER (tp + fn > 0 AND fp = 0 AND fn = 0) AS perfect,
  count(*) FILTER (tp > 0 AND fp + fn > 0) AS partial, count(*) FILTER (tp = 0 AND fn > 0) AS missed,
  round(sum(tp) / sum(tp + fp), 8) AS precision, round(sum(tp) / sum(tp + fn), 8) AS recall FROM g"""))
def f05_macro(spark, d):
    return rounded(M.macro_report(scored(spark, d)), "macro_f05", "precision", "recall")


@query("entity_f05", entity_sql(f"SELECT s1, tp, fp, fn, tp + fn AS n_true, tp + fp AS n_predicted, round({F05}, 8) AS f05 FROM g"))
def entity_f05(spark, d):
    return rounded(scored(spark, d), "f05")


@query("f05_histogram", entity_sql(f"""SELECT CASE WHEN f = 1 THEN '1.00' WHEN f >= 0.75 THEN '0.75-<1' WHEN f >= 0.5 THEN '0.50-<0.75' WHEN f > 0 THEN '>0-<0.50' ELSE '0' END AS bin, count(*) AS entities
FROM (SELECT {F05} AS f FROM g) GROUP BY 1"""))
def f05_histogram(spark, d):
    return scored(spark, d).groupBy(A.f05_bin(F.col("f05")).alias("bin")).agg(F.count("*").alias("entities"))


@query("link_counts_by_source", entity_sql("""SELECT source, tp, fp, fn, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall FROM (
  SELECT CASE WHEN target % 2 = 0 THEN 'S2' ELSE 'S3' END AS source, count(*) FILTER (is_true AND is_predicted) AS tp, count(*) FILTER (NOT is_true AND is_predicted) AS fp, count(*) FILTER (is_true AND NOT is_predicted) AS fn FROM j GROUP BY 1)"""))
def link_counts_by_source(spark, d):
    return rounded(M.link_counts(R.truth(spark, d), R.predictions(spark, d), R.source_of()), "precision", "recall")


@query("coverage_check", with_cte("u t", "SELECT (SELECT count(*) FROM u WHERE s1 NOT IN (SELECT s1 FROM t)) AS missing, (SELECT count(DISTINCT s1) FROM t WHERE s1 NOT IN (SELECT s1 FROM u)) AS extra"))
def coverage_check(spark, d):
    return M.coverage(R.universe(spark, d), R.truth(spark, d))


@query("candidate_sizes", with_cte("u c", """SELECT round(avg(n), 8) AS mean, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS max,
  round(avg((n = 0)::INT), 8) AS zero_share, round(avg((n > 1000)::INT), 8) AS over_1000_share FROM (SELECT u.s1, count(c.s1) AS n FROM u LEFT JOIN c ON u.s1 = c.s1 GROUP BY 1)"""))
def candidate_sizes(spark, d):
    return rounded(M.distribution(M.sizes(R.universe(spark, d), R.candidates(spark, d))), "mean", "zero_share", "over_1000_share")


@query("candidate_diagnostics", with_cte("t p c", """SELECT source, links, retrieved, links - retrieved AS blocking_misses, model_misses, round(retrieved / links, 8) AS candidate_recall FROM (
  SELECT CASE WHEN t.target % 2 = 0 THEN 'S2' ELSE 'S3' END AS source, count(*) AS links, count(c.s1) AS retrieved, count(*) FILTER (c.s1 IS NOT NULL AND p.s1 IS NULL) AS model_misses
  FROM t LEFT JOIN c ON t.s1 = c.s1 AND t.target = c.target LEFT JOIN p ON t.s1 = p.s1 AND t.target = p.target GROUP BY 1)"""))
def candidate_diagnostics(spark, d):
    return rounded(M.candidate_diagnostics(R.truth(spark, d), R.predictions(spark, d), R.candidates(spark, d), R.source_of()), "candidate_recall")


@query("candidate_comparison", with_cte("t c c2", """SELECT count(*) FILTER (c.s1 IS NULL) AS old_misses, count(*) FILTER (n.s1 IS NULL) AS new_misses, count(*) FILTER (c.s1 IS NULL AND n.s1 IS NOT NULL) AS recovered,
  count(*) FILTER (c.s1 IS NOT NULL AND n.s1 IS NULL) AS lost, (SELECT count(*) FROM c) AS old_pairs, (SELECT count(*) FROM c2) AS new_pairs, (SELECT count(*) FROM c2) - (SELECT count(*) FROM c) AS growth
FROM t LEFT JOIN c ON t.s1 = c.s1 AND t.target = c.target LEFT JOIN c2 n ON t.s1 = n.s1 AND t.target = n.target"""))
def candidate_comparison(spark, d):
    return M.compare_candidates(R.truth(spark, d), R.candidates(spark, d), R.candidates_wider(spark, d))


@query("candidate_containment", with_cte("c c2", "SELECT (SELECT count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM c2)) AS only_left, (SELECT count(*) FROM (SELECT * FROM c2 EXCEPT SELECT * FROM c)) AS only_right"))
def candidate_containment(spark, d):
    from ..operators.retrieval import same_pairs

    return same_pairs(R.candidates(spark, d), R.candidates_wider(spark, d))


@query("binary_metrics", """WITH x AS (SELECT quality AS label, least(n_chars, 100000) / 100000.0 AS score FROM labels JOIN documents USING (doc_id)),
y AS (SELECT score, sum(label) AS pos, count(*) AS n FROM x GROUP BY 1), z AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS upto FROM y WINDOW w AS (ORDER BY score DESC))
SELECT round((SELECT avg(CASE WHEN label > 0 THEN -ln(greatest(score, 1e-15)) ELSE -ln(1 - least(score, 1 - 1e-15)) END) FROM x), 8) AS log_loss, (SELECT count(*) FROM x) AS rows, (SELECT sum(label)::BIGINT FROM x) AS positives,
  round(sum(pos * tp / upto) / sum(pos), 8) AS pr_auc, round(sum((n - pos) * (tp - pos / 2.0)) / (sum(pos) * (sum(n) - sum(pos))), 8) AS roc_auc FROM z""")
def binary_metrics(spark, d):
    rows = R.table(spark, d, "labels").join(R.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select(F.col("quality").alias("label"), (F.least("n_chars", F.lit(100000)) / 100000.0).alias("score"))
    return rounded(M.binary_metrics(rows), "log_loss", "pr_auc", "roc_auc")


# Policies


@query("threshold_select", with_cte("sel", "SELECT s1, target, source, score FROM sel"))
def threshold_select(spark, d):
    return P.select_pairs(R.scores(spark, d), P.DecisionPolicy())


@query("open_gate", with_cte("m sc", "SELECT s1, target, source, score FROM (SELECT *, max(score) OVER (PARTITION BY s1) AS top FROM sc) WHERE top >= 0.95 AND score >= CASE WHEN source = 'S2' THEN 0.8 ELSE 0.85 END"))
def open_gate(spark, d):
    return P.select_pairs(R.scores(spark, d), P.DecisionPolicy(0.8, 0.85, open=0.95))


@query("ownership_highest", with_cte("own", "SELECT * FROM own"))
def ownership_highest(spark, d):
    return P.decide(R.scores(spark, d))


@query("ownership_margin", with_cte("sel", """SELECT s1, target, source, score FROM (SELECT *, row_number() OVER w AS r, max(score) OVER (PARTITION BY target) AS a FROM sel WINDOW w AS (PARTITION BY target ORDER BY score DESC, s1))
LEFT JOIN (SELECT target, score AS b FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, s1) AS r FROM sel) WHERE r = 2) USING (target) WHERE r = 1 OR a - b < 0.005"""))
def ownership_margin(spark, d):
    return P.decide(R.scores(spark, d), P.DecisionPolicy(conflict="margin", margin=0.005))


@query("ownership_conflicts", with_cte("sel", "SELECT target, count(*) AS claims FROM sel GROUP BY 1 HAVING count(*) > 1"))
def ownership_conflicts(spark, d):
    return V.repeated(P.select_pairs(R.scores(spark, d), P.DecisionPolicy()), "target").withColumnRenamed("c", "claims")


_SWEEP = """, grid AS (SELECT unnest(range(10)) AS i), pol AS (SELECT round(0.90 + 0.01 * i, 2)::DOUBLE AS s2, round(0.90 + 0.01 * i, 2)::DOUBLE AS s3 FROM grid),
o AS (SELECT * FROM (SELECT s2, s3, s1, target, row_number() OVER (PARTITION BY s2, s3, target ORDER BY score DESC, s1) AS r FROM sc, pol WHERE score >= CASE WHEN source = 'S2' THEN s2 ELSE s3 END) WHERE r = 1),
k AS (SELECT s2, s3, u.s1, (SELECT count(*) FROM t WHERE t.s1 = u.s1) AS n_true FROM pol, u),
h AS (SELECT o.s2, o.s3, o.s1, count(*) AS told, count(t.s1) AS tp FROM o LEFT JOIN t ON o.s1 = t.s1 AND o.target = t.target GROUP BY 1, 2, 3),
r AS (SELECT k.s2, k.s3, coalesce(h.tp, 0) AS tp, coalesce(told, 0) - coalesce(h.tp, 0) AS fp, n_true - coalesce(h.tp, 0) AS fn FROM k LEFT JOIN h ON k.s2 = h.s2 AND k.s3 = h.s3 AND k.s1 = h.s1),
w AS (SELECT s2, s3, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(""" + F05 + """), 8) AS macro_f05 FROM r GROUP BY 1, 2)
"""


@query("policy_sweep", with_cte("u t m sc", "").strip() + _SWEEP + "SELECT * FROM w")
def policy_sweep(spark, d):
    return rounded(P.sweep(R.scores(spark, d), R.truth(spark, d), R.universe(spark, d)), "macro_f05")


@query("policy_best", with_cte("u t m sc", "").strip() + _SWEEP + "SELECT * FROM w ORDER BY macro_f05 DESC, tp / nullif(tp + fp, 0) DESC, s2 DESC, s3 DESC LIMIT 1")
def policy_best(spark, d):
    return P.best(policy_sweep(spark, d))


def _owned(where: str, inner: str = "cs") -> str:
    return with_cte("m cs", f"""SELECT s1, target, source, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, s1) AS w FROM (
  SELECT *, CASE WHEN source = 'S2' THEN 0.93 ELSE 0.97 END AS base, count(*) OVER (PARTITION BY s1, source) AS n, row_number() OVER (PARTITION BY s1, source ORDER BY score DESC, target) AS r,
    max(score) OVER (PARTITION BY s1, source) AS top FROM {inner}) x {where}) WHERE w = 1""")


@query("group_policy_a", _owned("WHERE score >= least(1.0, greatest(0.0, base + CASE WHEN n <= 100 THEN -0.015 ELSE 0.005 END))"))
def group_policy_a(spark, d):
    return P.group_policy_a(R.crowded_scores(spark, d), -0.015, 0.005)


@query("group_policy_a_source", _owned("WHERE score >= least(1.0, greatest(0.0, base + CASE WHEN n <= 100 THEN -0.015 ELSE 0.015 END + CASE WHEN source = 'S2' THEN -0.005 ELSE 0.0 END))"))
def group_policy_a_source(spark, d):
    return P.group_policy_a(R.crowded_scores(spark, d), -0.015, 0.015, {"S2": -0.005, "S3": 0.0})


@query("group_policy_gap", _owned("LEFT JOIN (SELECT s1 AS z1, source AS zs, score AS second FROM (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY score DESC, target) AS q FROM cs) WHERE q = 2) ON s1 = z1 AND source = zs WHERE score >= base - CASE WHEN top - second >= 0.001 THEN 0.02 ELSE 0.0 END"))
def group_policy_gap(spark, d):
    return P.group_policy_gap(R.crowded_scores(spark, d), 0.02, 0.001)


@query("group_policy_tail", _owned("WHERE score >= least(1.0, base + CASE WHEN n >= 101 AND r > 1 THEN 0.01 ELSE 0.0 END)"))
def group_policy_tail(spark, d):
    return P.group_policy_tail(R.crowded_scores(spark, d), 0.01)


@query("prefix_policy")
def prefix_policy(spark, d):
    """Isotonic calibration and choice of prefixes: not expressible in SQL; tested against brute force."""
    from ..operators import models

    sc = R.scores(spark, d).join(R.truth(spark, d).withColumn("label", F.lit(1.0)), ["s1", "target"], "left").na.fill(0.0, ["label"])
    sizes = sc.groupBy("s1").agg(F.count_if(F.col("source") == "S2").alias("n2"), F.count_if(F.col("source") == "S3").alias("n3"), F.sum("label").alias("m"))
    expected = sizes.groupBy(P.count_bin(F.col("n2")).alias("bin2"), P.count_bin(F.col("n3")).alias("bin3")).agg(F.avg("m").alias("m"))
    return P.prefix_policy(models.calibrated(sc, sc), expected, 1.0)


CONTEXT = ("rank_source", "rank_total", "top_score_source", "second_score_source", "third_score_source", "current_minus_next", "current_minus_previous", "count_ge_080", "score_minus_mean", "score_minus_median", "score_z", "passes_baseline", "passes_a_source", "bin_101_500")


@query("context_features", with_cte("m cs", """, x AS (SELECT *, row_number() OVER g AS rs, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, target) AS rt, lag(score) OVER g AS prev, lead(score) OVER g AS nxt FROM cs WINDOW g AS (PARTITION BY s1, source ORDER BY score DESC, target)),
y AS (SELECT s1, source, count(*) AS n, max(score) FILTER (rs = 1) AS a, coalesce(max(score) FILTER (rs = 2), 0) AS b, coalesce(max(score) FILTER (rs = 3), 0) AS c, count(*) FILTER (score >= 0.8) AS d, avg(score) AS mean, quantile_cont(score, 0.5) AS med, stddev_pop(score) AS sd FROM x GROUP BY 1, 2)
SELECT x.s1, x.target, x.source, rs::DOUBLE AS rank_source, rt::DOUBLE AS rank_total, round(a, 8) AS top_score_source, round(b, 8) AS second_score_source, round(c, 8) AS third_score_source, round(score - coalesce(nxt, score), 8) AS current_minus_next, round(score - coalesce(prev, score), 8) AS current_minus_previous,
  d::DOUBLE AS count_ge_080, round(score - mean, 11) AS score_minus_mean, round(score - med, 9) AS score_minus_median, round(CASE WHEN sd > 1e-6 THEN (score - mean) / sd ELSE 0 END, 9) AS score_z,
  (score >= CASE WHEN x.source = 'S2' THEN 0.93 ELSE 0.97 END)::INT::DOUBLE AS passes_baseline, (score >= CASE WHEN x.source = 'S2' THEN 0.93 ELSE 0.97 END + CASE WHEN n <= 100 THEN -0.015 ELSE 0.015 END + CASE WHEN x.source = 'S2' THEN -0.005 ELSE 0.0 END)::INT::DOUBLE AS passes_a_source, (n BETWEEN 101 AND 500)::INT::DOUBLE AS bin_101_500
FROM x JOIN y ON x.s1 = y.s1 AND x.source = y.source""").replace("\n, x AS", ", x AS"))
def context_features(spark, d):
    df = P.context_features(R.crowded_scores(spark, d)).select("s1", "target", "source", *CONTEXT)
    df = rounded(df, *[c for c in CONTEXT if not c.startswith("score_")])
    return rounded(rounded(df, "score_minus_mean", digits=11), "score_z", "score_minus_median", digits=9)


# Samples, folds and hashes


@query("hash_fold", with_cte("u", "SELECT s1, (('0x' || left(sha256(s1::VARCHAR), 16))::UBIGINT % 5)::INT AS fold FROM u"))
def hash_fold(spark, d):
    return R.universe(spark, d).withColumn("fold", S.fold(F.col("s1").cast("string")))


@query("hash_split", with_cte("u", "SELECT s1, CASE WHEN ('0x' || left(sha256('20260925|' || s1), 8))::UBIGINT < 3865470566 THEN 'train' ELSE 'validation' END AS part FROM u"))
def hash_split(spark, d):
    return S.split(R.universe(spark, d), 0.9)


@query("pair_hash", with_cte("t", "SELECT s1, target, sha256(encode('20260925') || '\\x00'::BLOB || encode(s1::VARCHAR) || '\\x00'::BLOB || encode(target::VARCHAR)) AS hash FROM t"))
def pair_hash(spark, d):
    return R.truth(spark, d).withColumn("hash", S.pair_hash(F.col("s1").cast("string"), F.col("target").cast("string")))


@query("hash_sample", with_cte("u", "SELECT s1 FROM u ORDER BY sha256('20260925|' || s1), s1 LIMIT 200"))
def hash_sample(spark, d):
    return S.first_by_hash(R.universe(spark, d), 200)


@query("eligible_ids", with_cte("u t p", "SELECT s1 FROM u EXCEPT SELECT s1 FROM t EXCEPT SELECT s1 FROM p"))
def eligible_ids(spark, d):
    return S.eligible(R.universe(spark, d), R.truth(spark, d).select("s1"), R.predictions(spark, d).select("s1"))


_LABELLED = """, l AS (SELECT cs.s1, cs.target, cs.source, cs.score, CASE WHEN ct.s1 IS NULL THEN 0 ELSE 1 END AS label, row_number() OVER (PARTITION BY cs.s1, source ORDER BY score DESC, cs.target) AS rank, count(*) OVER (PARTITION BY cs.s1, source) > 100 AS crowd
  FROM cs LEFT JOIN ct ON cs.s1 = ct.s1 AND cs.target = ct.target)"""


def labelled(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("s1", "source")
    df = R.crowded_scores(spark, d).join(R.crowded_truth(spark, d).withColumn("label", F.lit(1)), ["s1", "target"], "left").na.fill(0, ["label"])
    return df.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "target")), "crowd": F.count("*").over(w) > 100})


@query("negative_sample", with_cte("m cs ct", "").strip() + _LABELLED + """, q AS (SELECT *, sha256(encode('20260925') || '\\x00'::BLOB || encode(s1::VARCHAR) || '\\x00'::BLOB || encode(target::VARCHAR)) AS h, CASE WHEN label = 0 THEN (target % 9)::INT END AS priority FROM l),
e AS (SELECT *, label = 0 AND priority >= 6 AND row_number() OVER (PARTITION BY s1, label = 0 AND priority >= 6 ORDER BY h) = 1 AS is_easy FROM q),
f AS (SELECT *, max(is_easy::INT) OVER (PARTITION BY s1) AS some_easy, row_number() OVER (PARTITION BY s1, label = 0 AND NOT is_easy ORDER BY priority, rank, h, target) AS r FROM e)
SELECT s1, target, label, coalesce(is_easy, false) AS is_easy FROM f WHERE label = 1 OR is_easy OR r <= 12 - some_easy""")
def negative_sample(spark, d):
    df = labelled(spark, d).withColumn("priority", F.when(F.col("label") == 0, (F.col("target") % 9).cast("int")))
    return S.sample_negatives(df).select("s1", "target", "label", "is_easy")


@query("reranker_sample", with_cte("m cs ct", "").strip() + _LABELLED + """, q AS (SELECT *, sha256('20260925' || chr(31) || s1 || chr(31) || target) AS h, CASE WHEN score >= 0.9 THEN 6 WHEN score >= 0.75 THEN 4 WHEN score >= 0.5 THEN 3 ELSE 2 END AS cap, label = 0 AND (rank <= 3 OR crowd) AS ext FROM l),
e AS (SELECT *, row_number() OVER (PARTITION BY s1, source, label, cap ORDER BY score DESC, rank, h) AS b, row_number() OVER (PARTITION BY s1, source, ext ORDER BY rank, score DESC, h) AS x FROM q),
k AS (SELECT * FROM e WHERE label = 1 OR b <= cap OR (ext AND x <= CASE WHEN crowd THEN 3 ELSE 1 END)), z AS (SELECT *, row_number() OVER (PARTITION BY s1, source, label ORDER BY score DESC, rank, h) AS last FROM k)
SELECT s1, target, source, label FROM z WHERE label = 1 OR last <= 20""")
def reranker_sample(spark, d):
    return S.sample_for_reranker(labelled(spark, d)).select("s1", "target", "source", "label")


# Error analysis


@query("error_stages", with_cte("t own", "SELECT CASE WHEN sc.s1 IS NULL THEN 'A_blocking_miss' WHEN sc.score < CASE WHEN sc.source = 'S2' THEN 0.93 ELSE 0.97 END THEN 'B1_below_threshold' WHEN own.s1 IS NULL THEN 'B2_ownership_conflict' ELSE 'TP' END AS stage, count(*) AS links FROM t LEFT JOIN sc ON t.s1 = sc.s1 AND t.target = sc.target AND sc.score >= 0.2 LEFT JOIN own ON t.s1 = own.s1 AND t.target = own.target GROUP BY 1"))
def error_stages(spark, d):
    sc = R.scores(spark, d)
    found = A.error_stages(R.truth(spark, d), sc.where("score >= 0.2"), P.decide(sc))
    return found.groupBy("stage").agg(F.count("*").alias("links"))


@query("fp_categories", with_cte("t own", """, f AS (SELECT own.*, n, k > 1 AS contested, CASE WHEN own.source = 'S2' THEN 0.93 ELSE 0.97 END AS th FROM own JOIN (SELECT s1, source, count(*) AS n FROM sc GROUP BY 1, 2) c ON own.s1 = c.s1 AND own.source = c.source JOIN (SELECT target, count(*) AS k FROM sel GROUP BY 1) v ON own.target = v.target ANTI JOIN t ON own.s1 = t.s1 AND own.target = t.target)
SELECT source, CASE WHEN score >= 0.99 THEN 'C1_high_confidence' WHEN score < th + 0.02 THEN 'C2_near_threshold' WHEN contested THEN 'C3_target_conflict_related' WHEN n > 500 THEN 'C4_crowded_candidate_set' ELSE 'C5_other' END AS category, count(*) AS links FROM f GROUP BY 1, 2""").replace("\n, f AS", ", f AS"))
def fp_categories(spark, d):
    sc = R.scores(spark, d)
    selected = P.select_pairs(sc, P.DecisionPolicy())
    return A.false_positives(R.truth(spark, d), sc, P.resolve(selected), selected).groupBy("source", "category").agg(F.count("*").alias("links"))


@query("score_bins", with_cte("t m sc", """SELECT source, CASE WHEN score < 0.5 THEN '<0.50' WHEN score < 0.8 THEN '0.50-0.80' WHEN score < 0.9 THEN '0.80-0.90' WHEN source = 'S2' AND score < 0.93 THEN '0.90-0.93' WHEN source = 'S2' AND score < 0.97 THEN '0.93-0.97'
WHEN source = 'S3' AND score < 0.95 THEN '0.90-0.95' WHEN source = 'S3' AND score < 0.97 THEN '0.95-0.97' WHEN score < 0.99 THEN '0.97-0.99' ELSE '>=0.99' END AS bin, count(*) AS pairs, count(t.s1) AS true_links
FROM sc LEFT JOIN t ON sc.s1 = t.s1 AND sc.target = t.target GROUP BY 1, 2"""))
def score_bins(spark, d):
    df = R.scores(spark, d).join(R.truth(spark, d).withColumn("t", F.lit(1)), ["s1", "target"], "left")
    return df.groupBy("source", A.score_bin(F.col("score"), F.col("source")).alias("bin")).agg(F.count("*").alias("pairs"), F.count("t").alias("true_links"))


@query("slice_metrics", with_cte("cu ct m cs", """, own2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, s1) AS r FROM cs WHERE score >= CASE WHEN source = 'S2' THEN 0.93 ELSE 0.97 END) WHERE r = 1),
src AS (SELECT DISTINCT target, source FROM cs), j AS (SELECT coalesce(ct.s1, o.s1) AS s1, coalesce(ct.target, o.target) AS target, ct.s1 IS NOT NULL AS t, o.s1 IS NOT NULL AS p FROM ct FULL JOIN own2 o ON ct.s1 = o.s1 AND ct.target = o.target),
g AS (SELECT s1, source, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM j JOIN src USING (target) GROUP BY 1, 2),
n AS (SELECT s1, source, count(*) AS n FROM cs GROUP BY 1, 2),
a AS (SELECT cu.s1, x.source, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM cu CROSS JOIN (SELECT DISTINCT source FROM cs) x LEFT JOIN g ON cu.s1 = g.s1 AND x.source = g.source LEFT JOIN n ON cu.s1 = n.s1 AND x.source = n.source)
SELECT source, CASE WHEN n <= 0 THEN '0' WHEN n <= 25 THEN '1-25' WHEN n <= 100 THEN '26-100' WHEN n <= 500 THEN '101-500' ELSE '501+' END AS bin, count(*) AS entities, round(avg(""" + F05 + """), 8) AS macro_f05, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM a GROUP BY 1, 2""").replace("\n, own2 AS", ", own2 AS"))
def slice_metrics(spark, d):
    sc = R.crowded_scores(spark, d)
    return rounded(A.slice_metrics(R.crowded_truth(spark, d), P.decide(sc), sc, R.crowded_universe(spark, d)), "macro_f05")


@query("ownership_summary", with_cte("t own", """, x AS (SELECT sel.*, t.s1 IS NOT NULL AS t, own.s1 IS NOT NULL AS k, row_number() OVER w AS r, sel.score - lead(sel.score) OVER w AS gap FROM sel LEFT JOIN t ON sel.s1 = t.s1 AND sel.target = t.target LEFT JOIN own ON sel.s1 = own.s1 AND sel.target = own.target WINDOW w AS (PARTITION BY sel.target ORDER BY sel.score DESC, sel.s1)),
b AS (SELECT target, max(gap) FILTER (r = 1) AS gap, bool_or(r = 1 AND t) AS win, bool_or(r > 1 AND t) AS lose, count(*) FILTER (r > 1 AND NOT k) AS gone, count(*) FILTER (r > 1 AND NOT k AND t) AS gone_true FROM x GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS conflicted_targets, count(*) FILTER (gap < 0.01) AS tiny_gaps, count(*) FILTER (gap >= 0.05) AS large_gaps, count(*) FILTER (win AND lose) AS both_true, count(*) FILTER (win AND NOT lose) AS winner_true, count(*) FILTER (NOT win AND lose) AS loser_true, count(*) FILTER (NOT win AND NOT lose) AS none_true,
  coalesce(sum(gone), 0)::BIGINT AS links_removed, coalesce(sum(gone_true), 0)::BIGINT AS tp_removed, coalesce(sum(gone - gone_true), 0)::BIGINT AS fp_removed, round(quantile_cont(gap, 0.5), 8) AS gap_median, round(quantile_cont(gap, 0.95), 8) AS gap_p95 FROM b""").replace("\n, x AS", ", x AS"))
def ownership_summary(spark, d):
    selected = P.select_pairs(R.scores(spark, d), P.DecisionPolicy())
    return rounded(A.ownership_summary(selected, P.resolve(selected), R.truth(spark, d)), "gap_median", "gap_p95")


@query("prediction_diff", entity_sql("SELECT count(*) FILTER (fp = 0 AND fn = 0) AS identical, count(*) FILTER (fp + fn > 0) AS changed, sum(fp)::BIGINT AS added, sum(fn)::BIGINT AS removed, count(*) FILTER (tp + fn > 0 AND tp + fp = 0) AS became_alone, count(*) FILTER (tp + fn = 0 AND fp > 0) AS no_longer_alone FROM g"))
def prediction_diff(spark, d):
    return A.prediction_diff(R.truth(spark, d), R.predictions(spark, d), R.universe(spark, d))


@query("prediction_lists", with_cte("u p", "SELECT u.s1, coalesce(string_agg(p.target::VARCHAR, ',' ORDER BY p.target::VARCHAR), '') AS targets FROM u LEFT JOIN p ON u.s1 = p.s1 GROUP BY 1"))
def prediction_lists(spark, d):
    p = R.predictions(spark, d).withColumn("target", F.col("target").cast("string"))
    return files.as_lists(p, R.universe(spark, d), "targets")


@query("finding_comparison", with_cte("t own", """, f AS (SELECT t.s1 % 10 = 0 AS v, CASE WHEN sc.score < CASE WHEN sc.source = 'S2' THEN 0.93 ELSE 0.97 END THEN 'B1_below_threshold' WHEN own.s1 IS NULL THEN 'B2_ownership_conflict' ELSE 'TP' END AS finding FROM t JOIN sc ON t.s1 = sc.s1 AND t.target = sc.target LEFT JOIN own ON t.s1 = own.s1 AND t.target = own.target),
h AS (SELECT finding, count(*) FILTER (NOT v) AS tune_n, count(*) FILTER (v) AS validation_n FROM f WHERE finding <> 'TP' GROUP BY 1), s AS (SELECT *, tune_n / greatest(1, sum(tune_n) OVER ()) AS a, validation_n / greatest(1, sum(validation_n) OVER ()) AS b FROM h)
SELECT finding, tune_n, validation_n, round(a, 8) AS tune_share, round(b, 8) AS validation_share, CASE WHEN abs(a - b) <= 0.05 THEN 'ROBUST' WHEN a > b THEN 'TUNE_ONLY' ELSE 'VALIDATION_ONLY' END AS classification FROM s""").replace("\n, f AS", ", f AS"))
def finding_comparison(spark, d):
    sc = R.scores(spark, d)
    found = A.error_stages(R.truth(spark, d), sc, P.decide(sc))
    part = lambda cond: found.where(cond).groupBy(F.col("stage").alias("finding")).agg(F.count("*").alias("n"))
    return rounded(A.compare_findings(part("s1 % 10 <> 0"), part("s1 % 10 = 0")), "tune_share", "validation_share")


@query("target_reuse", with_cte("t", "SELECT target, count(DISTINCT s1) AS entities FROM t GROUP BY 1 HAVING count(DISTINCT s1) > 1"))
def target_reuse(spark, d):
    return R.truth(spark, d).groupBy("target").agg(F.countDistinct("s1").alias("entities")).where("entities > 1")


@query("link_audit", with_cte("t", """SELECT CASE WHEN o.o_orderkey IS NULL THEN 'no_entity' WHEN pt.p_partkey IS NULL THEN 'no_target' WHEN pt.p_type = 'ECONOMY' THEN 'same' ELSE 'other' END AS relation, CASE WHEN t.target % 2 = 0 THEN 'S2' ELSE 'S3' END AS source, count(*) AS links
FROM t LEFT JOIN orders o ON t.s1 = o.o_orderkey LEFT JOIN part pt ON t.target = pt.p_partkey GROUP BY 1, 2"""))
def link_audit(spark, d):
    R.truth(spark, d).createOrReplaceTempView("kinmatch_truth")
    R.table(spark, d, "orders").createOrReplaceTempView("kinmatch_orders")
    R.table(spark, d, "part").createOrReplaceTempView("kinmatch_part")
    return spark.sql("""
      SELECT CASE WHEN o_orderkey IS NULL THEN 'no_entity' WHEN p_partkey IS NULL THEN 'no_target' WHEN p_type = 'ECONOMY' THEN 'same' ELSE 'other' END AS relation,
        CASE WHEN target % 2 = 0 THEN 'S2' ELSE 'S3' END AS source, count(*) AS links
      FROM kinmatch_truth LEFT JOIN kinmatch_orders ON s1 = o_orderkey LEFT JOIN kinmatch_part ON target = p_partkey GROUP BY 1, 2""")


@query("profile_by_nation", """SELECT side, n_name AS country, count(*) AS rows, count(*) FILTER (bal < 0) AS in_debt, round(avg(bal), 6) AS mean_balance FROM (
  SELECT 'customer' AS side, c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1, 2""")
def profile_by_nation(spark, d):
    side = lambda t, p: R.table(spark, d, t).select(F.lit(t).alias("side"), F.col(f"{p}_nationkey").alias("n_nationkey"), F.col(f"{p}_acctbal").alias("bal"))
    df = side("customer", "c").unionByName(side("supplier", "s")).join(R.table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return rounded(df.groupBy("side", F.col("n_name").alias("country")).agg(F.count("*").alias("rows"), F.count_if(F.col("bal") < 0).alias("in_debt"), F.avg("bal").alias("mean_balance")), "mean_balance", digits=6)


@query("score_checks", with_cte("m sc", "SELECT count(*) AS rows, count(*) FILTER (NOT starts_with(source || '-' || target, source || '-')) AS bad_source, count(*) FILTER (score IS NULL OR score < 0 OR score > 1) AS bad_score, (SELECT count(*) FROM (SELECT 1 FROM sc GROUP BY s1, target HAVING count(*) > 1)) AS repeated FROM sc"))
def score_checks(spark, d):
    return V.check_scores(R.scores(spark, d).withColumn("target", F.concat_ws("-", "source", "target")))


@query("list_checks", with_cte("u p", """, b AS (SELECT DISTINCT s1::VARCHAR AS id FROM u ANTI JOIN p ON u.s1 = p.s1), f AS (SELECT id FROM b ORDER BY id LIMIT 5)
SELECT 'missing_s1' AS rule, (SELECT count(*) FROM b) AS n, (SELECT coalesce(string_agg(id, ',' ORDER BY id), '') FROM f) AS examples
UNION ALL SELECT unnest(['repeated_row', 'bad_list', 'unknown_s1']), 0, ''""").replace("\n, b AS", ", b AS"))
def list_checks(spark, d):
    p = R.predictions(spark, d).select("s1", F.concat(R.source_of(), F.lit("-"), F.col("target").cast("string")).alias("target"))
    lists = files.as_lists(p, p.select("s1").distinct(), "targets")
    return V.check_lists(lists, R.universe(spark, d)).withColumn("examples", F.array_join("examples", ","))


@query("membership_hash")
def membership_hash(spark, d):
    """An engine's own hash: tested for order independence."""
    return A.membership_hash(R.predictions(spark, d))


@query("gbdt_out_of_fold")
def gbdt_out_of_fold(spark, d):
    """Out-of-fold scores of boosted trees on context features; a trained model."""
    from ..operators import models

    ctx = P.context_features(R.crowded_scores(spark, d))
    df = ctx.join(R.crowded_truth(spark, d).withColumn("label", F.lit(1.0)), ["s1", "target"], "left").na.fill(0.0, ["label"])
    features = ["base_score", "rank_fraction_source", "score_z", "top_minus_current_source", "current_minus_next"]
    return models.out_of_fold(df, features, folds=5, rounds=3, maxDepth=3).select("s1", "target", "source", "label", "fold", F.round("base_score", 6).alias("base_score"))
