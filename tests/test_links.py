import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.operators import analysis as A
from kinmatch.operators import metrics as M
from kinmatch.operators import policy as P
from kinmatch.operators import sampling as S
from kinmatch.operators import validation as V


def links(spark, d):
    return spark.createDataFrame([(k, t) for k, ts in d.items() for t in ts], "s1 string, target string")


def ids(spark, d):
    return spark.createDataFrame([(k,) for k in d], "s1 string")


TRUTH = {"k1": ["S2-1", "S3-1"], "k2": ["S2-2"], "k3": [], "k4": ["S3-4", "S3-5", "S2-6"], "k5": [], "k6": ["S2-7"]}
PRED = {"k1": ["S2-1"], "k2": ["S2-2", "S3-9"], "k3": [], "k4": ["S3-4", "S2-6"], "k5": ["S2-8"], "k6": ["S3-7"]}
CAND = {"k1": ["S2-1", "S3-1"], "k2": ["S2-2", "S3-9", "S2-3"], "k3": ["S3-2"], "k4": ["S3-4", "S2-6"], "k5": ["S2-8"], "k6": ["S3-7"]}


def pairs(d):
    return {(k, t) for k, ts in d.items() for t in ts}


def f05(truth, told):
    tp = len(set(truth) & set(told))
    return 1.0 if not truth and not told else 0.0 if not tp else 1.25 * tp / (1.25 * tp + 0.25 * (len(truth) - tp) + len(told) - tp)


def source():
    return F.substring("target", 1, 2)



@pytest.mark.parametrize("truth, told, expected", [(["a"], ["a", "x"], 5 / 9), (["a", "b"], ["a"], 5 / 6), ([], [], 1), ([], ["x"], 0), (["x"], [], 0)])
def test_entity_score(spark, truth, told, expected):
    got = M.entity_scores(links(spark, {"e": truth}), links(spark, {"e": told}), ids(spark, ["e"])).first()
    assert got.f05 == pytest.approx(expected)


def test_macro_report(spark):
    r = M.macro_f05(links(spark, TRUTH), links(spark, PRED), ids(spark, TRUTH)).first()
    t, p = pairs(TRUTH), pairs(PRED)
    assert (r.tp, r.fp, r.fn) == (len(t & p), len(p - t), len(t - p)) and r.macro_f05 == pytest.approx(sum(f05(TRUTH[k], PRED[k]) for k in TRUTH) / len(TRUTH))
    empty = [k for k in TRUTH if not TRUTH[k]]
    assert (r.true_singletons, r.predicted_singletons, r.correct_singletons, r.false_merges) == (len(empty), sum(not v for v in PRED.values()), sum(not PRED[k] for k in empty), sum(bool(PRED[k]) for k in empty))


def test_candidate_diagnostics(spark):
    t, p, c = pairs(TRUTH), pairs(PRED), pairs(CAND)
    for r in M.candidate_diagnostics(links(spark, TRUTH), links(spark, PRED), links(spark, CAND), source()).collect():
        own = {x for x in t if x[1].startswith(r.source)}
        assert r.candidate_recall == pytest.approx(len(own & c) / len(own))
        assert (r.blocking_misses, r.model_misses) == (len(own - c), len((own & c) - p))


def test_candidate_sizes(spark):
    r = M.distribution(M.sizes(ids(spark, CAND), links(spark, CAND))).first()
    n = np.array([len(v) for v in CAND.values()])
    assert (r["mean"], r["median"], r.p90, r.p95, r.p99, r["max"]) == pytest.approx((n.mean(), np.median(n), *np.percentile(n, [90, 95, 99]), n.max()))


def test_candidate_comparison(spark):
    old = {"k1": ["S2-1"], "k4": ["S2-6"], "k5": ["S3-3"]}
    r = M.compare_candidates(links(spark, TRUTH), links(spark, old), links(spark, CAND)).first()
    t, a, b = pairs(TRUTH), pairs(old), pairs(CAND)
    assert (r.old_misses, r.recovered, r.new_misses, r.growth) == (len(t - a), len((t - a) & b), len(t - b), len(b) - len(a))


def scores(spark):
    rows = [("A", "S2-A", "S2", 0.9), ("A", "S2-X", "S2", 0.8), ("C", "S2-C", "S2", 0.7), ("D", "S2-D", "S2", 0.95), ("B", "S3-B", "S3", 0.85), ("C", "S3-C", "S3", 0.92), ("D", "S3-D", "S3", 0.1)]
    return spark.createDataFrame(rows, "s1 string, target string, source string, score double")


def told(df):
    return sorted((r.s1, r.target) for r in df.collect())


def test_thresholds_and_gate(spark):
    assert told(P.decide(scores(spark), P.DecisionPolicy(0.8, 0.85))) == [("A", "S2-A"), ("A", "S2-X"), ("B", "S3-B"), ("C", "S3-C"), ("D", "S2-D")]
    assert told(P.decide(scores(spark), P.DecisionPolicy(0.7, 0.8, open=0.93))) == [("D", "S2-D")]


def test_ownership_ties_and_margin(spark):
    df = spark.createDataFrame([("S1-B", "S2-X", "S2", 0.9), ("S1-A", "S2-X", "S2", 0.9)], "s1 string, target string, source string, score double")
    assert told(P.resolve(df)) == [("S1-A", "S2-X")]
    assert len(told(P.resolve(df, "margin", 0.01))) == 2 and len(told(P.resolve(df, "none"))) == 2


def test_group_policies(spark):
    rows = [("A", "S2-A", "S2", 0.93), ("A", "S2-X", "S2", 0.94), ("B", "S2-B", "S2", 0.92), ("A", "S3-A", "S3", 0.97), ("C", "S3-C", "S3", 0.98), ("C", "S3-X", "S3", 0.97)]
    df = spark.createDataFrame(rows, "s1 string, target string, source string, score double")
    base = [("A", "S2-A"), ("A", "S2-X"), ("A", "S3-A"), ("C", "S3-C"), ("C", "S3-X")]
    assert told(P.group_policy_a(df, 0.0, 0.0)) == base
    assert told(P.group_policy_a(df, -0.015, 0.0)) == sorted([*base, ("B", "S2-B")])
    assert len(P.SHARED_OFFSETS) == 20 and len(P.GAP_GRID) + len(P.TAIL_GRID) == 18


def test_moved_thresholds_let_scores_on_them_pass(spark):
    far = [("k", f"S3-{i}", "S3", 0.1) for i in range(100)] + [("k", f"S2-{i}", "S2", 0.1) for i in range(100)]
    near = [("k", "S2-a", "S2", 0.999), ("k", "S2-b", "S2", 0.94), ("k", "S2-c", "S2", 0.939999)]
    df = spark.createDataFrame(far + near, "s1 string, target string, source string, score double")
    assert sorted(r.target for r in P.group_policy_tail(df, 0.01).collect()) == ["S2-a", "S2-b"]
    assert sorted(r.target for r in P.group_policy_a(df, -0.015, 0.015, {"S2": -0.005}).collect()) == ["S2-a", "S2-b"]
    told = {r.target: r.passes_a_source for r in P.context_features(df).collect()}
    assert (told["S2-b"], told["S2-c"]) == (1.0, 0.0)


def test_halves_are_rounded_as_the_sql_does(spark):
    import duckdb

    from kinmatch.functions.numbers import nearest

    values = [0.866309 - 0.698622203125, 0.5, -0.5, 1.005, 2.675, 0.1234567890123, -0.09086820312499997, 0.0]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(nearest(F.col("v"), 11).alias("v")).collect()]
    assert got == [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 11)").fetchall()[0][0] for v in values]


def test_context_means_do_not_hang_on_the_order_of_rows(spark):
    rows = [("k", f"S2-{i:03d}", "S2", round(0.3 + 0.7 * (i * 7919 % 1009) / 1009, 6)) for i in range(640)]
    mean = sum(sorted((r[3] for r in rows), reverse=True)) / len(rows)
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: int(r[1][3:]) * 37 % 640)):
        got = P.context_features(spark.createDataFrame(order, "s1 string, target string, source string, score double").coalesce(1)).collect()
        assert all(r.score_minus_mean == r.base_score - mean for r in got)


def test_prefix_policy_is_the_best_of_all_prefixes(spark):
    rows = [("A", f"S{2 + i % 2}-{i}", f"S{2 + i % 2}", 0.9 - i / 20, 0.9 - i / 12) for i in range(9)]
    df = spark.createDataFrame(rows, "s1 string, target string, source string, score double, probability double")
    got = told(P.prefix_policy(df, spark.createDataFrame([("1-25", "1-25", 3.0)], "bin2 string, bin3 string, m double"), 1.0))
    side = {s: [r for r in rows if r[2] == s] for s in ("S2", "S3")}

    def value(k2, k3):
        tp = sum(r[4] for r in side["S2"][:k2]) + sum(r[4] for r in side["S3"][:k3])
        return (1.25 * tp / (tp + 0.75 + 0.75 * (k2 + k3)), -(k2 + k3), -k2, k2, k3)

    *_, k2, k3 = max(value(a, b) for a in range(len(side["S2"]) + 1) for b in range(len(side["S3"]) + 1))
    assert got == sorted((r[0], r[1]) for r in side["S2"][:k2] + side["S3"][:k3])


def test_sampler_keeps_one_easy_negative(spark):
    rows = [("A", f"S2-{i}", 0, 4 if i > 3 else 0, i) for i in range(1, 21)] + [("A", f"S3-{i}", 0, 6, 10_000) for i in range(2)] + [("A", "S2-P", 1, None, None)]
    got = S.sample_negatives(spark.createDataFrame(rows, "s1 string, target string, label int, priority int, rank int"), 8).collect()
    assert len(got) == 9 and sum(r.is_easy for r in got) == 1 and sum(r.label == 0 and r["rank"] <= 3 for r in got) == 3


def test_folds_follow_the_hash(spark):
    import hashlib

    got = ids(spark, ["S1-1", "S1-2", "x"]).withColumn("f", S.fold(F.col("s1"))).collect()
    assert all(r.f == int.from_bytes(hashlib.sha256(r.s1.encode()).digest()[:8], "big") % 5 for r in got)


def test_context_ranks(spark):
    df = spark.createDataFrame([("a", "S2-1", "S2", 0.95), ("a", "S2-2", "S2", 0.80), ("a", "S3-1", "S3", 0.97)], "s1 string, target string, source string, score double")
    r = {x.target: x for x in P.context_features(df).collect()}
    assert (r["S2-1"].rank_source, r["S2-2"].rank_source) == (1, 2) and r["S2-1"].top_minus_second_source == pytest.approx(0.15)
    assert r["S3-1"].rank_total == 1 and r["S3-1"].score_z == 0


def test_error_taxonomy(spark):
    sc = spark.createDataFrame([("a", "S2-x", "S2", 0.929999), ("b", "S2-y", "S2", 0.93), ("c", "S3-z", "S3", 0.97)], "s1 string, target string, source string, score double")
    got = A.error_stages(links(spark, {"a": ["S2-x"], "b": ["S2-y"], "c": ["S3-z"], "d": ["S2-q"]}), sc, links(spark, {"c": ["S3-z"]}))
    assert {r.s1: r.stage for r in got.collect()} == {"a": "B1_below_threshold", "b": "B2_ownership_conflict", "c": "TP", "d": "A_blocking_miss"}


def test_ownership_summary(spark):
    df = spark.createDataFrame([("a", "x", 0.99), ("b", "x", 0.98), ("c", "y", 0.97)], "s1 string, target string, score double")
    r = A.ownership_summary(df, links(spark, {"a": ["x"], "c": ["y"]}), links(spark, {"b": ["x"], "c": ["y"]})).first()
    assert (r.conflicted_targets, r.loser_true, r.tp_removed) == (1, 1, 1)


def test_list_validators(spark):
    lists = spark.createDataFrame([("S1-a", "S2-1,S2-1"), ("S1-b", ""), ("S1-b", "S3-1"), ("S1-z", "S4-1")], "s1 string, targets string")
    r = {x.rule: (x.n, x.examples) for x in V.check_lists(lists, ids(spark, ["S1-a", "S1-b", "S1-c"])).collect()}
    assert r == {"repeated_row": (1, ["S1-b"]), "bad_list": (2, ["S1-a", "S1-z"]), "unknown_s1": (1, ["S1-z"]), "missing_s1": (1, ["S1-c"])}


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "label int, score double")
    r = M.binary_metrics(df).first()
    assert r.roc_auc == pytest.approx(0.875) and r.pr_auc == pytest.approx((1 + 2 / 3) / 2)


def test_membership_hash_ignores_order(spark):
    df = links(spark, TRUTH)
    assert A.membership_hash(df).first() == A.membership_hash(df.orderBy(F.desc("target"))).first()
