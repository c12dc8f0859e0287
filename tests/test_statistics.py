"""Tests against published values, brute force and hand-computed small tables."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from sitelens.functions import tails
from sitelens.operators import metrics, rank_tests


def test_exact_rank_sum_matches_enumeration():
    m, n = 4, 6
    counts = tails.rank_sum_counts(m, n)
    seen = [0] * (m * n + 1)
    for chosen in itertools.combinations(range(1, m + n + 1), m):
        seen[sum(chosen) - m * (m + 1) // 2] += 1
    total = math.comb(m + n, m)
    assert [round(c * total) for c in counts] == seen


def test_exact_signed_rank_matches_enumeration():
    n = 6
    counts = tails.signed_rank_counts(n)
    seen = [0] * (n * (n + 1) // 2 + 1)
    for signs in itertools.product((0, 1), repeat=n):
        seen[sum(r for r, s in zip(range(1, n + 1), signs) if s)] += 1
    assert [round(c * 2**n) for c in counts] == seen


def test_student_tail_known_points():
    # Table values: two-sided 5 % points.
    for dof, t in ((1, 12.706), (5, 2.571), (10, 2.228), (30, 2.042)):
        assert tails.student_p(t, dof) == pytest.approx(0.05, abs=2e-4)


def test_fisher_tea_tasting():
    assert tails.fisher_p(3, 1, 1, 3, "greater") == pytest.approx(17 / 70)
    assert tails.fisher_p(3, 1, 1, 3, "two-sided") == pytest.approx(34 / 70)


def test_expected_reciprocal_rank_by_enumeration():
    n, p = 7, 3
    firsts = [min(c) for c in itertools.combinations(range(1, n + 1), p)]
    assert tails.expected_reciprocal_rank(n, p) == pytest.approx(sum(1 / f for f in firsts) / len(firsts))


def test_rank_sum_small_groups(spark):
    rows = [("t", "high", v) for v in (5.0, 6.0, 7.0)] + [("t", "low", v) for v in (1.0, 2.0, 3.0)]
    rows += [("few", "high", 1.0), ("few", "low", 2.0), ("flat", "high", 1.0)] + [("flat", "low", 1.0)] * 3
    out = {r.k: r for r in rank_tests.rank_sum_test(spark.createDataFrame(rows, "k string, side string, v double"), ["k"], "side", "v").collect()}
    assert out["t"].u == 9.0 and out["t"].p_value == pytest.approx(0.1)
    assert out["few"].p_value is None and out["flat"].p_value is None


def test_two_group_test_medians(spark):
    rows = [("high", float(v)) for v in (1, 2, 9, 10)] + [("low", float(v)) for v in (2, 2, 5)]
    r = rank_tests.two_group_test(spark.createDataFrame(rows, "side string, v double"), [], "side", "v").first()
    assert (r.n_high, r.n_low, r.median_high, r.median_low) == (4, 3, 5.5, 2.0)
    assert r.mean_high == pytest.approx(5.5) and r.mean_low == pytest.approx(3.0)


def test_signed_rank_zeros_and_ties(spark):
    rows = [("a", d) for d in (0.0, 1.0, -1.0, 2.0, 3.0)] + [("zero", 0.0)] * 4 + [("few", 1.0)] * 2
    out = {r.k: r for r in rank_tests.signed_rank_test(spark.createDataFrame(rows, "k string, d double"), ["k"], "d").collect()}
    assert out["a"].w_plus == 1.5 + 3 + 4 and out["a"].n_zero == 1 and out["a"].tie_term == 6
    assert out["zero"].p_value is None and out["few"].p_value is None


def test_ols_guards(spark):
    rows = [("ok", float(i), 2.0 * i + (i % 3), 1.0) for i in range(12)] + [("flat", 1.0, float(i), 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, x double, y double, c double")
    out = {r.k: r for r in rank_tests.ols_coefficient(df, ["k"], "y", "x").collect()}
    assert out["ok"].coef == pytest.approx(2.0, abs=0.1) and out["ok"].p_value < 1e-6
    assert out["flat"].coef is None
    with_constant = rank_tests.ols_coefficient(df.where("k = 'ok'"), ["k"], "y", "x", ["c"]).first()
    assert with_constant.coef is None


def test_auroc_flips_with_sign_and_needs_two_classes(spark):
    rows = [("a", float(s), int(s > 4) if s != 3 else 1) for s in range(10)] + [("one", 1.0, 1), ("one", 2.0, 1)]
    df = spark.createDataFrame(rows, "k string, s double, y int")
    up = {r.k: r.auroc for r in metrics.ranking_metrics(df, ["k"], "s", "y").collect()}
    down = {r.k: r.auroc for r in metrics.ranking_metrics(df.withColumn("s", -F.col("s")), ["k"], "s", "y").collect()}
    assert up["a"] + down["a"] == pytest.approx(1.0) and up["one"] is None


def test_constant_scores_give_half(spark):
    df = spark.createDataFrame([(0.3, 1), (0.3, 0), (0.3, 0)], "s double, y int")
    r = metrics.ranking_metrics(df, [], "s", "y").first()
    assert r.auroc == 0.5 and r.average_precision == pytest.approx(1 / 3)


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([("a", 0.4), ("a", 0.5), ("a", 0.6), ("one", 0.5)], "k string, v double")
    out = rank_tests.kernel_density(df, ["k"], "v", points=201).groupBy("k").agg((F.sum("density") / 200).alias("area")).collect()
    assert all(r.area == pytest.approx(1.0, abs=0.05) for r in out)
