"""Large tables are read once: by key, by arm and value, by p-value."""

import math

from pyspark.sql import functions as F

from sitelens.operators import aggregates as A
from sitelens.operators import ensembles as E
from sitelens.operators import joins as J
from sitelens.operators import ranking as R


def test_matches_come_from_one_join(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k long")
    out = J.with_match(left, right, ["k"])
    assert sorted((r.k or 0, r.matched) for r in out.collect()) == [(0, False), (1, True), (1, True), (2, False)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_arm_statistics_reads_its_rows_once(spark, hot, tmp_path):
    source = str(tmp_path / "long")
    rows = [("f", "a", float(i % 5)) for i in range(40)] + [("f", "b", 3.0), ("f", "b", 4.0), ("g", "a", 1.0), ("g", "a", 0.0), ("g", "b", 1.0)]
    spark.createDataFrame(rows, "feature string, arm string, value double").write.parquet(source)
    out = A.arm_statistics(spark.read.parquet(source), "feature", "arm", "value", ["a", "b"])
    found = {r.feature: (r.is_binary, r.n_a, r.n_b, r.stat_a, r.stat_b) for r in out.collect()}
    assert found == {"f": (False, 40, 2, 2.0, 3.5), "g": (True, 2, 1, 0.5, 1.0)}
    assert out.inputFiles() and not any(source in f for f in out.inputFiles())


def test_score_sums_travel_as_one_row_of_features(spark):
    rows = spark.createDataFrame([(1, 2.0, None), (1, 1.0, 1.0), (2, 0.0, 4.0)], "k long, x double, y double")
    coefs = spark.createDataFrame([(1, "x", 0.5), (1, "(intercept)", 1.0), (2, "y", -1.0)], "fold int, feature string, coef double")
    out = E.linear_score_sums(rows, coefs, ["k"], ["x", "y"])
    plain = E.linear_scores(rows, coefs, ["k"], ["x", "y"]).groupBy("k", "fold").agg(F.sum("decision").alias("decision"), F.sum("prob").alias("prob"))
    got, want = ({(r.k, r.fold): (r.decision, r.prob) for r in df.collect()} for df in (out, plain))
    assert got.keys() == want.keys() and all(math.isclose(a, b) for k in want for a, b in zip(got[k], want[k]))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "NestedLoop" not in plan


def test_repeated_p_values_need_no_cut(spark, hot, monkeypatch):
    rows = spark.range(600).select("id", (F.col("id") % 20 / 100.0).alias("p"))
    spark.conf.set("spark.sitelens.hotGroupRows", "100")

    def refused(*_, **__):
        raise AssertionError("rows were cut")

    monkeypatch.setattr(F, "percentile_approx", refused)
    found = {(round(r.p, 2), round(r.q_value, 6)) for r in R.benjamini_hochberg(rows, [], "p").collect()}
    raw = [i / 100 * 600 / (30 * (i + 1)) for i in range(20)]
    assert found == {(i / 100, round(min(1.0, *raw[i:], 1.0), 6)) for i in range(20)}
