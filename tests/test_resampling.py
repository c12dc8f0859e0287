"""Draws: exact sizes, no repeats, every member reachable, same for any partitioning."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators import resampling as RS
from sitelens.operators import splits


def requests(spark):
    return spark.createDataFrame([("a", 50, 10), ("b", 6, 6), ("c", 5, 9), ("d", 7, 6), ("e", 0, 3)], "k string, n long, w long")


def test_draws_without_replacement(spark):
    drawn = RS.draw_positions(requests(spark), ["k"], "n", "w", 200, 1)
    per = drawn.groupBy("k", "iteration").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("d"), F.max("position").alias("top")).collect()
    sizes = {"a": 10, "b": 6, "c": 5, "d": 6}
    assert len(per) == 4 * 200
    for r in per:
        assert r.n == r.d == sizes[r.k]
        assert 1 <= r.top <= {"a": 50, "b": 6, "c": 5, "d": 7}[r.k]


def test_draws_are_uniform(spark):
    drawn = RS.draw_positions(requests(spark).where("k = 'd'"), ["k"], "n", "w", 3000, 5)
    counts = [r["count"] for r in drawn.groupBy("position").count().collect()]
    assert len(counts) == 7
    assert all(abs(c - 3000 * 6 / 7) < 6 * (3000 * 6 / 49) ** 0.5 for c in counts)


def test_draws_do_not_depend_on_partitioning_or_path(spark, hot):
    get = lambda df: sorted((r.k, r.iteration, r.position) for r in RS.draw_positions(df, ["k"], "n", "w", 20, 9).collect())
    hot_path = get(requests(spark))
    spark.conf.set("spark.sitelens.smallInputBytes", str(2**30))
    assert get(requests(spark).repartition(5)) == hot_path


def test_bootstrap_of_a_constant_has_no_spread(spark):
    df = spark.createDataFrame([("x", i, 3.0) for i in range(5)] + [("y", i, 1.0) for i in range(4)], "g string, id long, v double")
    r = RS.bootstrap_mean_difference(df, [], "g", "v", "x", "y", "id", draws=50).first()
    assert (r.effect, r.ci_lower, r.ci_upper, r.se) == (2.0, 2.0, 2.0, 0.0)


def test_random_control_counts_the_observed_set(spark):
    seen = spark.createDataFrame([("s", 9.0)] * 4, "site string, e double")
    pool = spark.createDataFrame([("s", i, float(i % 3)) for i in range(40)], "site string, member long, e double")
    r = RS.matched_random_control(seen, pool, ["site"], "e", "member", iterations=50).first()
    assert r.n_random == 50 and r.p_greater == pytest.approx(1 / 51) and r.null_mean == pytest.approx(1.0, abs=0.2)


def test_bags_have_the_asked_size(spark):
    bags = splits.sample_bags(spark.range(30).withColumnRenamed("id", "doc"), "doc", 3, 8, 1)
    assert {(r.bag, r.n) for r in bags.groupBy("bag").agg(F.countDistinct("doc").alias("n")).collect()} == {(1, 8), (2, 8), (3, 8)}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_a_keyed_permutation_holds_every_place_once(spark, n):
    from sitelens.functions.draws import permutation_keys, permuted

    base = spark.range(40).select(F.col("id").alias("it")).withColumn("keys", permutation_keys(F.lit(n), 3, "it"))
    rows = permuted(base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))), "i", "keys", "place")
    per = rows.groupBy("it").agg(F.countDistinct("place").alias("d"), F.min("place").alias("lo"), F.max("place").alias("hi")).collect()
    assert len(per) == 40 and all((r.d, r.lo, r.hi) == (n, 0, n - 1) for r in per)


def test_pairs_of_draws_are_uniform(spark):
    ask = spark.createDataFrame([("a", 12, 2)], "k string, n long, w long")
    pairs = RS.draw_positions(ask, ["k"], "n", "w", 13_200, 4).groupBy("iteration").agg(F.max_by("position", "slot").alias("b"), F.min_by("position", "slot").alias("a"))
    counts = [r["count"] for r in pairs.groupBy("a", "b").count().collect()]
    assert len(counts) == 132 and sum((c - 100) ** 2 / 100 for c in counts) < 131 + 5 * (2 * 131) ** 0.5


def test_drawn_rows_are_not_broadcast(spark):
    pool = spark.range(1, 200).select(F.lit("a").alias("k"), F.col("id").alias("position"), (F.col("id") * 0.5).alias("e"))
    ask = spark.createDataFrame([("a", 199, 60)], "k string, n long, w long")
    drawn = RS.repeated_draws(ask, pool, ["k"], "n", "w", 300, 1)
    assert drawn.count() == 300 * 60
    drawn.collect()
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_best_of_draws_follows_the_law_of_the_minimum(spark):
    from math import comb

    import numpy as np

    from sitelens.functions.tails import smallest_place

    u = (np.arange(200_000) + 0.5) / 200_000
    got = smallest_place(np.full(len(u), 30), np.full(len(u), 4), u)
    for r in range(1, 28):
        assert abs((got > r).mean() - comb(30 - r, 4) / comb(30, 4)) < 2e-5
    assert got.min() == 1 and got.max() == 27
    assert (smallest_place(np.array([5, 1]), np.array([5, 1]), np.array([0.999, 0.0])) == 1).all()
    pool = spark.createDataFrame([("c", i, 100.0 - i, i) for i in range(1, 31)], "c string, m long, s double, r long")
    clusters = spark.createDataFrame([("c", 500 + i, 99.5 - i, 0) for i in range(4)], "c string, m long, s double, r long")
    row = RS.cluster_draw_test(clusters, pool, ["c"], "s", "r", "m", 4000, 7).first()
    assert row.n_random == 4000 and abs(row.null_mean_best_rank - 31 / 5) < 0.4 and row.null_median_best_rank in (4.0, 5.0, 6.0)
    tests = {r.metric: r for r in RS.cluster_hit_test(clusters, pool, ["c"], "s", "r", "m", [1, 5], 4000, 7).collect()}
    assert abs(tests["hit_rate_5"].null_mean - (1 - comb(25, 4) / comb(30, 4))) < 0.05 and tests["hit_rate_1"].observed == 1.0


@pytest.mark.parametrize("replace", [False, True])
def test_sums_of_draws_are_those_of_the_drawn_rows(spark, replace):
    """Pools held as arrays and pools joined row by row give what the drawn rows add up to; NULL keys take no part."""
    rows = spark.range(1, 701).select(
        F.when(F.col("id") % 7 != 6, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), (F.col("id") * 13 % 701).alias("m"),
        F.when(F.col("id") % 10 != 0, F.col("id") * 0.25).alias("v"))
    blocks = RS.pool_blocks(rows, ["k"], "v", "m")
    asked = blocks.groupBy("k").agg(F.sum("_n").alias("n")).withColumn("w", F.when(F.col("k") == "k0", 200).otherwise(17))
    pool = RS.number_pool(rows.where("v IS NOT NULL"), ["k"], "m")
    drawn = RS.repeated_draws(asked, pool, ["k"], "n", "w", 60, 3, replace).groupBy("k", "iteration").agg(F.sum("v"), F.count("v"))
    expected = sorted(tuple(r) for r in drawn.collect())
    get = lambda: sorted(tuple(r) for r in RS.drawn_sums(rows, blocks, asked, ["k"], "n", "w", "v", "m", 60, 3, replace).collect())
    assert len(expected) == 6 * 60 and get() == expected
    spark.conf.set(RS.HELD_ROWS_KEY, "90")
    try:
        assert get() == expected
    finally:
        spark.conf.unset(RS.HELD_ROWS_KEY)


@pytest.mark.parametrize("name", ["bootstrap", "control"])
def test_controls_make_no_row_for_a_draw(spark, name):
    rows = spark.range(400).select(F.lit("s").alias("site"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("g"), F.col("id"), (F.col("id") % 9 * 1.0).alias("v"))
    out = RS.bootstrap_mean_difference(rows, [], "g", "v", "x", "y", "id", 50) if name == "bootstrap" else RS.matched_random_control(
        rows.where("g = 'x'"), rows.where("g = 'y'"), ["site"], "v", "id", 50)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "slot" not in plan and "FlatMapGroupsInPandas" in plan


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_places_worked_out_in_a_task_are_those_of_the_columns(spark, n):
    import numpy as np

    from sitelens.functions import draws as D

    base = spark.range(n).withColumn("keys", D.permutation_keys(F.lit(n), 3, F.lit("é|x"), F.lit(8)))
    rows = D.permuted(base, "id", "keys", "place").withColumn("drawn", D.draw_index(F.lit(n), 3, F.lit("é|x"), F.lit(8), "id")).orderBy("id").collect()
    assert D.permuted_places(np.arange(n), n, D.network_keys("3|é|x", 8)).tolist() == [r.place for r in rows]
    assert (D.index_places("3|é|x", 8, [str(i).encode() for i in range(n)], n) + 1).tolist() == [r.drawn for r in rows]
