"""Large intermediates are worked out and written once."""

from pyspark.sql import functions as F

from sitelens.operators import ordered
from sitelens.operators.aggregates import collapse_edges
from sitelens.operators.cohort import group_means


def test_settle_works_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(20).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id") / 7.0)).mapInArrow(count, "id long, x double")
    out = ordered.settle(rows)
    assert seen.value == 20
    assert sorted(map(tuple, out.collect())) == [(i, i / 7.0 if i % 3 else None) for i in range(20)]
    assert ordered.settle(spark.range(3).select(F.lit(None).alias("a"))).count() == 3


def test_group_means_of_settled_tables(hot):
    members = hot.createDataFrame([("c", s, m, "low" if m < 2 else "high") for s in ("p", "q") for m in range(4)], "cohort string, site string, sample int, side string")
    targets = hot.createDataFrame([("p", "g", "activate"), ("p", "h", "repress"), ("q", "h", "activate")], "site string, gene string, regulation string")
    expression = hot.createDataFrame([("c", g, m, float(m + len(g) * (g == "h"))) for g in ("g", "h") for m in range(4)], "cohort string, gene string, sample int, expr double")
    out = group_means(members, targets, expression, ["cohort"], ["site"], "sample", "gene", "expr", ["regulation"])
    got = {(r["site"], r["gene"], r["side"]): (r["group_mean"], r["n_samples"]) for r in out.collect()}
    assert got == {
        ("p", "g", "low"): (0.5, 2), ("p", "g", "high"): (2.5, 2),
        ("p", "h", "low"): (1.5, 2), ("p", "h", "high"): (3.5, 2),
        ("q", "h", "low"): (1.5, 2), ("q", "h", "high"): (3.5, 2),
    }


def test_signs_of_edges_need_no_distinct_count(spark):
    edges = spark.createDataFrame([("a", "x", 2.0), ("A", "x", -1.0), ("b", "x", 1.0), ("b", "x", 3.0), ("c", "x", -1.0), ("c", "x", 0.0)], "s string, t string, w double")
    out = collapse_edges(edges, "s", "t", "w")
    assert {r["s"]: (r["n_signs"], r["n_edges"], r["sign_conflict"]) for r in out.collect()} == {"A": (2, 2, True), "b": (1, 2, False), "c": (1, 1, False)}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
