"""Targets of edges as genes."""

from sitelens.operators import joins as J


def test_targets_to_genes_is_distinct_before_the_join(spark):
    edges = spark.createDataFrame([("a", "X ", 1.0), ("a", "X ", 1.0), ("b", "x", 2.0), ("c", "none", 3.0)], "source string, target string, w double")
    genes = spark.createDataFrame([("x", 1), ("X", 1), ("x", 2), ("x", 3)], "symbol string, gene int")
    measured = spark.createDataFrame([(1,), (1,), (2,)], "gene int")
    out = J.targets_to_genes(edges, genes, measured, "target", "symbol", "gene")
    assert sorted(map(tuple, out.collect())) == [(1, "a", "X ", 1.0), (1, "b", "x", 2.0), (2, "a", "X ", 1.0), (2, "b", "x", 2.0)]
    # Nothing is grouped or exchanged after the pairs are made: the topmost operators only select.
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(line for line in plan if "Aggregate" in line or "Join" in line)
    assert "Join" in first
