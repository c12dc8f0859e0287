"""Tables that grow with the input are merged, never collected by the driver to be broadcast."""

from sitelens.catalog import cohorts as Q
from sitelens.catalog import joining
from sitelens.catalog.registry import Tables
from sitelens.operators import cohort as C
from sitelens.operators import joins as J
from sitelens.operators.ordered import merge_join, settle

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_small_inputs_are_left_to_spark(spark):
    left, right = spark.range(5).toDF("k"), spark.range(3).toDF("k")
    assert "BroadcastHashJoin" in plan(merge_join(left, right, ["k"]))
    assert {r.k for r in merge_join(left, right, ["k"]).collect()} == {0, 1, 2}


def test_settled_tables_are_never_small(spark):
    left, right = settle(spark.range(5).toDF("k")), spark.range(3).toDF("k")
    for one, other in ((left, right), (right, left), (left.distinct(), right)):
        assert "Broadcast" not in plan(merge_join(one, other, ["k"]))
        assert {r.k for r in merge_join(one, other, ["k"]).collect()} == {0, 1, 2}


def test_copies_of_genes_are_merged(hot):
    edges = hot.createDataFrame([("s", "g", 0.5), ("s", "g", 0.5), ("r", " G", None), (None, "h", 1.0), ("s", None, 1.0)], "site string, target string, weight double")
    genes = hot.createDataFrame([("g", 1), ("G", 1), ("g", 2), ("h", 3), (None, 4)], "symbol string, gene int")
    measured = hot.createDataFrame([(1,), (1,), (3,), (None,)], "gene int")
    out = J.targets_to_genes(edges, genes, measured, "target", "symbol", "gene")
    assert "SortMergeJoin" in plan(out).split("Exchange")[0] and "Broadcast" not in plan(out).split("Exchange")[0]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "s", "g", 0.5), (1, "r", " G", None), (3, None, "h", 1.0)]))


def test_parts_are_merged_with_their_lines(hot):
    t = Tables(hot, SMALL)
    assert "Broadcast" not in plan(joining.edges(t))
    top = plan(joining.targets_to_parts(t)).split("Exchange")[0]
    assert "SortMergeJoin" in top and "Broadcast" not in top


def inputs(session):
    rows = [(c, s, m, "low" if m < 2 else "high") for c in "cd" for s in ("p", "q", "r") for m in range(4)]
    members = session.createDataFrame(rows, "cohort string, site string, sample int, side string")
    targets = session.createDataFrame([("p", "g", "activate"), ("p", "h", "repress"), ("q", "h", "repress"), (None, "h", "repress")], "site string, gene string, regulation string")
    expression = session.createDataFrame([(c, g, m, float(m if g == "g" else m % 2)) for c in "cd" for g in "gh" for m in range(4)], "cohort string, gene string, sample int, expr double")
    return members, targets, expression


def test_members_and_targets_are_merged(hot):
    members, targets, expression = inputs(hot)
    names = ["cohort"], ["site"], "sample", "gene", "expr"
    activity = C.regulator_activity(members, targets, expression, *names)
    # Above the tiles only tables of a row for each site or member are left.
    assert "SortMergeJoin" in plan(activity).split("MapInArrow")[0] and "Broadcast" not in plan(activity).split("MapInArrow")[0]
    means = C.group_means(members, targets, expression, *names, ["regulation"])
    assert "SortMergeJoin" in plan(means).split("MapInArrow")[0] and "Broadcast" not in plan(means)
    assert {(r.cohort, r.site, r.gene, r.side): r.group_mean for r in means.where("site = 'p'").collect()} == {
        (c, "p", g, s): {"g": {"low": 0.5, "high": 2.5}, "h": {"low": 0.5, "high": 0.5}}[g][s] for c in "cd" for g in "gh" for s in ("low", "high")
    }


def test_sensitivity_parts_are_merged_with_their_sites(hot):
    sites = hot.createDataFrame([("c", i) for i in range(4)], "cohort string, site int")
    fits = hot.createDataFrame([("c", 1, "g", 0.5, 0.01), ("c", 1, "h", 1.5, 0.2)], "cohort string, site int, gene string, directional_coef double, p_value double")
    own = hot.createDataFrame([("c", 2, 0.25, 0.5)], "cohort string, site int, coef double, p_value double")
    out = C.robustness_summary(sites, ["cohort", "site"], adjusted_targets=fits, adjusted_activity=own)
    assert "Broadcast" not in plan(out)
    assert {r.site: (r.n_adjusted_targets, r.mean_directional_coef, r.activity_coef) for r in out.collect()} == {
        0: (None, None, None), 1: (2, 1.0, None), 2: (None, None, 0.25), 3: (None, None, None)
    }


def test_matrix_is_merged_with_its_values(hot):
    top = plan(Q.site_matrix(Tables(hot, SMALL))).split("Exchange")[0]
    assert "SortMergeJoin" in top and "Broadcast" not in top
