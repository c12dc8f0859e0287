"""Cohort queries make their inputs once, and no row for a sample of a (site, target) pair."""

from sitelens.catalog import cohorts as Q
from sitelens.catalog.registry import Tables
from sitelens.operators import cohort as C
from sitelens.operators import rank_tests as R

SMALL = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_site_status_reads_lineitem_in_no_step_twice(hot):
    t = Tables(hot, SMALL)
    out = Q.site_status(t)
    assert Q.observed(t) is Q.observed(t) and Q.median_split(t) is Q.median_split(t)
    assert Q.observed(t) is not Q.observed(Tables(hot, SMALL))
    assert out.inputFiles() and not any("lineitem" in f for f in out.inputFiles())
    assert "MapInArrow" not in executed(out)


def test_activity_writes_its_members_once(hot, tmp_path):
    source = str(tmp_path / "members")
    rows = [("c", s, m, "low" if m < 2 else "high") for s in ("p", "q", "r") for m in range(4)]
    hot.createDataFrame(rows, "cohort string, site string, sample int, side string").write.parquet(source)
    targets = hot.createDataFrame([("p", "g", "activate"), ("p", "h", "repress"), ("q", "h", "repress")], "site string, gene string, regulation string")
    expression = hot.createDataFrame([("c", g, m, float(m if g == "g" else m % 2)) for g in "gh" for m in range(4)], "cohort string, gene string, sample int, expr double")
    members = hot.read.parquet(source)
    out = C.regulator_activity(members, targets, expression, ["cohort"], ["site"], "sample", "gene", "expr")
    assert not any(source in f for f in out.inputFiles())
    found = {(r.site, r.sample): round(r.activity, 6) for r in out.collect()}
    assert found == {(s, m): round((s == "p") * (m - 1.5) / 1.25**0.5 - (1 if m % 2 else -1), 6) for s in "pq" for m in range(4)}
    hot.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(out.drop("side").join(members, ["cohort", "site", "sample"])).split("== Initial Plan ==")[-1]
    finally:
        hot.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = plan.split("Join")[1]
    assert "Exchange" not in top


def test_sites_with_values_are_those_of_group_means(hot):
    members = hot.createDataFrame(
        [("c", s, m, "low" if m < 2 else "high") for s in "pqr" for m in range(3)] + [("d", "p", 9, "high")],
        "cohort string, site string, sample int, side string",
    )
    targets = hot.createDataFrame([("p", "g", "activate"), ("q", "h", "repress"), ("q", "i", "repress"), (None, "g", "repress")], "site string, gene string, regulation string")
    expression = hot.createDataFrame([("c", "g", 1, None), ("c", "h", 7, 1.0), ("d", "g", 8, 1.0), ("c", "i", None, 1.0)], "cohort string, gene string, sample int, expr double")
    names = ["cohort"], ["site"], "sample", "gene"
    found = {tuple(r) for r in C.sites_with_values(members, targets, expression, *names).collect()}
    means = C.group_means(members, targets, expression, *names, "expr", ["regulation"]).select("cohort", "site").distinct()
    assert found == {tuple(r) for r in means.collect()} == {("c", "p")}


def test_abundance_diagnostic_makes_its_rows_once(spark, hot, tmp_path):
    source = str(tmp_path / "rows")
    rows = [("c", i % 2, "high" if i % 3 else "low", float(i % 7), float((i * i) % 5) if i % 11 else None) for i in range(60)]
    spark.createDataFrame(rows, "cohort string, site int, side string, value double, purity double").write.parquet(source)
    keys = ["cohort", "site"]
    found = []
    for limit in ("4", "1000"):
        spark.conf.set("spark.sitelens.hotGroupRows", limit)
        out = C.abundance_diagnostic(spark.read.parquet(source), keys, "value", "purity")
        assert out.inputFiles() and not any(source in f for f in out.inputFiles())
        found.append({r.site: (r.n_high, r.n_low, r.u, round(r.rho, 12), r.higher_in_high) for r in out.collect()})
    assert found[0] == found[1] and len(found[0]) == 2


def test_ordinary_groups_are_ranked_in_one_shuffle(spark, hot):
    spark.conf.set("spark.sitelens.hotGroupRows", "1000")
    nan = float("nan")
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 1.0), (1, 3.0, nan), (1, 4.0, 0.0), (1, 0.0, -0.0), (1, None, 9.0), (2, 1.0, 1.0)], "k int, x double, y double")
    out = R.spearman(rows, ["k"], "x", "y")
    # ranks 2.5, 2.5, 4, 5, 1 and 4, 3, 5, 1.5, 1.5
    assert {r.k: (r.n_pairs, r.rho and round(r.rho, 9)) for r in out.collect()} == {1: (5, 0.157894737), 2: (1, None)}
    plan = executed(out).split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_adjusted_targets_equal_the_regressions_of_joined_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("c", s, m, 5e4 + ((m * m + ord(s)) % 11) / 100, ((m * 7 + ord(s)) % 13) / 1000) for s in "pqr" for m in range(20)]
    rows += [("c", "k", m, 0.1, m / 7) for m in range(12)] + [("d", "p", m, float(m % 4), 1.0 + m % 3) for m in range(9)]
    rows += [("c", "n", m, nan if m == 3 else float(m * m % 5), float(m % 7)) for m in range(15)] + [("c", None, 1, 1.0, 1.0), ("c", "p", 21, None, 1.0)]
    rows = spark.createDataFrame(rows, "cohort string, site string, sample int, value double, purity double")
    targets = spark.createDataFrame([(s, g, "activate") for s in "pqrkn" for g in "ghi"] + [("p", "z", "repress"), ("p", None, "repress")], "site string, gene string, regulation string")
    held = [("c", g, m, 3.0 + ((m * m * 3 + ord(g)) % 17) / 7) for g in "gh" for m in range(22) if g == "g" or m not in (3, 8)]
    held += [("d", "g", m, float(m * m % 5)) for m in range(9)] + [("c", "i", m, inf if m == 2 else 1.0 * (m % 2)) for m in range(18)]
    expression = spark.createDataFrame(held, "cohort string, gene string, sample int, expr double")
    joined = rows.join(targets, "site").join(expression, ["cohort", "gene", "sample"])
    keys = ["cohort", "site", "gene", "regulation"]
    plain = C.adjusted_association(joined, keys, "expr", "value", ["purity"], ["cohort"], 9)
    names = ["cohort"], ["site"], "sample", "gene", "expr", "value", ["purity"], ["cohort"], 9
    out = C.adjusted_target_association(rows, targets, expression, *names, extra=["regulation"])

    def shown(df):
        return {tuple(r[k] for k in keys): (r.n_samples, *[None if v is None else round(v, 7) for v in (r.coef, r.p_value, r.q_value)]) for r in df.collect()}

    found = shown(out)
    assert found == shown(plain)
    assert found[("c", "n", "h", "activate")][1] is not None and found[("c", "n", "g", "activate")][1] is None
    assert found[("c", "k", "g", "activate")][1] is None and len(found) == 16


def test_adjusted_targets_make_no_row_for_a_sample_of_a_pair(hot, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows were joined")

    monkeypatch.setattr(C, "ols_coefficient", refused)
    t = Tables(hot, SMALL)
    assert Q.adjusted_targets(t).count() > 0
    assert {m.__name__ for m in t.made} == {"observed", "covariates", "targets", "expression"}
