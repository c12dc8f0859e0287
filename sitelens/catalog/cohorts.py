"""Cohort validation: return flag = cohort, supplier = site, ship month = sample, brand = target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.catalog.registry import Tables, query, rounded, shared, whole
from sitelens.catalog.statistics import U_P, rank_sum_sql, student_sql, upper_sql
from sitelens.operators import aggregates as A
from sitelens.operators import cohort as C
from sitelens.operators import rank_tests as Q
from sitelens.operators.clean import ratio_values
from sitelens.operators.ordered import merge_join, settled

SITE = ["cohort", "site"]


def month_number(c: str = "l_shipdate"):
    return (F.year(c) * 100 + F.month(c)).cast("bigint")


@shared
def observed(t: Tables) -> DataFrame:
    return settled(t.lineitem.groupBy(
        F.col("l_returnflag").alias("cohort"), F.col("l_suppkey").alias("site"), month_number().alias("sample")
    ).agg(F.round(F.avg("l_quantity"), 2).alias("value")))


def site_matrix(t: Tables) -> DataFrame:
    """Mean quantity per (cohort, site, sample) on the full sample grid; NULL where nothing was shipped."""
    rows = observed(t)
    samples = rows.select("cohort", "sample").distinct()
    grid = rows.select(*SITE).distinct().join(samples, "cohort")
    return merge_join(grid, rows, [*SITE, "sample"], "left")


MATRIX = """obs AS (SELECT l_returnflag AS cohort, l_suppkey AS site, year(l_shipdate) * 100 + month(l_shipdate) AS sample, round(avg(l_quantity), 2) AS value FROM lineitem GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT cohort, site FROM obs) JOIN (SELECT DISTINCT cohort, sample FROM obs) USING (cohort)),
m AS (SELECT cohort, site, sample, value FROM grid LEFT JOIN obs USING (cohort, site, sample))"""


@shared
def expression(t: Tables) -> DataFrame:
    """Mean price per (cohort, brand, sample)."""
    rows = merge_join(t.lineitem, t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), ["l_partkey"])
    return settled(rows.groupBy(
        F.col("l_returnflag").alias("cohort"), F.col("p_brand").alias("gene"), month_number().alias("sample")
    ).agg(F.round(F.avg("l_extendedprice") / 1000, 3).alias("expr")))


EXPR = """ex AS (SELECT l_returnflag AS cohort, p_brand AS gene, year(l_shipdate) * 100 + month(l_shipdate) AS sample, round(avg(l_extendedprice) / 1000, 3) AS expr
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


@shared
def targets(t: Tables) -> DataFrame:
    """Signed targets of every site: brands whose mean discount is off the middle."""
    rows = merge_join(t.lineitem, t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), ["l_partkey"]).select(
        F.col("l_suppkey").alias("site"), F.col("p_brand").alias("gene"), (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("w"))
    return settled(A.collapse_edges(rows, "site", "gene", "w").select("site", "gene", "regulation"))


TARGETS = """tg AS (SELECT l_suppkey AS site, p_brand AS gene, CASE WHEN sum(w) > 0 THEN 'activate' ELSE 'repress' END AS regulation
  FROM (SELECT l_suppkey, p_brand, (l_discount * 100)::INT - 5 AS w FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE w <> 0 GROUP BY ALL HAVING sum(w) <> 0)"""

STATS = """st AS (SELECT cohort, site, avg(coalesce((value > 0)::INT, 0)) AS nonzero_ratio, avg((value IS NOT NULL)::INT) AS observed_ratio, avg((value IS NULL)::INT) AS missing_ratio,
  count(value) AS n_observed, count(*) FILTER (value IS NULL) AS n_missing, median(value) AS median_value FROM m GROUP BY ALL)"""
STATS_OUT = """cohort, site, round(nonzero_ratio, 6) AS nonzero_ratio, round(observed_ratio, 6) AS observed_ratio, round(missing_ratio, 6) AS missing_ratio, n_observed, n_missing, round(median_value, 6) AS median_value"""


@query("matrix_row_stats", f"WITH {MATRIX}, {STATS} SELECT {STATS_OUT} FROM st")
def matrix_row_stats(t: Tables) -> DataFrame:
    return rounded(A.matrix_row_stats(site_matrix(t), SITE, "value"))


@query("variable_sites_median", f"""WITH {MATRIX}, {STATS}, h AS (SELECT m.cohort, m.site, count(*) FILTER (value >= median_value) AS n_high, count(*) FILTER (value < median_value) AS n_low
  FROM m JOIN st USING (cohort, site) GROUP BY ALL) SELECT {STATS_OUT}, n_high, n_low FROM st JOIN h USING (cohort, site) WHERE n_high >= 20 AND n_low >= 20""")
def variable_sites_median(t: Tables) -> DataFrame:
    return rounded(C.variable_sites(site_matrix(t), SITE, "value", "median_nonmissing", 20))


@query("variable_sites_observed", f"WITH {MATRIX}, {STATS} SELECT {STATS_OUT} FROM st WHERE n_observed >= 15 AND n_missing >= 15")
def variable_sites_observed(t: Tables) -> DataFrame:
    return rounded(C.variable_sites(site_matrix(t), SITE, "value", "observed_missing", 15))


SPLIT_MEDIAN = f"""{MATRIX}, med AS (SELECT cohort, site, median(value) AS median_cutoff, count(value) AS n_valid, count(*) FILTER (value IS NULL) AS n_missing, count(*) AS n_matched FROM m GROUP BY ALL),
side AS (SELECT m.*, CASE WHEN value >= median_cutoff THEN 'high' ELSE 'low' END AS side FROM m JOIN med USING (cohort, site) WHERE value IS NOT NULL),
cnt AS (SELECT cohort, site, count(*) FILTER (side = 'low') AS n_low, count(*) FILTER (side = 'high') AS n_high, max(value) FILTER (side = 'low') AS low_cutoff, min(value) FILTER (side = 'high') AS high_cutoff,
  avg(value) FILTER (side = 'low') AS low_mean, avg(value) FILTER (side = 'high') AS high_mean FROM side GROUP BY ALL),
summ AS (SELECT *, CASE WHEN n_valid < 10 THEN 'insufficient_valid_samples' WHEN n_low < 5 OR n_high < 5 THEN 'insufficient_median_split_samples' ELSE 'success' END AS status FROM med JOIN cnt USING (cohort, site)),
members AS (SELECT side.cohort, side.site, sample, side FROM side JOIN summ USING (cohort, site) WHERE status = 'success')"""


@shared
def median_split(t: Tables):
    return C.split_samples(site_matrix(t), SITE, "sample", "value")


SPLIT_OUT = """cohort, site, n_low, n_high, round(low_cutoff, 9) AS low_cutoff, round(high_cutoff, 9) AS high_cutoff, round(low_mean, 9) AS low_mean, round(high_mean, 9) AS high_mean, status"""
SPLIT_COLUMNS = ["cohort", "site", "n_low", "n_high", "low_cutoff", "high_cutoff", "low_mean", "high_mean", "status"]


@query("median_split_summary", f"WITH {SPLIT_MEDIAN} SELECT {SPLIT_OUT}, n_matched, n_valid, n_missing, round(median_cutoff, 9) AS median_cutoff FROM summ")
def median_split_summary(t: Tables) -> DataFrame:
    return rounded(median_split(t)[1].select(*SPLIT_COLUMNS, "n_matched", "n_valid", "n_missing", "median_cutoff"), digits=9)


@query("median_split_members", f"WITH {SPLIT_MEDIAN} SELECT * FROM members")
def median_split_members(t: Tables) -> DataFrame:
    return median_split(t)[0]


@query("observed_split_summary", f"""WITH {MATRIX}, cnt AS (SELECT cohort, site, count(*) FILTER (value IS NULL) AS n_low, count(value) AS n_high, NULL::DOUBLE AS low_cutoff, min(value) AS high_cutoff, NULL::DOUBLE AS low_mean, avg(value) AS high_mean FROM m GROUP BY ALL),
summ AS (SELECT *, CASE WHEN n_low < 10 OR n_high < 10 THEN 'insufficient_observed_or_missing_samples' ELSE 'success' END AS status FROM cnt) SELECT {SPLIT_OUT} FROM summ""")
def observed_split_summary(t: Tables) -> DataFrame:
    return rounded(C.split_samples(site_matrix(t), SITE, "sample", "value", "observed_missing", 10)[1].select(*SPLIT_COLUMNS), digits=9)


@query("extreme_split_members", f"""WITH {MATRIX}, r AS (SELECT *, row_number() OVER (PARTITION BY cohort, site ORDER BY value, sample) AS up, count(*) OVER (PARTITION BY cohort, site) AS n FROM m WHERE value IS NOT NULL),
k AS (SELECT *, least(greatest(floor(n * 0.25), 5), floor(n / 2)) AS k FROM r)
SELECT cohort, site, sample, CASE WHEN up <= k THEN 'low' ELSE 'high' END AS side FROM k WHERE n >= 10 AND (up <= k OR up > n - k)""")
def extreme_split_members(t: Tables) -> DataFrame:
    return C.split_samples(site_matrix(t), SITE, "sample", "value", "quantile_extreme", 5)[0]


POINTS = f"""{SPLIT_MEDIAN}, {EXPR}, {TARGETS},
pts AS (SELECT cohort, site, gene, regulation, side, avg(expr) AS group_mean, count(*) AS n_samples FROM members JOIN tg USING (site) JOIN ex USING (cohort, gene, sample) GROUP BY ALL),
prs AS (SELECT cohort, site, gene, regulation, CASE WHEN cohort = 'A' THEN 'import' ELSE 'export' END AS direction, avg(group_mean) FILTER (side = 'low') AS low_mean, avg(group_mean) FILTER (side = 'high') AS high_mean FROM pts GROUP BY ALL),
prs2 AS (SELECT *, high_mean - low_mean AS target_effect, CASE WHEN (direction = 'import') = (regulation = 'activate') THEN 1 ELSE -1 END AS expected_sign FROM prs WHERE low_mean IS NOT NULL AND high_mean IS NOT NULL)"""


def points(t: Tables) -> DataFrame:
    members, _ = median_split(t)
    return C.group_means(members, targets(t), expression(t), ["cohort"], ["site"], "sample", "gene", "expr", ["regulation"])


def effects(t: Tables) -> DataFrame:
    pairs = C.high_low_pairs(points(t), ["cohort", "site", "gene", "regulation"])
    way = F.when(F.col("cohort") == "A", "import").otherwise("export")
    return C.target_effects(pairs.withColumn("direction", way), "direction", "regulation")


@query("target_group_means", f"WITH {POINTS} SELECT cohort, site, gene, regulation, side, round(group_mean, 9) AS group_mean, n_samples FROM pts")
def target_group_means(t: Tables) -> DataFrame:
    return rounded(points(t), digits=9)


@query("target_effects", f"""WITH {POINTS} SELECT cohort, site, gene, regulation, direction, round(target_effect, 9) AS target_effect, expected_sign,
  round(target_effect * expected_sign, 9) AS directional_effect FROM prs2""")
def target_effects(t: Tables) -> DataFrame:
    return rounded(effects(t).drop("low_mean", "high_mean"), digits=9)


@query("target_counts", f"""WITH {POINTS} SELECT cohort, site, count(DISTINCT gene) AS n_targets, count(DISTINCT gene) FILTER (regulation = 'activate') AS n_activated,
  count(DISTINCT gene) FILTER (regulation = 'repress') AS n_repressed FROM pts GROUP BY ALL""")
def target_counts(t: Tables) -> DataFrame:
    return C.target_counts(points(t), SITE, "gene", "regulation")


@query("pair_metadata", """SELECT l_suppkey, min(p_name) AS first_name, count(DISTINCT l_orderkey) AS n_source_sites, count(DISTINCT p_brand) AS n_source_regulators,
  string_agg(DISTINCT l_orderkey::VARCHAR, ';' ORDER BY l_orderkey::VARCHAR) AS source_sites, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS source_regulators, round(avg(l_discount), 6) AS mean_score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def pair_metadata(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    return rounded(C.pair_metadata(rows, ["l_suppkey"], "p_name", "l_orderkey", "p_brand", "l_discount"))


SIGNED = """d AS (SELECT *, round(high_mean - low_mean, 12) AS d FROM prs2),
rk AS (SELECT {k}, d, rank() OVER (PARTITION BY {k} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {k}, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY {k}, abs(d)) AS t FROM d WHERE d <> 0),
w AS (SELECT {k}, sum(r) FILTER (d > 0) AS w_plus, count(*) AS n, sum(t::DOUBLE * t - 1) AS tie FROM rk GROUP BY ALL),
z AS (SELECT *, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM w)"""


@query("site_contrasts", f"""WITH {POINTS}, {SIGNED.format(k='cohort, direction, regulation, site')}
SELECT p.cohort, p.direction, p.regulation, p.site, count(*) AS n_targets, round(avg(low_mean), 9) AS mean_low, round(avg(high_mean), 9) AS mean_high, round(avg(high_mean) - avg(low_mean), 9) AS delta, any_value(z.w_plus) AS w_plus,
  CASE WHEN any_value(expected_sign) > 0 THEN 'High > Low' ELSE 'High < Low' END AS expected FROM prs2 p JOIN z USING (cohort, direction, regulation, site) GROUP BY ALL""")
def site_contrasts(t: Tables) -> DataFrame:
    keys = ["cohort", "direction", "regulation", "site"]
    out = C.contrast_test(effects(t), keys, "direction", "regulation", ["cohort", "direction", "regulation"], "gene")
    base = out.select(*keys, "n_targets", "mean_low", "mean_high", "delta", F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), "expected")
    base = base.withColumn("w_plus", F.when(F.col("w_plus") > 0, F.col("w_plus")))
    return rounded(base, digits=9)


POOLED_KEYS = "cohort, direction, regulation"


@query("pooled_contrasts", f"""WITH {POINTS}, {SIGNED.format(k=POOLED_KEYS)}, ag AS (SELECT {POOLED_KEYS}, count(*) AS n_targets, count(DISTINCT gene) AS n_distinct_targets, count(DISTINCT site) AS n_sites, avg(low_mean) AS lo, avg(high_mean) AS hi,
  any_value(expected_sign) AS sg FROM prs2 GROUP BY ALL), pv AS (SELECT *, CASE WHEN sg > 0 THEN {upper_sql('z')} ELSE {upper_sql('(-z)')} END AS p FROM ag JOIN z USING ({POOLED_KEYS})),
q AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM pv)
SELECT {POOLED_KEYS}, n_targets, n_distinct_targets, n_sites, round(lo, 9) AS mean_low, round(hi, 9) AS mean_high, round(hi - lo, 9) AS delta, w_plus, round(p, 6) AS p_value, round(least(1, min(raw) OVER (ORDER BY p DESC)), 6) AS q_value FROM q""")
def pooled_contrasts(t: Tables) -> DataFrame:
    keys = ["cohort", "direction", "regulation"]
    out = C.contrast_test(effects(t), keys, "direction", "regulation", [], "gene", site="site")
    out = out.select(*keys, "n_targets", "n_distinct_targets", "n_sites", "mean_low", "mean_high", "delta", "w_plus", "p_value", "q_value")
    return rounded(rounded(out, ["mean_low", "mean_high", "delta"], 9), ["p_value", "q_value"], 6)


@query("cohort_pair_summary", f"""WITH {POINTS} SELECT cohort, count(*) AS n_pairs, count(DISTINCT gene) AS n_distinct_targets, count(DISTINCT site) AS n_distinct_sites, round(avg(low_mean), 9) AS mean_low, round(avg(high_mean), 9) AS mean_high
FROM prs2 WHERE regulation = 'activate' GROUP BY 1 HAVING count(*) >= 3""")
def cohort_pair_summary(t: Tables) -> DataFrame:
    return rounded(C.cohort_pair_summary(effects(t).where("regulation = 'activate'"), "cohort", "gene", "site").drop("delta"), digits=9)


@query("effect_summary", f"""WITH {POINTS} SELECT cohort, direction, regulation, site, count(*) AS n_targets, round(avg(target_effect), 9) AS mean_effect, round(avg(target_effect * expected_sign), 9) AS mean_directional,
  round(median(target_effect), 9) AS median_effect, round(median(target_effect * expected_sign), 9) AS median_directional FROM prs2 GROUP BY ALL""")
def effect_summary(t: Tables) -> DataFrame:
    out = C.summarize_effects(effects(t), ["cohort", "direction", "regulation", "site"])
    return rounded(out.drop("w_plus", "p_value", "q_value", "stars"), digits=9)


ACT = f"""{SPLIT_MEDIAN}, {EXPR}, {TARGETS}, zs0 AS (SELECT cohort, gene, avg(expr) AS mu, stddev_pop(expr) AS sd FROM ex GROUP BY ALL),
zx AS (SELECT cohort, gene, sample, (expr - mu) / nullif(sd, 0) AS z FROM ex JOIN zs0 USING (cohort, gene)),
ac AS (SELECT cohort, site, sample, side, avg(z) FILTER (regulation = 'activate') AS positive_score, avg(z) FILTER (regulation = 'repress') AS negative_score, count(*) FILTER (regulation = 'activate') AS n_positive_targets, count(*) FILTER (regulation = 'repress') AS n_negative_targets
  FROM members JOIN tg USING (site) JOIN zx USING (cohort, gene, sample) GROUP BY ALL),
act AS (SELECT *, CASE WHEN n_positive_targets > 0 AND n_negative_targets > 0 THEN positive_score - negative_score WHEN n_positive_targets > 0 THEN positive_score ELSE -negative_score END AS activity FROM ac)"""


def activity(t: Tables) -> DataFrame:
    members, _ = median_split(t)
    return C.regulator_activity(members, targets(t), expression(t), ["cohort"], ["site"], "sample", "gene", "expr")


@query("regulator_activity", f"""WITH {ACT} SELECT cohort, site, sample, side, round(positive_score, 6) AS positive_score, round(negative_score, 6) AS negative_score, n_positive_targets, n_negative_targets, round(activity, 6) AS activity FROM act""")
def regulator_activity(t: Tables) -> DataFrame:
    return rounded(activity(t))


WAY = "CASE WHEN cohort = 'A' THEN 'import' ELSE 'export' END"


def directed_activity(t: Tables) -> DataFrame:
    return activity(t).withColumn("direction", F.when(F.col("cohort") == "A", "import").otherwise("export"))


@query("activity_by_cohort", f"""WITH {ACT}, ra AS (SELECT cohort, site, sample, side, round(activity, 9) AS activity FROM act), us AS {rank_sum_sql('ra', 'cohort', 'side', 'activity', 'high', 'low')}, {U_P},
g AS (SELECT cohort, {WAY} AS direction, avg(activity) FILTER (side = 'high') AS mh, avg(activity) FILTER (side = 'low') AS ml, median(activity) FILTER (side = 'high') AS dh, median(activity) FILTER (side = 'low') AS dl FROM ra GROUP BY 1),
pv AS (SELECT *, CASE WHEN direction = 'import' THEN above ELSE below END AS p FROM g JOIN ps USING (cohort)),
q AS (SELECT *, p * count(*) OVER (PARTITION BY direction) / count(*) OVER (PARTITION BY direction ORDER BY p) AS raw FROM pv)
SELECT cohort, direction, CASE WHEN direction = 'import' THEN 'greater' ELSE 'less' END AS alternative, round(mh, 6) AS mean_high, round(ml, 6) AS mean_low, round(dh, 6) AS median_high, round(dl, 6) AS median_low, n_high, n_low, u,
  round(p, 6) AS p_value, round(least(1, min(raw) OVER (PARTITION BY direction ORDER BY p DESC)), 6) AS q_value FROM q""")
def activity_by_cohort(t: Tables) -> DataFrame:
    rows = directed_activity(t).withColumn("activity", F.round("activity", 9))
    out = C.activity_test(rows, ["cohort", "direction"], ["direction"], direction="direction")
    return rounded(out.select("cohort", "direction", "alternative", "mean_high", "mean_low", "median_high", "median_low", "n_high", "n_low", "u", "p_value", "q_value"))


@query("activity_by_site", f"""WITH {ACT} SELECT cohort, site, {WAY} AS direction, CASE WHEN cohort = 'A' THEN 'greater' ELSE 'less' END AS alternative, round(avg(activity) FILTER (side = 'high'), 6) AS mean_high, round(avg(activity) FILTER (side = 'low'), 6) AS mean_low, round(median(activity) FILTER (side = 'high'), 6) AS median_high,
  round(median(activity) FILTER (side = 'low'), 6) AS median_low, count(*) FILTER (side = 'high') AS n_high, count(*) FILTER (side = 'low') AS n_low FROM act GROUP BY ALL""")
def activity_by_site(t: Tables) -> DataFrame:
    out = C.activity_test(directed_activity(t), [*SITE, "direction"], ["cohort", "direction"], direction="direction")
    return rounded(out.drop("u", "p_value", "q_value", "stars", "delta"))


@shared
def covariates(t: Tables) -> DataFrame:
    """Mean tax per (cohort, sample) as phenotype covariate."""
    return settled(t.lineitem.groupBy(F.col("l_returnflag").alias("cohort"), month_number().alias("sample")).agg(F.round(F.avg("l_tax"), 8).alias("purity")))


COV = "cov AS (SELECT l_returnflag AS cohort, year(l_shipdate) * 100 + month(l_shipdate) AS sample, round(avg(l_tax), 8) AS purity FROM lineitem GROUP BY ALL)"


@query("residual_expression", f"""WITH {EXPR}, {COV}, j AS (SELECT * FROM ex JOIN cov USING (cohort, sample)), f AS (SELECT cohort, gene, regr_slope(expr, purity) AS b, regr_intercept(expr, purity) AS a, count(*) AS n, var_pop(purity) AS v FROM j GROUP BY ALL)
SELECT cohort, gene, sample, CASE WHEN n >= 10 AND v > 0 THEN round(expr - a - b * purity, 6) END AS residual FROM j JOIN f USING (cohort, gene)""")
def residual_expression(t: Tables) -> DataFrame:
    out = C.residual_expression(expression(t), covariates(t), ["cohort"], "gene", "sample", "expr", "purity")
    return rounded(out.select("cohort", "gene", "sample", "residual"))


@query("covariate_frame", f"""WITH {MATRIX}, {COV}, g AS (SELECT l_returnflag AS cohort, l_suppkey AS site, year(l_shipdate) * 100 + month(l_shipdate) AS sample, round(avg(l_tax), 8) AS v FROM lineitem GROUP BY ALL)
SELECT m.cohort, m.site, m.sample, g.v AS own_tax FROM m LEFT JOIN g USING (cohort, site, sample)""")
def covariate_frame(t: Tables) -> DataFrame:
    own = t.lineitem.groupBy(F.col("l_returnflag").alias("cohort"), F.col("l_suppkey").alias("site"), month_number().alias("sample")).agg(F.round(F.avg("l_tax"), 8).alias("value"))
    return C.covariate_frame(site_matrix(t).select(*SITE, "sample"), {"own_tax": own}, [*SITE, "sample"])


ADJ = f"""{ACT}, {COV}, rows AS (SELECT a.cohort, a.site, round(activity, 9) AS y, value AS x, purity AS z FROM act a JOIN m USING (cohort, site, sample) JOIN cov USING (cohort, sample)),
s AS (SELECT cohort, site, count(*) AS n, var_pop(x) AS s11, var_pop(z) AS s22, covar_pop(x, z) AS s12, covar_pop(y, x) AS s1y, covar_pop(y, z) AS s2y, var_pop(y) AS syy FROM rows GROUP BY ALL),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
r AS (SELECT *, b1 / sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / det) AS tv, (n - 3)::DOUBLE AS dof FROM b)"""


@query("adjusted_activity", f"""WITH {ADJ} SELECT cohort, site, n AS n_samples, CASE WHEN n >= 10 THEN round(b1, 7) END AS coef, CASE WHEN n >= 10 THEN round({student_sql('tv', 'dof')}, 5) END AS p_value FROM r""")
def adjusted_activity(t: Tables) -> DataFrame:
    rows = activity(t).withColumn("activity", F.round("activity", 9))
    rows = merge_join(rows, observed(t), [*SITE, "sample"]).join(covariates(t), ["cohort", "sample"])
    out = C.adjusted_association(rows, SITE, "activity", "value", ["purity"], ["cohort"])
    return rounded(rounded(out.select(*SITE, "n_samples", "coef", "p_value"), ["coef"], 7), ["p_value"], 5)


def target_fits(t: Tables, fdr_keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Coefficient of the site's value on each of its targets beside the purity."""
    rows = observed(t).join(covariates(t), ["cohort", "sample"])
    return C.adjusted_target_association(
        rows, targets(t), expression(t), ["cohort"], ["site"], "sample", "gene", "expr", "value", ["purity"], fdr_keys, extra=extra)


@query("adjusted_targets", f"""WITH {MATRIX}, {EXPR}, {TARGETS}, {COV}, rows AS (SELECT o.cohort, o.site, gene, expr AS y, o.value AS x, purity AS z FROM obs o JOIN tg USING (site) JOIN ex USING (cohort, gene, sample) JOIN cov USING (cohort, sample)),
s AS (SELECT cohort, site, gene, count(*) AS n, var_pop(x) AS s11, var_pop(z) AS s22, covar_pop(x, z) AS s12, covar_pop(y, x) AS s1y, covar_pop(y, z) AS s2y FROM rows GROUP BY ALL)
SELECT cohort, site, gene, n AS n_samples, CASE WHEN n >= 10 THEN round((s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12), 7) END AS coef FROM s""")
def adjusted_targets(t: Tables) -> DataFrame:
    out = target_fits(t, ["cohort", "site"])
    return rounded(out.select(*SITE, "gene", "n_samples", "coef"), digits=7)


@query("abundance_diagnostic", f"""WITH {SPLIT_MEDIAN}, {COV}, rows AS (SELECT cohort, site, sample, side, value, purity, cohort || '|' || site AS cs FROM members JOIN m USING (cohort, site, sample) JOIN cov USING (cohort, sample)),
us AS {rank_sum_sql('rows', 'cs', 'side', 'purity', 'high', 'low')},
rk AS (SELECT cs, rank() OVER (PARTITION BY cs ORDER BY value) + (count(*) OVER (PARTITION BY cs, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY cs ORDER BY purity) + (count(*) OVER (PARTITION BY cs, purity) - 1) / 2 AS ry FROM rows),
sp AS (SELECT cs, corr(rx, ry) AS rho FROM rk GROUP BY 1), g AS (SELECT cs, any_value(cohort) AS cohort, any_value(site) AS site, avg(purity) FILTER (side = 'high') AS h, avg(purity) FILTER (side = 'low') AS l FROM rows GROUP BY cs)
SELECT cohort, site, round(h, 6) AS mean_high, round(l, 6) AS mean_low, u, round(rho, 6) AS rho FROM g JOIN us USING (cs) JOIN sp USING (cs)""")
def abundance_diagnostic(t: Tables) -> DataFrame:
    members, _ = median_split(t)
    rows = merge_join(members, observed(t), [*SITE, "sample"]).join(covariates(t), ["cohort", "sample"])
    out = C.abundance_diagnostic(rows, SITE, "value", "purity")
    return rounded(out.select(*SITE, "mean_high", "mean_low", "u", "rho"))


def shifted(t: Tables) -> DataFrame:
    """Site matrix less a value of the site's own, as the site's protein is taken off: its mean discount in percent."""
    own = t.lineitem.groupBy(F.col("l_returnflag").alias("cohort"), F.col("l_suppkey").alias("site"), month_number().alias("sample")).agg(
        F.round(F.avg("l_discount") * 100, 2).alias("value"))
    out = ratio_values(site_matrix(t), own, [*SITE, "sample"])
    return out.withColumn("value", F.round("value", 6))


RATIO = f"""ownd AS (SELECT l_returnflag AS cohort, l_suppkey AS site, year(l_shipdate) * 100 + month(l_shipdate) AS sample, round(avg(l_discount) * 100, 2) AS base FROM lineitem GROUP BY ALL),
m2 AS (SELECT cohort, site, sample, round(value - base, 6) AS value FROM m LEFT JOIN ownd USING (cohort, site, sample)),
med2 AS (SELECT cohort, site, median(value) AS cut, count(value) AS n_valid FROM m2 GROUP BY ALL),
side2 AS (SELECT m2.*, CASE WHEN value >= cut THEN 'high' ELSE 'low' END AS side FROM m2 JOIN med2 USING (cohort, site) WHERE value IS NOT NULL AND n_valid >= 10),
mem2 AS (SELECT * FROM side2 QUALIFY count(*) FILTER (side = 'low') OVER (PARTITION BY cohort, site) >= 5 AND count(*) FILTER (side = 'high') OVER (PARTITION BY cohort, site) >= 5),
pr2 AS (SELECT cohort, site, gene, regulation, avg(expr) FILTER (side = 'high') - avg(expr) FILTER (side = 'low') AS eff FROM mem2 JOIN tg USING (site) JOIN ex USING (cohort, gene, sample) GROUP BY ALL),
ra2 AS (SELECT cohort, site, avg(d) AS ratio_mean_directional FROM (SELECT cohort, site, regulation, avg(CASE WHEN (cohort = 'A') = (regulation = 'activate') THEN eff ELSE -eff END) AS d FROM pr2 WHERE eff IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


@query("ratio_sensitivity", f"""WITH {SPLIT_MEDIAN}, {EXPR}, {TARGETS}, {RATIO} SELECT cohort, site, regulation, count(*) AS n_targets, round(avg(CASE WHEN (cohort = 'A') = (regulation = 'activate') THEN eff ELSE -eff END), 9) AS mean_directional
FROM pr2 WHERE eff IS NOT NULL GROUP BY ALL""")
def ratio_sensitivity(t: Tables) -> DataFrame:
    return rounded(ratio_effects(t).select(*SITE, "regulation", "n_targets", "mean_directional"), digits=9)


def ratio_effects(t: Tables) -> DataFrame:
    """Split, contrast and summary of every site once more on its shifted values."""
    members, _ = C.split_samples(shifted(t), SITE, "sample", "value")
    means = C.group_means(members, targets(t), expression(t), ["cohort"], ["site"], "sample", "gene", "expr", ["regulation"])
    pairs = C.high_low_pairs(means, [*SITE, "gene", "regulation"])
    moved = C.target_effects(pairs.withColumn("direction", F.when(F.col("cohort") == "A", "import").otherwise("export")), "direction", "regulation")
    return C.summarize_effects(moved, [*SITE, "regulation"])


@query("robustness_summary", f"""WITH {ADJ}, {RATIO}, base AS (SELECT cohort, site FROM summ WHERE status = 'success'),
drows AS (SELECT cohort, site, side, value, purity, cohort || '|' || site AS cs FROM members JOIN m USING (cohort, site, sample) JOIN cov USING (cohort, sample) WHERE value IS NOT NULL),
us AS {rank_sum_sql('drows', 'cs', 'side', 'purity', 'high', 'low')}, {U_P},
dg AS (SELECT cohort, site, any_value(cs) AS cs, avg(purity) FILTER (side = 'low') AS lo, avg(purity) FILTER (side = 'high') AS hi FROM drows GROUP BY ALL),
dgp AS (SELECT cohort, site, lo, hi, least(1, 2 * least(above, below)) AS p FROM dg LEFT JOIN ps USING (cs)),
tr AS (SELECT o.cohort, o.site, gene, regulation, expr AS y, o.value AS x, purity AS z FROM obs o JOIN tg USING (site) JOIN ex USING (cohort, gene, sample) JOIN cov USING (cohort, sample)),
tf AS (SELECT cohort, site, gene, regulation, count(*) AS n, (covar_pop(y, x) * var_pop(z) - covar_pop(y, z) * covar_pop(x, z)) / (var_pop(x) * var_pop(z) - covar_pop(x, z) * covar_pop(x, z)) AS c FROM tr GROUP BY ALL),
ta AS (SELECT cohort, site, count(DISTINCT gene) AS n_adjusted_targets, avg(CASE WHEN n >= 10 THEN CASE WHEN (cohort = 'A') = (regulation = 'activate') THEN c ELSE -c END END) AS mdc FROM tf GROUP BY ALL)
SELECT cohort, site, round(lo, 6) AS purity_mean_low, round(hi, 6) AS purity_mean_high, round(dgp.p, 6) AS purity_p, round(ratio_mean_directional, 6) AS ratio_mean_directional, n_adjusted_targets, round(mdc, 6) AS mean_directional_coef,
  CASE WHEN r.n >= 10 THEN round(b1, 6) END AS activity_coef, coalesce(dgp.p < 0.05, false) AS possible_confounding
FROM base LEFT JOIN dgp USING (cohort, site) LEFT JOIN ra2 USING (cohort, site) LEFT JOIN ta USING (cohort, site) LEFT JOIN r USING (cohort, site)""")
def robustness_summary(t: Tables) -> DataFrame:
    members, summary = median_split(t)
    rows = merge_join(members, observed(t), [*SITE, "sample"]).join(covariates(t), ["cohort", "sample"])
    way = F.when(F.col("cohort") == "A", "import").otherwise("export")
    adjusted = target_fits(t, [], ("regulation",)).withColumn("direction", way).withColumn("directional_coef", S.directional_effect("coef", "direction", "regulation"))
    own = activity(t).withColumn("activity", F.round("activity", 9))
    own = merge_join(own, observed(t), [*SITE, "sample"]).join(covariates(t), ["cohort", "sample"])
    out = C.robustness_summary(
        summary.where("status = 'success'").select(*SITE),
        SITE,
        diagnostics=C.abundance_diagnostics(rows, SITE, "value", ["purity"]),
        abundances=["purity"],
        ratio=ratio_effects(t),
        adjusted_targets=adjusted,
        adjusted_activity=C.adjusted_association(own, SITE, "activity", "value", ["purity"], []),
    )
    return rounded(out.select(*SITE, "purity_mean_low", "purity_mean_high", "purity_p", "ratio_mean_directional", "n_adjusted_targets", "mean_directional_coef", "activity_coef", "possible_confounding"))


@query("site_status", f"""WITH {POINTS}, base AS (SELECT DISTINCT l_returnflag AS cohort, s_suppkey AS site FROM supplier, (SELECT DISTINCT l_returnflag FROM lineitem))
SELECT b.cohort, b.site, CASE WHEN NOT EXISTS (SELECT 1 FROM obs o WHERE o.cohort = b.cohort AND o.site = b.site) THEN 'site_not_in_matrix'
  WHEN NOT EXISTS (SELECT 1 FROM summ s WHERE s.cohort = b.cohort AND s.site = b.site AND status = 'success') THEN 'insufficient_samples'
  WHEN NOT EXISTS (SELECT 1 FROM tg WHERE tg.site = b.site) THEN 'no_signed_targets'
  WHEN NOT EXISTS (SELECT 1 FROM pts p WHERE p.cohort = b.cohort AND p.site = b.site) THEN 'no_valid_expression_values' ELSE 'success' END AS status FROM base b""")
def site_status(t: Tables) -> DataFrame:
    members, summary = median_split(t)
    with_values = C.sites_with_values(members, targets(t), expression(t), ["cohort"], ["site"], "sample", "gene")
    cohorts = observed(t).select("cohort").distinct()
    every = cohorts.agg(F.collect_set("cohort").alias("_c"))
    sites = t.supplier.select(F.col("s_suppkey").alias("site")).crossJoin(F.broadcast(every)).select(
        "site", F.explode("_c").alias("cohort"))
    with_targets = sites.join(targets(t).select("site").distinct(), "site", "left_semi")
    return C.site_status(
        sites,
        [
            (observed(t), "site_not_in_matrix"),
            (summary.where("status = 'success'"), "insufficient_samples"),
            (with_targets, "no_signed_targets"),
            (with_values, "no_valid_expression_values"),
        ],
        SITE,
    )


@query("cohort_activity_summary", f"""WITH {ACT} SELECT cohort, count(*) AS n_samples, CASE cohort WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END::BIGINT AS cohort_order FROM act GROUP BY 1""")
def cohort_activity_summary(t: Tables) -> DataFrame:
    rows = settled(activity(t))
    out = C.cohort_activity_summary(rows, C.activity_test(rows, ["cohort"], []), "cohort", ["R", "N"])
    return whole(out.select("cohort", "n_samples", "cohort_order"), "cohort_order")


@query("expression_zscores", f"""WITH {EXPR} SELECT cohort, gene, sample, round((expr - avg(expr) OVER w) / nullif(stddev_pop(expr) OVER w, 0), 6) AS z FROM ex WINDOW w AS (PARTITION BY cohort, gene)""")
def expression_zscores(t: Tables) -> DataFrame:
    return rounded(Q.row_zscore(expression(t), ["cohort", "gene"], "expr").drop("expr"))
