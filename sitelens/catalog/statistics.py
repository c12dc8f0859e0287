"""Rank tests, exact tests, regression, density and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.catalog.ranking import PERMUTATIONS, scored
from sitelens.catalog.registry import Tables, query, rounded
from sitelens.functions.draws import PRIME, ROUNDS
from sitelens.operators import rank_tests as Q
from sitelens.operators import ranking as R
from sitelens.operators import resampling as RS
from sitelens.operators.ordered import settled


def upper_sql(z: str) -> str:
    """Upper normal tail by Simpson's rule on 400 steps."""
    return f"""(0.5 - sign({z}) * least(abs({z}), 12) / 1200 * 0.3989422804014327 * list_sum(list_transform(range(0, 401),
      lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow(least(abs({z}), 12) * i / 400, 2)))))"""


def student_sql(tv: str, dof: str) -> str:
    """Two-sided t tail by Simpson's rule on 4000 steps."""
    return f"""(1 - 2 * exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt({dof} * pi()) * least(abs({tv}), 60) / 12000 * list_sum(list_transform(range(0, 4001),
      lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(least(abs({tv}), 60) * i / 4000, 2) / {dof}, -({dof} + 1) / 2))))"""


def rank_sum_sql(source: str, key: str, group: str, value: str, high: str, low: str) -> str:
    """CTE body: key, n_high, n_low, u, tie_term."""
    return f"""(SELECT {key}, count(*) FILTER ({group} = '{high}') AS n_high, count(*) FILTER ({group} = '{low}') AS n_low,
      sum(r) FILTER ({group} = '{high}') - count(*) FILTER ({group} = '{high}') * (count(*) FILTER ({group} = '{high}') + 1) / 2 AS u,
      sum(t::DOUBLE * t - 1) AS tie_term
      FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY {value}) + (count(*) OVER (PARTITION BY {key}, {value}) - 1) / 2 AS r,
              count(*) OVER (PARTITION BY {key}, {value}) AS t FROM {source} WHERE {value} IS NOT NULL AND {group} IN ('{high}', '{low}')) GROUP BY {key})"""


U_P = f"""zs AS (SELECT *, sqrt(n_high::DOUBLE * n_low / 12 * ((n_high + n_low + 1) - tie_term / ((n_high + n_low)::DOUBLE * (n_high + n_low - 1)))) AS sd FROM us),
ps AS (SELECT *, {upper_sql('((u - n_high::DOUBLE * n_low / 2 - 0.5) / sd)')} AS above, {upper_sql('((n_high::DOUBLE * n_low / 2 - u - 0.5) / sd)')} AS below FROM zs)"""


@query("rank_sum_two_sided", f"""WITH us AS {rank_sum_sql('orders', 'o_orderpriority', 'o_orderstatus', 'o_totalprice', 'F', 'O')}, {U_P}
SELECT o_orderpriority, n_high, n_low, u, round(least(1, 2 * least(above, below)), 6) AS p_value FROM ps""")
def rank_sum_two_sided(t: Tables) -> DataFrame:
    out = Q.rank_sum_test(t.orders, ["o_orderpriority"], "o_orderstatus", "o_totalprice", "F", "O")
    return rounded(out.select("o_orderpriority", "n_high", "n_low", "u", "p_value"))


EXACT_P = """n AS (SELECT k, count(*) AS n, count(*) FILTER (g = 'high') AS m, sum(r) FILTER (g = 'high') AS w FROM ranked GROUP BY 1),
dp(i, m, s, c) AS (SELECT 0, 0, 0, 1::DOUBLE UNION ALL
  SELECT i + 1, m + t, s + t * (i + 1), sum(c) FROM dp, (VALUES (0), (1)) v(t) WHERE i < (SELECT max(n) FROM n) AND m + t <= (SELECT max(n.m) FROM n) GROUP BY ALL)"""


@query("rank_sum_exact", f"""WITH RECURSIVE ranked AS (SELECT s_nationkey % 5 AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'high' ELSE 'low' END AS g, rank() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_acctbal) AS r FROM supplier), {EXACT_P}
SELECT k, any_value(n.m) AS n_high, any_value(n.n - n.m) AS n_low, round(sum(c) FILTER (s >= w) / sum(c), 9) AS p_value, 'exact' AS method FROM n JOIN dp ON dp.i = n.n AND dp.m = n.m GROUP BY k""")
def rank_sum_exact(t: Tables) -> DataFrame:
    rows = t.supplier.select((F.col("s_nationkey") % 5).alias("k"), F.when(F.col("s_suppkey") % 3 == 0, "high").otherwise("low").alias("g"), "s_acctbal")
    out = Q.rank_sum_test(rows, ["k"], "g", "s_acctbal", side="greater", method="exact", used="method")
    return rounded(out.select("k", "n_high", "n_low", "p_value", "method"), digits=9)


@query("rank_sum_with_ties", f"""WITH us AS {rank_sum_sql('lineitem', 'l_returnflag', 'l_linestatus', 'l_quantity', 'F', 'O')}, {U_P}
SELECT l_returnflag, n_high, n_low, u, tie_term, round(least(1, above), 6) AS p_value FROM ps""")
def rank_sum_with_ties(t: Tables) -> DataFrame:
    out = Q.rank_sum_test(t.lineitem, ["l_returnflag"], "l_linestatus", "l_quantity", "F", "O", side="greater")
    return rounded(out.select("l_returnflag", "n_high", "n_low", "u", "tie_term", "p_value"))


PAIRS = """pairs AS (SELECT p_brand, p_partkey, (sum(l_quantity) FILTER (l_linestatus = 'F'))::BIGINT - (sum(l_quantity) FILTER (l_linestatus = 'O'))::BIGINT AS d
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
SIGNED = f"""{PAIRS}, base AS (SELECT p_brand, count(d) AS n_pairs, count(*) FILTER (d = 0) AS n_zero FROM pairs GROUP BY 1),
r AS (SELECT p_brand, d, rank() OVER (PARTITION BY p_brand ORDER BY abs(d)) + (count(*) OVER (PARTITION BY p_brand, abs(d)) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY p_brand, abs(d)) AS t FROM pairs WHERE d <> 0),
ws AS (SELECT p_brand, sum(r) FILTER (d > 0) AS w_plus, sum(t::DOUBLE * t - 1) AS tie_term, count(*) AS n FROM r GROUP BY 1),
zs AS (SELECT *, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48) AS z FROM ws JOIN base USING (p_brand))"""


def pair_rows(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    side = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity"))).cast("bigint")
    return rows.groupBy("p_brand", "l_partkey").agg((side("F") - side("O")).alias("d"))


@query("signed_rank_greater", f"WITH {SIGNED} SELECT p_brand, n_pairs, n_zero, w_plus, tie_term, round({upper_sql('z')}, 6) AS p_value FROM zs")
def signed_rank_greater(t: Tables) -> DataFrame:
    return rounded(Q.signed_rank_test(pair_rows(t), ["p_brand"], "d", "greater"))


@query("signed_rank_less", f"WITH {SIGNED} SELECT p_brand, round({upper_sql('(-z)')}, 6) AS p_value FROM zs")
def signed_rank_less(t: Tables) -> DataFrame:
    return rounded(Q.signed_rank_test(pair_rows(t), ["p_brand"], "d", "less").select("p_brand", "p_value"))


@query("spearman", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT l_returnflag, count(*) AS n_pairs, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")
def spearman(t: Tables) -> DataFrame:
    return rounded(Q.spearman(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice"))


CELLS = """cells AS (SELECT s_nationkey, count(*) FILTER (x AND y) AS a, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c, count(*) FILTER (NOT x AND NOT y) AS d
  FROM (SELECT s_nationkey, l_returnflag = 'R' AS x, l_quantity > 40 AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1)"""
HYPER = """(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - a - c + k + 1)
  - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1))"""
FISHER = f"""{CELLS}, h AS (SELECT cells.*, k, exp({HYPER}) AS p FROM cells, LATERAL (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k)),
own AS (SELECT s_nationkey, p AS p_own FROM h WHERE k = a)"""


def table_rows(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return Q.two_by_two(rows, ["s_nationkey"], F.col("l_returnflag") == "R", F.col("l_quantity") > 40)


@query("fisher_two_sided", f"""WITH {FISHER} SELECT s_nationkey, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d,
  round(least(1, sum(p) FILTER (p <= p_own * 1.0000001)), 6) AS p_value, round(any_value(a * d / (b * c)), 6) AS odds_ratio,
  round(any_value(a / (a + b) / ((a + c) / (a + b + c + d))), 6) AS fold_enrichment FROM h JOIN own USING (s_nationkey) GROUP BY 1""")
def fisher_two_sided(t: Tables) -> DataFrame:
    return rounded(Q.fisher_test(table_rows(t)))


@query("fisher_greater", f"WITH {FISHER} SELECT s_nationkey, round(sum(p) FILTER (k >= a), 6) AS p_value FROM h GROUP BY 1")
def fisher_greater(t: Tables) -> DataFrame:
    return rounded(Q.fisher_test(table_rows(t), "greater").select("s_nationkey", "p_value"))


def priority_enrichment(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", (F.col("o_orderstatus") == "P").alias("hit"))
    ranked = R.rank_within(rows, ["o_orderpriority"], "o_totalprice", "o_orderkey")
    return Q.top_percentile_enrichment(ranked, ["o_orderpriority"], "hit", [0.05, 0.1, 0.2])


ENRICH = f"""ranked AS (SELECT o_orderpriority, o_orderstatus = 'P' AS hit, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
e AS (SELECT o_orderpriority, f AS percentile, any_value(n) AS n_candidates, count(*) FILTER (hit) AS n_flagged, greatest(1, ceil(any_value(n) * f))::BIGINT AS top_n,
  count(*) FILTER (hit AND r <= ceil(n * f)) AS a FROM ranked, (VALUES (0.05::DOUBLE), (0.1), (0.2)) v(f) GROUP BY o_orderpriority, f),
c4 AS (SELECT *, top_n - a AS b, n_flagged - a AS c, n_candidates - top_n - n_flagged + a AS d FROM e),
h AS (SELECT o_orderpriority, percentile, exp({HYPER}) AS p FROM c4, LATERAL (SELECT unnest(range(a, least(a + b, a + c) + 1)) AS k)),
per AS (SELECT c4.*, (SELECT sum(p) FROM h WHERE h.o_orderpriority = c4.o_orderpriority AND h.percentile = c4.percentile) AS p_value FROM c4)"""


@query("top_percentile_enrichment", f"""WITH {ENRICH} SELECT o_orderpriority, percentile, n_candidates, n_flagged, top_n, a, b, c, d, round(p_value, 6) AS p_value,
  round(a / n_flagged, 6) AS recall_in_top, round(top_n / n_candidates, 6) AS random_recall, round(a * d / (b * c), 6) AS odds_ratio, round(a / top_n / (n_flagged / n_candidates), 6) AS fold_enrichment FROM per""")
def top_percentile_enrichment(t: Tables) -> DataFrame:
    return rounded(priority_enrichment(t))


@query("enrichment_summary", f"""WITH {ENRICH}, q AS (SELECT *, min(raw) OVER (PARTITION BY percentile ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM
  (SELECT *, p_value * count(*) OVER (PARTITION BY percentile) / count(*) OVER (PARTITION BY percentile ORDER BY p_value) AS raw FROM per)),
s AS (SELECT percentile, count(*) AS n_groups, avg(a / n_flagged) AS macro_recall, avg(top_n / n_candidates) AS macro_random_recall,
  avg(a / top_n / (n_flagged / n_candidates)) AS macro_fold, median(a / n_flagged) AS median_recall, median(p_value) AS median_p, median(least(q, 1)) AS median_q FROM q GROUP BY 1)
SELECT percentile, n_groups, round(macro_recall, 6) AS macro_recall, round(macro_random_recall, 6) AS macro_random_recall, round(macro_fold, 6) AS macro_fold, round(median_recall, 6) AS median_recall,
  round(median_p, 6) AS median_p, round(median_q, 6) AS median_q, round(least(1, min(raw) OVER (ORDER BY median_p DESC)), 6) AS q_of_medians
FROM (SELECT *, median_p * count(*) OVER () / count(*) OVER (ORDER BY median_p) AS raw FROM s)""")
def enrichment_summary(t: Tables) -> DataFrame:
    return rounded(RS.enrichment_summary(priority_enrichment(t)))


@query("recall_excess_test")
def recall_excess_test(t: Tables) -> DataFrame:
    ranked = R.rank_within(scored(t), ["source"], "score", "doc_id")
    per = Q.top_percentile_enrichment(ranked, ["source"], "toxic", [0.05, 0.1, 0.2])
    return rounded(RS.recall_excess_test(per, ["source"], PERMUTATIONS, 43))


@query("ols_residuals", """WITH f AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, count(*) AS n, round(sum(abs(l_extendedprice - a - b * l_quantity)), 2) AS total FROM lineitem JOIN f USING (l_suppkey) GROUP BY 1""")
def ols_residuals(t: Tables) -> DataFrame:
    out = Q.ols_residuals(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity")
    return rounded(out.groupBy("l_suppkey").agg(F.count("residual").alias("n"), F.sum(F.abs("residual")).alias("total")), digits=2)


OLS2 = f"""WITH s AS (SELECT l_returnflag, count(*) AS n, var_pop(l_discount) AS s11, var_pop(l_tax) AS s22, covar_pop(l_discount, l_tax) AS s12,
  covar_pop(l_quantity, l_discount) AS s1y, covar_pop(l_quantity, l_tax) AS s2y, var_pop(l_quantity) AS syy FROM lineitem GROUP BY 1),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
r AS (SELECT *, b1 / sqrt((syy - b1 * s1y - b2 * s2y) * n / (n - 3) * s22 / det / n) AS tv, (n - 3)::DOUBLE AS dof FROM b)
SELECT l_returnflag, n AS n_samples, round(b1, 6) AS coef, round({student_sql('tv', 'dof')}, 6) AS p_value FROM r"""


@query("ols_coefficient", OLS2)
def ols_coefficient(t: Tables) -> DataFrame:
    return rounded(Q.ols_coefficient(t.lineitem, ["l_returnflag"], "l_quantity", "l_discount", ["l_tax"]))


@query("kernel_density", """WITH g AS (SELECT round(i * 0.02, 10) AS x FROM range(51) r(i)), v AS (SELECT l_returnflag, l_quantity / 50 AS v, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT l_returnflag, count(*) AS n, stddev_samp(l_quantity / 50) * pow(count(*), -0.2) AS h FROM lineitem GROUP BY 1)
SELECT v.l_returnflag, x::DOUBLE AS x, round(sum(v.n * exp(-0.5 * pow((x - v.v) / h, 2)) / (s.n * h * sqrt(2 * pi()))), 6) AS density FROM v JOIN s USING (l_returnflag), g GROUP BY ALL""")
def kernel_density(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", (F.col("l_quantity") / 50).alias("v"))
    return rounded(Q.kernel_density(rows, ["l_returnflag"], "v", points=51))


@query("kernel_density_normal_rule", """WITH g AS (SELECT round(i * 0.02, 10) AS x FROM range(51) r(i)), v AS (SELECT l_discount * 10 AS v, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT count(*) AS n, greatest(1.06 * stddev_samp(l_discount * 10) * pow(count(*), -0.2), 0.03) AS h FROM lineitem)
SELECT x::DOUBLE AS x, round(sum(v.n * exp(-0.5 * pow((x - v.v) / h, 2)) / (s.n * h * sqrt(2 * pi()))), 6) AS density FROM v, s, g GROUP BY ALL""")
def kernel_density_normal_rule(t: Tables) -> DataFrame:
    return rounded(Q.kernel_density(t.lineitem.select((F.col("l_discount") * 10).alias("v")), [], "v", points=51, rule="normal"))


@query("score_histogram", """SELECT l_returnflag, least(floor(l_quantity / 50 * 20)::BIGINT + 1, 20) AS bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def score_histogram(t: Tables) -> DataFrame:
    return Q.histogram(t.lineitem.select("l_returnflag", (F.col("l_quantity") / 50).alias("v")), ["l_returnflag"], "v", 20)


@query("fixed_effect", """WITH e AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS e, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL),
p AS (SELECT l_returnflag, count(*) AS n_effects, sum(e / (se * se)) / sum(1 / (se * se)) AS m, sqrt(1 / sum(1 / (se * se))) AS s FROM e WHERE se > 0 GROUP BY 1)
SELECT l_returnflag, n_effects, round(m, 6) AS pooled_effect, round(s, 6) AS pooled_se, round(m - 1.96 * s, 6) AS ci_lower, round(m + 1.96 * s, 6) AS ci_upper FROM p""")
def fixed_effect(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("e"), (F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return rounded(Q.fixed_effect(rows, ["l_returnflag"], "e", "se"))


@query("row_zscores", """SELECT l_orderkey, l_linenumber, l_suppkey, round((l_quantity - avg(l_quantity) OVER w) / nullif(stddev_pop(l_quantity) OVER w, 0), 6) AS z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def row_zscores(t: Tables) -> DataFrame:
    return rounded(Q.row_zscore(t.lineitem, ["l_suppkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_suppkey", "z"))


BOOT = """WITH r AS (SELECT quality, d.doc_id, n_chars, row_number() OVER (PARTITION BY quality ORDER BY d.doc_id) AS pos, count(*) OVER (PARTITION BY quality) AS n FROM documents d JOIN labels USING (doc_id)),
sz AS (SELECT DISTINCT quality, n FROM r), d AS (SELECT quality, it, ('0x' || substr(md5('42|' || quality || '|' || it || '|' || slot), 1, 12))::BIGINT % n + 1 AS pos FROM sz, range(1, 2001) i(it), LATERAL (SELECT unnest(range(1, n + 1)) AS slot)),
m AS (SELECT it, avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0) AS diff FROM d JOIN r USING (quality, pos) GROUP BY 1)
SELECT round((SELECT avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0) FROM r), 4) AS effect, round(quantile_cont(diff, 0.025), 4) AS ci_lower,
  round(quantile_cont(diff, 0.975), 4) AS ci_upper, round(stddev_samp(diff), 4) AS se FROM m"""


@query("bootstrap_mean_difference", BOOT)
def bootstrap_mean_difference(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", F.col("quality").cast("string").alias("q")), "doc_id")
    return rounded(RS.bootstrap_mean_difference(rows, [], "q", "n_chars", "1", "0", "doc_id"), digits=4)


def controls(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Suppliers of each nation in two classes: few returned items as targets, the rest as background."""
    rows = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").select(
        F.col("s_nationkey").alias("site"), F.col("l_returnflag").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member"),
        (F.col("l_discount") - 0.05).alias("effect"), "l_quantity")
    rows = settled(rows.groupBy("site", "member").agg(F.min(F.struct("grp", "effect", "l_quantity")).alias("_row")).select("site", "member", "_row.*"))
    return rows.where("l_quantity >= 45"), rows.where("l_quantity < 45")


def _round_sql(x: str, r: int) -> str:
    return f"(((k[{3 * r + 1}] * {x} % {PRIME} + k[{3 * r + 2}]) * {x} % {PRIME} + k[{3 * r + 3}]) % {PRIME})"


def draws_sql(requests: str, key: str, seed: int, text: str, iterations: int) -> str:
    """CTE bodies ``ready`` and ``walk``: places l * b + r + 1 of a keyed permutation; ``requests`` has key, n and w."""
    turned = "SELECT * FROM walk WHERE step = 0 OR l * b + r >= n"
    for j in range(0, ROUNDS, 2):
        turned = f"SELECT * EXCLUDE (l), (l + {_round_sql('r', j)}) % a AS l FROM ({turned})"
        turned = f"SELECT * EXCLUDE (r), (r + {_round_sql('l', j + 1)}) % b AS r FROM ({turned})"
    return f"""ready AS (SELECT *, (n + a - 1) // a AS b FROM (SELECT {key}, n, w, it, ceil(sqrt(n::DOUBLE))::BIGINT AS a,
    list_transform(range(0, {3 * ROUNDS}), lambda i: ('0x' || substr(md5('{seed}|' || {text} || '|' || it || '|' || (i // 3)), (1 + 8 * (i % 3))::BIGINT, 8))::BIGINT % {PRIME}) AS k
    FROM {requests}, range(1, {iterations + 1}) t(it))),
  walk AS (SELECT *, slot // b AS l, slot % b AS r, 0 AS step FROM (SELECT *, unnest(range(0, least(w, n))) AS slot FROM ready)
    UNION ALL SELECT * EXCLUDE (l, r, step), l, r, step + 1 FROM ({turned}))"""


CONTROL_ROWS = """rows AS (SELECT site, member, v.grp AS grp, v.effect AS effect, v.l_quantity AS l_quantity FROM (SELECT s_nationkey AS site, l_orderkey * 10 + l_linenumber AS member,
    min({'grp': l_returnflag, 'effect': l_discount - 0.05, 'l_quantity': l_quantity}) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)),
  seen AS (SELECT * FROM rows WHERE l_quantity >= 45), pool AS (SELECT * FROM rows WHERE l_quantity < 45)"""
NULL_SQL = """count(random) AS n_random, round(avg(random), 6) AS null_mean, round(median(random), 6) AS null_median, round(quantile_cont(random, 0.025), 6) AS null_ci_lower,
  round(quantile_cont(random, 0.975), 6) AS null_ci_upper, round(stddev_samp(random), 6) AS null_sd, round((any_value(observed) - avg(random)) / nullif(stddev_samp(random), 0), 6) AS z,
  (count(*) FILTER (round(random, 12) >= round(observed, 12)) + 1) / (count(random) + 1) AS p_greater, (count(*) FILTER (round(random, 12) <= round(observed, 12)) + 1) / (count(random) + 1) AS p_less"""
Q_SQL = "least(1, min(raw) OVER (ORDER BY p_greater DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
MATCHED = f"""WITH RECURSIVE {CONTROL_ROWS},
  want AS (SELECT site, count(*) AS w, avg(effect) AS observed FROM seen GROUP BY 1),
  req AS (SELECT site, (SELECT count(*) FROM pool p WHERE p.site = want.site) AS n, w, observed FROM want WHERE w >= 3 AND n >= w),
  placed AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY member) AS place FROM pool),
  {draws_sql('req', 'site', 42, 'site', 100)},
  null_means AS (SELECT site, it, avg(effect) AS random FROM walk JOIN placed USING (site) WHERE step > 0 AND l * b + r < walk.n AND place = l * b + r + 1 GROUP BY 1, 2),
  t AS (SELECT site, any_value(w) AS n_targets, round(any_value(observed), 6) AS observed_mean, {NULL_SQL} FROM req JOIN null_means USING (site) GROUP BY site),
  q AS (SELECT *, p_greater * count(*) OVER () / count(*) OVER (ORDER BY p_greater) AS raw FROM t)
SELECT * EXCLUDE (raw) REPLACE (round(p_greater, 6) AS p_greater, round(p_less, 6) AS p_less), round({Q_SQL}, 6) AS empirical_q FROM q"""
POOLED = f"""{CONTROL_ROWS},
  want AS (SELECT grp, site, count(*) AS w FROM seen GROUP BY ALL),
  req AS (SELECT grp, site, (SELECT count(*) FROM pool p WHERE p.site = want.site AND p.grp = want.grp) AS n, w FROM want WHERE w >= 3 AND n >= w),
  placed AS (SELECT *, row_number() OVER (PARTITION BY grp, site ORDER BY member) AS place FROM pool),
  {draws_sql('req', 'grp, site', 42, "grp || '|' || site", 100)},
  means AS (SELECT grp, it, avg(effect) AS random, count(*) AS n_random_values FROM walk JOIN placed USING (grp, site) WHERE step > 0 AND l * b + r < walk.n AND place = l * b + r + 1 GROUP BY 1, 2)"""


@query("matched_random_control", MATCHED)
def matched_random_control(t: Tables) -> DataFrame:
    seen, background = controls(t)
    return rounded(RS.matched_random_control(seen, background, ["site"], "effect", "member"))


@query("pooled_random_control", f"""WITH RECURSIVE {POOLED},
  obs AS (SELECT grp, avg(effect) AS observed, count(*) AS n_observed_values FROM seen GROUP BY 1),
  t AS (SELECT grp, round(any_value(observed), 6) AS observed_global_mean, any_value(n_observed_values) AS n_observed_values, {NULL_SQL} FROM obs JOIN means USING (grp) GROUP BY grp),
  q AS (SELECT *, p_greater * count(*) OVER () / count(*) OVER (ORDER BY p_greater) AS raw FROM t)
SELECT * EXCLUDE (raw) REPLACE (round(p_greater, 6) AS p_greater, round(p_less, 6) AS p_less), round({Q_SQL}, 6) AS empirical_q FROM q""")
def pooled_random_control(t: Tables) -> DataFrame:
    seen, background = controls(t)
    _, _, summary = RS.pooled_random_control(seen, background, ["grp"], ["site"], "effect", "member")
    return rounded(summary)


@query("random_global_means", f"""WITH RECURSIVE {POOLED} SELECT grp, it AS iteration, round(random, 6) AS random_global_mean, n_random_values FROM means""")
def random_global_means(t: Tables) -> DataFrame:
    seen, background = controls(t)
    _, means, _ = RS.pooled_random_control(seen, background, ["grp"], ["site"], "effect", "member")
    return rounded(means)


@query("observed_vs_random", f"""WITH us AS {rank_sum_sql('lineitem', 'l_linenumber, l_returnflag', 'l_linestatus', 'l_discount', 'F', 'O')}, {U_P},
m AS (SELECT l_linenumber, l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_observed, avg(l_discount) FILTER (l_linestatus = 'F') AS mean_observed, median(l_discount) FILTER (l_linestatus = 'F') AS median_observed,
  count(*) FILTER (l_linestatus = 'O') AS n_random, avg(l_discount) FILTER (l_linestatus = 'O') AS mean_random, median(l_discount) FILTER (l_linestatus = 'O') AS median_random FROM lineitem GROUP BY 1, 2),
j AS (SELECT m.*, u, above AS p FROM m JOIN ps USING (l_linenumber, l_returnflag)),
k AS (SELECT *, p * count(*) OVER (PARTITION BY l_linenumber) / count(*) OVER (PARTITION BY l_linenumber ORDER BY p) AS raw FROM j)
SELECT l_linenumber, l_returnflag, n_observed, round(mean_observed, 6) AS mean_observed, round(median_observed, 6) AS median_observed, n_random, round(mean_random, 6) AS mean_random, round(median_random, 6) AS median_random,
  round(mean_observed - mean_random, 6) AS delta_mean, round(median_observed - median_random, 6) AS delta_median, u, round(p, 6) AS p_value,
  round(least(1, min(raw) OVER (PARTITION BY l_linenumber ORDER BY p DESC)), 6) AS q_value FROM k""")
def observed_vs_random(t: Tables) -> DataFrame:
    return rounded(RS.observed_vs_random(t.lineitem, ["l_linenumber", "l_returnflag"], "l_linestatus", "l_discount", "F", "O", ["l_linenumber"]))


LABELLED = """lab AS (SELECT coalesce(lang, 'none') AS lang, quality::VARCHAR AS q, d.doc_id, n_chars FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)"""


@query("observed_against_random", f"""WITH {LABELLED}, us AS {rank_sum_sql('lab', 'lang', 'q', 'n_chars', '1', '0')}, {U_P},
m AS (SELECT lang, count(*) FILTER (q = '1') AS n_observed, count(*) FILTER (q = '0') AS n_random, avg(n_chars) FILTER (q = '1') - avg(n_chars) FILTER (q = '0') AS d FROM lab GROUP BY 1 HAVING n_observed > 0 AND n_random > 0),
r AS (SELECT lang, q, n_chars, row_number() OVER w AS pos, count(*) OVER (PARTITION BY lang, q) AS n FROM lab JOIN m USING (lang) WHERE n_observed >= 3 AND n_random >= 3 WINDOW w AS (PARTITION BY lang, q ORDER BY doc_id)),
sz AS (SELECT DISTINCT lang, q, n FROM r),
dr AS (SELECT lang, q, it, ('0x' || substr(md5('42|' || lang || '|' || q || '|' || it || '|' || slot), 1, 12))::BIGINT % n + 1 AS pos FROM sz, range(1, 2001) i(it), LATERAL (SELECT unnest(range(1, n + 1)) AS slot)),
bm AS (SELECT lang, it, avg(n_chars) FILTER (q = '1') - avg(n_chars) FILTER (q = '0') AS diff FROM dr JOIN r USING (lang, q, pos) GROUP BY 1, 2),
bs AS (SELECT lang, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi, stddev_samp(diff) AS se FROM bm GROUP BY 1)
SELECT lang, n_observed, n_random, CASE WHEN se IS NOT NULL THEN round(d, 4) END AS mean_difference, round(lo, 4) AS difference_ci_lower, round(hi, 4) AS difference_ci_upper, round(se, 4) AS difference_se,
  CASE WHEN se IS NOT NULL THEN round(above, 4) END AS p_value FROM m LEFT JOIN ps USING (lang) LEFT JOIN bs USING (lang)""")
def observed_against_random(t: Tables) -> DataFrame:
    rows = t.documents.select(F.coalesce("lang", F.lit("none")).alias("lang"), "doc_id", "n_chars").join(
        t.labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("string").alias("q")), "doc_id")
    out = RS.observed_against_random(rows, ["lang"], "q", "n_chars", "1", "0", "doc_id")
    return rounded(out.select("lang", "n_observed", "n_random", "mean_difference", "difference_ci_lower", "difference_ci_upper", "difference_se", "p_value"), digits=4)


def cluster_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Returned items of a customer nation as cluster, the nation's other orders as pool."""
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(
        F.col("c_nationkey").alias("cluster"), "o_orderkey", "o_totalprice", "o_orderstatus")
    ranked = R.rank_within(rows, ["cluster"], "o_totalprice", "o_orderkey")
    return ranked.where("o_orderstatus = 'P'"), ranked.where("o_orderstatus <> 'P'")


CLUSTER = """ranked AS (SELECT c_nationkey AS cluster, o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rk
    FROM orders JOIN customer ON o_custkey = c_custkey),
  pool AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rk) AS place, count(*) OVER (PARTITION BY cluster) AS n FROM ranked WHERE o_orderstatus <> 'P'),
  req AS (SELECT cluster, count(*) AS w, max(o_totalprice) AS max_score, min(rk) AS best_rank, (SELECT count(*) FROM pool p WHERE p.cluster = ranked.cluster) AS n FROM ranked WHERE o_orderstatus = 'P' GROUP BY 1 HAVING n >= w),
  beyond AS (SELECT cluster, place, o_totalprice, rk, CASE WHEN place > req.n - w THEN 0 ELSE exp(lgamma(req.n - place + 1) - lgamma(req.n - place - w + 1) - lgamma(req.n + 1) + lgamma(req.n - w + 1)) END AS s
    FROM pool JOIN req USING (cluster) WHERE place <= req.n - w + 1),
  drawn AS (SELECT cluster, it, 1 - ('0x' || substr(md5('44|' || cluster || '|' || it), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM req, range(1, {draws}) t(it)),
  best AS (SELECT d.cluster, it, o_totalprice AS random_max, rk AS random_best_rank FROM drawn d ASOF JOIN beyond b ON d.cluster = b.cluster AND d.u >= b.s)""".replace("{draws}", str(PERMUTATIONS + 1))
RANK_NULL = """SELECT cluster, (count(*) FILTER (random_best_rank <= best_rank) + 1) / (count(*) + 1) AS rank_p_less, avg(random_best_rank) AS null_mean_best_rank, median(random_best_rank) AS null_median_best_rank,
    quantile_cont(random_best_rank, 0.025) AS best_rank_ci_lower, quantile_cont(random_best_rank, 0.975) AS best_rank_ci_upper FROM req JOIN best USING (cluster) GROUP BY cluster"""


@query("cluster_draw_test", f"""WITH {CLUSTER},
  t AS (SELECT cluster, any_value(w) AS n_sites, round(any_value(max_score), 6) AS max_score, any_value(best_rank) AS best_rank, {NULL_SQL}
    FROM (SELECT *, max_score AS observed, random_max AS random FROM req JOIN best USING (cluster)) GROUP BY cluster),
  q AS (SELECT *, p_greater * count(*) OVER () / count(*) OVER (ORDER BY p_greater) AS raw FROM t), r AS ({RANK_NULL})
SELECT q.* EXCLUDE (raw) REPLACE (round(p_greater, 6) AS p_greater, round(p_less, 6) AS p_less), round({Q_SQL}, 6) AS empirical_q, round(rank_p_less, 6) AS rank_p_less, round(null_mean_best_rank, 6) AS null_mean_best_rank,
  null_median_best_rank, round(best_rank_ci_lower, 6) AS best_rank_ci_lower, round(best_rank_ci_upper, 6) AS best_rank_ci_upper FROM q JOIN r USING (cluster)""")
def cluster_draw_test(t: Tables) -> DataFrame:
    clusters, pool = cluster_rows(t)
    return rounded(RS.cluster_draw_test(clusters, pool, ["cluster"], "o_totalprice", "rank_in_group", "o_orderkey", PERMUTATIONS, 44))


HITS = ", ".join(f"avg(CASE WHEN {{r}} <= {k} THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate_{k}" for k in (1, 5, 10))


@query("cluster_draw_null", f"""WITH {CLUSTER}, m AS (SELECT it AS iteration, avg(random_max) AS mean_max_score, {HITS.format(r='random_best_rank')} FROM best GROUP BY it)
SELECT iteration, round(mean_max_score, 6) AS mean_max_score, round(hit_rate_1, 6) AS hit_rate_1, round(hit_rate_5, 6) AS hit_rate_5, round(hit_rate_10, 6) AS hit_rate_10 FROM m""")
def cluster_draw_null(t: Tables) -> DataFrame:
    clusters, pool = cluster_rows(t)
    return rounded(RS.cluster_draw_null(clusters, pool, ["cluster"], "o_totalprice", "rank_in_group", "o_orderkey", [1, 5, 10], PERMUTATIONS, 44))


@query("cluster_hit_test", f"""WITH {CLUSTER}, m AS (SELECT it, avg(random_max) AS mean_max_score, {HITS.format(r='random_best_rank')} FROM best GROUP BY it),
  o AS (SELECT count(*) AS n_clusters, avg(max_score) AS mean_max_score, {HITS.format(r='best_rank')} FROM req),
  mm AS (UNPIVOT m ON mean_max_score, hit_rate_1, hit_rate_5, hit_rate_10 INTO NAME metric VALUE random), oo AS (UNPIVOT o ON mean_max_score, hit_rate_1, hit_rate_5, hit_rate_10 INTO NAME metric VALUE observed),
  t AS (SELECT metric, any_value(n_clusters) AS n_clusters, round(any_value(observed), 6) AS observed, {NULL_SQL} FROM oo JOIN mm USING (metric) GROUP BY metric),
  q AS (SELECT metric, min(raw) OVER (ORDER BY p_greater DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM
    (SELECT metric, p_greater, p_greater * count(*) OVER () / count(*) OVER (ORDER BY p_greater) AS raw FROM t WHERE metric <> 'mean_max_score'))
SELECT t.* REPLACE (round(p_greater, 6) AS p_greater, round(p_less, 6) AS p_less), CASE WHEN metric <> 'mean_max_score' THEN round(p_greater, 6) END AS rate_p, CASE WHEN q IS NOT NULL THEN round(least(1, q), 6) END AS q_value FROM t LEFT JOIN q USING (metric)""")
def cluster_hit_test(t: Tables) -> DataFrame:
    clusters, pool = cluster_rows(t)
    return rounded(RS.cluster_hit_test(clusters, pool, ["cluster"], "o_totalprice", "rank_in_group", "o_orderkey", [1, 5, 10], PERMUTATIONS, 44))


@query("random_reciprocal_rank", """SELECT c_nationkey, n, p, round(list_sum(list_transform(range(1, n - p + 2), lambda r:
  exp(lgamma(n - r + 1) - lgamma(p) - lgamma(n - r - p + 2) - lgamma(n + 1) + lgamma(p + 1) + lgamma(n - p + 1)) / r)), 6) AS expected
FROM (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < 500) AS p FROM customer GROUP BY 1) WHERE p > 0""")
def random_reciprocal_rank(t: Tables) -> DataFrame:
    from sitelens.functions.tails import random_reciprocal_rank as expected

    per = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 500).alias("p")).where("p > 0")
    return rounded(per.withColumn("expected", expected(F.col("n").cast("double"), F.col("p").cast("double"))))


