"""Aggregations over line items, orders, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.catalog.joining import EDGES, edges
from sitelens.catalog.registry import Tables, query, rounded, whole
from sitelens.functions import scalars as S
from sitelens.operators import aggregates as A
from sitelens.operators import ranking as R


@query("mean_std_by_flag", """SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std,
  round(avg(l_discount), 6) AS l_discount_mean, round(stddev_samp(l_discount), 6) AS l_discount_std, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem GROUP BY 1""")
def mean_std_by_flag(t: Tables) -> DataFrame:
    return rounded(A.mean_std(t.lineitem, ["l_returnflag"], ["l_quantity", "l_discount"], count="l_suppkey"))


@query("mean_std_two_keys", """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std FROM lineitem GROUP BY ALL""")
def mean_std_two_keys(t: Tables) -> DataFrame:
    return rounded(A.mean_std(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity"], population=True))


@query("melted_mean_std", """SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM
  (UNPIVOT (SELECT l_quantity, l_tax, l_discount FROM lineitem) ON l_quantity, l_tax, l_discount INTO NAME metric VALUE v) GROUP BY 1""")
def melted_mean_std(t: Tables) -> DataFrame:
    return rounded(A.melted_mean_std(t.lineitem.select("l_quantity", "l_tax", "l_discount"), ["l_quantity", "l_tax", "l_discount"]))


@query("describe_price", """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
  round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1""")
def describe_price(t: Tables) -> DataFrame:
    return rounded(A.describe(t.lineitem, ["l_returnflag"], "l_extendedprice"), digits=4)


@query("expression_summary", """SELECT o_orderpriority, o_orderstatus, count(*) AS n_points, count(DISTINCT o_custkey) AS n_targets,
  round(avg(o_totalprice), 4) AS mean_value, round(median(o_totalprice), 4) AS median_value FROM orders GROUP BY ALL""")
def expression_summary(t: Tables) -> DataFrame:
    return rounded(A.expression_summary(t.orders, ["o_orderpriority", "o_orderstatus"], "o_custkey", "o_totalprice"), digits=4)


@query("joined_brands", """SELECT s_nationkey, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def joined_brands(t: Tables) -> DataFrame:
    rows = (
        t.lineitem
        .join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        .join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    )
    return A.joined_values(rows.withColumn("text", F.concat(F.lit(" "), "p_brand", F.lit(" ;"))), ["s_nationkey"], "text", "brands")


@query("first_seen_types", """SELECT p_brand, string_agg(p_type, ';' ORDER BY first_key) AS types FROM (SELECT p_brand, p_type, min(p_partkey) AS first_key FROM part GROUP BY ALL) GROUP BY 1""")
def first_seen_types(t: Tables) -> DataFrame:
    return A.joined_values(t.part, ["p_brand"], "p_type", "types", order="p_partkey")


@query("collapsed_edges", """SELECT l_suppkey, l_partkey, round(avg(w), 6) AS mean_weight, count(*) AS n_edges, count(DISTINCT sign(w)) AS n_signs,
  count(DISTINCT sign(w)) > 1 AS sign_conflict, sign(avg(w))::INT AS sign, CASE WHEN avg(w) > 0 THEN 'activate' ELSE 'repress' END AS regulation
FROM (SELECT l_suppkey, l_partkey, (l_discount * 100)::INT - 5 AS w FROM lineitem) WHERE w <> 0 GROUP BY ALL HAVING avg(w) <> 0""")
def collapsed_edges(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_partkey", (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("w"))
    return rounded(A.collapse_edges(rows, "l_suppkey", "l_partkey", "w"))


SYMBOLS = """e AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN lower(p_brand) ELSE ' ' || p_brand || ' ' END AS source, CASE WHEN l_linenumber % 3 = 0 THEN lower(p_type) ELSE p_type END AS target,
  (l_discount * 100)::INT - 5 AS weight, l_returnflag || '; ' || l_linestatus || ';' || l_returnflag AS resources, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT *, upper(trim(source)) AS s, upper(trim(target)) AS t FROM e WHERE weight <> 0)"""


def symbol_edges(t: Tables) -> DataFrame:
    """Edges from brand to type in mixed spelling, with joined resources, in the order of the order lines."""
    even = F.col("l_linenumber") % 2 == 0
    return t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey").select(
        F.when(even, F.lower("p_brand")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("source"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("target"),
        (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("weight"),
        F.concat("l_returnflag", F.lit("; "), "l_linestatus", F.lit(";"), "l_returnflag").alias("resources"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


@query("collapsed_symbols", f"""WITH {SYMBOLS}, g AS (SELECT s, t, arg_min(source, ord) AS source, arg_min(target, ord) AS target, avg(weight) AS w, count(*) AS n_edges, count(DISTINCT sign(weight)) AS n_signs FROM k GROUP BY ALL HAVING avg(weight) <> 0),
p AS (SELECT s, t, part, min(ord * 10 + i) AS spot FROM (SELECT s, t, ord, trim(unnest(string_split(resources, ';'))) AS part, generate_subscripts(string_split(resources, ';'), 1) AS i FROM k) WHERE part <> '' GROUP BY ALL),
r AS (SELECT s, t, string_agg(part, ';' ORDER BY spot) AS resources FROM p GROUP BY ALL)
SELECT source, target, round(w, 6) AS mean_weight, n_edges, n_signs, resources, n_signs > 1 AS sign_conflict, sign(w)::INT AS sign, CASE WHEN w > 0 THEN 'activate' ELSE 'repress' END AS regulation FROM g JOIN r USING (s, t)""")
def collapsed_symbols(t: Tables) -> DataFrame:
    return rounded(A.collapse_edges(symbol_edges(t), "source", "target", "weight", joined=["resources"], order="ord"))


EVID = """stats AS (SELECT p_brand, l_partkey, count(*) FILTER (l_quantity > 40) AS hit_count, avg(l_quantity) AS mean_score, max(l_quantity) AS max_score, median(l_quantity) AS median_score
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
tot AS (SELECT p_brand, count(DISTINCT month(l_shipdate)) AS n_experiments FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
ev AS (SELECT *, hit_count / n_experiments AS hit_fraction FROM stats JOIN tot USING (p_brand) WHERE hit_count >= greatest(1, ceil(n_experiments * 0.3)))"""


def evidence(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").withColumn("m", F.month("l_shipdate"))
    return A.classify_evidence(rows, "p_brand", "l_partkey", "m", "l_quantity", 40, 0.3)


@query("classified_evidence", f"""WITH {EVID} SELECT p_brand, l_partkey, hit_count, round(mean_score, 6) AS mean_score, max_score, median_score, n_experiments, round(hit_fraction, 6) AS hit_fraction FROM ev""")
def classified_evidence(t: Tables) -> DataFrame:
    return rounded(evidence(t))


@query("top_evidence", f"""WITH {EVID} SELECT p_brand, l_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY hit_count DESC, round(hit_fraction, 9) DESC, round(mean_score, 9) DESC, max_score DESC, median_score DESC, l_partkey) AS rank FROM ev) WHERE rank <= 5""")
def top_evidence(t: Tables) -> DataFrame:
    order = [F.desc("hit_count"), F.round("hit_fraction", 9).desc(), F.round("mean_score", 9).desc(), F.desc("max_score"), F.desc("median_score"), F.asc("l_partkey")]
    return whole(R.top_per_group(evidence(t), ["p_brand"], order, 5).select("p_brand", "l_partkey", "rank"), "rank")


@query("class_cross_tab", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P,
  count(*) FILTER (o_orderstatus = 'X') AS X FROM orders GROUP BY 1""")
def class_cross_tab(t: Tables) -> DataFrame:
    return A.cross_tab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P", "X"])


@query("class_counts", """SELECT n_name, count(c_custkey) AS n_rows, count(DISTINCT c_mktsegment) AS n_groups FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY 1""")
def class_counts(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 9000").join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return A.class_counts(rich, "n_name", "c_mktsegment", t.nation.select("n_name"))


@query("names_by_count", """WITH c AS (SELECT l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) >= 35) SELECT l_partkey, n_rows, count(*) OVER (PARTITION BY n_rows) AS n_names FROM c""")
def names_by_count(t: Tables) -> DataFrame:
    return A.names_by_count(t.lineitem, "l_partkey", 35)


@query("binary_summary", """SELECT s_nationkey, count(*) AS n, count(*) FILTER (r = 1) AS n_ones, count(*) FILTER (r = 0) AS n_zeros, round(avg(r), 6) AS share_ones, round(avg(1 - r), 6) AS share_zeros
FROM (SELECT s_nationkey, (l_returnflag = 'R')::INT AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1""")
def binary_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").withColumn("r", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(A.binary_summary(rows, ["s_nationkey"], "r"))


@query("robustness_rollup", """SELECT l_suppkey, round(avg(l_discount), 6) AS mean_effect, min(l_tax) AS min_p, count(DISTINCT l_returnflag) AS n_parts, round(avg((l_tax < 0.05)::INT), 6) AS share_significant FROM lineitem GROUP BY 1""")
def robustness_rollup(t: Tables) -> DataFrame:
    return rounded(A.robustness_rollup(t.lineitem, ["l_suppkey"], "l_discount", "l_tax", "l_returnflag"))


CMP = """cmp AS (SELECT l_suppkey, l_partkey, avg(d) FILTER (l_linestatus = 'F') AS plain_value, avg(d) FILTER (l_linestatus = 'O') AS adjusted_value
  FROM (SELECT *, (l_discount * 100)::INT - 5 AS d FROM lineitem) GROUP BY ALL),
both_modes AS (SELECT *, adjusted_value - plain_value AS change, sign(plain_value) * sign(adjusted_value) < 0 AS sign_flip FROM cmp WHERE plain_value IS NOT NULL AND adjusted_value IS NOT NULL)"""


def compared(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("d", F.round(F.col("l_discount") * 100).cast("int") - 5)
    return A.compare_modes(rows, ["l_suppkey", "l_partkey"], "l_linestatus", "d", "F", "O")


@query("mode_comparison", f"WITH {CMP} SELECT l_suppkey, l_partkey, round(plain_value, 6) AS plain_value, round(adjusted_value, 6) AS adjusted_value, round(change, 6) AS change, sign_flip FROM both_modes")
def mode_comparison(t: Tables) -> DataFrame:
    return rounded(compared(t))


@query("mode_rollup", f"""WITH {CMP} SELECT l_suppkey, count(*) AS n_targets, round(avg(plain_value), 6) AS mean_plain, round(avg(adjusted_value), 6) AS mean_adjusted,
  round(avg(sign_flip::INT), 6) AS flip_share, round(avg((adjusted_value > 0)::INT), 6) AS share_positive FROM both_modes GROUP BY 1""")
def mode_rollup(t: Tables) -> DataFrame:
    return rounded(A.mode_rollup(compared(t), ["l_suppkey"]))


CSUM = """csum AS (SELECT c_mktsegment, count(*) AS n_sites, count(*) FILTER (c_acctbal > 8000) AS n_significant,
  count(*) FILTER (c_acctbal > 8000 AND c_nationkey < 5) AS n_significant_known, count(*) FILTER (c_acctbal > 8000 AND c_nationkey >= 5) AS n_significant_new FROM customer GROUP BY 1)"""


@query("cohort_summary", f"WITH {CSUM} SELECT *, row_number() OVER (ORDER BY n_significant DESC, c_mktsegment)::INT AS cohort_rank FROM csum")
def cohort_summary(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("sig", F.col("c_acctbal") > 8000).withColumn("known", F.col("c_nationkey") < 5)
    return A.cohort_order(A.cohort_summary(rows, "c_mktsegment", "sig", "known"), "c_mktsegment")


@query("bag_plan", """SELECT n_positive, n_background, least(round_even(n_positive * 1.5, 0)::BIGINT, n_background) AS bag_size,
  least(20, greatest(3, ceil(n_background / least(round_even(n_positive * 1.5, 0), n_background))))::BIGINT AS n_bags
FROM (SELECT count(*) FILTER (quality = 0) AS n_positive, count(*) FILTER (quality = 1) AS n_background FROM labels)""")
def bag_plan(t: Tables) -> DataFrame:
    return A.bag_plan(t.labels.withColumn("label", 1 - F.col("quality")), "label", 1.5, 3, 20)


@query("class_weights", """SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS balanced,
  round(CASE WHEN quality = 1 THEN (SELECT count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1) FROM labels) ELSE 1 END, 6) AS ratio, CASE quality WHEN 1 THEN 2.5 ELSE 0.5 END::DOUBLE AS explicit FROM labels GROUP BY 1""")
def class_weights(t: Tables) -> DataFrame:
    parts = [
        A.class_weights(t.labels, "quality", mode, explicit).select("quality", "n", F.col("weight").alias(mode))
        for mode, explicit in (("balanced", None), ("ratio", None), ("explicit", {1: 2.5, 0: 0.5}))
    ]
    return rounded(parts[0].join(parts[1], ["quality", "n"]).join(parts[2], ["quality", "n"]))


@query("split_label_counts", """SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def split_label_counts(t: Tables) -> DataFrame:
    return A.split_label_counts(t.documents.select("doc_id", "lang").join(t.labels, "doc_id"), "lang", "quality")


@query("impute_summary", """SELECT feature, 'median' AS strategy, round(median(v), 6) AS fill_value, round(avg((v IS NULL)::INT), 6) AS missing_rate FROM
  (SELECT 'l_quantity' AS feature, nullif(l_quantity, 50) AS v FROM lineitem UNION ALL SELECT 'l_tax', nullif(l_tax, 0) FROM lineitem) GROUP BY 1""")
def impute_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.nullif("l_quantity", F.lit(50.0)).alias("l_quantity"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return rounded(A.impute_summary(rows, ["l_quantity", "l_tax"]))


@query("global_median", """SELECT s_suppkey, median(s_acctbal) OVER () AS global_median, s_acctbal > median(s_acctbal) OVER () AS above FROM supplier""")
def global_median(t: Tables) -> DataFrame:
    out = A.with_global_median(t.supplier, "s_acctbal")
    return out.select("s_suppkey", "global_median", (F.col("s_acctbal") > F.col("global_median")).alias("above"))


@query("group_quantiles", """SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
  round(quantile_cont(l_extendedprice, 0.99), 4) AS q99 FROM lineitem GROUP BY 1""")
def group_quantiles(t: Tables) -> DataFrame:
    from sitelens.operators.ordered import quantiles

    return rounded(quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q99": 0.99}), digits=4)


@query("edge_signs", f"""WITH {EDGES} SELECT l_suppkey, count(*) FILTER (weight > 0) AS n_up, count(*) FILTER (weight < 0) AS n_down,
  round(count(*) FILTER (weight > 0) / nullif(count(*) FILTER (weight < 0), 0), 6) AS up_down FROM edges GROUP BY 1""")
def edge_signs(t: Tables) -> DataFrame:
    out = edges(t).groupBy("l_suppkey").agg(F.count_if(F.col("weight") > 0).alias("n_up"), F.count_if(F.col("weight") < 0).alias("n_down"))
    return rounded(out.withColumn("up_down", S.ratio("n_up", "n_down")))
