"""Ranks, windows, top-k, clusters, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.catalog.registry import Tables, query, rounded, whole
from sitelens.catalog.scoring import auroc_sql
from sitelens.operators import metrics as M
from sitelens.operators import ranking as R
from sitelens.operators import resampling as RS
from sitelens.operators import splits as X
from sitelens.operators.ordered import average_ranks

#: Permutations of the reference's ranking validation.
PERMUTATIONS = 10_000

SCORED = """scored AS (SELECT doc_id, source, lang, n_chars::DOUBLE AS score, quality AS label, toxic FROM documents JOIN labels USING (doc_id))"""


def scored(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", "lang", F.col("n_chars").cast("double").alias("score"))
    return docs.join(t.labels.select("doc_id", F.col("quality").alias("label"), "toxic"), "doc_id")


@query("best_per_key", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def best_per_key(t: Tables) -> DataFrame:
    return R.best_per_key(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("global_rank", """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS global_rank,
  round(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) / (SELECT count(*) FROM orders), 6) AS global_percentile FROM orders""")
def global_rank(t: Tables) -> DataFrame:
    return rounded(R.global_rank(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "global_rank", "global_percentile"))


@query("rank_in_group", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank_in_group,
  count(*) OVER (PARTITION BY o_orderpriority) AS group_size FROM orders""")
def rank_in_group(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return R.rank_within(rows, ["o_orderpriority"], "o_totalprice", "o_orderkey").select("o_orderkey", "rank_in_group", "group_size")


@query("average_ranks", """SELECT DISTINCT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS avg_rank FROM lineitem""")
def avg_ranks(t: Tables) -> DataFrame:
    return average_ranks(t.lineitem, ["l_returnflag"], "l_quantity").select("l_returnflag", "l_quantity", "avg_rank")


RANKED = f"""{SCORED}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n_rows FROM scored)"""


@query("running_class_share", f"""WITH {RANKED} SELECT doc_id, rank, n_flagged, rank - n_flagged AS n_other, round(n_flagged / rank, 6) AS flagged_share, round(100.0 * rank / n_rows, 6) AS rank_percentile
FROM (SELECT *, sum(label) OVER (ORDER BY rank)::BIGINT AS n_flagged FROM ranked)""")
def running_class_share(t: Tables) -> DataFrame:
    out = R.running_class_share(scored(t), "score", "doc_id", "label")
    return rounded(out.select("doc_id", "rank", "n_flagged", "n_other", "flagged_share", "rank_percentile"))


@query("top_fraction_enrichment", f"""WITH {RANKED}, c AS (SELECT f AS fraction, greatest(1, ceil((SELECT count(*) FROM scored) * f))::BIGINT AS top_n FROM (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.2)) v(f))
SELECT sum(label)::BIGINT AS n_flagged, count(*) AS n_rows, fraction, top_n, (sum(label) FILTER (rank <= top_n))::BIGINT AS n_hits,
  round((sum(label) FILTER (rank <= top_n)) / top_n, 6) AS share_in_top, round((sum(label) FILTER (rank <= top_n)) / top_n / (sum(label) / count(*)), 6) AS enrichment FROM ranked, c GROUP BY fraction, top_n""")
def top_fraction_enrichment(t: Tables) -> DataFrame:
    ranked = R.row_rank(scored(t), [], "score", "doc_id", "rank", size="n_rows")
    return rounded(R.top_fraction_enrichment(ranked, "label", [0.01, 0.05, 0.1, 0.2]))


@query("event_clusters", """WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS pos, event_type FROM events),
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id) > 14400 THEN 1 ELSE 0 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos, event_id) + 1 AS run FROM g)
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'manual' ELSE user_id || '_C' || CASE WHEN run < 10 THEN '0' ELSE '' END || run END AS cluster_id FROM r""")
def event_clusters(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.unix_timestamp("ts").alias("pos"), F.when(F.col("event_type") == "signup", " manual ").alias("given"))
    return R.gap_clusters(rows, ["user_id"], "pos", 14400, "given").select("event_id", "cluster_id")


@query("top_families", """SELECT p_brand, count(*) AS total FROM part GROUP BY 1 ORDER BY total DESC, p_brand LIMIT 15""")
def top_families(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "p_brand").limit(15)


BH = """SELECT {k}l_orderkey, l_linenumber, round(least(min(raw) OVER ({part} ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 8) AS q_value
FROM (SELECT *, p * count(p) OVER ({part}) / count(p) OVER ({part} ORDER BY p) AS raw FROM r WHERE p IS NOT NULL)
UNION ALL SELECT {k}l_orderkey, l_linenumber, NULL FROM r WHERE p IS NULL"""
PVALS = """WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, CASE WHEN l_discount = 0.1 THEN NULL ELSE round(pow(l_extendedprice / 110000, 3), 10) END AS p FROM lineitem)"""


def p_rows(t: Tables) -> DataFrame:
    p = F.when(F.col("l_discount") != 0.1, F.round(F.pow(F.col("l_extendedprice") / 110000, F.lit(3.0)), 10))
    return t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", p.alias("p"))


@query("fdr_by_group", f"{PVALS} " + BH.format(k="l_returnflag, ", part="PARTITION BY l_returnflag"))
def fdr_by_group(t: Tables) -> DataFrame:
    return rounded(R.benjamini_hochberg(p_rows(t), ["l_returnflag"], "p").drop("p"), digits=8)


@query("fdr_global", f"{PVALS} " + BH.format(k="", part=""))
def fdr_global(t: Tables) -> DataFrame:
    return rounded(R.benjamini_hochberg(p_rows(t).drop("l_returnflag"), [], "p").drop("p"), digits=8)


@query("seeded_pick", """SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7|' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn <= 20""")
def seeded_pick(t: Tables) -> DataFrame:
    return R.seeded_pick(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], 20, 7)


@query("ordered_sites", """SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END DESC NULLS LAST, s_suppkey) AS row_order FROM supplier""")
def ordered_sites(t: Tables) -> DataFrame:
    rows = t.supplier.withColumn("v", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")))
    return R.ordered_rows(rows, [F.asc("s_nationkey"), F.col("v").desc_nulls_last(), F.asc("s_suppkey")]).select("s_suppkey", "row_order")


@query("cohort_sequence", """WITH c AS (SELECT c_mktsegment, avg(c_acctbal) AS a FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)
SELECT m.c_mktsegment, row_number() OVER (ORDER BY coalesce(a > 4500, false) DESC, a / 10000 NULLS LAST, m.c_mktsegment) AS cohort_order FROM (SELECT DISTINCT c_mktsegment FROM customer) m LEFT JOIN c USING (c_mktsegment)""")
def cohort_sequence(t: Tables) -> DataFrame:
    rows = t.customer.where("c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("a"))
    rows = rows.select("c_mktsegment", (F.col("a") > 4500).alias("sig"), (F.col("a") / 10000).alias("p"), F.lit(1.0).alias("delta"))
    return R.cohort_sequence(rows, t.customer.select("c_mktsegment").distinct(), "c_mktsegment", "sig", "p", "delta").select("c_mktsegment", "cohort_order")


@query("cohorts_with_pairs", "SELECT c_nationkey, count(*) AS n_pairs FROM customer GROUP BY 1 HAVING count(*) >= 60")
def cohorts_with_pairs(t: Tables) -> DataFrame:
    return R.cohorts_with_pairs(t.customer, "c_nationkey", 60)


@query("combined_sites", """WITH f AS (SELECT c_mktsegment, c_custkey, abs(c_acctbal) / 10000 AS p, c_nationkey < 5 AS known, abs(c_acctbal) / 10000 < 0.05 AS is_significant FROM customer),
o AS (SELECT c_mktsegment, count(*) FILTER (is_significant) AS n_significant FROM f GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY n_significant DESC, c_mktsegment) AS cohort_rank FROM o),
s AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY p, c_custkey) AS site_rank FROM f JOIN k USING (c_mktsegment))
SELECT c_custkey, is_significant, CASE WHEN known THEN 'Known' ELSE 'New' END AS status, n_significant, cohort_rank, site_rank, is_significant AND site_rank <= 10 AS in_figure FROM s""")
def combined_sites(t: Tables) -> DataFrame:
    rows = t.customer.select("c_mktsegment", "c_custkey", (F.abs("c_acctbal") / 10000).alias("p"), (F.col("c_nationkey") < 5).alias("known"))
    out = R.combined_site_table(rows, "c_mktsegment", "c_custkey", "p", "known")
    return whole(out.select("c_custkey", "is_significant", "status", "n_significant", "cohort_rank", "site_rank", "in_figure"), "cohort_rank", "site_rank")


# ------------------------------------------------------------------ metrics


@query("auroc_by_language", f"""WITH {SCORED} SELECT lang, round(auroc, 6) AS auroc FROM {auroc_sql('scored', 'score', 'label', 'lang')}""")
def auroc_by_language(t: Tables) -> DataFrame:
    return rounded(M.ranking_metrics(scored(t), ["lang"], "score", "label").select("lang", "auroc"))


STEPS = f"""{SCORED}, steps AS (SELECT lang, score, count(*) AS n, sum(label) AS p FROM scored GROUP BY ALL),
cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS above, sum(p) OVER (PARTITION BY lang) AS p_total, sum(n) OVER (PARTITION BY lang) AS n_total FROM steps
  WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"""


@query("average_precision", f"""WITH {STEPS} SELECT lang, round(sum(p / p_total * tp / above), 6) AS average_precision FROM cum GROUP BY 1""")
def average_precision(t: Tables) -> DataFrame:
    return rounded(M.ranking_metrics(scored(t), ["lang"], "score", "label").select("lang", "average_precision"))


@query("roc_curve", f"WITH {STEPS} SELECT lang, score AS threshold, round((above - tp) / (n_total - p_total), 6) AS fpr, round(tp / p_total, 6) AS tpr FROM cum")
def roc_curve(t: Tables) -> DataFrame:
    return rounded(M.roc_points(scored(t), ["lang"], "score", "label"))


@query("pr_curve", f"WITH {STEPS} SELECT lang, score AS threshold, round(tp / above, 6) AS precision, round(tp / p_total, 6) AS recall FROM cum")
def pr_curve(t: Tables) -> DataFrame:
    return rounded(M.pr_points(scored(t), ["lang"], "score", "label"))


CONF = """cells AS (SELECT o_orderpriority, count(*) FILTER (s AND y) AS tp, count(*) FILTER (s AND NOT y) AS fp, count(*) FILTER (NOT s AND y) AS fn, count(*) FILTER (NOT s AND NOT y) AS tn
  FROM (SELECT o_orderpriority, o_totalprice / 500000 >= 0.5 AS s, o_orderstatus = 'F' AS y FROM orders) GROUP BY 1)"""


def order_scores(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


@query("threshold_metrics", f"""WITH {CONF} SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
  round(tp / (tp + fn), 6) AS recall_positive, round(tn / (tn + fp), 6) AS recall_negative, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM cells""")
def threshold_metrics(t: Tables) -> DataFrame:
    return rounded(M.threshold_metrics(order_scores(t), ["o_orderpriority"], "score", "label", 0.5))


SEARCH = """g AS (SELECT o_orderpriority, i, i * 0.05 AS threshold, count(*) FILTER (score >= round(i * 0.05::DOUBLE, 2) AND label = 1) AS tp, count(*) FILTER (score >= round(i * 0.05::DOUBLE, 2) AND label = 0) AS fp,
  count(*) FILTER (score < round(i * 0.05::DOUBLE, 2) AND label = 1) AS fn, count(*) FILTER (score < round(i * 0.05::DOUBLE, 2) AND label = 0) AS tn
  FROM (SELECT o_orderpriority, o_totalprice / 500000 AS score, (o_orderstatus = 'F')::INT AS label FROM orders), range(1, 20) r(i) GROUP BY ALL)"""


@query("best_f1_threshold", f"""WITH {SEARCH}, v AS (SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 12) AS val FROM g)
SELECT o_orderpriority, round(first(threshold ORDER BY val DESC, i)::DOUBLE, 6) AS threshold, round(max(val), 6) AS best_f1 FROM v GROUP BY 1""")
def best_f1_threshold(t: Tables) -> DataFrame:
    return rounded(M.best_threshold(order_scores(t), ["o_orderpriority"], "score", "label", "f1"))


@query("best_mcc_threshold", f"""WITH {SEARCH}, v AS (SELECT *, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 12) AS val FROM g)
SELECT o_orderpriority, round(first(threshold ORDER BY val DESC, i)::DOUBLE, 6) AS threshold, round(max(val), 6) AS best_mcc FROM v GROUP BY 1""")
def best_mcc_threshold(t: Tables) -> DataFrame:
    return rounded(M.best_threshold(order_scores(t), ["o_orderpriority"], "score", "label", "mcc"))


@query("metrics_by_model", f"""WITH {SCORED}, long AS (SELECT lang, label, 'score' AS model, score FROM scored UNION ALL SELECT lang, label, 'toxic', toxic FROM scored),
k AS (SELECT *, lang || '/' || model AS lm FROM long)
SELECT split_part(lm, '/', 1) AS lang, split_part(lm, '/', 2) AS model, round(auroc, 6) AS auroc FROM {auroc_sql('k', 'score', 'label', 'lm')}""")
def metrics_by_model(t: Tables) -> DataFrame:
    return rounded(M.metrics_by_model(scored(t), ["lang"], ["score", "toxic"], "label").select("lang", "model", "auroc"))


@query("split_metrics", f"""WITH {CONF} SELECT o_orderpriority, tp, fp, fn, tn, tp + fp + fn + tn AS n_rows, tp + fn AS n_positive, round(a.auroc, 6) AS auroc
FROM cells JOIN {auroc_sql("(SELECT o_orderpriority, o_totalprice AS score, (o_orderstatus = 'F')::INT AS label FROM orders)", 'score', 'label', 'o_orderpriority')} a USING (o_orderpriority)""")
def split_metrics(t: Tables) -> DataFrame:
    out = M.split_metrics(order_scores(t).withColumn("k", F.lit(1)), ["k"], "o_orderpriority", "score", "label", 0.5)
    return rounded(whole(out.select("o_orderpriority", "tp", "fp", "fn", "tn", "n_rows", "n_positive", "auroc"), "n_positive"))


SP = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


@query("positive_unlabelled_risks", f"""WITH r AS (SELECT avg({SP.format(x='-s')}) FILTER (y) AS rp, avg({SP.format(x='s')}) FILTER (y) AS rn, avg({SP.format(x='s')}) FILTER (NOT y) AS ru
  FROM (SELECT (l_quantity - 25) / 10 AS s, l_returnflag = 'R' AS y FROM lineitem))
SELECT round(rp, 6) AS risk_positive, round(rn, 6) AS risk_positive_as_negative, round(ru, 6) AS risk_unlabelled, round(0.3 * rp + greatest(0, ru - 0.3 * rn), 6) AS nn_risk,
  round(0.3 * rp + ru - 0.3 * rn, 6) AS unbiased_risk, round(0.5 * (rp + rn) + 0.1 * ru, 6) AS weighted_risk FROM r""")
def positive_unlabelled_risks(t: Tables) -> DataFrame:
    rows = t.lineitem.select(((F.col("l_quantity") - 25) / 10).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(M.pu_risks(rows, "s", "y", 0.3))


@query("log_losses", f"""WITH r AS (SELECT l_linestatus, y, CASE WHEN y THEN {SP.format(x='-s')} ELSE {SP.format(x='s')} END AS own FROM (SELECT l_linestatus, (l_quantity - 25) / 10 AS s, l_returnflag = 'R' AS y FROM lineitem))
SELECT l_linestatus, round(avg(CASE WHEN y THEN 2 ELSE 1 END * own), 6) AS log_loss, round(avg(CASE WHEN y THEN 0.25 ELSE 0.75 END * pow(1 - exp(-own), 2) * own), 6) AS focal_loss FROM r GROUP BY 1""")
def log_losses(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_linestatus", ((F.col("l_quantity") - 25) / 10).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(M.log_losses(rows, ["l_linestatus"], "s", "y", 2.0))


@query("training_prior", "SELECT round(avg(quality), 6) AS prior, round(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1), 6) AS negative_ratio FROM labels")
def training_prior(t: Tables) -> DataFrame:
    return rounded(M.training_prior(t.labels, "quality"))


# ----------------------------------------------------- validation of rankings

REC = f"""WITH {SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM scored),
per AS (SELECT source, max(n) AS n_candidates, sum(toxic)::BIGINT AS n_positive, min(r) FILTER (toxic = 1) AS first_rank, k, count(*) FILTER (toxic = 1 AND r <= k) AS hits FROM ranked, (VALUES (1), (3), (5), (10)) v(k) GROUP BY source, k HAVING sum(toxic) > 0)"""


def recall_rows(t: Tables) -> DataFrame:
    ranked = R.rank_within(scored(t), ["source"], "score", "doc_id")
    return RS.recall_at(ranked, ["source"], "toxic", [1, 3, 5, 10])


@query("recall_at_k", f"""{REC} SELECT source, n_candidates, n_positive, first_rank, k, hits, round(hits / n_positive, 6) AS recall, round(least(k, n_candidates) / n_candidates, 6) AS random_recall,
  round(hits / n_positive / (least(k, n_candidates) / n_candidates), 6) AS fold, round(1 / first_rank, 6) AS reciprocal_rank FROM per""")
def recall_at_k(t: Tables) -> DataFrame:
    return rounded(recall_rows(t))


@query("recall_summary", f"""{REC} SELECT k, count(*) AS n_groups, round(avg(hits / n_positive), 6) AS macro_recall, round(sum(hits) / sum(n_positive), 6) AS micro_recall,
  round(avg(least(k, n_candidates) / n_candidates), 6) AS macro_random_recall, round(avg(1 / first_rank), 6) AS mrr FROM per GROUP BY k""")
def recall_summary(t: Tables) -> DataFrame:
    return rounded(RS.recall_summary(recall_rows(t)))


@query("recall_permutations")
def recall_permutations(t: Tables) -> DataFrame:
    rows = recall_rows(t)
    null = RS.recall_permutation_null(rows, ["source"], [1, 3, 5, 10], PERMUTATIONS, 43)
    return rounded(RS.permutation_summary(RS.recall_summary(rows), null, [1, 3, 5, 10]))


# ----------------------------------------------------------- sets and splits


@query("labelled_parts", """SELECT DISTINCT o_custkey, 'urgent' AS grp FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT DISTINCT o_custkey, 'low' FROM orders WHERE o_orderpriority = '5-LOW'""")
def labelled_parts(t: Tables) -> DataFrame:
    o = t.orders
    return X.labelled_parts({"urgent": o.where("o_orderpriority = '1-URGENT'"), "low": o.where("o_orderpriority = '5-LOW'")}, ["o_custkey"], "grp")


@query("key_intersection", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity = 1")
def key_intersection(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_partkey", "l_quantity")
    return li.where("l_quantity = 50").select("l_partkey").intersect(li.where("l_quantity = 1").select("l_partkey"))


@query("key_difference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 1")
def key_difference(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_partkey", "l_quantity")
    return li.where("l_quantity = 50").select("l_partkey").distinct().join(li.where("l_quantity = 1").select("l_partkey"), "l_partkey", "left_anti")


@query("leaking_groups", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_parts FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def leaking_groups(t: Tables) -> DataFrame:
    return X.leaking_groups(t.orders, "o_custkey", "o_orderstatus")


HASH = "('0x' || substr(md5('{s}|' || {g}), 1, 12))::BIGINT"
PLACED = f"""placed AS (SELECT g, n_rows, n_pos, row_number() OVER (ORDER BY {HASH.format(s=11, g='g')}) AS place, count(*) OVER () AS n FROM (SELECT o_custkey AS g, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'P') AS n_pos FROM orders GROUP BY 1))"""


@query("three_way_split", f"""WITH {PLACED} SELECT o_orderkey, CASE WHEN place <= ceil(n * 0.2) THEN 'test' WHEN place <= ceil(n * 0.2) + ceil(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM orders JOIN placed ON o_custkey = g""")
def three_way_split(t: Tables) -> DataFrame:
    return X.three_way_split(t.orders, "o_custkey", 0.7, 0.1, 0.2, 11).select("o_orderkey", "split")


@query("inner_split", f"""WITH {PLACED} SELECT o_orderkey, CASE WHEN place <= ceil(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM orders JOIN placed ON o_custkey = g""")
def inner_split(t: Tables) -> DataFrame:
    return X.inner_split(t.orders, "o_custkey", 11).select("o_orderkey", "split")


def greedy_sql(k: int) -> str:
    """CTE ``dealt`` (g, hand): groups by falling size, each to the hand with the fewest rows."""
    return f"""WITH RECURSIVE {PLACED}, ordered AS (SELECT g, n_rows, row_number() OVER (ORDER BY n_rows DESC, {HASH.format(s=11, g='g')}) AS spot FROM placed),
  dealt AS (SELECT 0::BIGINT AS i, list_transform(range(0, {k}), lambda x: 0::BIGINT) AS loads, NULL::INTEGER AS hand, NULL::BIGINT AS g UNION ALL
    SELECT spot, list_transform(loads, lambda x, j: CASE WHEN j = h THEN x + n_rows ELSE x END), (h - 1)::INTEGER, g FROM
      (SELECT loads, list_position(loads, list_min(loads)) AS h, o.spot, o.g, o.n_rows FROM dealt JOIN ordered o ON o.spot = dealt.i + 1))"""


STRATIFIED = f"""WITH RECURSIVE {PLACED}, ordered AS (SELECT g, n_rows - n_pos AS a, n_pos AS b, sum(n_rows - n_pos) OVER () AS ta, sum(n_pos) OVER () AS tb,
    row_number() OVER (ORDER BY abs(2 * n_pos - n_rows) DESC, n_rows DESC, n_pos DESC, {HASH.format(s=11, g='g')}) AS spot FROM placed),
  dealt AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS la, [0, 0, 0, 0, 0]::BIGINT[] AS lb, NULL::INTEGER AS hand, NULL::BIGINT AS g UNION ALL
    SELECT spot, list_transform(la, lambda x, j: CASE WHEN j = h THEN x + a ELSE x END), list_transform(lb, lambda x, j: CASE WHEN j = h THEN x + b ELSE x END), (h - 1)::INTEGER, g FROM
      (SELECT la, lb, o.*, list_min(list_transform(range(1, 6), lambda f: struct_pack(
          e := round((list_aggregate(list_transform(la, lambda x, j: (CASE WHEN j = f THEN x + o.a ELSE x END) / greatest(o.ta, 1)::DOUBLE), 'stddev_pop')
            + list_aggregate(list_transform(lb, lambda x, j: (CASE WHEN j = f THEN x + o.b ELSE x END) / greatest(o.tb, 1)::DOUBLE), 'stddev_pop')) / 2, 9),
          s := la[f] + lb[f], f := f))).f AS h FROM dealt JOIN ordered o ON o.spot = dealt.i + 1))"""


@query("stratified_group_folds", f"""{STRATIFIED} SELECT o_orderkey, hand AS fold FROM orders JOIN dealt ON o_custkey = g""")
def stratified_group_folds(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("label", (F.col("o_orderstatus") == "P").cast("int"))
    return X.group_folds(rows, "o_custkey", 5, 11, "label").select("o_orderkey", "fold")


@query("group_folds", f"""{greedy_sql(3)} SELECT o_orderkey, hand AS fold FROM orders JOIN dealt ON o_custkey = g""")
def group_folds(t: Tables) -> DataFrame:
    return X.development_folds(t.orders, "o_custkey", 3, 11).select("o_orderkey", "fold")


@query("fixed_holdout", f"""{greedy_sql(5)} SELECT o_orderkey, hand = 0 AS is_test FROM orders JOIN dealt ON o_custkey = g""")
def fixed_holdout(t: Tables) -> DataFrame:
    return X.fixed_holdout(t.orders, "o_custkey", 0.2, 11).select("o_orderkey", "is_test")


@query("balanced_chunks", f"""{greedy_sql(8)} SELECT hand AS chunk, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups FROM orders JOIN dealt ON o_custkey = g GROUP BY 1""")
def balanced_chunks(t: Tables) -> DataFrame:
    return X.balanced_chunks(t.orders, "o_custkey", 8, 11).groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("n_groups"))


@query("sampled_bags", """WITH n AS (SELECT count(*) AS n FROM labels WHERE quality = 0), p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM labels WHERE quality = 0),
d AS (SELECT bag, slot, ('0x' || substr(md5('5|' || bag || '|' || slot), 1, 12))::BIGINT % n + 1 AS pos FROM n, range(1, 6) b(bag), range(1, 41) s(slot))
SELECT bag, doc_id, count(*) AS times FROM d JOIN p USING (pos) GROUP BY ALL""")
def sampled_bags(t: Tables) -> DataFrame:
    bags = X.sample_bags(t.labels.where("quality = 0").select("doc_id"), "doc_id", 5, 40, 5, replace=True)
    return bags.groupBy("bag", "doc_id").agg(F.count(F.lit(1)).alias("times"))


@query("positive_unlabelled_bags")
def positive_unlabelled_bags(t: Tables) -> DataFrame:
    positives = t.labels.where("toxic = 1").select("doc_id")
    bags = X.sample_bags(t.labels.where("toxic = 0").select("doc_id"), "doc_id", 4, 30, 5)
    return X.positive_unlabelled_bags(positives, bags, 4)


@query("background_fallback", """WITH r AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag = 'A' AS c, l_linestatus = 'F' AS o, l_quantity > 3 AS k FROM lineitem),
a AS (SELECT l_suppkey, bool_or(NOT k AND NOT c AND NOT o) AS s, bool_or(NOT k AND NOT c) AS x, bool_or(NOT c) AS m FROM r GROUP BY 1)
SELECT l_suppkey, CASE WHEN s THEN 'strict' WHEN x THEN 'relaxed_without_other_clusters' WHEN m THEN 'minimal_without_current_cluster' END AS pool_mode, count(*) AS n
FROM r JOIN a USING (l_suppkey) WHERE CASE WHEN s THEN NOT k AND NOT c AND NOT o WHEN x THEN NOT k AND NOT c ELSE NOT c END GROUP BY ALL""")
def background_fallback(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_suppkey", "l_partkey", (F.col("l_returnflag") == "A").alias("c"), (F.col("l_linestatus") == "F").alias("o"), (F.col("l_quantity") > 3).alias("k")).distinct()
    out = X.background_with_fallback(rows, "l_partkey", "l_suppkey", "c", "o", "k")
    return out.groupBy("l_suppkey", "pool_mode").agg(F.count(F.lit(1)).alias("n"))
