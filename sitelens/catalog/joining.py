"""Joins: events by user and time, orders and customers, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.catalog.registry import Tables, query, rounded
from sitelens.operators import joins as J
from sitelens.operators.aggregates import arm_statistics, close_relative, filter_audit
from sitelens.operators.ordered import merge_join


@query("inner_join", """SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey""")
def inner_join(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return t.lineitem.join(parts, "l_partkey", "inner").select("l_orderkey", "l_linenumber", "p_brand")


@query("one_to_one_join", """SELECT s_suppkey, c_name FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey""")
def one_to_one_join(t: Tables) -> DataFrame:
    right = t.customer.select(F.col("c_custkey").alias("s_suppkey"), "c_name")
    return J.one_to_one(t.supplier.select("s_suppkey"), right, ["s_suppkey"])


@query("feature_families", """SELECT p_partkey, q, d FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) a ON p_partkey = a.l_partkey
LEFT JOIN (SELECT l_partkey, min(l_discount) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON p_partkey = b.l_partkey""")
def feature_families(t: Tables) -> DataFrame:
    key = F.col("l_partkey").alias("p_partkey")
    a = t.lineitem.groupBy(key).agg(F.max("l_quantity").alias("q"))
    b = t.lineitem.where("l_returnflag = 'R'").groupBy(key).agg(F.min("l_discount").alias("d"))
    return J.join_families(t.part.select("p_partkey"), [a, b], "p_partkey")


@query("group_fallback", """SELECT c_custkey, coalesce(s_name, 'UNCLUSTERED_' || c_custkey) AS s_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def group_fallback(t: Tables) -> DataFrame:
    groups = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    return J.with_group(t.customer.select("c_custkey"), groups, "c_custkey", "s_name")


@query("matched_and_missing", """SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS matched FROM orders""")
def matched_and_missing(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return J.with_match(t.orders.select("o_orderkey"), items, ["o_orderkey"])


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(t: Tables) -> DataFrame:
    partial = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(partial, "c_custkey", "left_semi")


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_join(t: Tables) -> DataFrame:
    partial = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(partial, "c_custkey", "left_anti")


def positioned(t: Tables) -> DataFrame:
    """Events with their whole second as position."""
    return t.events.select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("pos"))


EV = "ev AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS pos FROM events)"
NEAR = f"""{EV}, near AS (SELECT v.event_id, v.user_id, v.pos, min(abs(v.pos - p.pos)) AS distance
  FROM (SELECT * FROM ev WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') p USING (user_id) GROUP BY ALL)"""


@query("nearest_purchase", f"WITH {NEAR} SELECT event_id, distance FROM near")
def nearest_purchase(t: Tables) -> DataFrame:
    ev = positioned(t)
    return J.nearest_distance(ev.where("event_type = 'view'"), ev.where("event_type = 'purchase'"), ["user_id"], "pos").select("event_id", "distance")


@query("views_far_from_purchases", f"WITH {NEAR} SELECT event_id FROM near WHERE distance IS NULL OR distance > 7200")
def views_far_from_purchases(t: Tables) -> DataFrame:
    ev = positioned(t)
    return J.far_from(ev.where("event_type = 'view'"), ev.where("event_type = 'purchase'"), ["user_id"], "pos", 7200).select("event_id")


@query("views_far_same_user", f"""WITH {NEAR} SELECT event_id FROM near WHERE distance > 7200""")
def views_far_same_user(t: Tables) -> DataFrame:
    ev = positioned(t)
    return J.far_from(ev.where("event_type = 'view'"), ev.where("event_type = 'purchase'"), ["user_id"], "pos", 7200, True).select("event_id")


POOL = f"""WITH {EV}, pos AS (SELECT * FROM ev WHERE event_type = 'signup'), cand AS (SELECT * FROM ev WHERE event_type IN ('signup', 'click')),
d AS (SELECT c.event_id, c.user_id, min(abs(c.pos - p.pos)) AS distance FROM cand c LEFT JOIN pos p USING (user_id)
  WHERE c.event_id NOT IN (SELECT event_id FROM pos) GROUP BY ALL)"""


def pool_query(mode: str, distance: float):
    def run(t: Tables) -> DataFrame:
        ev = positioned(t)
        positives, cands = ev.where("event_type = 'signup'"), ev.where("event_type IN ('signup', 'click')")
        return J.background_pool(positives, cands, mode, "user_id", "event_id", "pos", distance).select("event_id")

    return run


query("pool_far", f"{POOL} SELECT event_id FROM d WHERE distance > 10000")(pool_query("far", 10000))
query("pool_other", f"{POOL} SELECT event_id FROM d WHERE distance IS NOT NULL")(pool_query("other", 0))


@query("pool_no_positive", """SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
  AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def pool_no_positive(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderkey").alias("pos"))
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    return J.background_pool(urgent, orders, "no_positive", "o_custkey", "o_orderkey", "pos").select("o_orderkey")


@query("labelled_union", f"""{POOL} SELECT event_id, 1 AS LABEL FROM pos UNION ALL SELECT event_id, 0 FROM d WHERE distance > 10000""")
def labelled_union(t: Tables) -> DataFrame:
    ev = positioned(t)
    positives = ev.where("event_type = 'signup'")
    pool = J.background_pool(positives, ev.where("event_type IN ('signup', 'click')"), "far", "user_id", "event_id", "pos", 10000)
    return J.labelled_union(positives, pool).select("event_id", "LABEL")


@query("shared_background", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""")
def shared_background(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    big = t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.shared_background(orders, orders.where("o_orderstatus = 'F'"), big, "o_orderkey").select("o_orderkey")


@query("new_predictions", """SELECT o_orderkey FROM orders WHERE o_totalprice >= 400000 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def new_predictions(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return J.new_predictions(orders, orders.where("o_orderstatus = 'F'"), "o_orderkey", "o_totalprice", 400000).select("o_orderkey")


@query("background_two_keys", """WITH t AS (SELECT * FROM lineitem WHERE l_quantity = 50)
SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_suppkey IN (SELECT l_suppkey FROM t) AND l_orderkey NOT IN (SELECT l_orderkey FROM t)
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.l_suppkey = l.l_suppkey AND t.l_partkey = l.l_partkey)""")
def background_two_keys(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    return J.excluding_two_keys(li, li.where("l_quantity = 50"), "l_suppkey", "l_orderkey", "l_partkey").select("l_orderkey", "l_linenumber")


@query("mapped_sites", """WITH m AS (SELECT l_partkey AS acc, min(l_suppkey) AS gene FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey, m.gene, m.gene || '|' || p_size AS site, p_retailprice FROM part JOIN m ON p_partkey = acc
  WHERE m.gene IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
SELECT site, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY p_retailprice DESC, p_partkey) AS rn FROM p) WHERE rn = 1""")
def mapped_sites(t: Tables) -> DataFrame:
    preds = t.part.select(F.col("p_partkey").alias("acc"), "p_size", "p_retailprice")
    ids = t.lineitem.select(F.col("l_partkey").alias("acc"), F.col("l_suppkey").alias("gene"))
    genes = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("gene"))
    out = J.map_to_genes(preds, ids, genes, "acc", "gene", F.col("p_size"), "p_retailprice")
    return out.select("site", F.col("acc").alias("p_partkey"))


@query("site_regulators", """SELECT l_suppkey, count(*) AS n, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY ALL""")
def site_regulators(t: Tables) -> DataFrame:
    genes = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("s_name"))
    named = J.sites_with_regulator(t.lineitem.select("l_suppkey"), genes, "l_suppkey", "s_name")
    return named.groupBy("l_suppkey", "s_name").agg(F.count(F.lit(1)).alias("n"))


EDGES = """edges AS (SELECT l_suppkey, p_brand, round(avg(l_discount - 0.05), 8) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def edges(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = merge_join(t.lineitem, parts, ["l_partkey"])
    return rows.groupBy("l_suppkey", "p_brand").agg(F.round(F.avg(F.col("l_discount") - 0.05), 8).alias("weight"))


@query("supported_targets", f"""WITH {EDGES} SELECT l_suppkey, p_brand, weight FROM edges e WHERE EXISTS
  (SELECT 1 FROM lineitem l JOIN part ON l.l_partkey = p_partkey WHERE l.l_quantity = 50 AND l.l_suppkey = e.l_suppkey AND part.p_brand = e.p_brand)""")
def supported_targets(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    hits = t.lineitem.where("l_quantity = 50").join(parts, "l_partkey").select("l_suppkey", "p_brand")
    return J.supported_targets(edges(t), hits, "l_suppkey", "p_brand")


@query("targets_to_parts", f"""WITH {EDGES} SELECT DISTINCT l_suppkey, p_brand, weight, p_partkey FROM edges JOIN part USING (p_brand)
  WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48)""")
def targets_to_parts(t: Tables) -> DataFrame:
    measured = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    genes = t.part.select(F.lower("p_brand").alias("symbol"), "p_partkey")
    return J.targets_to_genes(edges(t), genes, measured, "p_brand", "symbol", "p_partkey")


@query("shared_samples", """SELECT DISTINCT l_returnflag, month(l_shipdate)::BIGINT AS m FROM lineitem WHERE l_quantity = 50
INTERSECT SELECT DISTINCT l_returnflag, month(l_shipdate)::BIGINT FROM lineitem WHERE l_discount = 0""")
def shared_samples(t: Tables) -> DataFrame:
    li = t.lineitem.withColumn("m", F.month("l_shipdate").cast("bigint"))
    return J.shared_samples(li.where("l_quantity = 50"), li.where("l_discount = 0"), ["l_returnflag", "m"])


@query("sample_lookup", """SELECT o_orderkey, v FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON o_orderkey = l_orderkey""")
def sample_lookup(t: Tables) -> DataFrame:
    firsts = t.lineitem.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("q"))
    return J.lookup_values(t.orders.select("o_orderkey"), firsts, ["o_orderkey"], "q", "v")


EXT = """ext AS (SELECT p_partkey, p_size, a, b FROM part LEFT JOIN (SELECT l_partkey, arg_min(l_discount, (l_orderkey, l_linenumber, l_discount)) AS a FROM lineitem WHERE l_quantity > 45 GROUP BY 1) x ON p_partkey = x.l_partkey
LEFT JOIN (SELECT l_partkey, arg_min(l_tax, (l_orderkey, l_linenumber, l_tax)) AS b FROM lineitem WHERE l_quantity < 4 GROUP BY 1) y ON p_partkey = y.l_partkey)"""


def external(t: Tables, complete: bool) -> DataFrame:
    key = F.col("l_partkey").alias("p_partkey")
    a = t.lineitem.where("l_quantity > 45").select(key, "l_orderkey", "l_linenumber", F.col("l_discount").alias("a"))
    b = t.lineitem.where("l_quantity < 4").select(key, "l_orderkey", "l_linenumber", F.col("l_tax").alias("b"))
    return J.with_external_scores(t.part.select("p_partkey", "p_size"), [(a, "a"), (b, "b")], "p_partkey", complete, ["l_orderkey", "l_linenumber"])


@query("external_scores", f"WITH {EXT} SELECT * FROM ext WHERE a IS NOT NULL AND b IS NOT NULL")
def external_scores(t: Tables) -> DataFrame:
    return external(t, True)


@query("external_score_gaps", f"""WITH {EXT} SELECT count(*) AS n_rows, count(*) FILTER (a IS NULL) AS missing_a, count(*) FILTER (b IS NULL) AS missing_b,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_complete FROM ext""")
def external_score_gaps(t: Tables) -> DataFrame:
    return J.missing_scores(external(t, False), ["a", "b"])


CURATED = """cur AS (SELECT d.doc_id, coalesce(quality, 0) AS label, d.doc_id IN (SELECT item_id * 5 FROM benchmark) AS is_curated FROM documents d LEFT JOIN labels USING (doc_id)),
flagged AS (SELECT *, NOT (label = 0 AND is_curated) AS kept FROM cur)"""


def curated(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("label"))
    return J.flag_curated(docs, t.benchmark.select((F.col("item_id") * 5).alias("doc_id")), "doc_id", "label")


@query("curated_flags", f"WITH {CURATED} SELECT * FROM flagged")
def curated_flags(t: Tables) -> DataFrame:
    return curated(t)


@query("curated_audit", f"""WITH {CURATED} SELECT count(*) AS n_complete, count(*) FILTER (kept) AS n_clean, count(*) FILTER (NOT kept) AS n_excluded,
  round(avg(label), 6) AS prevalence_complete, round(avg(label) FILTER (kept), 6) AS prevalence_clean FROM flagged""")
def curated_audit(t: Tables) -> DataFrame:
    return rounded(filter_audit(curated(t), "label"))


@query("expanded_keys", """SELECT p_partkey, p_brand AS key FROM part UNION ALL SELECT p_partkey, split_part(p_brand, '#', 1) || '_' || p_size FROM part""")
def expanded_keys(t: Tables) -> DataFrame:
    canonical = F.concat(F.split_part("p_brand", F.lit("#"), F.lit(1)), F.lit("_"), "p_size")
    return J.expand_keys(t.part, F.col("p_brand"), canonical, "key").select("p_partkey", "key")


@query("average_scores", """SELECT p_partkey, round(coalesce(a, 0), 6) AS mean_score FROM part LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey""")
def average_scores(t: Tables) -> DataFrame:
    scores = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return rounded(J.weighted_by_average(t.part.select("p_partkey"), scores, "p_partkey", "l_quantity", "mean_score"))


@query("restored_columns", "SELECT p_partkey, p_size, p_brand, p_type FROM part WHERE p_size > 20")
def restored_columns(t: Tables) -> DataFrame:
    short = t.part.where("p_size > 20").select("p_partkey", "p_size")
    return J.restore_columns(short, t.part.select("p_partkey", "p_brand", "p_type"), "p_partkey").select("p_partkey", "p_size", "p_brand", "p_type")


@query("replaced_columns", """SELECT c_nationkey, count(*) AS n, round(max(s), 6) AS balance FROM customer LEFT JOIN
  (SELECT s_nationkey, max(s_acctbal) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey GROUP BY 1""")
def replaced_columns(t: Tables) -> DataFrame:
    summary = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("balance"))
    extra = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("balance"))
    return rounded(J.replace_columns(summary, extra, ["c_nationkey"]))


@query("dimension_join", """SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE') GROUP BY 1""")
def dimension_join(t: Tables) -> DataFrame:
    named = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey").join(
        t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit(" "), F.lower("r_name")).alias("fact_name")), "n_regionkey")
    out = J.join_dimension(named, t.region, "fact_name", "r_name", "r_name", ["ASIA", "EUROPE"])
    return out.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("known_annotation", """SELECT c_custkey, s_name AS known_s_name, s_nationkey AS known_s_nationkey, CASE WHEN s_suppkey IS NULL THEN 'Unknown' ELSE 'Known' END AS known_status
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def known_annotation(t: Tables) -> DataFrame:
    known = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), "s_name", "s_nationkey")
    return J.annotate_known(t.customer.select("c_custkey"), known, "c_custkey")


@query("first_of_key", """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def first_of_key(t: Tables) -> DataFrame:
    order = [F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey"), F.asc("l_extendedprice")]
    return J.first_per_key(t.lineitem, ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber")


ARMS = """members AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'known' WHEN 'P' THEN 'new' ELSE 'background' END AS arm FROM orders),
feat AS (SELECT l_orderkey AS k, l_quantity AS quantity, l_discount AS discount, (l_returnflag = 'R')::INT::DOUBLE AS returned FROM lineitem),
long AS (UNPIVOT (SELECT k, arm, quantity, discount, returned FROM members JOIN feat USING (k)) ON quantity, discount, returned INTO NAME feature VALUE value)"""


def arms(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    members = t.orders.select(F.col("o_orderkey").alias("k"), F.when(status == "F", "known").when(status == "P", "new").otherwise("background").alias("arm"))
    feats = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").cast("double").alias("returned"))
    return J.values_by_group(members, feats, "k", "arm", ["quantity", "discount", "returned"])


@query("values_by_arm", f"""WITH {ARMS} SELECT feature, arm, count(*) AS n, round(sum(value), 4) AS total FROM long GROUP BY ALL""")
def values_by_arm(t: Tables) -> DataFrame:
    return rounded(arms(t).groupBy("feature", "arm").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), digits=4)


@query("arm_statistics", f"""WITH {ARMS}, kinds AS (SELECT feature, bool_and(value IN (0, 1)) AS is_binary FROM long GROUP BY 1),
s AS (SELECT feature, bool_and(is_binary) AS is_binary, arm, count(*) AS n, CASE WHEN bool_and(is_binary) THEN avg((value = 1)::INT) ELSE median(value) END AS stat
  FROM long JOIN kinds USING (feature) GROUP BY feature, arm),
w AS (SELECT feature, is_binary, max(n) FILTER (arm = 'known') AS n_known, max(n) FILTER (arm = 'new') AS n_new,
  max(n) FILTER (arm = 'background') AS n_background, max(stat) FILTER (arm = 'known') AS k, max(stat) FILTER (arm = 'new') AS w,
  max(stat) FILTER (arm = 'background') AS b FROM s GROUP BY ALL)
SELECT feature, is_binary, n_known, n_new, n_background, round(k, 6) AS stat_known, round(w, 6) AS stat_new, round(b, 6) AS stat_background,
  sign(k - b) * sign(w - b) > 0 AND abs(k - w) < least(abs(k - b), abs(w - b)) AS is_close FROM w""")
def arm_stats(t: Tables) -> DataFrame:
    wide = arm_statistics(arms(t), "feature", "arm", "value", ["known", "new", "background"])
    return rounded(wide.withColumn("is_close", close_relative("stat_known", "stat_new", "stat_background")))
