"""Cleaning: documents, parts and line items as site tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.catalog.registry import Tables, query, rounded
from sitelens.functions import scalars as S
from sitelens.operators import clean as C


@query("site_keys", """SELECT trim(source) AS ACC_ID, n_chars::BIGINT AS POSITION,
  trim(source) || '_' || trim(n_chars::VARCHAR) AS INDEX, doc_id FROM documents""")
def site_keys(t: Tables) -> DataFrame:
    raw = t.documents.select(
        F.concat(F.lit(" "), "source", F.lit(" ")).alias("ACC_ID"),
        F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(" ")).alias("POSITION"),
        "doc_id",
    )
    return C.standardize_sites(raw).select("ACC_ID", "POSITION", "INDEX", "doc_id")


RESIDUES = """sites AS (SELECT doc_id, source AS acc, text AS seq, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id * 7) % 400 - 3 END AS pos,
  CASE WHEN doc_id % 3 = 0 THEN source || '_S' || doc_id ELSE source || '_' || doc_id END AS key FROM documents)"""


def text_sites(t: Tables) -> DataFrame:
    """Documents as sequences with a position and a key that sometimes names a residue."""
    d = F.col("doc_id")
    return t.documents.select(
        "doc_id",
        F.col("source").alias("acc"),
        F.col("text").alias("seq"),
        F.when(d % 11 != 0, (d * 7) % 400 - 3).alias("pos"),
        F.when(d % 3 == 0, F.concat("source", F.lit("_S"), d)).otherwise(F.concat("source", F.lit("_"), d)).alias("key"),
    )


REASON_SQL = f"""WITH {RESIDUES}
SELECT doc_id, CASE WHEN pos IS NULL THEN 'position_missing' WHEN pos < 1 THEN 'position_below_one'
  WHEN seq IS NULL THEN 'sequence_missing' WHEN pos > length(seq) THEN 'position_beyond_sequence'
  WHEN regexp_extract(key, '_([A-Za-z])[0-9]+$', 1) <> '' AND upper(substr(seq, pos, 1)) <> upper(regexp_extract(key, '_([A-Za-z])[0-9]+$', 1))
    THEN 'residue_differs_from_key'
  WHEN upper(substr(seq, pos, 1)) NOT IN ('S', 'T', 'Y') THEN 'residue_not_allowed' END AS drop_reason FROM sites"""


@query("invalid_site_reasons", REASON_SQL)
def invalid_site_reasons(t: Tables) -> DataFrame:
    return C.tag_invalid_sites(text_sites(t), "pos", "seq", "key").select("doc_id", "drop_reason")


@query("valid_sites", f"SELECT doc_id FROM ({REASON_SQL}) WHERE drop_reason IS NULL")
def valid_sites(t: Tables) -> DataFrame:
    kept, _ = C.drop_invalid_sites(text_sites(t), "pos", "seq", "key")
    return kept.select("doc_id")


@query("reject_counts", f"""SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n_rows FROM ({REASON_SQL}) GROUP BY 1""")
def reject_counts(t: Tables) -> DataFrame:
    return C.reject_audit(C.tag_invalid_sites(text_sites(t), "pos", "seq", "key"))


@query("combined_rejects", f"""WITH r AS ({REASON_SQL}) SELECT doc_id, drop_reason FROM r WHERE drop_reason IS NOT NULL
UNION ALL SELECT doc_id, 'no_label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def combined_rejects(t: Tables) -> DataFrame:
    _, bad = C.drop_invalid_sites(text_sites(t), "pos", "seq", "key")
    unlabelled = t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", F.lit("no_label").alias("drop_reason"))
    return C.combine_rejects(bad.select("doc_id", "drop_reason"), unlabelled)


@query("missing_inputs", """SELECT o_orderkey, CASE WHEN e.k IS NULL THEN 'no_embedding' WHEN s.len IS NULL THEN 'no_sequence'
  WHEN o.pos < 1 OR o.pos > s.len THEN 'position_out_of_range' END AS drop_reason
FROM (SELECT o_orderkey, o_custkey AS acc, o_orderkey % 30 AS pos FROM orders) o
LEFT JOIN (SELECT DISTINCT vec_id AS k FROM embeddings) e ON o.acc = e.k
LEFT JOIN (SELECT doc_id, length(text) % 25 AS len FROM documents) s ON o.acc = s.doc_id""")
def missing_inputs(t: Tables) -> DataFrame:
    sites = t.orders.select("o_orderkey", F.col("o_custkey").alias("acc"), (F.col("o_orderkey") % 30).alias("pos"))
    seqs = t.documents.select(F.col("doc_id").alias("acc"), F.repeat(F.lit("x"), (F.length("text") % 25)).alias("sequence"))
    have = t.embeddings.select(F.col("vec_id").alias("acc"))
    return C.tag_missing_inputs(sites, seqs, have, "acc", "pos").select("o_orderkey", "drop_reason")


@query("structure_availability", """SELECT l_returnflag, count(*) AS n_in,
  count(*) FILTER (f.k IS NOT NULL AND p.k IS NOT NULL) AS n_kept, count(*) FILTER (f.k IS NULL) AS n_missing_file,
  count(*) FILTER (f.k IS NOT NULL AND p.k IS NULL) AS n_missing_position
FROM lineitem l LEFT JOIN (SELECT DISTINCT user_id AS k FROM events) f ON l.l_suppkey = f.k
LEFT JOIN (SELECT DISTINCT user_id AS k, floor(value)::BIGINT AS pos FROM events) p ON l.l_suppkey = p.k AND l.l_quantity::BIGINT = p.pos
GROUP BY 1""")
def structure_availability(t: Tables) -> DataFrame:
    residues = t.events.select(F.col("user_id").alias("acc"), F.floor("value").cast("bigint").alias("pos"))
    sites = t.lineitem.select(F.col("l_suppkey").alias("acc"), F.col("l_quantity").cast("bigint").alias("pos"), "l_returnflag")
    return C.structure_audit(C.tag_structure_availability(sites, residues, "acc", "pos"), "l_returnflag")


@query("direction_labels", """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Nuclear Import' WHEN 'R' THEN 'Nuclear Export'
  ELSE 'Nuclear Export' END AS direction FROM lineitem""")
def direction_labels(t: Tables) -> DataFrame:
    named = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", "promote_import").when(F.col("l_returnflag") == "R", "inhibit_import")
        .otherwise(" promote_export ").alias("label"),
    )
    return C.normalize_direction(named, "label", "direction").drop("label")


@query("direction_from_text", """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'Known Import'
  WHEN event_type IN ('error', 'purchase') THEN 'Known Export' END AS direction FROM events""")
def direction_from_text(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", "Nuclear Import site").when(kind == "view", "may inhibit-export")
        .when(kind == "error", "X Export").when(kind == "purchase", "promote nuclear export").otherwise("none")
    )
    return C.direction_from_first_column(t.events.select("event_id", text.alias("LABEL")), ["Transport_Direction", "LABEL"], "direction").drop("LABEL")


@query("task_rows", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def task_rows(t: Tables) -> DataFrame:
    return C.select_task(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


@query("without_conflicts", """SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey NOT IN
  (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)""")
def without_conflicts(t: Tables) -> DataFrame:
    return C.drop_conflicts(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey"], "l_returnflag")


@query("binary_labels", """SELECT l_returnflag, (l_returnflag = 'R')::INT AS label, count(*) AS n FROM lineitem GROUP BY ALL""")
def binary_labels(t: Tables) -> DataFrame:
    return C.binary_label(t.lineitem, "l_returnflag", "R").groupBy("l_returnflag", "label").agg(F.count(F.lit(1)).alias("n"))


@query("site_key_variants", """SELECT p_partkey, p_type || '_S' || p_size AS canonical,
  CASE WHEN p_size > 25 THEN '' ELSE p_brand || '_' || p_size END AS identity,
  upper(p_brand) || '_S' || p_size AS label, split_part(p_brand, '#', 1) AS stem,
  regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM part""")
def site_key_variants(t: Tables) -> DataFrame:
    small = F.when(F.col("p_size") <= 25, F.col("p_size"))
    return t.part.select(
        "p_partkey",
        S.canonical_site_key("p_type", "p_size", F.lit(None).cast("string"), F.concat(F.lit("s"), "p_size", F.lit("-p"))).alias("canonical"),
        S.identity_key("p_brand", small).alias("identity"),
        S.display_label(F.upper("p_brand"), F.lit("s"), "p_size").alias("label"),
        F.substring_index("p_brand", "#", 1).alias("stem"),
        S.safe_name("p_brand").alias("safe"),
    )


@query("modification_parse", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'S' END AS residue,
  CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT END AS pos, 'P' || p_partkey AS acc FROM part""")
def modification_parse(t: Tables) -> DataFrame:
    mod = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("s"), "p_size", F.lit("-P"))).otherwise(F.concat(F.lit("K"), "p_size", F.lit("-ub")))
    acc = F.concat(F.lit("P"), "p_partkey", F.lit("-2"))
    return t.part.select(
        "p_partkey", S.modification_residue(mod).alias("residue"), S.modification_position(mod).alias("pos"),
        S.without_isoform(acc).alias("acc"),
    )


@query("text_flags", """SELECT event_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.0 WHEN 'error' THEN (value > 0)::INT::DOUBLE
  WHEN 'purchase' THEN 1.0 END AS flag FROM events""")
def text_flags(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", " TRUE ").when(kind == "view", "0").when(kind == "error", F.col("value").cast("string"))
        .when(kind == "purchase", "yes").otherwise("maybe")
    )
    return t.events.select("event_id", S.text_flag(text, wide=True).alias("flag"))


@query("relative_position", """SELECT l_orderkey, l_linenumber, round(l_quantity / p_size, 6) AS relative_position
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 AND l_quantity <= p_size""")
def relative_position(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    return rounded(C.relative_position(joined, "l_quantity", "p_size").select("l_orderkey", "l_linenumber", "relative_position"))


def gappy(t: Tables) -> DataFrame:
    """Line items as a long matrix with missing values: order, part, quantity."""
    return t.lineitem.select(
        "l_suppkey", "l_orderkey", "l_linenumber",
        F.when(F.col("l_discount") > 0.04, F.col("l_quantity")).alias("value"),
        F.when(F.col("l_tax") != 0.02, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_discount") < 0.03, F.col("l_discount")).alias("discount"),
        (F.col("l_returnflag") == "R").cast("double").alias("returned"),
    )


GAPPY = """gappy AS (SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_discount > 0.04 THEN l_quantity END AS value,
  CASE WHEN l_tax <> 0.02 THEN l_tax END AS tax, CASE WHEN l_discount < 0.03 THEN l_discount END AS discount,
  (l_returnflag = 'R')::INT::DOUBLE AS returned FROM lineitem)"""


@query("observed_rows", f"""WITH {GAPPY} SELECT l_suppkey, l_orderkey, l_linenumber, value FROM gappy WHERE l_suppkey IN
  (SELECT l_suppkey FROM gappy GROUP BY 1 HAVING avg((value IS NULL)::INT) <= 0.45)""")
def observed_rows(t: Tables) -> DataFrame:
    return C.keep_observed_rows(gappy(t), ["l_suppkey"], "value", 0.45).select("l_suppkey", "l_orderkey", "l_linenumber", "value")


@query("missing_rates", f"""WITH {GAPPY}, w AS (SELECT avg((value IS NULL)::INT) AS value, avg((tax IS NULL)::INT) AS tax,
  avg((discount IS NULL)::INT) AS discount FROM gappy)
SELECT feature, round(missing_rate, 6) AS missing_rate FROM (UNPIVOT w ON value, tax, discount INTO NAME feature VALUE missing_rate)""")
def missing_rates(t: Tables) -> DataFrame:
    return rounded(C.missing_rates(gappy(t), ["value", "tax", "discount"]))


@query("dense_columns", f"""WITH {GAPPY} SELECT l_orderkey, l_linenumber, value, tax FROM gappy""")
def dense_columns(t: Tables) -> DataFrame:
    out = C.drop_sparse_columns(gappy(t), ["value", "tax", "discount"], 0.6)
    return out.select("l_orderkey", "l_linenumber", *[c for c in ("value", "tax", "discount") if c in out.columns])


@query("binary_columns", f"""WITH {GAPPY} SELECT 'value' AS feature, false AS is_binary UNION ALL SELECT 'returned',
  (SELECT bool_and(returned IN (0, 1)) FROM gappy)""")
def binary_columns(t: Tables) -> DataFrame:
    return C.binary_columns(gappy(t), ["value", "returned"])


@query("known_marks", """WITH s AS (SELECT s_suppkey, 'K' || s_nationkey AS k1, 'S' || s_suppkey AS k2,
  CASE WHEN s_suppkey % 2 = 0 THEN 'import' ELSE 'export' END AS direction FROM supplier),
k AS (SELECT DISTINCT 'K' || n_nationkey AS key, 'import' AS direction FROM nation WHERE n_regionkey = 1)
SELECT s_suppkey, (EXISTS (SELECT 1 FROM k WHERE (k.key = k1 OR k.key = k2) AND (s.direction = 'export' OR k.direction = s.direction))) AS is_known FROM s""")
def known_marks(t: Tables) -> DataFrame:
    sites = t.supplier.select(
        "s_suppkey", F.concat(F.lit("K"), "s_nationkey").alias("k1"), F.concat(F.lit("S"), "s_suppkey").alias("k2"),
        F.when(F.col("s_suppkey") % 2 == 0, "import").otherwise("export").alias("direction"),
    )
    known = t.nation.where("n_regionkey = 1").select(F.concat(F.lit("K"), "n_nationkey").alias("key"), F.lit("import").alias("direction"))
    return C.mark_known(sites, known, ["k1", "k2"], "direction").select("s_suppkey", "is_known")


@query("unit_scores", """SELECT l_orderkey, l_linenumber, least(greatest(l_discount * 15, 0), 1) AS score FROM lineitem""")
def unit_scores(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 15).alias("mean_prob"))
    return C.unit_score(rows, ["prob_import", "mean_prob"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "score")


@query("fallback_keys", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand || '_S' || p_size
  ELSE p_brand || '_' || p_size END AS site_key FROM part""")
def fallback_keys(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("INDEX"), F.col("p_brand").alias("ACC_ID"),
        F.when(F.col("p_partkey") % 3 == 0, "s").alias("RESIDUE"), F.col("p_size").alias("POSITION"),
    )
    return C.fallback_key(rows, "INDEX", "ACC_ID", "RESIDUE", "POSITION").select("p_partkey", "site_key")


@query("ratio_values", """WITH s AS (SELECT l_suppkey, p_brand, year(l_shipdate) AS y, round(avg(l_quantity), 6) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
g AS (SELECT p_brand, year(l_shipdate) AS y, round(avg(l_quantity), 6) AS base FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 1 GROUP BY ALL)
SELECT l_suppkey, p_brand, y, round(value - base, 6) AS value FROM s LEFT JOIN g USING (p_brand, y)""")
def ratio_values(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey").withColumn("y", F.year("l_shipdate").cast("bigint"))
    site = rows.groupBy("l_suppkey", "p_brand", "y").agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    gene = rows.where("p_size > 1").groupBy("p_brand", "y").agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    return rounded(C.ratio_values(site, gene, ["p_brand", "y"])).select("l_suppkey", "p_brand", "y", "value")


@query("mode_rows", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def mode_rows(t: Tables) -> DataFrame:
    return C.select_mode(t.orders, "F", "o_orderstatus").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


STARS = """CASE WHEN p IS NULL THEN 'ns' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END"""


@query("star_labels", f"""WITH r AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.1) * l_tax AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, {STARS} AS stars, CASE WHEN p IS NULL THEN 'NA' WHEN p < 0.0001 THEN '****' WHEN p < 0.001 THEN '***'
  WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars4,
  CASE {STARS} WHEN '***' THEN 0 WHEN '**' THEN 1 WHEN '*' THEN 2 ELSE 3 END AS star_rank FROM r""")
def star_labels(t: Tables) -> DataFrame:
    p = F.nullif("l_discount", F.lit(0.1)) * F.col("l_tax")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", S.stars(p).alias("stars"), S.stars(p, S.STAR_CUTS_4, "NA").alias("stars4"),
        S.star_rank(p).alias("star_rank"),
    )


@query("expected_directions", """WITH r AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'N' THEN 'two-sided'
  WHEN (l_returnflag = 'A') = (l_linestatus = 'F') THEN 'greater' ELSE 'less' END AS alternative, l_tax - l_discount AS d FROM lineitem)
SELECT l_returnflag, l_linestatus, alternative, round(sum(CASE alternative WHEN 'two-sided' THEN abs(d) WHEN 'greater' THEN d ELSE -d END), 4) AS effect,
  count(*) AS n FROM r GROUP BY ALL""")
def expected_directions(t: Tables) -> DataFrame:
    way = F.when(F.col("l_returnflag") == "A", "Import").when(F.col("l_returnflag") == "R", "export").otherwise("none")
    reg = F.when(F.col("l_linestatus") == "F", "activate").otherwise("repress")
    delta = F.col("l_tax") - F.col("l_discount")
    return rounded(t.lineitem.select("l_returnflag", "l_linestatus", S.expected_alternative(way, reg).alias("alternative"),
        S.directional_effect(delta, way, reg).alias("e")).groupBy("l_returnflag", "l_linestatus", "alternative").agg(
        F.sum("e").alias("effect"), F.count(F.lit(1)).alias("n")), digits=4)


@query("scalar_functions", """SELECT p_partkey, upper(trim(p_name)) AS name_key, 'gt' || replace((p_size / 100)::VARCHAR, '.', 'p') AS tag,
  round(ln(1 + p_size), 6) AS log1p_size, sign(p_size - 25)::INT AS side, ceil(p_size / 7)::BIGINT AS up, floor(p_size / 7)::BIGINT AS down,
  round(CASE WHEN p_size < 25 THEN -1 WHEN p_size > 25 THEN 1 ELSE 0 END * ln(1 + abs(p_size - 25)), 6) AS signed_log,
  greatest(least(p_size, 40), 10) AS clipped, try_cast(split_part(p_brand, '#', 2) AS BIGINT) AS brand_number FROM part""")
def scalar_functions(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return rounded(t.part.select(
        "p_partkey", S.name_key("p_name").alias("name_key"), S.threshold_tag(size / 100).alias("tag"),
        F.log1p(size).alias("log1p_size"), F.signum(size - 25).cast("int").alias("side"),
        F.ceil(size / 7).alias("up"), F.floor(size / 7).alias("down"), S.signed_log(size - 25).alias("signed_log"),
        S.clip(size, 10, 40).alias("clipped"), S.whole_number(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("brand_number"),
    ))


@query("p_value_text", """SELECT p_partkey, CASE WHEN p_size = 7 THEN 'NA' WHEN p < 0.0001 THEN
  replace(format('{:.1e}', p), 'E', 'e') ELSE format('{:.4f}', p) END AS text FROM (SELECT p_partkey, p_size, 1.0 / pow(p_size + 0.37, 3.1) AS p FROM part)""")
def p_value_text(t: Tables) -> DataFrame:
    p = F.when(F.col("p_size") != 7, 1.0 / F.pow(F.col("p_size") + F.lit(0.37), F.lit(3.1)))
    return t.part.select("p_partkey", S.p_text(p).alias("text"))


@query("url_parts", """SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, position('?' IN url) > 0 AS has_query,
  split_part(url, '#', 1) AS base FROM pages""")
def url_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select(
        "page_id", F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"),
        F.contains(url, F.lit("?")).alias("has_query"), F.split_part(url, F.lit("#"), F.lit(1)).alias("base"),
    )


