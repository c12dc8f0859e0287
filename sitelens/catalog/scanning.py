"""Parsers of the readers on lines that Spark derives from the tables, and spatial neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.catalog.registry import Tables, query, rounded
from sitelens.operators import graphs as G
from sitelens.sources import sequences as SQ
from sitelens.sources import tables as ST


@query("sequence_records", """SELECT acc, sequence FROM (SELECT source AS acc, regexp_replace(text, '\\s+', '', 'g') AS sequence, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def sequence_records(t: Tables) -> DataFrame:
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(">sp|"), "source", F.lit("|NAME extra"))).otherwise(F.concat("source", F.lit(" text")))
    body = F.regexp_replace("text", r"[\s ]+", "\n\n")
    return SQ.parse_sequence_records(t.documents.select("doc_id", F.concat(head, F.lit("\n"), body).alias("r")), "r", ["doc_id"])


def atom_lines(t: Tables) -> DataFrame:
    """Line items written as structure lines of their supplier's file."""
    part = lambda c, w: F.lpad(c.cast("string"), w, " ")
    line = F.concat(
        F.when(F.col("l_returnflag") == "N", "HETATM").otherwise("ATOM  "), part(F.col("l_linenumber"), 5),
        F.when(F.col("l_linestatus") == "F", "  CA  ").otherwise("  CB  "), F.when(F.col("l_discount") > 0.05, "SER").otherwise("QQQ"), F.lit(" A"),
        part(F.col("l_partkey") % 500, 4), F.lit("    "), part(F.format_string("%.3f", F.col("l_quantity")), 8), part(F.format_string("%.3f", F.col("l_discount") * 100), 8),
        part(F.format_string("%.3f", F.col("l_tax") * 100), 8), F.lit("  1.00"), part(F.format_string("%.2f", F.col("l_quantity") + 40), 6))
    file = F.concat(F.lit("/data/AF-"), F.col("l_suppkey").cast("string"), F.lit("-F1-model_v4.pdb"))
    return t.lineitem.select(line.alias("line"), file.alias("file"))


@query("structure_positions", "SELECT DISTINCT l_suppkey::VARCHAR AS acc, (l_partkey % 500)::INT AS pos FROM lineitem WHERE l_returnflag <> 'N'")
def structure_positions(t: Tables) -> DataFrame:
    return SQ.parse_atom_lines(atom_lines(t), "line", "file")


@query("structure_atoms", """SELECT l_suppkey::VARCHAR AS acc, (l_partkey % 500)::INT AS resseq, CASE WHEN l_discount > 0.05 THEN 'S' ELSE 'X' END AS aa, l_quantity AS x, round(l_discount * 100, 3) AS y,
  round(l_tax * 100, 3) AS z, l_quantity + 40 AS plddt FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'F'""")
def structure_atoms(t: Tables) -> DataFrame:
    return SQ.parse_ca_atoms(atom_lines(t), "line", "file")


@query("resolved_files", """SELECT s_suppkey::VARCHAR AS acc, CASE WHEN s_nationkey < 5 THEN 'dir/' || s_suppkey || '.pdb' WHEN s_nationkey < 15 THEN 'dir/AF-' || s_suppkey || '-F1-model_v4.pdb'
  WHEN s_nationkey < 20 THEN 'dir/AF-' || s_suppkey || '-F1-model_v2.cif' END AS name FROM supplier""")
def resolved_files(t: Tables) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    s = t.supplier
    plain = s.where("s_nationkey < 15").select(F.concat(F.lit("dir/"), key, F.lit(".pdb")).alias("name"))
    exact = s.where("s_nationkey >= 5 AND s_nationkey < 15").select(F.concat(F.lit("dir/AF-"), key, F.lit("-F1-model_v4.pdb")).alias("name"))
    other = s.where("s_nationkey >= 5 AND s_nationkey < 20").select(F.concat(F.lit("dir/AF-"), key, F.lit("-F1-model_v2.cif")).alias("name"))
    return SQ.resolve_files(plain.union(exact).union(other), s.select(key.alias("acc")))


@query("matrix_unpivot", """SELECT l_returnflag AS cohort, l_suppkey::VARCHAR AS entity, 'm' || m AS sample, round(avg(l_quantity) FILTER (month(l_shipdate) = m), 6) AS value FROM lineitem, range(1, 13) r(m) GROUP BY ALL""")
def matrix_unpivot(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("m", F.month("l_shipdate"))
    wide = rows.groupBy("l_returnflag", F.col("l_suppkey").cast("string").alias("id")).pivot("m", list(range(1, 13))).agg(F.round(F.avg("l_quantity"), 6).cast("string"))
    wide = wide.withColumnsRenamed({str(i): f"m{i}" for i in range(1, 13)})
    tagged = wide.withColumn("id", F.concat("l_returnflag", F.lit("|"), "id")).drop("l_returnflag")
    long = ST.unpivot_matrix(tagged, "id", "x")
    part = lambda i: F.split_part("entity", F.lit("|"), F.lit(i))
    return long.select(part(1).alias("cohort"), part(2).alias("entity"), "sample", "value")


@query("nonzero_entities", """SELECT l_suppkey, l_partkey, l_tax FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem GROUP BY l_suppkey, l_partkey HAVING bool_and(l_tax = 0))""")
def nonzero_entities(t: Tables) -> DataFrame:
    return ST.drop_all_zero(t.lineitem.select("l_suppkey", "l_partkey", "l_tax"), ["l_suppkey", "l_partkey"], "l_tax")


@query("id_map", """SELECT DISTINCT c_name AS ACC_ID, 'G' || c_nationkey AS gene_id FROM customer WHERE c_mktsegment = 'BUILDING'""")
def id_map(t: Tables) -> DataFrame:
    rows = t.customer.select("c_name", "c_mktsegment", F.concat(F.lit("G"), "c_nationkey", F.lit(".12")).alias("v"))
    return ST.parse_id_map(rows, "c_name", "c_mktsegment", "v", "BUILDING")


@query("entity_ids", """SELECT p_partkey, 'G' || p_partkey AS gene, 'G' || p_partkey || '|S' || p_size AS site FROM part""")
def entity_ids(t: Tables) -> DataFrame:
    text = F.concat(F.lit("G"), "p_partkey", F.lit(".3|X|S"), "p_size", F.lit("|tail"))
    rows = t.part.select("p_partkey", text.alias("entity"))
    return rows.select("p_partkey", F.split_part(ST.gene_entity(), F.lit("|"), F.lit(1)).alias("gene"), ST.site_entity().alias("site"))


@query("annotated_genes", """SELECT s_suppkey, upper(s_name) AS name_key FROM supplier WHERE s_nationkey BETWEEN 1 AND 22""")
def annotated_genes(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", F.col("s_suppkey").alias("gene_id"), F.concat("s_name", F.lit(" ")).alias("gene_name"), F.col("s_nationkey").cast("string").alias("chrom"))
    return ST.parse_annotation(rows).select("s_suppkey", "name_key")


@query("evidence_scan", """SELECT p_brand AS regulator, l_partkey::VARCHAR AS target, 'SRX' || m AS experiment, max(l_quantity) FILTER (l_linenumber = m) AS score FROM lineitem JOIN part ON l_partkey = p_partkey, range(1, 8) r(m) GROUP BY ALL""")
def evidence_scan(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    wide = rows.groupBy("p_brand", F.col("l_partkey").cast("string").alias("target")).agg(
        F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("l_linenumber") == m, F.col("l_quantity"))).alias(f"SRX{m}") for m in range(1, 8)])
    return ST.parse_evidence(wide, F.col("p_brand"), "target")


@query("edge_scan", """SELECT l_suppkey::VARCHAR AS source, l_partkey::VARCHAR AS target, count(*) AS n, sum(sign((l_discount * 100)::INT - 5))::BIGINT AS signs FROM lineitem WHERE (l_discount * 100)::INT <> 5 AND l_tax <> 0.04 GROUP BY ALL""")
def edge_scan(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").cast("string").alias("source"), F.when(F.col("l_tax") == 0.04, " ").otherwise(F.col("l_partkey").cast("string")).alias("target"),
                             (F.round(F.col("l_discount") * 100).cast("int") - 5).cast("string").alias("weight"))
    return ST.parse_edges(rows).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("sign").alias("signs"))


@query("preamble_table", """SELECT p_name AS GENE, p_brand AS PROTEIN, p_size::VARCHAR AS SITE FROM part WHERE p_partkey > 10""")
def preamble_table(t: Tables) -> DataFrame:
    row = F.concat_ws("\t", F.concat(F.lit(" "), "p_name"), "p_brand", F.col("p_size").cast("string"))
    text = F.when(F.col("p_partkey") < 10, "some preamble").when(F.col("p_partkey") == 10, "GENE\tPROTEIN\tSITE").otherwise(row)
    return ST.parse_preamble_table(t.part.select("p_partkey", text.alias("line")), "p_partkey", "line")


@query("known_sites", """SELECT DISTINCT p_brand AS ACC_ID, 'S' AS RESIDUE, p_size::BIGINT AS POSITION, CASE WHEN p_type LIKE 'E%' THEN 'Import' WHEN p_type LIKE 'S%' THEN 'Export' END AS direction FROM part""")
def known_sites(t: Tables) -> DataFrame:
    label = F.when(F.startswith("p_type", F.lit("E")), "Nuclear Import").when(F.startswith("p_type", F.lit("S")), "promote_export").otherwise("none")
    rows = t.part.select(F.concat("p_brand", F.lit("_S"), "p_size").alias("INDEX"), label.alias("LABEL"))
    return ST.parse_known_sites(rows)


@query("fold_metrics", """SELECT 'a' AS run, 0 AS run_order, month(l_shipdate) AS fold, round(avg(l_tax), 6) AS metric FROM lineitem WHERE l_returnflag = 'A' GROUP BY 3 UNION ALL
SELECT 'r', 1, month(l_shipdate), round(avg(l_tax), 6) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 3""")
def fold_metrics(t: Tables) -> DataFrame:
    one = lambda f: t.lineitem.where(F.col("l_returnflag") == f).groupBy(F.month("l_shipdate").alias("fold")).agg(F.avg("l_tax").alias("metric"))
    return rounded(ST.load_fold_metrics({"a": one("A"), "r": one("R")}, "fold", 12).withColumn("fold", F.col("fold").cast("bigint")))


ATOMS = """atoms AS (SELECT DISTINCT l_suppkey AS site, l_partkey AS resseq, l_quantity AS x, round(l_discount * 100, 6) AS y, round(l_tax * 100, 6) AS z FROM lineitem WHERE l_returnflag = 'R'),
near AS (SELECT site, resseq, x, y, z, sqrt((x - 25) * (x - 25) + (y - 5) * (y - 5) + (z - 4) * (z - 4)) AS distance FROM atoms),
nodes AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(distance, 9), resseq, x, y, z) AS node_rank FROM near WHERE round(distance, 9) <= 6 QUALIFY node_rank <= 12)"""


def nodes(t: Tables) -> DataFrame:
    atoms = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("resseq"), F.col("l_quantity").alias("x"),
                                                          F.round(F.col("l_discount") * 100, 6).alias("y"), F.round(F.col("l_tax") * 100, 6).alias("z")).distinct()
    sites = t.supplier.select(F.col("s_suppkey").alias("site"), F.lit(25.0).alias("x"), F.lit(5.0).alias("y"), F.lit(4.0).alias("z"))
    return G.radius_nodes(sites, atoms, ["site"], ["site"], 6.0, 12)


@query("radius_nodes", f"WITH {ATOMS} SELECT site, count(*) AS n, round(sum(distance), 6) AS total FROM nodes GROUP BY 1")
def radius_nodes(t: Tables) -> DataFrame:
    return rounded(nodes(t).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("total")))


@query("node_attributes", f"""WITH {ATOMS} SELECT site, round(sum((x + 40) / 100), 6) AS confidence, round(sum((resseq - 100) / 50), 6) AS offset, 21 AS width FROM nodes GROUP BY 1""")
def node_attributes(t: Tables) -> DataFrame:
    rows = nodes(t).withColumn("aa", F.lit("S")).withColumn("plddt", F.col("x") + 40).withColumn("centre", F.lit(100))
    out = G.node_attributes(rows, "centre")
    return out.groupBy("site").agg(F.round(F.sum("confidence"), 6).alias("confidence"), F.round(F.sum("offset"), 6).alias("offset"), F.max(F.size("one_hot")).alias("width"))


@query("node_edges", f"""WITH {ATOMS}, own AS (SELECT site, resseq, x, y, z, row_number() OVER (PARTITION BY site ORDER BY resseq, x, y, z) AS node FROM nodes),
e AS (SELECT a.site, abs(a.resseq - b.resseq) = 1 AS adj FROM own a JOIN own b ON a.site = b.site AND a.node <> b.node
  AND (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 4 OR abs(a.resseq - b.resseq) = 1)),
c AS (SELECT site, count(*) AS n_edges, count(*) FILTER (adj) AS n_adjacent FROM e GROUP BY 1)
SELECT site, coalesce(n_edges, 1) AS n_edges, coalesce(n_adjacent, 0) AS n_adjacent FROM (SELECT DISTINCT site FROM own) LEFT JOIN c USING (site)""")
def node_edges(t: Tables) -> DataFrame:
    out = G.node_edges(nodes(t), ["site"], 4.0)
    return out.groupBy("site").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("adjacent").cast("bigint").alias("n_adjacent"))
