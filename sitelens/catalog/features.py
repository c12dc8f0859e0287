"""Feature families on line items with gaps; windows on documents; vectors on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.catalog.joining import ARMS, arms
from sitelens.catalog.registry import Tables, query, rounded
from sitelens.catalog.scoring import auroc_sql
from sitelens.catalog.statistics import HYPER, U_P, rank_sum_sql
from sitelens.functions import scalars as S
from sitelens.operators import features as X
from sitelens.operators import rank_tests as Q
from sitelens.operators import vectors as V
from sitelens.operators.aggregates import arm_statistics

KEY = ["l_orderkey", "l_linenumber"]


def segments(t: Tables, prefix: str, has: str = "HasSegment_Flag") -> DataFrame:
    """Line items as a segment family: has by return flag, inside by line status, distances by quantity."""
    flag = F.col("l_returnflag")
    columns = {
        has: F.when(flag == "R", "True").when(flag == "A", "1").otherwise(" false "),
        "Inside_Flag": (F.col("l_linestatus") == "F").cast("string"),
        "Nearest_Distance": F.nullif("l_quantity", F.lit(7.0)),
        "Nearest_CenterSignedDistance": F.nullif("l_quantity", F.lit(11.0)) - 25,
        "Inside_RelativePosition": F.nullif(F.col("l_discount"), F.lit(0.03)) * 20 - 0.5,
        "Inside_SegmentLength": F.nullif("l_quantity", F.lit(9.0)),
        "Protein_CoverageFraction": F.nullif("l_tax", F.lit(0.01)) * 20,
        "Nearest_Score": F.nullif("l_tax", F.lit(0.03)) * 20,
    }
    if prefix == "MOTIF_Domain_DBD_":
        columns["Nearest_Start"] = F.nullif("l_quantity", F.lit(13.0))
    if prefix == "MOTIF_IDR_":
        columns["Site_DisorderScore"] = F.nullif("l_tax", F.lit(0.02)) * 10
        columns["NearestRegion_DisorderMean"] = F.nullif("l_tax", F.lit(0.04)) * 10
    return t.lineitem.select(*KEY, *[c.alias(prefix + n) for n, c in columns.items()])


SEG = """seg AS (SELECT l_orderkey, l_linenumber, (l_returnflag <> 'N')::INT AS has, (l_linestatus = 'F')::INT AS inside, nullif(l_quantity, 7) AS dist,
  nullif(l_quantity, 11) - 25 AS center, nullif(l_discount, 0.03) * 20 - 0.5 AS rel, nullif(l_quantity, 9) AS len, nullif(l_tax, 0.01) * 20 AS cov,
  nullif(l_tax, 0.03) * 20 AS score, nullif(l_quantity, 13) AS start, nullif(l_tax, 0.02) * 10 AS site, nullif(l_tax, 0.04) * 10 AS region FROM lineitem),
fit AS (SELECT quantile_cont(dist, 0.99) FILTER (has = 1) + 1 AS fd, quantile_cont(center, 0.99) FILTER (has = 1) + 1 AS fc, median(center) FILTER (has = 1) AS mc,
  median(score) FILTER (has = 1) AS ms, median(start) FILTER (has = 1) AS mb, median(start) AS ma, quantile_cont(start, 0.99) FILTER (has = 1) + 1 AS fb,
  median(site) AS mt, median(region) FILTER (has = 1) AS mr, median(region) AS mr_all, median(score) AS ms_all FROM seg)"""

# The twins state each column's expression; "segment" below means a row with the family's flag.
LARGE_CENTER = "CASE WHEN has = 1 THEN coalesce(center, fc) ELSE fc END"
CUT_CENTER = f"ln(1 + greatest({LARGE_CENTER}, 0))"
MEDIAN_CENTER = "CASE WHEN has = 1 THEN coalesce(center, mc) ELSE 0 END"
ZERO_CENTER = "CASE WHEN has = 1 THEN coalesce(center, 0) ELSE 0 END"
OUTSIDE = "CASE WHEN inside = 1 THEN coalesce(rel, -1) ELSE -1 END"
BOUNDED_POSITION = "CASE WHEN inside = 1 AND rel >= 0 THEN least(rel, 1) ELSE -1 END"
SEGMENT_FRACTION = "CASE WHEN has = 1 THEN least(coalesce(cov, 0), 1) ELSE 0 END"


def signed(value: str) -> str:
    return f"sign({value}) * ln(1 + abs({value}))"


def seg_sql(p: str, center: str, rel: str, cov: str, has: str = "HasSegment_Flag", **more: str) -> str:
    rest = ", ".join(f'round({e}, 6) AS "{p}{n}"' for n, e in more.items())
    return f"""WITH {SEG} SELECT l_orderkey, l_linenumber, has::DOUBLE AS "{p}{has}", inside::DOUBLE AS "{p}Inside_Flag",
  round(ln(1 + CASE WHEN has = 1 THEN coalesce(dist, fd) ELSE fd END), 6) AS "{p}Nearest_Distance", round({center}, 6) AS "{p}Nearest_CenterSignedDistance",
  round({rel}, 6) AS "{p}Inside_RelativePosition", CASE WHEN inside = 1 THEN coalesce(len, 0) ELSE 0 END::DOUBLE AS "{p}Inside_SegmentLength",
  round({cov}, 6) AS "{p}Protein_CoverageFraction", {rest} FROM seg, fit"""


def family_query(family: str, variant: str, prefix: str, has: str = "HasSegment_Flag"):
    def run(t: Tables) -> DataFrame:
        rows = segments(t, prefix, has)
        rules = X.family_rules(family, [c for c in rows.columns if c not in KEY], variant)
        return rounded(X.transform(rows, rules, X.fit_fills(rows, rules), KEY))

    return run


FILLED = "coalesce(cov, 0)"
ZERO_SCORE = "CASE WHEN has = 1 THEN coalesce(score, 0) ELSE 0 END"
MEDIAN_SCORE = "CASE WHEN has = 1 THEN coalesce(score, ms) ELSE 0 END"
query("domain_family", seg_sql("MOTIF_Domain_DBD_", CUT_CENTER, OUTSIDE, FILLED, Nearest_Score=ZERO_SCORE, Nearest_Start="ln(1 + CASE WHEN has = 1 THEN coalesce(start, fb) ELSE fb END)"))(
    family_query("domain", "candidate", "MOTIF_Domain_DBD_"))
query("domain_family_signed", seg_sql("MOTIF_Domain_DBD_", signed(MEDIAN_CENTER), BOUNDED_POSITION, SEGMENT_FRACTION, Nearest_Score=ZERO_SCORE,
      Nearest_Start="CASE WHEN has = 1 THEN greatest(coalesce(start, mb), 0) ELSE 0 END"))(family_query("domain", "direction", "MOTIF_Domain_DBD_"))
query("nls_family", seg_sql("MOTIF_NLS_", CUT_CENTER, "CASE WHEN inside = 1 THEN coalesce(rel, 0) ELSE -1 END", "CASE WHEN inside = 1 THEN coalesce(cov, 0) ELSE 0 END",
      Nearest_Score="CASE WHEN inside = 1 THEN coalesce(score, 0) ELSE 0 END"))(family_query("nls", "candidate", "MOTIF_NLS_"))
query("nls_family_signed", seg_sql("MOTIF_NLS_", signed(LARGE_CENTER), BOUNDED_POSITION, SEGMENT_FRACTION, Nearest_Score=MEDIAN_SCORE))(family_query("nls", "direction", "MOTIF_NLS_"))
query("nes_family", seg_sql("MOTIF_NES_", CUT_CENTER, OUTSIDE, FILLED, Nearest_Score=ZERO_SCORE))(family_query("nes", "candidate", "MOTIF_NES_"))
query("nes_family_signed", seg_sql("MOTIF_NES_", signed(MEDIAN_CENTER), BOUNDED_POSITION, f"least({FILLED}, 1)", Nearest_Score=MEDIAN_SCORE))(family_query("nes", "direction", "MOTIF_NES_"))
query("motif1433_family", seg_sql("MOTIF_1433_", CUT_CENTER, OUTSIDE, "CASE WHEN has = 1 THEN coalesce(cov, 0) ELSE 0 END", "HasMotif_Flag", Nearest_Score=MEDIAN_SCORE))(
    family_query("motif1433", "candidate", "MOTIF_1433_", "HasMotif_Flag"))
query("motif1433_family_signed", seg_sql("MOTIF_1433_", signed(MEDIAN_CENTER), BOUNDED_POSITION, SEGMENT_FRACTION, "HasMotif_Flag", Nearest_Score=f"least({MEDIAN_SCORE}, 1)"))(
    family_query("motif1433", "direction", "MOTIF_1433_", "HasMotif_Flag"))
query("idr_family", seg_sql("MOTIF_IDR_", CUT_CENTER, OUTSIDE, FILLED, "HasRegion_Flag", Nearest_Score="coalesce(score, ms_all)", Site_DisorderScore="coalesce(site, mt)",
      NearestRegion_DisorderMean="coalesce(region, mr_all)"))(family_query("idr", "candidate", "MOTIF_IDR_", "HasRegion_Flag"))
query("idr_family_signed", seg_sql("MOTIF_IDR_", signed(ZERO_CENTER), BOUNDED_POSITION, SEGMENT_FRACTION, "HasRegion_Flag", Nearest_Score=MEDIAN_SCORE, Site_DisorderScore="coalesce(site, mt)",
      NearestRegion_DisorderMean="CASE WHEN has = 1 THEN coalesce(region, mr) ELSE 0 END"))(family_query("idr", "direction", "MOTIF_IDR_", "HasRegion_Flag"))


def plain_family(family: str, variant: str, columns: dict, **options):
    """Family query over columns given as expressions on line items."""
    def run(t: Tables) -> DataFrame:
        rows = t.lineitem.select(*KEY, *[F.expr(e).alias(c) for c, e in columns.items()])
        rules = X.family_rules(family, list(columns), variant, **options)
        return rounded(X.transform(rows, rules, X.fit_fills(rows, rules), KEY))

    return run


def plain_sql(columns: dict, outputs: dict, fits: dict) -> str:
    """SQL twin: raw columns, one-row fits, output expressions."""
    raw = ", ".join(f'{e} AS {c}' for c, e in columns.items())
    fit = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in fits.items()) + " FROM raw" if fits else "SELECT 0 AS nothing"
    out = ", ".join(f'round({e}, 6) AS "{n}"' for n, e in outputs.items())
    return f"WITH raw AS (SELECT l_orderkey, l_linenumber, {raw} FROM lineitem), fit AS ({fit}) SELECT l_orderkey, l_linenumber, {out} FROM raw, fit"


Q7, D3, TX = "nullif(l_quantity, 7.0)", "nullif(l_discount, 0.03)", "nullif(l_tax, 0.02)"

query("charge_family", plain_sql({"a": Q7, "b": D3 + " * 12"},
      {"SEQ_Charge_Net": "coalesce(a, ma)", "SEQ_Charge_PosFraction": "least(greatest(coalesce(b, mb), 0), 1)"}, {"ma": "median(a)", "mb": "median(b)"}))(
    plain_family("charge", "candidate", {"SEQ_Charge_Net": Q7, "SEQ_Charge_PosFraction": D3 + " * 12"}))
query("charge_family_bounded", plain_sql({"a": Q7, "b": D3 + " * 12"},
      {"SEQ_Charge_Net": "coalesce(a, ma)", "SEQ_Charge_Net__missing": "(a IS NULL)::INT::DOUBLE",
       "SEQ_Charge_PosFraction": "coalesce(CASE WHEN b IS NOT NULL THEN least(greatest(b, 0), 1) END, mb)", "SEQ_Charge_PosFraction__missing": "(b IS NULL)::INT::DOUBLE"},
      {"ma": "avg(a)", "mb": "avg(CASE WHEN b IS NOT NULL THEN least(greatest(b, 0), 1) END)"}))(
    plain_family("charge", "direction", {"SEQ_Charge_Net": Q7, "SEQ_Charge_PosFraction": D3 + " * 12"}, fill="mean", missing=True))
query("sequence_family", plain_sql({"a": D3, "b": Q7, "c": TX},
      {"SEQ_Physicochem_ratio_E_over_D": "coalesce(a, 0)", "SEQ_Physicochem_mean_hydropathy_kd": "coalesce(b, mb)", "SEQ_Physicochem_other": "coalesce(c, mc)"}, {"mb": "median(b)", "mc": "median(c)"}))(
    plain_family("sequence", "candidate", {"SEQ_Physicochem_ratio_E_over_D": D3, "SEQ_Physicochem_mean_hydropathy_kd": Q7, "SEQ_Physicochem_other": TX}))
HYD = "(nullif(l_quantity, 7.0) - 25) / 3"
query("sequence_family_bounded", plain_sql({"a": D3 + " * 300 - 2", "b": HYD, "c": TX + " * 20"},
      {"SEQ_X_ratio_E_over_D": "least(greatest(coalesce(a, 0), 0), 20)", "SEQ_X_hydropathy": "coalesce(CASE WHEN b IS NOT NULL THEN least(greatest(b, -4.5), 4.5) END, mb)", "SEQ_X_fraction_S": "coalesce(CASE WHEN c IS NOT NULL THEN least(greatest(c, 0), 1) END, mc)"},
      {"mb": "median(CASE WHEN b IS NOT NULL THEN least(greatest(b, -4.5), 4.5) END)", "mc": "median(CASE WHEN c IS NOT NULL THEN least(greatest(c, 0), 1) END)"}))(
    plain_family("sequence", "direction", {"SEQ_X_ratio_E_over_D": D3 + " * 300 - 2", "SEQ_X_hydropathy": HYD, "SEQ_X_fraction_S": TX + " * 20"}))
query("zscale_family", plain_sql({"a": HYD}, {"SEQ_ZScale_Z1_mean": "coalesce(a, 0)"}, {}))(plain_family("zscale", "candidate", {"SEQ_ZScale_Z1_mean": HYD}))
query("zscale_family_fitted", plain_sql({"a": HYD, "b": HYD}, {"SEQ_ZScale_Z1_mean": "coalesce(a, ma)", "SEQ_ZScale_Z1_std": "coalesce(CASE WHEN b IS NOT NULL THEN greatest(b, 0) END, mb)"},
      {"ma": "median(a)", "mb": "median(CASE WHEN b IS NOT NULL THEN greatest(b, 0) END)"}))(
    plain_family("zscale", "direction", {"SEQ_ZScale_Z1_mean": HYD, "SEQ_ZScale_Z1_std": HYD}))
query("hotspot_family", plain_sql({"a": Q7, "b": D3}, {"SEQ_Hotspot_Nearest_Distance": "coalesce(ln(1 + a), ma)", "SEQ_Hotspot_Density": "coalesce(b, mb)"}, {"ma": "median(ln(1 + a))", "mb": "median(b)"}))(
    plain_family("hotspot", "candidate", {"SEQ_Hotspot_Nearest_Distance": Q7, "SEQ_Hotspot_Density": D3}))
query("hotspot_family_signed", plain_sql({"a": HYD, "b": TX + " * 20"}, {"SEQ_Hotspot_Signed_Distance": "coalesce(sign(a) * ln(1 + abs(a)), ma)", "SEQ_Hotspot_fraction": "coalesce(CASE WHEN b IS NOT NULL THEN least(b, 1) END, mb)"},
      {"ma": "median(sign(a) * ln(1 + abs(a)))", "mb": "median(CASE WHEN b IS NOT NULL THEN least(b, 1) END)"}))(
    plain_family("hotspot", "direction", {"SEQ_Hotspot_Signed_Distance": HYD, "SEQ_Hotspot_fraction": TX + " * 20"}))
query("kinase_family_bounded", plain_sql({"a": TX + " * 20"}, {"FUNC_Kinase_prob__has": "(a IS NOT NULL)::INT::DOUBLE", "FUNC_Kinase_prob": "least(coalesce(a, ma), 1)"}, {"ma": "median(a)"}))(
    plain_family("kinase", "direction", {"FUNC_Kinase_prob": TX + " * 20"}))
query("evolution_family", plain_sql({"a": D3, "b": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"}, {"FUNC_Evolution_Entropy": "coalesce(a, ma)", "FUNC_Evolution_IsAvailable": "b::DOUBLE"}, {"ma": "median(a)"}))(
    plain_family("evolution", "candidate", {"FUNC_Evolution_Entropy": D3, "FUNC_Evolution_IsAvailable": "if(l_returnflag = 'R', 'true', 'false')"}))
query("evolution_family_bounded", plain_sql({"a": TX + " * 20"}, {"FUNC_Evolution_proportion__has": "(a IS NOT NULL)::INT::DOUBLE", "FUNC_Evolution_proportion": "coalesce(CASE WHEN a IS NOT NULL THEN least(a, 1) END, ma)"},
      {"ma": "median(CASE WHEN a IS NOT NULL THEN least(a, 1) END)"}))(
    plain_family("evolution", "direction", {"FUNC_Evolution_proportion": TX + " * 20"}))
query("alphamissense_family", plain_sql({"a": D3, "b": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"}, {"FUNC_AlphaMissense_Score": "coalesce(a, ma)", "FUNC_AlphaMissense_HasScore_Flag": "b::DOUBLE"}, {"ma": "avg(a)"}))(
    plain_family("alphamissense", "candidate", {"FUNC_AlphaMissense_Score": D3, "FUNC_AlphaMissense_HasScore_Flag": "if(l_returnflag = 'R', 'TRUE', 'x')"}, fill="mean"))
query("alphamissense_family_bounded", plain_sql({"a": TX + " * 20", "b": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"},
      {"FUNC_AlphaMissense_Score__has": "(a IS NOT NULL)::INT::DOUBLE", "FUNC_AlphaMissense_Score": "coalesce(CASE WHEN a IS NOT NULL THEN least(a, 1) END, ma)", "FUNC_AlphaMissense_HasScore_Flag": "b::DOUBLE"},
      {"ma": "median(CASE WHEN a IS NOT NULL THEN least(a, 1) END)"}))(
    plain_family("alphamissense", "direction", {"FUNC_AlphaMissense_Score": TX + " * 20", "FUNC_AlphaMissense_HasScore_Flag": "if(l_returnflag = 'R', 'yes', 'n')"}))
STRUCT = {"STRUCT_Site_RSA": D3 + " * 12", "STRUCT_Site_pLDDT": Q7 + " * 3", "STRUCT_Site_ContactCount": HYD}
query("structure_family", plain_sql({"a": D3 + " * 12", "b": Q7 + " * 3", "c": HYD},
      {"STRUCT_Site_RSA": "coalesce(CASE WHEN a IS NOT NULL THEN least(a, 1) END, ma)", "STRUCT_Site_pLDDT": "coalesce(CASE WHEN b IS NOT NULL THEN least(b, 100) END, mb)", "STRUCT_Site_ContactCount": "coalesce(CASE WHEN c IS NOT NULL THEN greatest(c, 0) END, mc)"},
      {"ma": "median(CASE WHEN a IS NOT NULL THEN least(a, 1) END)", "mb": "avg(CASE WHEN b IS NOT NULL THEN least(b, 100) END)", "mc": "median(CASE WHEN c IS NOT NULL THEN greatest(c, 0) END)"}))(
    plain_family("structure", "direction", STRUCT))


@query("kinase_family", """SELECT l_orderkey, l_linenumber, (l_tax <> 0.02)::INT::DOUBLE AS "FUNC_Kinase_PWM_MaxMSS__has", coalesce(nullif(l_tax, 0.02), 0) AS "FUNC_Kinase_PWM_MaxMSS" FROM lineitem""")
def kinase_family(t: Tables) -> DataFrame:
    rows = t.lineitem.select(*KEY, F.expr(TX).alias("KINASE_pwm_max"))
    rules = X.with_aliases(X.family_rules("kinase", ["FUNC_Kinase_PWM_MaxMSS"]), {"FUNC_Kinase_PWM_MaxMSS": ["KINASE_pwm_max"]})
    return X.transform(rows, rules, X.fit_fills(rows, rules), KEY)


@query("large_fill_modes", """SELECT round(max(l_quantity) + 1, 6) AS fill__a, round(quantile_cont(l_extendedprice, 0.95) * 2, 4) AS fill__b, round(quantile_cont(l_extendedprice, 0.99) + 1, 4) AS fill__c FROM lineitem""")
def large_fill_modes(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_extendedprice").alias("c"))
    rules = [X.Rule("a", fill="large", large="max_plus_1"), X.Rule("b", fill="large", large="p95_times_2"), X.Rule("c", fill="large")]
    return rounded(X.fit_fills(rows, rules), digits=4)


@query("class_one_hot", """WITH c AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_type ELSE 'OTHER' END AS v FROM part), l AS (SELECT v FROM c WHERE v <> 'OTHER' GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 3)
SELECT p_partkey, sum((level = lv)::INT)::BIGINT AS n_on, max(CASE WHEN level = 'OTHER' THEN 1 ELSE 0 END) AS is_other FROM (SELECT p_partkey, CASE WHEN v IN (SELECT v FROM l) THEN v ELSE 'OTHER' END AS level FROM c), (SELECT v AS lv FROM l UNION ALL SELECT 'OTHER') GROUP BY 1""")
def class_one_hot(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_type", (F.col("p_size") > 10).cast("string").alias("gate"))
    levels = X.class_levels(rows, "p_type", "gate", 3)
    wide = X.one_hot_class(rows, "p_type", levels, "class_", "gate")
    names = [c for c in wide.columns if c.startswith("class_")]
    total = sum((F.col(c).cast("bigint") for c in names[1:]), F.col(names[0]).cast("bigint"))
    return wide.select("p_partkey", total.alias("n_on"), F.col("class_OTHER").alias("is_other"))


@query("ratio_and_flag_groups", """WITH r AS (SELECT l_orderkey, l_linenumber, least(l_discount * 12, 1) AS h, least(l_tax * 12, 1) AS s, l_quantity / 50 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(h / (h + s + c), 6) AS h, round(s / (h + s + c), 6) AS s, round(c / (h + s + c), 6) AS c,
  CASE WHEN h + s + c > 1 THEN (h >= s AND h >= c)::INT::DOUBLE ELSE round(h, 6) END AS fh, CASE WHEN h + s + c > 1 THEN (s > h AND s >= c)::INT::DOUBLE ELSE round(s, 6) END AS fs,
  CASE WHEN h + s + c > 1 THEN (c > h AND c > s)::INT::DOUBLE ELSE round(c, 6) END AS fc FROM r""")
def ratio_and_flag_groups(t: Tables) -> DataFrame:
    h, s, c = F.col("l_discount") * 12, F.col("l_tax") * 12, F.col("l_quantity") / 50
    rows = t.lineitem.select(*KEY, h.alias("h"), s.alias("s"), c.alias("c"), h.alias("fh"), s.alias("fs"), c.alias("fc"))
    return rounded(X.resolve_flags(X.normalize_ratios(rows, ["h", "s", "c"]), ["fh", "fs", "fc"]))


@query("missing_summary", f"""SELECT l_orderkey, l_linenumber, round((({Q7} IS NULL)::INT + ({D3} IS NULL)::INT + ({TX} IS NULL)::INT) / 3, 6) AS missing_fraction,
  (NOT ({Q7} IS NULL AND {D3} IS NULL AND {TX} IS NULL))::INT::DOUBLE AS has_any_observed FROM lineitem""")
def missing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.select(*KEY, F.expr(Q7).alias("a"), F.expr(D3).alias("b"), F.expr(TX).alias("c"))
    return rounded(X.missing_summary(rows, ["a", "b", "c"]).select(*KEY, "missing_fraction", "has_any_observed"))


@query("standardized", """SELECT l_orderkey, l_linenumber, round((l_quantity - m1) / s1, 6) AS q, round((l_tax - m2) / s2, 6) AS x FROM lineitem,
  (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2 FROM lineitem)""")
def standardized(t: Tables) -> DataFrame:
    rows = t.lineitem.select(*KEY, F.col("l_quantity").alias("q"), F.col("l_tax").alias("x"))
    return rounded(X.standardize(rows, ["q", "x"], X.fit_scaling(rows, ["q", "x"])))


def family_table(t: Tables) -> DataFrame:
    """One table with columns of several families and a split by line status."""
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("INDEX"), "l_linestatus",
        F.expr(Q7).alias("SEQ_Charge_Net"), F.expr(TX).alias("FUNC_Kinase_PWM"), F.expr(D3).alias("FUNC_Evolution_Entropy"),
        F.when(F.col("l_discount") > 0.09, F.col("l_tax")).alias("SEQ_ZScale_sparse"),
    )


@query("assembled_families", """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS INDEX, l_linestatus, nullif(l_quantity, 7) AS a, nullif(l_tax, 0.02) AS k, nullif(l_discount, 0.03) AS e FROM lineitem),
f AS (SELECT median(a) AS ma, median(e) AS me FROM b WHERE l_linestatus = 'F')
SELECT INDEX, round(coalesce(a, ma), 6) AS "SEQ_Charge_Net", (k IS NOT NULL)::INT::DOUBLE AS "FUNC_Kinase_PWM__has", coalesce(k, 0) AS "FUNC_Kinase_PWM", round(coalesce(e, me), 6) AS "FUNC_Evolution_Entropy" FROM b, f WHERE l_linestatus = 'O'""")
def assembled_families(t: Tables) -> DataFrame:
    rows = family_table(t)
    _, test, _ = X.assemble(rows.where("l_linestatus = 'F'").drop("l_linestatus"), rows.where("l_linestatus = 'O'").drop("l_linestatus", "SEQ_ZScale_sparse"), "INDEX", max_missing=0.5)
    return rounded(test)


LONG = """long AS (UNPIVOT (SELECT (l_returnflag = 'R')::INT AS label, l_quantity AS q, l_discount AS d, l_tax AS x, l_extendedprice AS p FROM lineitem) ON q, d, x, p INTO NAME feature VALUE value)"""


def labelled(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_quantity").alias("q"),
                             F.col("l_discount").alias("d"), F.col("l_tax").alias("x"), F.col("l_extendedprice").alias("p"))


@query("top_features_by_auroc", f"""WITH {LONG}, a AS (SELECT * FROM {auroc_sql('long', 'value', 'label', 'feature')})
SELECT feature, round(greatest(auroc, 1 - auroc), 6) AS strength, row_number() OVER (ORDER BY round(greatest(auroc, 1 - auroc), 12) DESC, feature) AS rank FROM a QUALIFY rank <= 3""")
def top_features_by_auroc(t: Tables) -> DataFrame:
    out = X.top_features_by_auroc(labelled(t), "label", ["q", "d", "x", "p"], 3)
    return rounded(out.withColumn("rank", F.col("rank").cast("bigint")))


@query("features_by_rank_test", f"""WITH {LONG}, l2 AS (SELECT feature, label::VARCHAR AS label, value FROM long), us AS {rank_sum_sql('l2', 'feature', 'label', 'value', '1', '0')}, {U_P}
SELECT feature, u, round(least(1, 2 * least(above, below)), 6) AS p_value FROM ps WHERE least(1, 2 * least(above, below)) < 0.6""")
def features_by_rank_test(t: Tables) -> DataFrame:
    return rounded(X.features_by_rank_test(labelled(t), "label", ["q", "d", "x", "p"], below=0.6))


@query("panel_choice", f"""WITH {ARMS}, kinds AS (SELECT feature, bool_and(value IN (0, 1)) AS is_binary FROM long GROUP BY 1),
s AS (SELECT feature, arm, CASE WHEN bool_and(is_binary) THEN avg((value = 1)::INT) ELSE median(value) END AS stat FROM long JOIN kinds USING (feature) GROUP BY feature, arm),
w AS (SELECT feature, max(stat) FILTER (arm = 'known') AS k, max(stat) FILTER (arm = 'new') AS n, max(stat) FILTER (arm = 'background') AS b FROM s GROUP BY 1),
us AS {rank_sum_sql('long', 'feature', 'arm', 'value', 'known', 'background')}, {U_P},
cells AS (SELECT feature, count(*) FILTER (value = 1 AND arm = 'known') AS a, count(*) FILTER (value = 1 AND arm <> 'known') AS b, count(*) FILTER (value <> 1 AND arm = 'known') AS c,
  count(*) FILTER (value <> 1 AND arm <> 'known') AS d FROM long JOIN kinds USING (feature) WHERE is_binary AND arm IN ('known', 'background') GROUP BY 1),
h AS (SELECT cells.*, k, exp({HYPER}) AS p FROM cells, LATERAL (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k)),
fisher AS (SELECT h.feature, least(1, sum(p) FILTER (p <= o.p_own * 1.0000001)) AS p_exact FROM h JOIN (SELECT feature, p AS p_own FROM h WHERE k = a) o USING (feature) GROUP BY 1),
j AS (SELECT feature, is_binary, CASE WHEN is_binary THEN p_exact ELSE least(1, 2 * least(above, below)) END AS p, sign(k - b) * sign(n - b) > 0 AND abs(k - n) < least(abs(k - b), abs(n - b)) AS is_close
  FROM w JOIN kinds USING (feature) LEFT JOIN ps USING (feature) LEFT JOIN fisher USING (feature))
SELECT feature, is_binary, round(p, 6) AS p_value, is_close, p < 0.05 AND is_close AS selected,
  nullif(concat_ws(';', CASE WHEN NOT p < 0.05 THEN 'known_functional_vs_neg_not_significant' END, CASE WHEN NOT is_close THEN 'known_new_not_close' END), '') AS skip_reason FROM j""")
def panel_choice(t: Tables) -> DataFrame:
    long = arms(t)
    tests = Q.rank_sum_test(long, ["feature"], "arm", "value", "known", "background")
    ones = long.where(F.col("arm").isin("known", "background"))
    exact = Q.fisher_test(Q.two_by_two(ones, ["feature"], F.col("value") == 1, F.col("arm") == "known"))
    stats = arm_statistics(long, "feature", "arm", "value", ["known", "new", "background"])
    return rounded(X.panel_choice(tests, exact, stats).select("feature", "is_binary", "p_value", "is_close", "selected", "skip_reason"))


@query("feature_records", f"""WITH {ARMS}, kinds AS (SELECT feature, bool_and(value IN (0, 1)) AS is_binary FROM long GROUP BY 1),
pr AS (SELECT feature, value, 'known_vs_background' AS pair, CASE arm WHEN 'known' THEN 'a' ELSE 'b' END AS side FROM long WHERE arm IN ('known', 'background')
  UNION ALL SELECT feature, value, 'new_vs_background', CASE arm WHEN 'new' THEN 'a' ELSE 'b' END FROM long WHERE arm IN ('new', 'background')
  UNION ALL SELECT feature, value, 'known_vs_new', CASE arm WHEN 'known' THEN 'a' ELSE 'b' END FROM long WHERE arm IN ('known', 'new')),
fp AS (SELECT feature || '|' || pair AS fp, feature, pair, side, value FROM pr),
us AS {rank_sum_sql('fp', 'fp', 'side', 'value', 'a', 'b')}, {U_P},
cells AS (SELECT fp, any_value(feature) AS feature, any_value(pair) AS pair, count(*) FILTER (value = 1 AND side = 'a') AS a, count(*) FILTER (value = 1 AND side <> 'a') AS b, count(*) FILTER (value <> 1 AND side = 'a') AS c,
  count(*) FILTER (value <> 1 AND side <> 'a') AS d FROM fp GROUP BY 1),
h AS (SELECT cells.*, k, exp({HYPER}) AS p FROM cells JOIN kinds USING (feature), LATERAL (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k) WHERE is_binary),
fisher AS (SELECT h.fp, least(1, sum(p) FILTER (p <= o.p_own * 1.0000001)) AS p_exact FROM h JOIN (SELECT fp, p AS p_own FROM h WHERE k = a) o USING (fp) GROUP BY 1),
j AS (SELECT feature, is_binary, pair, CASE WHEN is_binary THEN p_exact ELSE least(1, 2 * least(above, below)) END AS p FROM cells JOIN kinds USING (feature) LEFT JOIN ps USING (fp) LEFT JOIN fisher USING (fp))
SELECT feature, is_binary, round(max(p) FILTER (pair = 'known_vs_background'), 6) AS known_vs_background_p, round(max(p) FILTER (pair = 'new_vs_background'), 6) AS new_vs_background_p, round(max(p) FILTER (pair = 'known_vs_new'), 6) AS known_vs_new_p FROM j GROUP BY ALL""")
def feature_records(t: Tables) -> DataFrame:
    pairs = {"known_vs_background": ("known", "background"), "new_vs_background": ("new", "background"), "known_vs_new": ("known", "new")}
    return rounded(X.feature_records(arms(t), "feature", "arm", "value", pairs))


# ------------------------------------------------------------------- windows


@query("text_windows", """WITH s AS (SELECT doc_id, text, (doc_id * 7) % 400 + 1 AS pos FROM documents)
SELECT doc_id, repeat('X', greatest(0, 11 - pos)::INT) || substr(text, greatest(pos - 10, 1), 21 - greatest(0, 11 - pos)) ||
  repeat('X', (21 - greatest(0, 11 - pos) - length(substr(text, greatest(pos - 10, 1), 21 - greatest(0, 11 - pos))))::INT) AS win FROM s""")
def text_windows(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", ((F.col("doc_id") * 7) % 400 + 1).alias("pos"))
    return rows.select("doc_id", V.text_window("text", "pos", 21).alias("win"))


WINDOW = """repeat('X', greatest(0, 11 - pos)::INT) || substr(text, greatest(pos - 10, 1), 21 - greatest(0, 11 - pos)) ||
  repeat('X', (21 - greatest(0, 11 - pos) - length(substr(text, greatest(pos - 10, 1), 21 - greatest(0, 11 - pos))))::INT)"""


@query("one_hot_windows", f"""WITH s AS (SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text, (doc_id * 7) % 400 + 1 AS pos FROM documents), w AS (SELECT doc_id, {WINDOW} AS w FROM s),
c AS (SELECT doc_id, w, unnest(range(1, length(w) + 1)) AS i FROM w)
SELECT doc_id, count(*) AS n_letters, count(*) FILTER (position(substr(w, i, 1) IN 'ACDEFGHIKLMNPQRSTVWY') = 0) AS n_unknown, count(*) FILTER (substr(w, i, 1) = 'S') AS n_s FROM c GROUP BY 1""")
def one_hot_windows(t: Tables) -> DataFrame:
    """21 tokens round the document's position, as in ``text_windows``, of the text, a-z as capitals."""
    rows = t.documents.select("doc_id", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("text"), ((F.col("doc_id") * 7) % 400 + 1).alias("pos"))
    hot = rows.select("doc_id", V.one_hot_window(V.text_window("text", "pos", 21)).alias("h")).where(F.size("h") > 0)
    count = lambda i: F.size(F.filter("h", lambda v: v[i] == 1)).cast("bigint")
    at = V.AMINO_ACIDS.index
    return hot.select("doc_id", F.size("h").cast("bigint").alias("n_letters"), count(at("X")).alias("n_unknown"), count(at("S")).alias("n_s"))


def vector_sites(t: Tables) -> DataFrame:
    vec = t.embeddings.select(F.lit("e").alias("acc"), F.col("vec_id").alias("pos"), "embedding")
    sites = vec.select(F.col("pos").alias("site"), "acc", "pos")
    return V.vector_window(sites, vec, ["acc"], "pos", "embedding", 2, 64, ["site"])


@query("vector_windows", """WITH o AS (SELECT e.vec_id AS site, i, v FROM embeddings e JOIN embeddings n ON n.vec_id BETWEEN e.vec_id - 2 AND e.vec_id + 2, LATERAL (SELECT unnest(range(1, 65)) AS i, unnest(n.embedding) AS v))
SELECT site, round(sum(abs_mean), 4) AS mean_size, round(max(c), 5) AS centre_first FROM (SELECT o.site, o.i, abs(sum(v::DOUBLE) / 5) AS abs_mean, any_value(e.embedding[1]::DOUBLE) AS c FROM o JOIN embeddings e ON e.vec_id = o.site GROUP BY o.site, o.i) GROUP BY 1""")
def vector_windows(t: Tables) -> DataFrame:
    wide = vector_sites(t).withColumn("mc", V.mean_and_centre("window", 2, 64))
    total = F.aggregate(F.slice("mc", 1, 64), F.lit(0.0), lambda a, x: a + F.abs(x))
    return wide.select("site", F.round(total, 4).alias("mean_size"), F.round(F.element_at("mc", 65), 5).alias("centre_first"))


@query("flat_windows", "SELECT vec_id AS site, 320::BIGINT AS size FROM embeddings")
def flat_windows(t: Tables) -> DataFrame:
    return vector_sites(t).select("site", F.size(V.flatten_window("window")).cast("bigint").alias("size"))


def labelled_vectors(t: Tables) -> DataFrame:
    vec = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", vec.alias("x"), (F.col("label") < 5).cast("int").alias("label"))


@query("principal_components")
def principal_components(t: Tables) -> DataFrame:
    rows = labelled_vectors(t)
    scaled = V.scale_vectors(rows, [rows], "x")[0]
    out = V.reduce_pca(scaled, [scaled], "x", 8, 64, "pc")[0]
    return out.select("vec_id", *[F.round(F.abs(F.col("pc")[i]), 5).alias(f"pc{i + 1}") for i in range(3)])


@query("partial_least_squares")
def partial_least_squares(t: Tables) -> DataFrame:
    rows = labelled_vectors(t)
    scaled = V.scale_vectors(rows, [rows], "x")[0]
    out = V.reduce_pls(scaled, [scaled], "x", "label", 4, "pls")[0]
    return out.select("vec_id", *[F.round(F.col("pls")[i], 6).alias(f"pls{i + 1}") for i in range(4)])


@query("first_pls_score", """WITH e AS (SELECT vec_id, (label < 5)::INT AS y, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY 1),
z AS (SELECT vec_id, y, i, (x - m) / sd AS z FROM e JOIN s USING (i)), w AS (SELECT i, sum(z * (y - (SELECT avg((label < 5)::INT) FROM embeddings))) AS w FROM z GROUP BY 1), n AS (SELECT sqrt(sum(w * w)) AS n FROM w)
SELECT vec_id, round(sum(z * w / n), 6) AS pls1 FROM z JOIN w USING (i), n GROUP BY 1""")
def first_pls_score(t: Tables) -> DataFrame:
    rows = labelled_vectors(t)
    scaled = V.scale_vectors(rows, [rows], "x")[0]
    out = V.reduce_pls(scaled, [scaled], "x", "label", 1, "pls")[0]
    return out.select("vec_id", F.round(F.col("pls")[0], 6).alias("pls1"))


@query("reduced_blocks")
def reduced_blocks(t: Tables) -> DataFrame:
    wide = vector_sites(t).withColumn("mean", V.window_mean("window", 64)).withColumn("centre", V.window_centre("window", 2))
    out = V.reduce_blocks(wide, [wide], ["mean", "centre"], {"mean": 64, "centre": 64}, 4, None)[0]
    return out.select("site", F.size("reduced").alias("size"), F.round(F.abs(F.col("reduced")[0]), 5).alias("first"))


@query("sigmoid_and_logit", """SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS s, round(ln(greatest(least(l_discount * 10, 0.999999), 0.000001) / (1 - greatest(least(l_discount * 10, 0.999999), 0.000001))), 6) AS g FROM lineitem""")
def sigmoid_and_logit(t: Tables) -> DataFrame:
    return rounded(t.lineitem.select(*KEY, S.sigmoid((F.col("l_quantity") - 25) / 10).alias("s"), S.logit(F.col("l_discount") * 10).alias("g")))
