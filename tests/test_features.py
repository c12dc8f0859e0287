"""Feature families on hand-made tables."""

import math

import pytest

from sitelens.operators import features as X

L = math.log1p


def rows_of(spark, prefix, has, names, values):
    schema = ", ".join(["k int", f"{prefix}{has} string", f"{prefix}Inside_Flag string", *[f"{prefix}{n} double" for n in names]])
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], schema)


def result(df, family, variant, name, prefix, **options):
    rules = X.family_rules(family, [c for c in df.columns if c != "k"], variant, **options)
    out = X.transform(df, rules, X.fit_fills(df, rules), ["k"])
    return [r[prefix + name] for r in out.orderBy("k").collect()]


CENTER = [("1", "1", 4.0), ("1", "0", -2.0), ("1", "0", None), ("0", "0", 9.0), ("1", "1", 6.0)]


@pytest.mark.parametrize(
    "family, prefix, has, filled",
    [
        ("nes", "MOTIF_NES_", "HasSegment_Flag", 4.0),
        ("domain", "MOTIF_Domain_DBD_", "HasSegment_Flag", 4.0),
        ("motif1433", "MOTIF_1433_", "HasMotif_Flag", 4.0),
        ("idr", "MOTIF_IDR_", "HasRegion_Flag", 0.0),
    ],
)
def test_signed_distance(spark, family, prefix, has, filled):
    """Median of rows with a segment (disorder: 0), nothing without one, sign kept."""
    df = rows_of(spark, prefix, has, ["Nearest_CenterSignedDistance"], CENTER)
    got = result(df, family, "direction", "Nearest_CenterSignedDistance", prefix)
    assert got == pytest.approx([L(4), -L(2), L(filled), 0.0, L(6)])


def test_domain_boundary_and_protein_columns(spark):
    p = "MOTIF_Domain_DBD_"
    df = rows_of(spark, p, "HasSegment_Flag", ["Nearest_Start", "Protein_CoverageFraction", "Inside_RelativePosition"],
                 [("1", "1", 10.0, 1.5, -0.2), ("1", "1", None, None, 1.4), ("0", "0", 7.0, 0.9, 0.3), ("1", "1", 30.0, 0.4, None), ("1", "0", 20.0, -1.0, 0.5)])
    assert result(df, "domain", "direction", "Nearest_Start", p) == [10.0, 20.0, 0.0, 30.0, 20.0]
    assert result(df, "domain", "direction", "Protein_CoverageFraction", p) == [1.0, 0.0, 0.0, 0.4, 0.0]
    assert result(df, "domain", "direction", "Inside_RelativePosition", p) == [-1.0, 1.0, -1.0, -1.0, -1.0]


def test_motif_scores_are_bounded(spark):
    p = "MOTIF_1433_"
    df = rows_of(spark, p, "HasMotif_Flag", ["Nearest_ConsensusScore", "Inside_OverlapCount"],
                 [("1", "1", 1.7, 2.0), ("1", "0", None, 3.0), ("0", "0", 0.4, 1.0), ("1", "1", -0.5, None), ("1", "1", 0.6, -1.0)])
    assert result(df, "motif1433", "direction", "Nearest_ConsensusScore", p) == pytest.approx([1.0, 0.6, 0.0, 0.0, 0.6])
    assert result(df, "motif1433", "direction", "Inside_OverlapCount", p) == [2.0, 0.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("variant, region", [("direction", [0.2, 0.4, 0.0, 0.6, 0.4]), ("candidate", [0.2, 0.5, 0.8, 0.6, 0.4])])
def test_disorder_scores(spark, variant, region):
    """Site scores take the median of all rows; region scores, in the direction variant, that of rows with a region."""
    p = "MOTIF_IDR_"
    df = rows_of(spark, p, "HasRegion_Flag", ["Site_DisorderScore", "NearestRegion_DisorderMean"],
                 [("1", "1", 0.1, 0.2), ("1", "0", None, None), ("0", "0", 0.3, 0.8), ("1", "1", 0.7, 0.6), ("1", "1", 0.5, 0.4)])
    assert result(df, "idr", variant, "Site_DisorderScore", p) == pytest.approx([0.1, 0.4, 0.3, 0.7, 0.5])
    assert result(df, "idr", variant, "NearestRegion_DisorderMean", p) == pytest.approx(region)


def test_candidate_import_signal(spark):
    """Scores count inside a segment only; a missing inside position is 0 there, -1 outside."""
    p = "MOTIF_NLS_"
    df = rows_of(spark, p, "HasSegment_Flag", ["Nearest_Score", "Inside_RelativePosition"],
                 [("1", "1", 3.0, 0.5), ("1", "0", 4.0, 0.5), ("1", "1", None, None), ("0", "0", 5.0, None), ("0", "1", 2.0, 0.1)])
    assert result(df, "nls", "candidate", "Nearest_Score", p) == [3.0, 0.0, 0.0, 0.0, 2.0]
    assert result(df, "nls", "candidate", "Inside_RelativePosition", p) == [0.5, -1.0, 0.0, -1.0, 0.1]


def test_ratio_and_kinase(spark):
    df = spark.createDataFrame([(0, 30.0, 2.0), (1, None, None), (2, -1.0, 0.25), (3, 3.0, 0.75)], "k int, SEQ_X_ratio_R_over_K double, FUNC_Kinase_prob double")
    ratio = lambda **o: result(df.drop("FUNC_Kinase_prob"), "sequence", "direction", "SEQ_X_ratio_R_over_K", "", **o)
    assert ratio() == [20.0, 0.0, 0.0, 3.0]
    assert ratio(log_ratios=True) == pytest.approx([L(20), 0.0, 0.0, L(3)])
    prob = lambda **o: result(df.drop("SEQ_X_ratio_R_over_K"), "kinase", "direction", "FUNC_Kinase_prob", "", **o)
    assert prob() == [1.0, 0.75, 0.25, 0.75]
    assert prob(fill="mean") == [1.0, 1.0, 0.25, 0.75] and prob(fill="zero") == [1.0, 0.0, 0.25, 0.75]
