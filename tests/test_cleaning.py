"""Keys, validity, folds and tags on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.operators import aggregates, clean, features, splits


def test_keys_are_trimmed_before_they_are_joined(spark):
    df = spark.createDataFrame([(" P12345 ", " 7 "), ("Q8XYZ1", "12")], "ACC_ID string, POSITION string")
    rows = clean.standardize_sites(df).collect()
    assert [(r.INDEX, r.ACC_ID, r.POSITION) for r in rows] == [("P12345_7", "P12345", 7), ("Q8XYZ1_12", "Q8XYZ1", 12)]


def test_bad_position_is_an_error(spark):
    df = spark.createDataFrame([("P1", "x")], "ACC_ID string, POSITION string")
    with pytest.raises(Exception, match="invalid POSITION"):
        clean.standardize_sites(df).collect()


def test_invalid_sites_are_dropped_with_reason(spark):
    rows = [("P1_S2", "P1", 2, "ASD"), ("P2_A1", "P2", 1, "ACD"), ("P3_T1", "P3", 1, "TAA"), ("P4_Y9", "P4", 9, "YAA"), ("P5_S1", "P5", None, "S")]
    df = spark.createDataFrame(rows, "INDEX string, ACC_ID string, POSITION int, FULL_SEQUENCE string")
    kept, rejected = clean.drop_invalid_sites(df)
    assert {r.INDEX for r in kept.collect()} == {"P1_S2", "P3_T1"}
    assert {r.INDEX: r.drop_reason for r in rejected.collect()} == {
        "P2_A1": "residue_not_allowed", "P4_Y9": "position_beyond_sequence", "P5_S1": "position_missing"}


def test_threshold_tag(spark):
    assert spark.range(1).select(S.threshold_tag(F.lit(0.75)).alias("t")).first().t == "gt0p75"


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([("promote_import",), ("sideways",)], "LABEL string")
    with pytest.raises(Exception, match="unknown label"):
        clean.normalize_direction(df, "LABEL", "d").collect()


@pytest.mark.parametrize("group", ["ACC_ID", "Cluster_ID"])
def test_group_folds_are_disjoint(spark, group):
    rows = [(f"P{i}", f"C{i}", i % 2) for i in range(12) for _ in range(3)]
    df = spark.createDataFrame(rows, "ACC_ID string, Cluster_ID string, LABEL int")
    folded = splits.group_folds(df, group, 3, 42, "LABEL")
    assert folded.select("fold").distinct().count() == 3
    assert splits.leaking_groups(folded, group, "fold").count() == 0
    per = folded.groupBy("fold").agg(F.sum("LABEL").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r.p, r.n) for r in per} == {(6, 12)}


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(200).select((F.col("id") % 37).alias("g"), "id")
    one = splits.three_way_split(df.coalesce(1), "g", 0.6, 0.2, 0.2, 7)
    many = splits.three_way_split(df.repartition(13), "g", 0.6, 0.2, 0.2, 7)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert splits.leaking_groups(one, "g", "split").count() == 0


def test_conflicts_drop_the_whole_key(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "k string, d string")
    assert [tuple(r) for r in clean.drop_conflicts(df, ["k"], "d").distinct().collect()] == [("b", "x")]


def test_number_reads_bad_text_nan_and_infinity_as_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), ("12.0",)], "t string")
    assert [r.v for r in df.select(S.number("t").alias("v")).collect()] == [1.5, None, None, None, 12.0]
    assert [r.v for r in df.select(S.whole_number("t").alias("v")).collect()][-1] == 12


def test_thresholds_need_both_known_classes(spark):
    df = spark.createDataFrame([(0.1, "up")], "s double, k string")
    with pytest.raises(Exception, match="no rows of class down"):
        aggregates.known_thresholds(df, "s", "k", "up", "down").collect()


def test_median_fill_same_on_train_and_test_and_on_large_path(spark, hot):
    df = spark.createDataFrame([(float(i), None if i % 4 else float(i)) for i in range(40)], "SEQ_ZScale_a double, SEQ_ZScale_b double")
    rules = features.family_rules("zscale", df.columns, "direction")
    large = features.fit_fills(df, rules).first().asDict()
    spark.conf.set("spark.sitelens.smallInputBytes", str(2**30))
    small = features.fit_fills(df, rules).first().asDict()
    assert large == small == {"fill__SEQ_ZScale_a": 19.5, "fill__SEQ_ZScale_b": 18.0}


def test_log_keeps_missing_values_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "SEQ_Hotspot_Distance double")
    rules = features.family_rules("hotspot", df.columns)
    out = [r[0] for r in features.transform(df, rules, features.fit_fills(df, rules), []).collect()]
    assert out[2] == pytest.approx((out[0] + out[1]) / 2)
