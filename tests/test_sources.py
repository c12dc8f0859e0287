"""Readers on files written to a test folder, and the three end-to-end plans on small tables."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators.clean import InvalidInput
from sitelens.plans.candidates import score_candidates
from sitelens.plans.cohorts import CohortConfig, confounder_sensitivity, validate_cohorts
from sitelens.plans.directions import DirectionConfig, score_directions
from sitelens.sources import sequences, tables


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_sites_with_mark_and_repeated_column(spark, tmp_path):
    path = write(tmp_path / "s.csv", "﻿INDEX,ACC_ID,POSITION,ACC_ID\nP1_S2,P1,2.0,other\n")
    df = tables.read_sites(spark, path)
    assert df.columns == ["INDEX", "ACC_ID", "POSITION"]
    assert tuple(df.first()) == ("P1_S2", "P1", 2)


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "p.fasta", ">sp|P1|NAME some > text\nAS\n\nDT\n>P2 x\nMM\n>sp|P1|again\nYY\n")
    assert {r.acc: r.sequence for r in sequences.read_fasta(spark, path).collect()} == {"P1": "YY", "P2": "MM"}


def test_structure_files(spark, tmp_path):
    line = "ATOM      1  CA  SER A   5      11.104   6.134  -6.504  1.00 87.50           C\n"
    other = "ATOM      2  N   SER A   6      11.104   6.134  -6.504  1.00 87.50           N\nHETATM    3  CA  XXX A   7      11.104   6.134  -6.504  1.00 87.50           C\n"
    path = write(tmp_path / "AF-P1-F1-model_v4.pdb", line + other)
    assert {tuple(r) for r in sequences.read_structure_positions(spark, path).collect()} == {("P1", 5), ("P1", 6)}
    assert [tuple(r) for r in sequences.read_ca_atoms(spark, path).collect()] == [("P1", 5, "S", 11.104, 6.134, -6.504, 87.5)]


def test_matrix_and_zero_rows(spark, tmp_path):
    path = write(tmp_path / "m.tsv", "id\ts1\ts.2\nG1.3\t0\t0\nG2\t0\t\nG3\tx\t4\n")
    long = tables.read_matrix(spark, path, "C")
    assert long.count() == 6
    assert {r.entity for r in tables.drop_all_zero(long, ["entity"]).collect()} == {"G2", "G3"}


def test_curated_table_behind_a_preamble(spark, tmp_path):
    path = write(tmp_path / "c.tsv", "note\n\nGENE\tPROTEIN\tX\n a \tb\t\n")
    assert [tuple(r) for r in tables.read_curated(spark, path).collect()] == [("a", "b", "")]


def test_encoding_fallback(spark, tmp_path):
    path = write(tmp_path / "l.txt", "café\n", "latin-1")
    assert tables.read_text_any(spark, path).first().value == "café"


def test_evidence_edges_and_id_map(spark, tmp_path):
    folder = tmp_path / "evidence"
    folder.mkdir()
    write(folder / "TF1.5.tsv", "t\tTF1|SRX1\tTF1|SRX2\tavg\nG1\t5\t0\t9\n")
    write(folder / "TF2.5.tsv", "")
    write(folder / "TF3.5.tsv", "t\tavg\tTF3|SRX9\nG2\t1\tx\n")
    ev = tables.read_evidence(spark, str(folder))
    assert {(r.regulator, r.target, r.experiment, r.score) for r in ev.collect()} == {
        ("TF1", "G1", "TF1|SRX1", 5.0), ("TF1", "G1", "TF1|SRX2", 0.0), ("TF3", "G2", "TF3|SRX9", None)}
    edges = tables.read_edges(spark, write(tmp_path / "e.csv", "source,target,weight\nA,B,1\nA,C,0\n ,D,1\nA,E,-2\n"))
    assert {(r.target, r.sign) for r in edges.collect()} == {("B", 1), ("E", -1)}
    ids = tables.read_id_map(spark, write(tmp_path / "i.tsv", "P1\tEnsembl\tENSG1.4\nP1\tOther\tX\nP1\tEnsembl\tENSG1.5\n"))
    assert [tuple(r) for r in ids.collect()] == [("P1", "ENSG1")]


def test_missing_fold_is_an_error(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.6)], "fold int, m double")
    with pytest.raises(ValueError, match="without 3 folds"):
        tables.load_fold_metrics({"a": df}, "fold", 3)


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, c string")
    tables.write_table(df, str(tmp_path / "out"), partition_by=["c"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_candidate_plan(spark):
    sites = spark.createDataFrame([("P1", "2"), ("P1", "3"), ("P2", "1")], "ACC_ID string, POSITION string")
    seqs = spark.createDataFrame([("P1", "ASDT"), ("P2", "YY")], "acc string, sequence string")
    feats = spark.createDataFrame([("P1_2", 1.0), ("P2_1", -1.0)], "INDEX string, f double")
    coefs = spark.createDataFrame([(k, "f", 2.0) for k in (1, 2)] + [(k, "(intercept)", 0.0) for k in (1, 2)], "fold int, feature string, coef double")
    out = score_candidates(sites, seqs, feats, coefs, ["f"])
    assert {r.INDEX: r.pred_label for r in out.scores.collect()} == {"P1_2": 1, "P2_1": 0}
    assert [r.drop_reason for r in out.rejected.collect()] == ["residue_not_allowed"]


def test_direction_plan(spark):
    folds = spark.createDataFrame([(s, k, p) for s, p in (("a", 0.9), ("b", 0.1), ("c", 0.8), ("d", 0.2)) for k in range(5)], "site string, fold int, prob double")
    func = spark.createDataFrame([(s, 0.5) for s in "abcd"], "site string, functional_prob double")
    known = spark.createDataFrame([("c", "promote_import"), ("d", "Nuclear Export")], "site string, label string")
    out = score_directions(folds, func, known, DirectionConfig(min_votes=4))
    assert {r.site: r.stable_direction for r in out.sites.collect()} == {
        "a": "Predicted Import", "b": "Predicted Export", "c": "Predicted Import", "d": "Unselected"}
    assert [r.n_up for r in out.rule_counts.orderBy("min_votes").collect()] == [2, 2, 2]


def test_cohort_plan(spark):
    samples = range(1, 13)
    values = spark.createDataFrame([("C", "S1", i, float(i)) for i in samples], "cohort string, site string, sample int, value double")
    expr = spark.createDataFrame([("C", f"g{j}", i, float(i * (1 if j < 4 else 0) + (i * j) % 5)) for j in range(12) for i in samples], "cohort string, gene string, sample int, value double")
    edges = spark.createDataFrame([("TF", f"g{j}", 1.0) for j in range(4)], "source string, target string, weight double")
    sites = spark.createDataFrame([("S1", "TF", "import")], "site string, regulator string, direction string")
    edges = edges.union(spark.createDataFrame([(" tf ", "G0", 1.0)], "source string, target string, weight double"))
    config = CohortConfig(random_iterations=20, confounders="none")
    out = validate_cohorts(values, expr, edges, sites, config=config)
    test = out.site_tests.first()
    assert test.n_targets == 4 and test.delta > 0 and test.w_plus == 10.0 and test.p_value == pytest.approx(1 / 16)
    control = out.random_control.first()
    assert control.n_random == 20 and control.observed_mean > control.null_mean and control.p_greater < 0.2
    assert out.activity_tests.first().mean_high > out.activity_tests.first().mean_low
    assert out.sensitivity is None


def test_confounder_sensitivity(spark):
    """Coefficients beside two covariates against least squares; too few samples give NULL, absent parts stay NULL."""
    import numpy as np

    samples = range(1, 13)
    values = spark.createDataFrame([("C", "S1", i, float(i)) for i in samples], "cohort string, site string, sample int, value double")
    expr = spark.createDataFrame([("C", f"g{j}", i, float(i + (i * j) % 5)) for j in (0, 1, 9) for i in samples], "cohort string, gene string, sample int, value double")
    protein = spark.createDataFrame([("C", "g9", i, float((i * 7) % 5)) for i in samples], "cohort string, gene string, sample int, value double")
    phenotype = spark.createDataFrame([("C", i, float((i * 5) % 7)) for i in samples], "cohort string, sample int, purity double")
    targets = spark.createDataFrame([("S1", "import", f"g{j}", "activate") for j in (0, 1)], "site string, direction string, gene string, regulation string")
    sites = spark.createDataFrame([("S1", "g9", "import")], "site string, regulator_gene string, direction string")
    members = spark.createDataFrame([("C", "S1", i, "high" if i > 6 else "low") for i in samples], "cohort string, site string, sample int, side string")
    summary = spark.createDataFrame([("C", "S1", "success")], "cohort string, site string, status string")
    activity = spark.createDataFrame([("C", "S1", "import", i, float((i * i) % 11)) for i in samples], "cohort string, site string, direction string, sample int, activity double")
    tables = (values, expr, targets, sites, members, summary, activity)
    config = CohortConfig(covariates=("protein", "purity"), confounders="adjusted")
    found = confounder_sensitivity(*tables, protein, phenotype, config)
    x = np.array([[1.0, i, (i * 7) % 5, (i * 5) % 7] for i in samples])
    for r in found.adjusted_targets.collect():
        y = np.array([i + (i * int(r.gene[1:])) % 5 for i in samples], float)
        assert r.coef == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0][1]) and r.n_samples == 12
    row = found.robustness.first()
    assert row.n_adjusted_targets == 2 and row.mean_directional_coef > 0 and row.ratio_significant is None and row.possible_confounding is None
    few = confounder_sensitivity(*tables, protein, phenotype, CohortConfig(covariates=("purity",), confounders="adjusted", min_samples=13))
    least = few.adjusted_activity.first()
    assert least.coef is None and least.n_samples == 12
    with pytest.raises(InvalidInput):
        confounder_sensitivity(*tables, config=CohortConfig(confounders="some"))
