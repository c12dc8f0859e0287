"""Candidate scoring: sites -> valid sites -> fold scores -> ensemble -> label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators import aggregates as A
from sitelens.operators import clean as C
from sitelens.operators import ensembles as E
from sitelens.operators import vectors as V


@dataclass(frozen=True)
class CandidateConfig:
    """Parameters of candidate scoring."""

    threshold: float | None = None
    enforce_residue: bool = True
    window: int = 31
    require_structure: bool = False


@dataclass(frozen=True)
class CandidateResult:
    scores: DataFrame
    rejected: DataFrame
    audit: DataFrame


def score_candidates(
    sites: DataFrame,
    sequences: DataFrame,
    features: DataFrame,
    coefficients: DataFrame,
    columns: Sequence[str],
    thresholds: DataFrame | None = None,
    residues: DataFrame | None = None,
    config: CandidateConfig = CandidateConfig(),
) -> CandidateResult:
    """Score every valid site with every fold's linear model and combine the folds.

    ``sequences`` (acc, sequence), ``features`` (INDEX + columns), ``coefficients``
    (fold, feature, coef), ``thresholds`` (threshold per fold), ``residues``
    (acc, pos) of structure files. Shuffles are on the accession and the site key.
    """
    keyed = C.standardize_sites(sites)
    with_seq = keyed.join(sequences.select(F.col("acc").alias("ACC_ID"), F.col("sequence").alias("FULL_SEQUENCE")), "ACC_ID", "left")
    tagged = C.tag_invalid_sites(with_seq, "POSITION", "FULL_SEQUENCE", "INDEX", config.enforce_residue)
    if config.require_structure and residues is not None:
        places = residues.select(F.col("acc").alias("ACC_ID"), F.col("pos").alias("POSITION"))
        tagged = C.tag_structure_availability(tagged, places, "ACC_ID", "POSITION")
        tagged = tagged.withColumn("drop_reason", F.coalesce("drop_reason", "structure_reason")).drop("structure_reason")
    kept, rejected = C.split_by_reason(tagged)
    windows = kept.withColumn("window", V.text_window("FULL_SEQUENCE", "POSITION", config.window))
    folds = E.linear_scores(features, coefficients, ["INDEX"], columns)
    combined = A.ensemble(folds, ["INDEX"], "prob")
    scored = windows.drop("FULL_SEQUENCE").join(combined, "INDEX", "inner")
    labelled = E.label_by_threshold(
        E.with_ensemble_threshold(scored, thresholds, "threshold", fixed=config.threshold), "mean_prob"
    )
    return CandidateResult(labelled, rejected.drop("FULL_SEQUENCE"), C.reject_audit(tagged))
