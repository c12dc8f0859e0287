"""Direction scoring: fold directions x functional score -> votes -> stable labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.operators import aggregates as A
from sitelens.operators import ensembles as E
from sitelens.operators import joins as J


@dataclass(frozen=True)
class DirectionConfig:
    """Parameters of direction scoring."""

    min_functional: float = 0.0
    fill_missing_functional: bool = False
    min_votes: int = 4
    vote_minimums: tuple[int, ...] = (3, 4, 5)


@dataclass(frozen=True)
class DirectionResult:
    sites: DataFrame
    stable: DataFrame
    rule_counts: DataFrame


def score_directions(
    folds: DataFrame, functional: DataFrame, known: DataFrame, config: DirectionConfig = DirectionConfig()
) -> DirectionResult:
    """Joint score of every site and its stability label.

    ``folds`` (site, fold, prob), ``functional`` (site, functional_prob), ``known``
    (site, label text). Fold predictions stay long; the thresholds and the global
    median are one-row tables.
    """
    usable = E.select_scores(
        folds.select("site").distinct(), functional, ["site"], "functional_prob", config.min_functional, config.fill_missing_functional
    )
    scored = E.joint_site_scores(E.joint_fold_scores(folds, usable, ["site"], "prob", "functional_prob"), ["site"])
    named = known.select("site", S.direction_from_text("label").alias("direction"))
    annotated = J.annotate_known(scored, named, "site")
    stable = E.stability_filter(annotated, "known_direction", "Known Import", "Known Export", config.min_votes)
    signed = E.direction_by_sign(stable, "mean_score")
    counts = A.rule_counts(stable, config.vote_minimums)
    return DirectionResult(signed, signed.where(F.col("stable_direction") != "Unselected"), counts)
