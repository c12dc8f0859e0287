"""Fold ensembles, joint direction scores, stability rules, fusion and calibration."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.operators.aggregates import known_thresholds, stability_flags, with_global_median
from sitelens.operators.metrics import ranking_metrics
from sitelens.operators.ordered import attach, quantiles


def with_ensemble_threshold(
    scores: DataFrame, thresholds: DataFrame | None, column: str, how: str = "mean", fixed: float | None = None
) -> DataFrame:
    """Final threshold on every row: mean or median of the fold thresholds, or a fixed value."""
    if fixed is not None or thresholds is None:
        return scores.withColumn("final_threshold", F.lit(float(fixed if fixed is not None else 0.5)))
    if how == "median":
        one = quantiles(thresholds, [], column, {"final_threshold": 0.5})
    else:
        one = thresholds.agg(F.avg(column).alias("final_threshold"))
    return scores.crossJoin(F.broadcast(one))


def label_by_threshold(scores: DataFrame, prob: str, threshold: str = "final_threshold") -> DataFrame:
    return scores.withColumn("pred_label", (F.col(prob) >= F.col(threshold)).cast("int"))


def name_by_positive_class(df: DataFrame, prob: str, positive: str, negative: str) -> DataFrame:
    """Probability columns named after the classes."""
    return df.withColumn(f"prob_{positive}", F.col(prob)).withColumn(f"prob_{negative}", 1.0 - F.col(prob))


def joint_fold_scores(folds: DataFrame, functional: DataFrame, site: Sequence[str], prob: str, functional_prob: str) -> DataFrame:
    """Signed direction of every fold weighted by the site's functional probability.

    ``folds`` stays long: one row per (site, fold).
    """
    joined = folds.join(functional.select(*site, functional_prob), list(site), "inner")
    return joined.withColumn("direction_raw", 2.0 * F.col(prob) - 1.0).withColumn(
        "direction_score", F.col("direction_raw") * F.col(functional_prob)
    )


def joint_site_scores(fold_scores: DataFrame, site: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, size and votes of a site's fold scores.

    The mean is rounded to 12 decimals: it is compared with limits taken from the
    same scores, and the order of a distributed sum must not decide.
    """
    return fold_scores.groupBy(*site, *keep).agg(
        F.avg("direction_raw").alias("mean_raw"),
        F.stddev_samp("direction_raw").alias("std_raw"),
        F.round(F.avg("direction_score"), 12).alias("mean_score"),
        F.stddev_samp("direction_score").alias("std_score"),
        F.abs(F.avg("direction_score")).alias("abs_score"),
        F.count_if(F.col("direction_score") > 0).alias("votes_up"),
        F.count_if(F.col("direction_score") < 0).alias("votes_down"),
    )


def stability_filter(
    sites: DataFrame, known: str, up_known: str, down_known: str, min_votes: int = 4,
    up: str = "Predicted Import", down: str = "Predicted Export",
) -> DataFrame:
    """Stable predictions: beyond the known class, enough fold votes, and on the right side of the median.

    A site meeting both rules is an error raised by the job.
    """
    limits = known_thresholds(sites, "mean_score", known, up_known, down_known)
    joined = with_global_median(sites, "mean_score").crossJoin(F.broadcast(limits))
    is_up, is_down = stability_flags(min_votes)
    label = (
        F.when(is_up & is_down, F.raise_error(F.lit("a site meets both stability rules")).cast("string"))
        .when(is_up, up)
        .when(is_down, down)
        .otherwise("Unselected")
    )
    return joined.withColumn("stable_direction", label)


def select_scores(
    left: DataFrame, right: DataFrame, key: Sequence[str], score: str, at_least: float, fill_zero: bool = False
) -> DataFrame:
    """Join of a score table, matched rows only or filled with 0, and the score filter after it."""
    joined = left.join(right.select(*key, score), list(key), "left" if fill_zero else "inner")
    if fill_zero:
        joined = joined.withColumn(score, F.coalesce(score, F.lit(0.0)))
    return joined.where(F.col(score) >= at_least)


def direction_by_sign(df: DataFrame, score: str, up: str = "import", down: str = "export") -> DataFrame:
    """Direction by sign with the split positive and negative scores and the margin."""
    s = F.col(score)
    return (
        df.withColumn("pred_direction", F.when(s > 0, up).when(s < 0, down).otherwise("neutral"))
        .withColumn(f"{up}_score", F.greatest(s, F.lit(0.0)))
        .withColumn(f"{down}_score", F.greatest(-s, F.lit(0.0)))
        .withColumn("margin", F.abs(s))
    )


def platt_apply(df: DataFrame, score: str, slope: float | Column, intercept: float | Column, out: str = "calibrated") -> DataFrame:
    a = slope if isinstance(slope, Column) else F.lit(float(slope))
    b = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    return df.withColumn(out, S.sigmoid(a * F.col(score) + b))


def normalized_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """Non-negative weights that add up to 1; equal ones if all are zero."""
    safe = {k: max(0.0, float(v)) for k, v in weights.items()}
    total = sum(safe.values())
    return {k: (v / total if total > 0 else 1.0 / len(safe)) for k, v in safe.items()}


def fuse(df: DataFrame, weights: Mapping[str, float], out: str = "fused") -> DataFrame:
    """Weighted mean of branch probabilities."""
    parts = [F.col(c) * F.lit(w) for c, w in normalized_weights(weights).items()]
    return df.withColumn(out, sum(parts[1:], parts[0]))


def mean_fusion(df: DataFrame, branches: Sequence[str], out: str = "fused_mean") -> DataFrame:
    return fuse(df, {b: 1.0 for b in branches}, out)


def adaptive_weights(df: DataFrame, branches: Sequence[str], label: str, floor: float = 0.5, power: float = 2.0) -> DataFrame:
    """One row per branch with its AUROC and normalised weight max(AUROC, floor)**power."""
    long = df.select(label, *branches).unpivot([label], list(branches), "branch", "score")
    scored = ranking_metrics(long, ["branch"], "score", label).select(
        "branch", "auroc", F.pow(F.greatest(F.coalesce("auroc", F.lit(0.5)), F.lit(floor)), F.lit(power)).alias("_w")
    )
    total = scored.agg(F.sum("_w").alias("_t"))
    return scored.crossJoin(F.broadcast(total)).withColumn("weight", S.ratio("_w", "_t")).drop("_w", "_t")


def fuse_with_table(df: DataFrame, weights: DataFrame, key: Sequence[str], branches: Sequence[str], out: str = "fused") -> DataFrame:
    """Weighted mean with weights from a (branch, weight) table."""
    wide = weights.agg(*[F.max(F.when(F.col("branch") == b, F.col("weight"))).alias(f"_w_{b}") for b in branches])
    joined = df.crossJoin(F.broadcast(wide))
    top = sum((F.col(f"_w_{b}") * F.col(b) for b in branches[1:]), F.col(f"_w_{branches[0]}") * F.col(branches[0]))
    bottom = sum((F.col(f"_w_{b}") for b in branches[1:]), F.col(f"_w_{branches[0]}"))
    return joined.withColumn(out, top / bottom).drop(*[f"_w_{b}" for b in branches])


def weight_grid(n: int, step: float = 0.1) -> list[tuple[float, ...]]:
    """All weight tuples of n branches on a grid that add up to 1."""
    parts = round(1 / step)
    grid = []
    for combo in itertools.product(range(parts + 1), repeat=n - 1):
        if sum(combo) <= parts:
            grid.append(tuple(round(c / parts, 10) for c in (*combo, parts - sum(combo))))
    return grid


def search_weights(df: DataFrame, branches: Sequence[str], label: str, step: float = 0.1) -> DataFrame:
    """AUROC of every weight tuple and the first best one flagged.

    The grid is a constant of a few hundred tuples; scores are combined by
    (grid point, score) before the ordered pass.
    """
    grid = weight_grid(len(branches), step)
    columns = [F.array(*[F.lit(ws[i]) for ws in grid]).alias(f"w_{b}") for i, b in enumerate(branches)]
    points = F.posexplode(F.arrays_zip(*columns))
    wide = df.select(label, *branches, points.alias("grid_id", "_w"))
    terms = [F.col(f"_w.w_{b}") * F.col(b) for b in branches]
    long = wide.select(label, "grid_id", F.round(sum(terms[1:], terms[0]), 12).alias("score"))
    scored = ranking_metrics(long, ["grid_id"], "score", label).select("grid_id", "auroc")
    table = df.sparkSession.range(1).select(points.alias("grid_id", "_w")).select("grid_id", "_w.*")
    best = scored.agg(F.max_by("grid_id", F.struct(F.round("auroc", 12), -F.col("grid_id"))).alias("_best"))
    return (
        attach(table, scored, ["grid_id"], small=True)
        .crossJoin(F.broadcast(best))
        .withColumn("is_best", F.col("grid_id") == F.col("_best"))
        .drop("_best")
    )


def linear_scores(features: DataFrame, coefs: DataFrame, key: Sequence[str], columns: Sequence[str], fold: str = "fold") -> DataFrame:
    """Score of each row under every fold's linear model.

    ``coefs`` has (fold, feature, coef), with the intercept as feature
    ``(intercept)``. The model table is turned into one row per fold, so the
    feature table is neither unpivoted nor shuffled.
    """
    models = coefs.groupBy(fold).agg(
        F.max(F.when(F.col("feature") == "(intercept)", F.col("coef"))).alias("_b"),
        *[F.max(F.when(F.col("feature") == c, F.col("coef"))).alias(f"_w_{i}") for i, c in enumerate(columns)],
    )
    joined = features.crossJoin(F.broadcast(models))
    terms = [F.coalesce(F.col(c) * F.col(f"_w_{i}"), F.lit(0.0)) for i, c in enumerate(columns)]
    raw = sum(terms[1:], terms[0]) + F.coalesce("_b", F.lit(0.0))
    return joined.select(*key, fold, raw.alias("decision"), S.sigmoid(raw).alias("prob"))


def linear_score_sums(features: DataFrame, coefs: DataFrame, key: Sequence[str], columns: Sequence[str], fold: str = "fold") -> DataFrame:
    """``linear_scores`` added up over the rows of a key, by fold.

    Rows meet by key before they are scored, and the folds are columns until their sums are made, so what
    travels is one row of features for all folds. The models, one row per fold, are read by the driver.
    """
    key = list(key)
    models = coefs.groupBy(fold).pivot("feature", ["(intercept)", *columns]).agg(F.max("coef")).orderBy(fold).collect()
    sums = []
    for i, m in enumerate(models):
        terms = [F.coalesce(F.col(c) * F.lit(m[c]).cast("double"), F.lit(0.0)) for c in columns]
        raw = sum(terms[1:], terms[0]) + F.lit(0.0 if m["(intercept)"] is None else m["(intercept)"])
        sums += [F.sum(raw).alias(f"_d{i}"), F.sum(S.sigmoid(raw)).alias(f"_p{i}")]
    if not models:
        return linear_scores(features, coefs, key, columns, fold)
    kind = coefs.schema[fold].dataType
    folds = [
        F.struct(F.lit(m[fold]).cast(kind).alias(fold), F.col(f"_d{i}").alias("decision"), F.col(f"_p{i}").alias("prob"))
        for i, m in enumerate(models)
    ]
    wide = features.select(*key, *columns).repartition(*key).groupBy(*key).agg(*sums)
    return wide.select(*key, F.inline(F.array(*folds)))


def score_or_model_mean(df: DataFrame, score: str, models: Sequence[str], out: str = "score") -> DataFrame:
    """The score column, else the mean of the model columns that are present."""
    have = [m for m in models if m in df.columns]
    values = F.filter(F.array(*[S.number(m) for m in have]), lambda v: v.isNotNull()) if have else None
    mean = (
        F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))
        if have
        else F.lit(None).cast("double")
    )
    own = S.number(score) if score in df.columns else F.lit(None).cast("double")
    return df.withColumn(out, F.coalesce(own, mean))


def collect_folds(parts: Mapping[int, DataFrame], fold: str = "fold") -> DataFrame:
    """Per-fold tables as one long table with the fold number."""
    out: DataFrame | None = None
    for number, df in parts.items():
        tagged = df.withColumn(fold, F.lit(number))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no folds given")
    return out
