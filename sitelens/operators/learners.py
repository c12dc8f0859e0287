"""Calibration, base classifiers, out-of-fold probabilities and stacking.

Logistic models of all folds share their passes over the data; other kinds are Spark ML's.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.operators.aggregates import class_weights, with_weights
from sitelens.operators.clean import InvalidInput
from sitelens.operators.ensembles import adaptive_weights, fuse_with_table, mean_fusion
from sitelens.operators.metrics import ranking_metrics

KINDS = ("logistic", "svm", "forest", "boosted", "perceptron")


def base_classifier(kind: str, features: str = "features", label: str = "label", weight: str | None = None, seed: int = 42, **options):
    """A Spark ML classifier by name, with class weights where the method takes them."""
    common = {"featuresCol": features, "labelCol": label}
    weighted = {"weightCol": weight} if weight else {}
    if kind == "logistic":
        return LogisticRegression(**common, **weighted, **{"regParam": 0.01, **options})
    if kind == "svm":
        return LinearSVC(**common, **weighted, **{"regParam": 0.01, "maxIter": 50, **options})
    if kind == "forest":
        return RandomForestClassifier(**common, **weighted, seed=seed, **{"numTrees": 50, **options})
    if kind == "boosted":
        return GBTClassifier(**common, **weighted, seed=seed, **{"maxIter": 20, "maxDepth": 3, **options})
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(**common, seed=seed, **options)
    raise ValueError(f"kind must be one of {KINDS}")


def fit_classifier(
    train: DataFrame, columns: Sequence[str], kind: str, label: str = "label", balance: str | None = None, seed: int = 42, **options
):
    """Fitted pipeline of assembler and classifier."""
    weight = None
    rows = train
    if balance and kind != "perceptron":
        rows = with_weights(train, class_weights(train, label, balance), label)
        weight = "weight"
    if kind == "perceptron":
        options.setdefault("layers", [len(columns), 8, 2])
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    return Pipeline(stages=[assembler, base_classifier(kind, label=label, weight=weight, seed=seed, **options)]).fit(rows)


def probabilities(model, df: DataFrame, out: str = "prob") -> DataFrame:
    """Positive-class probability, or the sigmoid of the margin for a method without one."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        value = vector_to_array("probability")[1]
    else:
        value = S.sigmoid(vector_to_array("rawPrediction")[1])
    drop = [c for c in ("features", "rawPrediction", "probability", "prediction") if c in scored.columns]
    return scored.withColumn(out, value).drop(*drop)


def _newton_sums(df: DataFrame, columns: Sequence[str], label: str, fold: str | None, models: list[tuple], at: np.ndarray | None) -> np.ndarray:
    """One pass for all models: per model the sums that the caller's step needs, features by features.

    ``models`` lists the fold that each leaves out (None: none). Without ``at``: (n, sum, sum of squares) of the
    features; with it, coefficients by model: log loss, gradient and Hessian. Only these sums leave a task.
    """
    width = len(columns) + 1
    kept = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(None)).cast("string").alias("fold"))
    outside = [None if m is None else str(m) for m in models]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 * width if at is None else 1 + width + width * width
        total = np.zeros((len(models), size))
        for batch in batches:
            x = np.hstack([batch.column("x").flatten().to_numpy().reshape(-1, width - 1), np.ones((batch.num_rows, 1))])
            y, folds = batch.column("y").to_numpy(), np.array(batch.column("fold").to_pylist(), object)
            for i, m in enumerate(outside):
                own = np.ones(len(y), bool) if m is None else folds != m
                z = x[own]
                if at is None:
                    total[i] += np.concatenate([z.sum(0), (z * z).sum(0)])
                    continue
                margin = z @ at[i]
                p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                loss = (np.logaddexp(0, margin) - y[own] * margin).sum()
                total[i] += np.concatenate([[loss], z.T @ (p - y[own]), (z.T @ (z * (p * (1 - p))[:, None])).ravel()])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(models))), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    def add(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(0)
        return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    schema = "i bigint, sums array<double>"
    return np.array([r["sums"] for r in kept.mapInArrow(part, schema).groupBy("i").applyInArrow(add, schema).orderBy("i").collect()])


def logistic_folds(
    df: DataFrame, columns: Sequence[str], label: str = "label", fold: str | None = None, folds: Sequence | None = None, reg: float = 0.01, steps: int = 50
) -> dict:
    """Logistic coefficients (intercept last) of one model per listed fold, each on the rows of the other folds; all models share the passes.

    Newton's method on mean log loss + reg / 2 * sum of (deviation * coefficient)**2, as on
    standardised features; a step that does not lower the loss is halved. Features
    without deviation get 0. Without ``fold`` there is one model, on all rows.
    """
    models = list(folds) if fold else [None]
    width = len(columns) + 1
    sums = _newton_sums(df, columns, label, fold, models, None)
    n = np.maximum(sums[:, width - 1], 1)[:, None]
    mean = sums[:, :width] / n
    spread = np.sqrt(np.maximum(sums[:, width:] / n - mean**2, 0) * n / np.maximum(n - 1, 1))
    moving = spread > 1e-12
    moving[:, -1] = True
    penalty = reg * spread**2
    penalty[:, -1] = 0
    at, step = np.zeros((len(models), width)), np.zeros((len(models), width))
    best, scale, done = np.full(len(models), np.inf), np.ones(len(models)), np.zeros(len(models), bool)
    for _ in range(steps):
        tried = at + scale[:, None] * step
        found = _newton_sums(df, columns, label, fold, models, tried)
        for i in range(len(models)):
            if done[i]:
                continue
            loss = found[i, 0] / n[i, 0] + (penalty[i] * tried[i] ** 2).sum() / 2
            if loss > best[i] + 1e-13:
                scale[i] /= 2
                done[i] = scale[i] < 1e-6
                continue
            at[i], best[i], scale[i] = tried[i], loss, 1.0
            gradient = found[i, 1 : 1 + width] / n[i, 0] + penalty[i] * at[i]
            hessian = found[i, 1 + width :].reshape(width, width) / n[i, 0] + np.diag(penalty[i] + 1e-12)
            use = np.flatnonzero(moving[i])
            step[i] = 0
            step[i, use] = -np.linalg.solve(hessian[np.ix_(use, use)], gradient[use])
            done[i] = np.abs(step[i]).max() <= 1e-10 * max(1.0, np.abs(at[i]).max())
        if done.all():
            break
    return dict(zip(models, at))


def platt_fit(scores: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic fit; the slope must be positive."""
    slope, intercept = (float(v) for v in logistic_folds(scores, [score], label, reg=0.0)[None])
    if not slope > 0:
        raise InvalidInput(f"calibration slope must be positive, got {slope}")
    return slope, intercept


def out_of_fold(
    df: DataFrame, columns: Sequence[str], fold: str, folds: Sequence[int], kind: str, label: str = "label", out: str = "prob", check: bool = True, **options
) -> DataFrame:
    """Probability of every row from the model that did not see its fold; each row exactly once.

    The logistic models of all folds are fitted together; other kinds one by one.
    """
    if not len(folds):
        raise InvalidInput("no folds given")
    if check and df.where(~F.col(fold).isin(*folds) | F.col(fold).isNull()).limit(1).count():
        raise InvalidInput("rows outside the listed folds have no out-of-fold score")
    if kind == "logistic" and not set(options) - {"regParam"}:
        models = {str(k): v for k, v in logistic_folds(df, columns, label, fold, folds, options.get("regParam", 0.01)).items()}

        @F.pandas_udf("double")
        def probability(x: pd.Series, of: pd.Series) -> pd.Series:
            values = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, len(columns)))
            table = np.array([models[k] for k in of]).reshape(-1, len(columns) + 1)
            margin = (values * table[:, :-1]).sum(1) + table[:, -1]
            return pd.Series(1 / (1 + np.exp(-np.clip(margin, -700, 700))))

        rows = df.where(F.col(fold).isin(*folds))
        return rows.withColumn(out, probability(F.array(*[F.col(c).cast("double") for c in columns]), F.col(fold).cast("string")))
    parts: DataFrame | None = None
    for k in folds:
        model = fit_classifier(df.where(F.col(fold) != k), columns, kind, label, **options)
        part = probabilities(model, df.where(F.col(fold) == k), out)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def stack(
    oof: DataFrame, test: DataFrame, branches: Sequence[str], label: str = "label", out: str = "stacked", weight_mode: str | None = "balanced"
) -> DataFrame:
    """Logistic meta-model on the logits of the branches' out-of-fold probabilities."""
    logits = {f"logit_{b}": S.logit(b) for b in branches}
    model = fit_classifier(oof.withColumns(logits), list(logits), "logistic", label, weight_mode, regParam=0.0)
    return probabilities(model, test.withColumns(logits), out).drop(*logits)


def fuse_three_ways(oof: DataFrame, test: DataFrame, branches: Sequence[str], key: Sequence[str], label: str = "label") -> DataFrame:
    """Stacked, mean and AUROC-weighted fusion of the branches on a test part."""
    stacked = stack(oof, test, branches, label)
    weights = adaptive_weights(oof, branches, label)
    return fuse_with_table(mean_fusion(stacked, branches, "fused_mean"), weights, key, branches, "fused_weighted")


def fusion_metrics(fused: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """AUROC and average precision of each branch and fusion."""
    long = fused.select(label, *columns).unpivot([label], list(columns), "output", "score")
    return ranking_metrics(long, ["output"], "score", label)


def calibration_report(scores: DataFrame, score: str, label: str, slope: float, intercept: float) -> DataFrame:
    """AUROC of the raw and of the calibrated score; a positive slope leaves it unchanged."""
    both = scores.select(label, F.col(score).alias("raw"), S.sigmoid(F.lit(slope) * F.col(score) + F.lit(intercept)).alias("calibrated"))
    return fusion_metrics(both, ["raw", "calibrated"], label)


def coefficients(models: Mapping[int, object], columns: Sequence[str], df: DataFrame) -> DataFrame:
    """(fold, feature, coef) of fitted logistic pipelines, for scoring by join."""
    rows = []
    for fold, pipeline in models.items():
        fitted = pipeline.stages[-1]
        rows += [(int(fold), c, float(w)) for c, w in zip(columns, fitted.coefficients)]
        rows.append((int(fold), "(intercept)", float(fitted.intercept)))
    return df.sparkSession.createDataFrame(rows, "fold int, feature string, coef double")
