"""Ranking and classification metrics from prefix sums over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.operators.ordered import ladder

# The thresholds a search tries.
SEARCH_GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def _score_steps(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    positive = F.when(F.col(label) == 1, 1).otherwise(0)
    steps = ladder(df.where(F.col(label).isNotNull()), keys, score, {"_n": F.lit(1), "_p": positive})
    return (
        steps.withColumn("_tp", F.col("_p_total") - F.col("_p_before"))
        .withColumn("_above", F.col("_n_total") - F.col("_n_before"))
        .withColumn("_neg", F.col("_n_total") - F.col("_p_total"))
    )


def ranking_metrics(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """AUROC and average precision by group in one ordered pass; NULL with one class only."""
    keys = list(keys)
    steps = _score_steps(df, keys, score, label)
    rank = F.col("_n_before") + (F.col("_n") + 1) / 2.0
    out = steps.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.sum("_p").alias("n_positive"),
        F.sum(rank * F.col("_p")).alias("_r"),
        F.sum(S.ratio(F.col("_p") * F.col("_tp"), F.col("_p_total") * F.col("_above"))).alias("_ap"),
    )
    p = F.col("n_positive")
    n = F.col("n_rows") - p
    both = (p > 0) & (n > 0)
    return out.select(
        *keys,
        "n_rows",
        "n_positive",
        F.when(both, (F.col("_r") - p * (p + 1) / 2.0) / (p.cast("double") * n)).alias("auroc"),
        F.when(both, F.col("_ap")).alias("average_precision"),
    )


def roc_points(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """One point per distinct score: false and true positive rate at that threshold."""
    steps = _score_steps(df, keys, score, label)
    return steps.select(
        *keys,
        F.col(score).alias("threshold"),
        S.ratio(F.col("_above") - F.col("_tp"), "_neg").alias("fpr"),
        S.ratio("_tp", "_p_total").alias("tpr"),
    )


def pr_points(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    steps = _score_steps(df, keys, score, label)
    return steps.select(
        *keys,
        F.col(score).alias("threshold"),
        S.ratio("_tp", "_above").alias("precision"),
        S.ratio("_tp", "_p_total").alias("recall"),
    )


def confusion(df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: Column | float) -> DataFrame:
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    said, is_pos = F.col(score) >= cut, F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.count_if(said & is_pos).alias("tp"),
        F.count_if(said & ~is_pos).alias("fp"),
        F.count_if(~said & is_pos).alias("fn"),
        F.count_if(~said & ~is_pos).alias("tn"),
    )


def f1_column() -> Column:
    return F.coalesce(S.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def mcc_column() -> Column:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.coalesce(S.ratio(tp * tn - fp * fn, bottom), F.lit(0.0))


def threshold_metrics(df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: Column | float = 0.5) -> DataFrame:
    """F1, MCC, balanced accuracy and recall per class at a threshold; 0 where undefined."""
    cells = confusion(df, keys, score, label, threshold)
    up = F.coalesce(S.ratio("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    down = F.coalesce(S.ratio("tn", F.col("tn") + F.col("fp")), F.lit(0.0))
    return (
        cells.withColumn("f1", f1_column())
        .withColumn("mcc", mcc_column())
        .withColumn("recall_positive", up)
        .withColumn("recall_negative", down)
        .withColumn("balanced_accuracy", (up + down) / 2)
    )


def threshold_grid(
    df: DataFrame, keys: Sequence[str], score: str, label: str, grid: Sequence[float] = SEARCH_GRID
) -> DataFrame:
    """Confusion cells at every threshold of the grid.

    Rows are first counted by how many thresholds they pass, so the table is
    read once and only a grid-sized histogram is expanded.
    """
    keys = list(keys)
    passed = sum(((F.col(score) >= F.lit(float(t))).cast("int") for t in grid), F.lit(0))
    bins = df.where(F.col(score).isNotNull()).groupBy(*keys, passed.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_p")
    )
    cuts = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(len(grid))).alias("i"),
                                  F.array(*[F.lit(float(t)) for t in grid]).alias("t")))
    wide = bins.withColumn("_cut", cuts)
    said = F.col("_bin") >= F.col("_cut.i")
    return wide.groupBy(*keys, F.col("_cut.t").alias("threshold")).agg(
        F.sum(F.when(said, F.col("_p")).otherwise(0)).alias("tp"),
        F.sum(F.when(said, F.col("_n") - F.col("_p")).otherwise(0)).alias("fp"),
        F.sum(F.when(~said, F.col("_p")).otherwise(0)).alias("fn"),
        F.sum(F.when(~said, F.col("_n") - F.col("_p")).otherwise(0)).alias("tn"),
    )


def best_threshold(
    df: DataFrame, keys: Sequence[str], score: str, label: str, metric: str = "f1", fallback: float = 0.5
) -> DataFrame:
    """First threshold of the grid with the highest F1 or MCC; the fallback when one class is missing."""
    keys = list(keys)
    value = f1_column() if metric == "f1" else mcc_column()
    scored = threshold_grid(df, keys, score, label).withColumn("_value", F.round(value, 12))
    best = scored.groupBy(*keys).agg(
        F.max(F.struct(F.col("_value").alias("v"), (-F.col("threshold")).alias("t"))).alias("_best"),
        F.max(F.col("tp") + F.col("fn")).alias("_pos"),
        F.max(F.col("fp") + F.col("tn")).alias("_neg"),
    )
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    chosen = -F.col("_best.t")
    if metric != "f1":
        chosen = F.when(both, chosen).otherwise(F.lit(fallback))
    return best.select(*keys, chosen.alias("threshold"), F.col("_best.v").alias("best_" + metric))


def metrics_by_model(df: DataFrame, keys: Sequence[str], models: Sequence[str], label: str) -> DataFrame:
    """AUROC and average precision of several score columns, by benchmark mode."""
    keys = list(keys)
    long = df.select(*keys, label, *[F.col(m).cast("double").alias(m) for m in models]).unpivot(
        [*keys, label], list(models), "model", "score"
    )
    return ranking_metrics(long, [*keys, "model"], "score", label)


def prediction_table(
    df: DataFrame, score: str, label: str | None, threshold: Column | float, up: str = "positive", down: str = "negative"
) -> DataFrame:
    """Predicted label and direction, and whether they are right."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    out = df.withColumn("pred_label", (F.col(score) >= cut).cast("int")).withColumn(
        "pred_direction", F.when(F.col("pred_label") == 1, up).otherwise(down)
    )
    return out.withColumn("correct", F.col("pred_label") == F.col(label)) if label else out


def best_fold(metrics: DataFrame, keys: Sequence[str], metric: str, fold: str) -> DataFrame:
    """The fold with the highest metric, the first on ties."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), F.asc(fold))
    return metrics.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def split_metrics(df: DataFrame, keys: Sequence[str], split: str, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Sizes by class and ranking and threshold metrics of every split: one row per (keys, split)."""
    both = [*keys, split]
    ranks = ranking_metrics(df, both, score, label)
    cells = threshold_metrics(df, both, score, label, threshold)
    return ranks.join(cells, both)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pu_risks(
    df: DataFrame, score: str, label: str, prior: float, unlabelled_weight: float = 1.0, weighted_u: float = 0.1
) -> DataFrame:
    """Positive-unlabelled risks of a raw score (Kiryo et al., 2017): one row.

    Non-negative and unbiased risk with class ``prior``; and the weighted risk in
    which unlabelled rows only add a down-weighted negative term.
    """
    s, is_pos = F.col(score), F.col(label) == 1
    sums = df.agg(
        F.coalesce(F.avg(F.when(is_pos, softplus(-s))), F.lit(0.0)).alias("risk_positive"),
        F.coalesce(F.avg(F.when(is_pos, softplus(s))), F.lit(0.0)).alias("risk_positive_as_negative"),
        F.coalesce(F.avg(F.when(~is_pos, softplus(s))), F.lit(0.0)).alias("risk_unlabelled"),
    )
    corrected = F.lit(unlabelled_weight) * F.col("risk_unlabelled") - F.lit(prior) * F.col("risk_positive_as_negative")
    gain = F.lit(prior) * F.col("risk_positive")
    weighted = 0.5 * (F.col("risk_positive") + F.col("risk_positive_as_negative")) + F.lit(weighted_u) * F.col(
        "risk_unlabelled"
    )
    return (
        sums.withColumn("nn_risk", gain + F.greatest(F.lit(0.0), corrected))
        .withColumn("unbiased_risk", gain + corrected)
        .withColumn("weighted_risk", weighted)
    )


def log_losses(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    label: str,
    positive_weight: float = 1.0,
    gamma: float = 2.0,
    alpha: float | None = 0.25,
) -> DataFrame:
    """Binary log loss with a positive weight, and focal loss, of a raw score."""
    s, is_pos = F.col(score), F.col(label) == 1
    own_loss = F.when(is_pos, softplus(-s)).otherwise(softplus(s))
    own_prob = F.exp(-own_loss)
    weight = F.when(is_pos, F.lit(float(positive_weight))).otherwise(F.lit(1.0))
    share = F.lit(1.0) if alpha is None else F.when(is_pos, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    return df.groupBy(*keys).agg(
        F.avg(weight * own_loss).alias("log_loss"),
        F.avg(share * F.pow(1 - own_prob, F.lit(float(gamma))) * own_loss).alias("focal_loss"),
    )


def training_prior(df: DataFrame, label: str) -> DataFrame:
    """Share of positives and the negative/positive ratio: one row."""
    return df.agg(
        F.avg((F.col(label) == 1).cast("double")).alias("prior"),
        S.ratio(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("negative_ratio"),
    )
