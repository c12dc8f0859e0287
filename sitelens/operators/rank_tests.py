"""Rank tests, exact tests, correlation, regression, density, pooled effects.

Ranks come from prefix sums over distinct values, so a test costs one
aggregation by (test, value) and one ordered pass, and a test that holds a
large part of the table is cut into slices. Only the tail probability of the
finished statistic is a UDF.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import scalars as S
from sitelens.functions import tails
from sitelens.functions.tails import student_p
from sitelens.operators.ordered import attach, average_ranks, hot_groups, is_small, ladder


def _side(side: str | Column) -> Column:
    return F.lit(side) if isinstance(side, str) else side


def rank_sum_statistic(df: DataFrame, keys: Sequence[str], group: str, value: str, high: str, low: str) -> DataFrame:
    """U of the ``high`` group against ``low`` with sizes and the tie term: one row per test."""
    keys = list(keys)
    two = df.where(F.col(group).isin(high, low))
    steps = ladder(two, keys, value, {"_n": F.lit(1), "_h": (F.col(group) == high).cast("bigint")})
    rank = F.col("_n_before") + (F.col("_n") + 1) / 2.0
    tied = F.col("_n").cast("double")
    out = steps.groupBy(*keys).agg(
        F.sum("_h").alias("n_high"),
        (F.sum("_n") - F.sum("_h")).alias("n_low"),
        F.sum(rank * F.col("_h")).alias("rank_sum"),
        F.sum(tied * tied * tied - tied).alias("tie_term"),
    )
    return out.withColumn("u", F.col("rank_sum") - F.col("n_high") * (F.col("n_high") + 1) / 2.0)


def rank_sum_test(
    df: DataFrame,
    keys: Sequence[str],
    group: str,
    value: str,
    high: str = "high",
    low: str = "low",
    side: str | Column = "two-sided",
    min_n: int = 3,
    p: str = "p_value",
    method: str = "auto",
    used: str | None = None,
) -> DataFrame:
    """Mann-Whitney U test of two groups; NULL p when either has fewer than ``min_n`` values.

    ``method`` is exact, asymptotic or auto (exact for a smaller group of at most 8
    without ties); ``used`` names a column that says which one was taken.
    """
    stat = rank_sum_statistic(df, keys, group, value, high, low)
    enough = (F.col("n_high") >= min_n) & (F.col("n_low") >= min_n)
    sizes = F.col("n_high").cast("double"), F.col("n_low").cast("double")
    exact = tails.rank_sum_exact(*sizes, F.col("tie_term"), method)
    tail = tails.rank_sum_tail(F.col("u"), *sizes, F.col("tie_term"), _side(side), exact)
    out = stat.withColumn(p, tail).withColumn(p, F.when(enough, F.col(p)))
    return out if used is None else out.withColumn(used, F.when(exact, "exact").otherwise("asymptotic"))


def two_group_test(
    df: DataFrame,
    keys: Sequence[str],
    group: str,
    value: str,
    high: str = "high",
    low: str = "low",
    side: str | Column = "two-sided",
    min_n: int = 3,
    method: str = "auto",
    used: str | None = None,
) -> DataFrame:
    """Sizes, means, medians and the rank-sum test of two groups, all from one ordered pass.

    ``method`` and ``used`` as in ``rank_sum_test``.
    """
    keys = list(keys)
    two = df.where(F.col(group).isin(high, low))
    is_high = (F.col(group) == high).cast("bigint")
    steps = ladder(two, keys, value, {"_n": F.lit(1), "_h": is_high, "_l": 1 - is_high})
    rank = F.col("_n_before") + (F.col("_n") + 1) / 2.0
    tied = F.col("_n").cast("double")
    number = F.col(value).cast("double")

    def middle(w: str) -> Column:
        """Mean of the two middle values of one group, which are equal for odd sizes."""
        last = F.col(w + "_total") - 1
        picks = [
            F.max(F.when((F.col(w + "_before") <= k) & (k < F.col(w + "_before") + F.col(w)), number))
            for k in (F.floor(last / 2), F.ceil(last / 2))
        ]
        return (picks[0] + picks[1]) / 2

    out = steps.groupBy(*keys).agg(
        F.sum("_h").alias("n_high"),
        F.sum("_l").alias("n_low"),
        S.ratio(F.sum(number * F.col("_h")), F.sum("_h")).alias("mean_high"),
        S.ratio(F.sum(number * F.col("_l")), F.sum("_l")).alias("mean_low"),
        middle("_h").alias("median_high"),
        middle("_l").alias("median_low"),
        F.sum(rank * F.col("_h")).alias("_r"),
        F.sum(tied * tied * tied - tied).alias("tie_term"),
    )
    out = out.withColumn("u", F.col("_r") - F.col("n_high") * (F.col("n_high") + 1) / 2.0).drop("_r")
    enough = (F.col("n_high") >= min_n) & (F.col("n_low") >= min_n)
    sizes = F.col("n_high").cast("double"), F.col("n_low").cast("double")
    exact = tails.rank_sum_exact(*sizes, F.col("tie_term"), method)
    tail = tails.rank_sum_tail(F.col("u"), *sizes, F.col("tie_term"), _side(side), exact)
    if used is not None:
        out = out.withColumn(used, F.when(exact, "exact").otherwise("asymptotic"))
    return (
        out.withColumn("p_value", tail)
        .withColumn("p_value", F.when(enough, F.col("p_value")))
        .withColumn("delta", F.col("mean_high") - F.col("mean_low"))
    )


def signed_rank_statistic(df: DataFrame, keys: Sequence[str], diff: str | Column) -> DataFrame:
    """Positive rank sum of the non-zero differences, with counts and the tie term."""
    keys = list(keys)
    work = df.withColumn("_d", S.col(diff)).where(F.col("_d").isNotNull()).withColumn("_a", F.abs("_d"))
    # Zeros sort first in |d|; taking their number off every rank is the same as dropping them.
    steps = ladder(
        work,
        keys,
        "_a",
        {
            "_n": F.lit(1),
            "_p": (F.col("_d") > 0).cast("bigint"),
            "_z": (F.col("_d") == 0).cast("bigint"),
        },
    )
    rank = F.col("_n_before") - F.col("_z_total") + (F.col("_n") + 1) / 2.0
    live = F.col("_a") > 0
    tied = F.col("_n").cast("double")
    return steps.groupBy(*keys).agg(
        F.sum("_n").alias("n_pairs"),
        F.sum("_z").alias("n_zero"),
        F.coalesce(F.sum(F.when(live, rank * F.col("_p"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(live, tied * tied * tied - tied)), F.lit(0.0)).alias("tie_term"),
    )


def signed_rank_test(
    df: DataFrame,
    keys: Sequence[str],
    diff: str | Column,
    side: str | Column = "greater",
    min_n: int = 3,
    p: str = "p_value",
    method: str = "auto",
    used: str | None = None,
) -> DataFrame:
    """Wilcoxon signed-rank test; NULL p below ``min_n`` pairs or when all differences are zero.

    ``method`` is exact, asymptotic or auto (exact for at most 50 pairs without ties
    or zeros); ``used`` names a column that says which one was taken.
    """
    stat = signed_rank_statistic(df, keys, diff)
    live = F.col("n_pairs") - F.col("n_zero")
    exact = tails.signed_rank_exact(live, F.col("tie_term"), F.col("n_zero"), method)
    tail = tails.signed_rank_tail(F.col("w_plus"), live.cast("double"), F.col("tie_term"), _side(side), exact)
    if used is not None:
        stat = stat.withColumn(used, F.when(exact, "exact").otherwise("asymptotic"))
    return stat.withColumn(p, tail).withColumn(
        p, F.when((F.col("n_pairs") >= min_n) & (F.col("n_pairs") > F.col("n_zero")), F.col(p))
    )


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 3, out: str = "rho") -> DataFrame:
    """Rank correlation on complete pairs.

    Groups of ordinary size are ranked by both columns in one shuffle; a hot group is ranked in slices and joined.
    """
    keys = list(keys)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    if is_small(pairs) or not hot_groups(pairs, keys):

        def middle(c: str) -> Column:
            """Mean of the first and the last rank of the rows that share a value."""
            order = Window.partitionBy(*keys).orderBy(c)
            last = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            return (F.rank().over(order) + last) / 2.0

        ranked = pairs.withColumn("_rx", middle(x)).withColumn("_ry", middle(y))
    else:
        rx = average_ranks(pairs, keys, x, "_rx").select(*keys, x, "_rx")
        ry = average_ranks(pairs, keys, y, "_ry").select(*keys, y, "_ry")
        ranked = attach(attach(pairs, rx, [*keys, x]), ry, [*keys, y])
    stat = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.corr("_rx", "_ry").alias(out)
    )
    return stat.withColumn(out, F.when((F.col("n_pairs") >= min_n) & ~F.isnan(out), F.col(out)))


def two_by_two(df: DataFrame, keys: Sequence[str], row: Column, column: Column) -> DataFrame:
    """Cells a, b, c, d of the table of two conditions."""
    return df.groupBy(*keys).agg(
        F.count_if(row & column).alias("a"),
        F.count_if(row & ~column).alias("b"),
        F.count_if(~row & column).alias("c"),
        F.count_if(~row & ~column).alias("d"),
    )


def fisher_test(table: DataFrame, side: str | Column = "two-sided", p: str = "p_value") -> DataFrame:
    """Fisher's exact test, odds ratio and fold enrichment of rows with cells a, b, c, d."""
    cells = [F.col(c).cast("double") for c in "abcd"]
    a, b, c, d = cells
    odds = F.when(b * c > 0, a * d / (b * c)).when(a * d > 0, F.lit(float("inf")))
    fold = S.ratio(S.ratio(a, a + b), S.ratio(a + c, a + b + c + d))
    return (
        table.withColumn(p, tails.fisher_tail(*cells, _side(side)))
        .withColumn("odds_ratio", odds)
        .withColumn("fold_enrichment", fold)
    )


def top_percentile_enrichment(
    ranked: DataFrame, group: Sequence[str], flag: str, percentiles: Sequence[float]
) -> DataFrame:
    """Flagged rows in the top share of each group: cells, recall, expected recall, fold, exact p.

    ``ranked`` has ``rank_in_group`` and ``group_size``. All percentiles are
    counted in one pass and unfolded from the finished group rows.
    """
    group = list(group)
    hit = F.col(flag).cast("boolean")

    def cut(size: str, share: float) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(size) * F.lit(float(share))))

    base = ranked.groupBy(*group).agg(
        F.max("group_size").alias("n_candidates"),
        F.count_if(hit).alias("n_flagged"),
        *[
            F.count_if(hit & (F.col("rank_in_group") <= cut("group_size", s))).alias(f"_a{i}")
            for i, s in enumerate(percentiles)
        ],
    )
    points = F.array(
        *[
            F.struct(
                F.lit(float(s)).alias("percentile"),
                cut("n_candidates", s).alias("top_n"),
                F.col(f"_a{i}").alias("a"),
            )
            for i, s in enumerate(percentiles)
        ]
    )
    rows = base.where(F.col("n_flagged") > 0).withColumn("_pt", F.explode(points))
    cells = rows.select(*group, "n_candidates", "n_flagged", "_pt.*").withColumns(
        {
            "b": F.col("top_n") - F.col("a"),
            "c": F.col("n_flagged") - F.col("a"),
            "d": F.col("n_candidates") - F.col("top_n") - F.col("n_flagged") + F.col("a"),
        }
    )
    return (
        fisher_test(cells, "greater")
        .withColumn("recall_in_top", S.ratio("a", "n_flagged"))
        .withColumn("random_recall", S.ratio("top_n", "n_candidates"))
    )


# ---------------------------------------------------------------- regression


def ols_residuals(
    df: DataFrame, keys: Sequence[str], y: str, x: str, min_n: int = 10, out: str = "residual"
) -> DataFrame:
    """Residuals of a straight-line fit per group; NULL where the fit is not possible.

    The fit is one partial aggregate; its one row per group joins back.
    """
    keys = list(keys)
    usable = F.col(x).isNotNull() & F.col(y).isNotNull()
    fit = (
        df.where(usable)
        .groupBy(*keys)
        .agg(
            F.regr_slope(F.col(y), F.col(x)).alias("_slope"),
            F.regr_intercept(F.col(y), F.col(x)).alias("_icpt"),
            F.count(F.lit(1)).alias("_n"),
            F.var_pop(x).alias("_vx"),
        )
    )
    joined = attach(df, fit, keys)
    good = usable & (F.col("_n") >= min_n) & (F.col("_vx") > 0)
    return joined.withColumn(out, F.when(good, F.col(y) - F.col("_icpt") - F.col("_slope") * F.col(x))).drop(
        "_slope", "_icpt", "_n", "_vx"
    )


@F.pandas_udf(T.StructType([T.StructField("coef", T.DoubleType()), T.StructField("p_value", T.DoubleType())]))
def _solve(n: pd.Series, params: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
    k = int(params.iloc[0]) if len(params) else 1

    def filled(values: pd.Series, size: int) -> np.ndarray:
        gap = [math.nan] * size
        return np.array([gap if v is None else v for v in values], dtype=float).reshape(len(values), size)

    coef, p = solve_centred(n.to_numpy(float), filled(xx, k * k).reshape(-1, k, k), filled(xy, k), yy.to_numpy(float))
    return pd.DataFrame({"coef": coef, "p_value": p}, dtype="float64")


def solve_centred(n: np.ndarray, cross: np.ndarray, towards: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First coefficient and its two-sided p-value of many centred regressions; NaN where there is none.

    ``cross`` (groups, k, k), ``towards`` (groups, k) and ``spread`` are population covariances of the k
    variables with each other, with the outcome, and the outcome's variance.
    """
    k = cross.shape[1]
    coef, p = np.full(len(n), math.nan), np.full(len(n), math.nan)
    scale = np.diagonal(cross, axis1=1, axis2=2)
    good = (n - k - 1 > 0) & (spread > 0) & np.isfinite(cross).all((1, 2)) & np.isfinite(towards).all(1) & (scale > 0).all(1)
    at = np.flatnonzero(good)
    root = np.sqrt(scale[at])
    unit = cross[at] / (root[:, :, None] * root[:, None, :])
    full = np.linalg.matrix_rank(unit, tol=1e-10) == k if len(at) else np.zeros(0, dtype=bool)
    at, root, unit = at[full], root[full], unit[full]
    if not len(at):
        return coef, p
    inverse, b = np.linalg.inv(unit), towards[at]
    beta = (inverse @ (b / root)[:, :, None])[:, :, 0] / root
    dof = n[at] - k - 1
    mse = np.maximum(0.0, n[at] * (spread[at] - (beta * b).sum(1))) / dof
    se = np.sqrt(np.maximum(0.0, mse * inverse[:, 0, 0] / scale[at, 0] / n[at]))
    coef[at] = beta[:, 0]
    live = se > 0
    tails_of = [student_p(t, d) for t, d in zip((beta[live, 0] / se[live]).tolist(), dof[live].tolist())]
    p[at[live]] = np.array(tails_of, dtype=float)
    return coef, p


def ols_coefficient(
    df: DataFrame, keys: Sequence[str], y: str, x: str, covariates: Sequence[str] = (), prefix: str = ""
) -> DataFrame:
    """Coefficient of ``x`` and its t-test p-value with up to three covariates.

    Covariances are Spark aggregates; the 4 by 4 system of a finished group is
    solved on its one aggregated row.
    """
    keys = list(keys)
    xs = [x, *covariates]
    complete = F.col(y).isNotNull()
    for c in xs:
        complete = complete & F.col(c).isNotNull()
    rows = df.where(complete)
    cross = F.array(*[F.covar_pop(F.col(a), F.col(b)) for a in xs for b in xs])
    towards = F.array(*[F.covar_pop(F.col(a), F.col(y)) for a in xs])
    stat = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(prefix + "n_samples"),
        cross.alias("_xx"),
        towards.alias("_xy"),
        F.var_pop(y).alias("_yy"),
    )
    solved = stat.withColumn(
        "_fit", _solve(F.col(prefix + "n_samples").cast("double"), F.lit(len(xs)), F.col("_xx"), F.col("_xy"), F.col("_yy"))
    )
    return solved.select(
        *keys,
        prefix + "n_samples",
        F.when(~F.isnan("_fit.coef"), F.col("_fit.coef")).alias(prefix + "coef"),
        F.when(~F.isnan("_fit.p_value"), F.col("_fit.p_value")).alias(prefix + "p_value"),
    )


# ------------------------------------------------------------------- density


def kernel_density(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    low: float = 0.0,
    high: float = 1.0,
    points: int = 101,
    rule: str = "scott",
    single_width: float = 0.03,
    floor: float = 0.03,
) -> DataFrame:
    """Gaussian kernel density on a fixed grid, by group.

    ``scott``: bandwidth sd * n**-0.2; ``normal``: 1.06 * sd * n**-0.2, at least ``floor``.
    A group with a single value gets a bell of ``single_width`` whose grid sum is one.
    Equal values are combined first; each row adds to the grid sums of its task,
    so only grid-sized sums are shuffled.
    """
    keys = list(keys)
    weights = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_total")
    stats = df.groupBy(*keys).agg(F.count(value).alias("_total"), F.stddev_samp(value).alias("_sd"))
    if rule == "scott":
        width = F.col("_sd") * F.pow(n.cast("double"), F.lit(-0.2))
    else:
        width = F.greatest(F.lit(1.06) * F.col("_sd") * F.pow(n.cast("double"), F.lit(-0.2)), F.lit(floor))
    single = F.col("_sd").isNull() | (F.col("_sd") == 0)
    step = (high - low) / (points - 1)
    rows = (
        attach(weights, stats, keys)
        .withColumn("_single", single)
        .withColumn("_h", F.when(single, F.lit(single_width)).otherwise(width))
        .withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.round(F.lit(low) + F.col("_g") * F.lit(step), 10))
    )
    z = (F.col("x") - F.col(value)) / F.col("_h")
    bell = F.exp(-0.5 * z * z)
    norm = n * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    sums = rows.groupBy(*keys, "x").agg(
        F.sum(F.when(F.col("_single"), bell).otherwise(F.col("_n") * bell / norm)).alias("density"),
        F.max("_single").alias("_single"),
    )
    # A single-value bell is scaled to unit area under the trapezoid rule.
    edge = F.when((F.col("x") == F.lit(float(low))) | (F.col("x") == F.lit(float(high))), 0.5).otherwise(1.0)
    area = sums.groupBy(*keys).agg((F.sum(F.col("density") * edge) * F.lit(step)).alias("_area"))
    return (
        attach(sums, area, keys)
        .withColumn("density", F.when(F.col("_single"), F.col("density") / F.col("_area")).otherwise(F.col("density")))
        .drop("_single", "_area")
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts on equal bins; the last bin includes the upper edge."""
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    number = F.least(F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
    return inside.groupBy(*keys, number.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- pooled effects


def fixed_effect(df: DataFrame, keys: Sequence[str], effect: str, se: str) -> DataFrame:
    """Inverse-variance pooled effect with a 95 % interval."""
    good = df.where((F.col(se) > 0) & F.col(effect).isNotNull())
    w = 1.0 / (F.col(se) * F.col(se))
    pooled = good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_effects"),
        (F.sum(w * F.col(effect)) / F.sum(w)).alias("pooled_effect"),
        F.sqrt(1.0 / F.sum(w)).alias("pooled_se"),
    )
    return pooled.withColumn("ci_lower", F.col("pooled_effect") - 1.96 * F.col("pooled_se")).withColumn(
        "ci_upper", F.col("pooled_effect") + 1.96 * F.col("pooled_se")
    )


def row_zscore(df: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """Value standardised by its group's mean and population deviation; NULL for constant groups.

    Aggregate and join back, so that a hot group is not collected in a window.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return attach(df, stats, keys).withColumn(out, S.ratio(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")
