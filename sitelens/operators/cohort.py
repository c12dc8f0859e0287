"""Cohort operators: sample splits, target contrasts, activity, confounders.

All matrices are long: one row per (cohort, entity, sample). The site is a key
column, so one plan serves every site of every cohort.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.operators.aggregates import matrix_row_stats
from sitelens.operators.products import masked_product, tiled_sums
from sitelens.operators.ordered import SLICE, attach, is_small, lay_out, merge_join, quantiles, row_rank, settle, settled, with_quantiles
from sitelens.operators.rank_tests import (
    ols_coefficient,
    ols_residuals,
    row_zscore,
    signed_rank_test,
    solve_centred,
    spearman,
    two_group_test,
)
from sitelens.operators.ranking import benjamini_hochberg

SPLIT_MODES = ("median_nonmissing", "observed_missing", "quantile_extreme")


def variable_sites(
    long: DataFrame,
    keys: Sequence[str],
    value: str,
    mode: str,
    min_group: int = 5,
    min_nonzero: float = 0.1,
    max_nonzero: float = 1.01,
) -> DataFrame:
    """Row statistics of the sites that a split mode can use."""
    keys = list(keys)
    stats = matrix_row_stats(long, keys, value)
    if mode == "observed_missing":
        return stats.where((F.col("n_observed") >= min_group) & (F.col("n_missing") >= min_group))
    if mode == "quantile_extreme":
        return stats.where(
            (F.col("nonzero_ratio") > min_nonzero)
            & (F.col("nonzero_ratio") < max_nonzero)
            & (F.col("n_observed") >= 2 * min_group)
        )
    if mode != "median_nonmissing":
        raise ValueError(f"mode must be one of {SPLIT_MODES}")
    sides = (
        attach(long.where(F.col(value).isNotNull()), stats.select(*keys, "median_value"), keys)
        .groupBy(*keys)
        .agg(
            F.count_if(F.col(value) >= F.col("median_value")).alias("n_high"),
            F.count_if(F.col(value) < F.col("median_value")).alias("n_low"),
        )
    )
    return stats.join(sides, keys).where((F.col("n_high") >= min_group) & (F.col("n_low") >= min_group))


def split_samples(
    long: DataFrame,
    keys: Sequence[str],
    sample: str,
    value: str,
    mode: str = "median_nonmissing",
    min_group: int = 5,
    fraction: float = 0.25,
    drop_zero: bool = False,
    sample_order: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """High and low samples of every site, and one status row per site.

    Returns (members, summary): ``members`` has ``side`` high or low for sites
    with status success only. ``sample_order`` is the unique numeric tie-break
    of the extreme split.
    """
    if mode not in SPLIT_MODES:
        raise ValueError(f"mode must be one of {SPLIT_MODES}")
    keys = list(keys)
    usable = F.col(value).isNotNull()
    if drop_zero:
        usable = usable & (F.col(value) > 0)
    layout = lay_out(long.withColumn("_ok", usable), keys, value)
    rows = layout.df.drop(SLICE)
    kept = F.when(F.col("_ok"), F.col(value))
    order = sample_order or sample

    def over_sites(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        """Aggregates of each site on its rows; sites of ordinary size need one shuffle for all of them."""
        if not layout.cut:
            w = Window.partitionBy(*keys)
            return df.select("*", *[c.over(w).alias(n) for n, c in aggs.items()])
        return attach(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)

    rows = over_sites(
        rows,
        {
            "n_matched": F.count(F.lit(1)),
            "n_observed": F.count(value),
            "n_missing": F.count(F.when(F.col(value).isNull(), 1)),
            "n_valid": F.count(kept),
        },
    )
    if mode == "observed_missing":
        rows = rows.withColumn("median_cutoff", F.lit(None).cast("double"))
        side = F.when(F.col("_ok"), "high").when(F.col(value).isNull(), "low")
    else:
        if layout.cut:
            rows = attach(rows, quantiles(rows.where("_ok"), keys, value, {"median_cutoff": 0.5}), keys)
        else:
            rows = over_sites(rows, {"median_cutoff": F.percentile(kept, 0.5)})
        side = F.when(F.col("_ok"), F.when(F.col(value) >= F.col("median_cutoff"), "high").otherwise("low"))
    if mode == "quantile_extreme":
        rows = row_rank(rows.withColumn("_v", kept), keys, "_v", order, "_up", ascending=True).drop("_v")
        size = F.least(
            F.greatest(F.floor(F.col("n_valid") * F.lit(fraction)), F.lit(min_group)), F.floor(F.col("n_valid") / 2)
        )
        side = F.when(
            F.col("_ok"),
            F.when(F.col("_up") <= size, "low").when(F.col("_up") > F.col("n_valid") - size, "high"),
        )
    rows = rows.withColumn("side", side)
    low = F.when(F.col("side") == "low", F.col(value))
    high = F.when(F.col("side") == "high", F.col(value))
    rows = over_sites(
        rows,
        {
            "n_low": F.count(F.when(F.col("side") == "low", 1)),
            "n_high": F.count(F.when(F.col("side") == "high", 1)),
            "low_cutoff": F.max(low),
            "high_cutoff": F.min(high),
            "low_mean": F.avg(low),
            "high_mean": F.avg(high),
        },
    )
    few = (F.col("n_low") < min_group) | (F.col("n_high") < min_group)
    if mode == "observed_missing":
        status = F.when(few, "insufficient_observed_or_missing_samples")
    else:
        status = F.when(F.col("n_valid") < 2 * min_group, "insufficient_valid_samples").when(
            few, "insufficient_median_split_samples" if mode == "median_nonmissing" else "insufficient_group_size"
        )
    rows = rows.withColumn("status", status.otherwise("success"))
    members = rows.where((F.col("status") == "success") & F.col("side").isNotNull()).select(*keys, sample, "side")
    per_site = [
        "n_matched", "n_observed", "n_missing", "n_valid", "n_low", "n_high", "median_cutoff",
        "low_cutoff", "high_cutoff", "low_mean", "high_mean", "status",
    ]
    return members, rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in per_site])


def group_means(
    members: DataFrame, targets: DataFrame, expression: DataFrame, cohort: Sequence[str], site: Sequence[str],
    sample: str, gene: str, value: str, extra: Sequence[str] = (),
) -> DataFrame:
    """Mean expression of each target of a site in its high and its low samples.

    ``members`` (cohort, site, sample, side), ``targets`` (site, gene, extra
    columns such as regulation), ``expression`` (cohort, gene, sample, value).
    Members and expression meet in tiles of a matrix product, so no row is made
    for a (member, target) pair.
    """
    cohort, site = list(cohort), list(site)
    members, targets, expression = settled(members), settled(targets), settled(expression)
    named, key = _one_name(members, site)
    asked = merge_join(named.select(*cohort, key).distinct(), _one_name(targets, site)[0].select(key, gene).distinct(), [key])
    held = expression.select(*cohort, F.col(gene).alias("_gene"), F.col(sample).alias("_sample"), F.col(value).alias("_value"))
    cells = masked_product(
        named.select(*cohort, key, F.col(sample).alias("_sample"), "side"), held, asked.withColumnRenamed(gene, "_gene"),
        cohort, key, "_sample", "_gene", "_value", "side", ["low", "high"],
    )
    means = cells.select(*cohort, key, F.col("_gene").alias(gene), "side", (F.col("total") / F.col("n")).alias("group_mean"), F.col("n").alias("n_samples"))
    extras = _one_name(targets.select(*site, gene, *extra).distinct(), site)[0]
    return merge_join(means, extras, [key, gene]).select(*cohort, *site, gene, *extra, "side", "group_mean", "n_samples")


def sites_with_values(
    members: DataFrame, targets: DataFrame, expression: DataFrame, cohort: Sequence[str], site: Sequence[str], sample: str, gene: str
) -> DataFrame:
    """The sites of ``group_means``: those of which a target has an expression row in a high or low sample.

    A site and a target meet as their sets of samples, so nothing is summed and no row is made for a sample of a pair.
    """
    own = members.groupBy(*cohort, *site).agg(F.collect_set(sample).alias("_own"))
    held = expression.groupBy(*cohort, gene).agg(F.collect_set(sample).alias("_held"))
    pairs = own.join(targets.select(*site, gene).distinct(), list(site)).join(held, [*cohort, gene])
    return pairs.where(F.arrays_overlap("_own", "_held")).select(*cohort, *site).distinct()


def _one_name(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, str]:
    """The table with the columns' values as one column: themselves if there is one, their JSON otherwise."""
    own = F.col(columns[0]) if len(columns) == 1 else F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.withColumn("_name", own), "_name"


def high_low_pairs(points: DataFrame, keys: Sequence[str], side: str = "side", value: str = "group_mean") -> DataFrame:
    """High and low mean of each pair side by side; pairs with both only."""
    wide = points.groupBy(*keys).agg(
        F.avg(F.when(F.col(side) == "low", F.col(value))).alias("low_mean"),
        F.avg(F.when(F.col(side) == "high", F.col(value))).alias("high_mean"),
    )
    return wide.where(F.col("low_mean").isNotNull() & F.col("high_mean").isNotNull())


def pair_metadata(
    points: DataFrame, keys: Sequence[str], name: str, site: str, regulator: str, score: str, separator: str = ";"
) -> DataFrame:
    """First name, distinct sites and regulators with their joined names, and mean score of each pair.

    A name that is itself a joined text counts part by part; parts are sorted.
    """

    def names(c: str) -> Column:
        parts = F.flatten(F.collect_set(F.split(F.col(c).cast("string"), re.escape(separator))))
        kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
        return F.array_join(F.array_sort(F.array_distinct(kept)), separator)

    return points.groupBy(*keys).agg(
        F.min(name).alias("first_name"),
        F.countDistinct(site).alias("n_source_sites"),
        F.countDistinct(regulator).alias("n_source_regulators"),
        names(site).alias("source_sites"),
        names(regulator).alias("source_regulators"),
        F.avg(score).alias("mean_score"),
    )


def target_effects(pairs: DataFrame, direction: str, regulation: str) -> DataFrame:
    """High minus low of every pair, and the same in the expected direction."""
    return (
        pairs.withColumn("target_effect", F.col("high_mean") - F.col("low_mean"))
        .withColumn("expected_sign", S.expected_sign(direction, regulation))
        .withColumn("directional_effect", F.col("target_effect") * F.coalesce("expected_sign", F.lit(1)))
    )


def contrast_test(
    pairs: DataFrame,
    keys: Sequence[str],
    direction: str,
    regulation: str,
    fdr_keys: Sequence[str],
    gene: str,
    min_pairs: int = 3,
    site: str | None = None,
) -> DataFrame:
    """High against low over the pairs of each group: means, expected side, signed-rank p and q.

    ``direction`` and ``regulation`` are among ``keys``. With ``site`` the
    number of distinct sites is added (groups pooled over sites).
    """
    keys = list(keys)
    pairs = settled(pairs)
    d = F.round(F.col("high_mean") - F.col("low_mean"), 12)
    counts = [F.countDistinct(site).alias("n_sites")] if site else []
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.countDistinct(gene).alias("n_distinct_targets"),
        *counts,
        F.avg("low_mean").alias("mean_low"),
        F.avg("high_mean").alias("mean_high"),
    )
    test = signed_rank_test(pairs, keys, d, S.expected_alternative(direction, regulation), min_pairs)
    out = (
        attach(sums, test.select(*keys, "w_plus", "p_value"), keys)
        .withColumn("delta", F.col("mean_high") - F.col("mean_low"))
        .withColumn("expected", S.expected_text(direction, regulation))
        .withColumn("directional_delta", S.directional_effect("delta", direction, regulation))
    )
    out = benjamini_hochberg(out, fdr_keys, "p_value")
    return out.withColumn("stars", S.stars("p_value")).withColumn("stars_q", S.stars("q_value"))


def summarize_effects(effects: DataFrame, keys: Sequence[str], min_n: int = 3) -> DataFrame:
    """Per site: number, mean and median of raw and directional effects, one-sided test, q over all sites."""
    keys = list(keys)
    effects = settled(effects)
    middle = {"median_effect": ("target_effect", 0.5), "median_directional": ("directional_effect", 0.5)}
    sums = with_quantiles(
        effects,
        keys,
        middle,
        [
            F.count("directional_effect").alias("n_targets"),
            F.avg("target_effect").alias("mean_effect"),
            F.avg("directional_effect").alias("mean_directional"),
        ],
    )
    test = signed_rank_test(effects, keys, F.round("directional_effect", 12), "greater", min_n)
    out = sums
    out = attach(out, test.select(*keys, "w_plus", "p_value"), keys)
    return benjamini_hochberg(out, [], "p_value").withColumn("stars", S.stars("p_value"))


def regulator_activity(
    members: DataFrame, targets: DataFrame, expression: DataFrame, cohort: Sequence[str], site: Sequence[str],
    sample: str, gene: str, value: str, regulation: str = "regulation", by: Sequence[str] = (),
) -> DataFrame:
    """Activity per (cohort, site, sample): mean z of activated minus mean z of repressed targets.

    ``by`` names further columns of ``targets``, as the direction, that are kept apart. One side alone counts as it is (or negated) when the other is empty.
    """
    cohort, site, by = list(cohort), list(site), list(by)
    targets, expression = settled(targets), settled(expression)
    z = row_zscore(expression, [*cohort, gene], value, "_z").select(*cohort, F.col(gene).alias("_gene"), F.col(sample).alias("_sample"), F.col("_z").alias("_value"))
    own = targets.select(*site, *by, gene, regulation).distinct()
    wanted = members.select(*cohort, *site, sample, "side").join(own.select(*site, *by).distinct(), site)
    if not is_small(wanted, 4):  # the four steps below read it
        wanted = settle(wanted)
    named, key = _one_name(wanted, [*site, *by])
    signs = _one_name(merge_join(named.select(*cohort, *site, *by).distinct(), own, [*site, *by]), [*site, *by])[0]
    cells = masked_product(
        signs.select(*cohort, key, F.col(gene).alias("_gene"), F.col(regulation).alias("_part")), z,
        named.select(*cohort, key, F.col(sample).alias("_sample")).distinct(),
        cohort, key, "_gene", "_sample", "_value", "_part", ["activate", "repress"],
    )
    act, rep = F.col("_part") == "activate", F.col("_part") == "repress"
    sides = cells.groupBy(*cohort, key, F.col("_sample").alias(sample)).agg(
        F.max(F.when(act, F.col("total") / F.col("n"))).alias("positive_score"),
        F.max(F.when(rep, F.col("total") / F.col("n"))).alias("negative_score"),
        F.coalesce(F.max(F.when(act, F.col("n_rows"))), F.lit(0)).alias("n_positive_targets"),
        F.coalesce(F.max(F.when(rep, F.col("n_rows"))), F.lit(0)).alias("n_negative_targets"),
    )
    if len(site) + len(by) == 1:  # joined by its own name, so that a later join on it needs no second shuffle
        named, sides, key = named.drop(key), sides.withColumnRenamed(key, [*site, *by][0]), [*site, *by][0]
    out = merge_join(named, sides, [*cohort, key, sample]).select(
        *cohort, *site, *by, sample, "side", "positive_score", "negative_score", "n_positive_targets", "n_negative_targets"
    )
    activity = (
        F.when((F.col("n_positive_targets") > 0) & (F.col("n_negative_targets") > 0),
               F.col("positive_score") - F.col("negative_score"))
        .when(F.col("n_positive_targets") > 0, F.col("positive_score"))
        .otherwise(-F.col("negative_score"))
    )
    return out.withColumn("activity", activity)


def activity_test(
    activity: DataFrame, keys: Sequence[str], fdr_keys: Sequence[str], min_n: int = 3, direction: str | None = None
) -> DataFrame:
    """Activity of high against low samples: sizes, means, medians, rank test and q.

    ``direction``, one of the keys, decides the alternative: import expects more
    activity in high samples, export less, anything else is tested on both sides.
    """
    rounded = activity.withColumn("activity", F.round("activity", 12))
    if direction is None:
        side = F.lit("two-sided")
    else:
        way = F.lower(F.col(direction))
        side = F.when(way == "import", "greater").when(way == "export", "less").otherwise("two-sided")
    out = two_group_test(rounded, keys, "side", "activity", side=side, min_n=min_n).drop("tie_term").withColumn("alternative", side)
    return benjamini_hochberg(out, fdr_keys, "p_value").withColumn("stars", S.stars("p_value"))


def covariate_frame(
    samples: DataFrame, sources: dict[str, DataFrame], keys: Sequence[str], value: str = "value"
) -> DataFrame:
    """One column per covariate at every (key, sample); ``sources`` maps a name to a long table."""
    out = samples
    for name, table in sources.items():
        out = out.join(table.select(*keys, F.col(value).alias(name)), list(keys), "left")
    return out


def residual_expression(
    expression: DataFrame, covariates: DataFrame, cohort: Sequence[str], gene: str, sample: str, value: str, covariate: str,
    min_n: int = 10, site: Sequence[str] = (),
) -> DataFrame:
    """Expression with a covariate's straight-line effect taken out, per (cohort, site, gene)."""
    joined = expression.join(covariates.select(*cohort, *site, sample, covariate), [*cohort, sample], "inner")
    return ols_residuals(joined, [*cohort, *site, gene], value, covariate, min_n)


def adjusted_association(
    rows: DataFrame, keys: Sequence[str], y: str, x: str, covariates: Sequence[str], fdr_keys: Sequence[str], min_samples: int = 10
) -> DataFrame:
    """Coefficient of the site value on the outcome with covariates, per key, with q.

    Keys with fewer than ``min_samples`` complete rows keep their count; coefficient and p are NULL.
    """
    return _corrected(ols_coefficient(rows, keys, y, x, covariates), fdr_keys, min_samples)


def _corrected(fit: DataFrame, fdr_keys: Sequence[str], min_samples: int) -> DataFrame:
    enough = F.col("n_samples") >= min_samples
    fit = fit.withColumn("coef", F.when(enough, F.col("coef"))).withColumn("p_value", F.when(enough, F.col("p_value")))
    return benjamini_hochberg(fit, fdr_keys, "p_value").withColumn("stars", S.stars("q_value"))


def adjusted_target_association(
    rows: DataFrame, targets: DataFrame, expression: DataFrame, cohort: Sequence[str], site: Sequence[str], sample: str, gene: str,
    y: str, x: str, covariates: Sequence[str], fdr_keys: Sequence[str], min_samples: int = 10, extra: Sequence[str] = (),
) -> DataFrame:
    """``adjusted_association`` of every target of a site, per (cohort, site, gene, extra).

    ``rows`` (cohort, site, sample, x, covariates), ``targets`` (site, gene, extra columns such as regulation),
    ``expression`` (cohort, gene, sample, y). Rows and expression meet in tiles of a matrix product, which yields the
    sums of each regression, so no row is made for a sample of a (site, target) pair.
    """
    cohort, site, xs = list(cohort), list(site), [x, *covariates]
    k = len(xs)
    rows, targets, expression = settled(rows.select(*cohort, *site, sample, *xs)), settled(targets), settled(expression)
    for c in (*cohort, sample, *xs):
        rows = rows.where(F.col(c).isNotNull())
    named, key = _one_name(rows, site)
    asked = merge_join(
        named.select(*cohort, key).distinct(),
        _one_name(targets, site)[0].where(F.col(gene).isNotNull()).select(key, F.col(gene).alias("_gene")).distinct(), [key])
    own = named.select(*cohort, key, F.col(sample).alias("_sample"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(xs)])
    held = expression.where(F.col(sample).isNotNull() & F.col(y).isNotNull()).select(
        *cohort, F.col(gene).alias("_gene"), F.col(sample).alias("_sample"), F.col(y).alias("_y"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def powers(v: np.ndarray) -> list[np.ndarray]:
        """Ones, the values, their products and a mark of what is no number, which would spoil the other cells."""
        bad = ~np.isfinite(v).all(0)
        v = np.where(bad, 0.0, v)
        return [np.ones(len(bad)), *v, *[v[i] * v[j] for i in range(len(v)) for j in range(i, len(v))], bad.astype(float)]

    products = [(i, 0) for i in range(1 + k + len(pairs) + 1)] + [(0, 1), (0, 2), (0, 3)] + [(1 + i, 1) for i in range(k)]

    def finish(sums: list[np.ndarray]) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        at = np.flatnonzero(sums[0])
        n, *means = (s[at] for s in sums)
        means = [s / n for s in means]
        first, second, (bad, my, myy, bad_y), towards = means[:k], means[k:-k - 4], means[-k - 4:-k], means[-k:]

        def left_over(total: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
            """A covariance; a variance that is only the rounding of its sums is 0."""
            out = total - a * b
            return np.where(out <= 1e-13 * total, 0.0, out) if same else out

        cross = np.empty((len(at), k, k))
        for (i, j), total in zip(pairs, second):
            cross[:, i, j] = cross[:, j, i] = left_over(total, first[i], first[j], i == j)
        to_y = np.column_stack([t - f * my for t, f in zip(towards, first)])
        spread = np.where(bad + bad_y > 0, np.nan, left_over(myy, my, my, True))
        coef, p = solve_centred(n, cross, to_y, spread)
        yield at, {
            "n_samples": pa.array(n.astype(np.int64)), "coef": pa.array(coef, mask=np.isnan(coef)), "p_value": pa.array(p, mask=np.isnan(p))
        }

    fit = tiled_sums(
        own, held, asked, cohort, key, "_sample", "_gene", [f"_x{i}" for i in range(k)], ["_y"], powers, powers, products, finish,
        "n_samples bigint, coef double, p_value double", centred=True,
    ).withColumnRenamed("_gene", gene)
    extras = _one_name(targets.select(*site, gene, *extra).distinct(), site)[0]
    fit = merge_join(fit, extras, [key, gene]).select(*cohort, *site, gene, *extra, "n_samples", "coef", "p_value")
    return _corrected(fit, fdr_keys, min_samples)


def abundance_diagnostic(rows: DataFrame, keys: Sequence[str], value: str, abundance: str, min_n: int = 3) -> DataFrame:
    """Does the regulator's abundance differ between the sides, and does it follow the site value?

    ``rows`` has keys, side, the site value and the abundance.
    """
    keys = list(keys)
    rows = settled(rows.select(*keys, "side", value, abundance))
    test = two_group_test(rows, keys, "side", abundance, min_n=min_n).drop("tie_term")
    rho = spearman(rows, keys, value, abundance).select(*keys, "rho")
    return attach(test, rho, keys).withColumn("higher_in_high", F.col("delta") > 0)


def abundance_diagnostics(rows: DataFrame, keys: Sequence[str], value: str, abundances: Sequence[str], min_n: int = 3) -> DataFrame:
    """``abundance_diagnostic`` of several abundances side by side: <name>_mean_low, _mean_high, _p, _rho, _higher_in_high."""
    out = None
    for name in abundances:
        one = abundance_diagnostic(rows.where(F.col(name).isNotNull()), keys, value, name, min_n).select(
            *keys,
            F.col("mean_low").alias(f"{name}_mean_low"),
            F.col("mean_high").alias(f"{name}_mean_high"),
            F.col("p_value").alias(f"{name}_p"),
            F.col("rho").alias(f"{name}_rho"),
            F.col("higher_in_high").alias(f"{name}_higher_in_high"),
        )
        out = one if out is None else out.join(one, list(keys), "full")
    return out


def robustness_summary(
    base: DataFrame,
    keys: Sequence[str],
    diagnostics: DataFrame | None = None,
    abundances: Sequence[str] = (),
    ratio: DataFrame | None = None,
    adjusted_targets: DataFrame | None = None,
    adjusted_activity: DataFrame | None = None,
    gene: str = "gene",
) -> DataFrame:
    """Left joins of the sensitivity parts to the sites; columns of a part that was not run are NULL, not false.

    ``diagnostics`` as from ``abundance_diagnostics``; ``ratio`` and
    ``adjusted_targets`` may have several rows a site (regulations, targets).
    A site is flagged where an abundance differs between its sides at p < 0.05.
    """
    keys, out = list(keys), base
    if diagnostics is not None:
        out = merge_join(out, diagnostics, keys, "left")
    if ratio is not None:
        site = ratio.groupBy(*keys).agg(
            F.avg("mean_directional").alias("ratio_mean_directional"), F.min("p_value").alias("ratio_p"), F.min("q_value").alias("ratio_q")
        )
        out = merge_join(out, site, keys, "left")
    if adjusted_targets is not None:
        site = adjusted_targets.groupBy(*keys).agg(
            F.countDistinct(gene).alias("n_adjusted_targets"),
            F.avg("directional_coef").alias("mean_directional_coef"),
            F.avg(F.coalesce(F.col("p_value") < 0.05, F.lit(False)).cast("double")).alias("share_adjusted_significant"),
        )
        out = merge_join(out, site, keys, "left")
    if adjusted_activity is not None:
        own = adjusted_activity.select(*keys, F.col("coef").alias("activity_coef"), F.col("p_value").alias("activity_p"))
        out = merge_join(out, own, keys, "left")
    flag = lambda c: F.coalesce(F.col(c) < 0.05, F.lit(False))
    missing = F.lit(None).cast("boolean")
    confounded = [flag(f"{n}_p") for n in abundances] if diagnostics is not None else []
    return out.withColumns(
        {
            "ratio_significant": flag("ratio_p") if ratio is not None else missing,
            "activity_significant": flag("activity_p") if adjusted_activity is not None else missing,
            "possible_confounding": reduce(lambda a, b: a | b, confounded) if confounded else missing,
        }
    )


def site_status(
    sites: DataFrame, steps: Sequence[tuple[DataFrame, str]], keys: Sequence[str], counts: DataFrame | None = None
) -> DataFrame:
    """Status of every site: the first step it does not pass, else success.

    Each step is a table of the keys that pass it, with the status of the others.
    """
    out = sites
    status: Column | None = None
    for i, (passed, name) in enumerate(steps):
        out = out.join(passed.select(*keys).distinct().withColumn(f"_s{i}", F.lit(True)), list(keys), "left")
        missed = F.col(f"_s{i}").isNull()
        status = F.when(missed, name) if status is None else status.when(missed, name)
    out = out.withColumn("status", status.otherwise("success") if status is not None else F.lit("success"))
    out = out.drop(*[f"_s{i}" for i in range(len(steps))])
    return out.join(counts, list(keys), "left") if counts is not None else out


def target_counts(points: DataFrame, keys: Sequence[str], gene: str, regulation: str) -> DataFrame:
    """Distinct targets, and those activated and repressed."""
    return points.groupBy(*keys).agg(
        F.countDistinct(gene).alias("n_targets"),
        F.countDistinct(F.when(F.col(regulation) == "activate", F.col(gene))).alias("n_activated"),
        F.countDistinct(F.when(F.col(regulation) == "repress", F.col(gene))).alias("n_repressed"),
    )


def cohort_activity_summary(activity: DataFrame, test: DataFrame, cohort: str, order: Sequence[str]) -> DataFrame:
    """Cohort rows of an activity test in a fixed order of cohorts; others follow by name."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(cohort))
    sizes = activity.groupBy(cohort).agg(F.count(F.lit(1)).alias("n_samples"))
    joined = sizes.join(test, cohort, "left")
    w = Window.orderBy(F.when(place == 0, F.lit(len(order) + 1)).otherwise(place), F.col(cohort))
    return joined.withColumn("cohort_order", F.row_number().over(w))


def cohort_pair_summary(pairs: DataFrame, cohort: str, gene: str, site: str, min_pairs: int = 3) -> DataFrame:
    """Pairs, distinct targets and sites, means and difference by cohort; cohorts with enough pairs."""
    return (
        pairs.groupBy(cohort)
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.countDistinct(gene).alias("n_distinct_targets"),
            F.countDistinct(site).alias("n_distinct_sites"),
            F.avg("low_mean").alias("mean_low"),
            F.avg("high_mean").alias("mean_high"),
        )
        .where(F.col("n_pairs") >= min_pairs)
        .withColumn("delta", F.col("mean_high") - F.col("mean_low"))
    )
