"""Group summaries, pivots, string roll-ups, thresholds, plans and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.operators.clean import InvalidInput
from sitelens.operators.ordered import attach, ladder, quantiles, settled, with_quantiles


def mean_std(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], population: bool = False, count: str | None = None
) -> DataFrame:
    """Mean and standard deviation of the columns by group."""
    std = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(c + "_mean"), std(c).alias(c + "_std")]
    if count:
        aggs.append(F.countDistinct(count).alias("n_" + count))
    return df.groupBy(*keys).agg(*aggs)


def melted_mean_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per metric with its overall mean and sample deviation."""
    long = df.unpivot([], list(columns), "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, median, minimum and maximum by group."""
    return with_quantiles(
        df,
        keys,
        {"median": (value, 0.5)},
        [
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        ],
    )


def expression_summary(df: DataFrame, keys: Sequence[str], target: str, value: str) -> DataFrame:
    """Size, distinct targets, mean and median by group."""
    return with_quantiles(
        df,
        keys,
        {"median_value": (value, 0.5)},
        [
            F.count(F.lit(1)).alias("n_points"),
            F.countDistinct(target).alias("n_targets"),
            F.avg(value).alias("mean_value"),
        ],
    )


def joined_values(
    df: DataFrame, keys: Sequence[str], text: str, out: str, order: str | None = None, separator: str = ";"
) -> DataFrame:
    """Distinct parts of ``;``-separated texts by group, joined again.

    In order of first appearance by ``order``, or sorted when it is not given.
    Parts are made distinct before they are collected, so the collected array
    is as long as the text it becomes.
    """
    parts = df.where(F.col(text).isNotNull()).select(
        *keys,
        *([F.col(order).alias("_o")] if order else []),
        F.posexplode(F.split(F.col(text), r"\s*;\s*")).alias("_i", "_part"),
    )
    parts = parts.withColumn("_part", F.trim("_part")).where(F.col("_part") != "")
    if order:
        firsts = parts.groupBy(*keys, "_part").agg(F.min(F.struct("_o", "_i")).alias("_at"))
        items = F.sort_array(F.collect_list(F.struct("_at", "_part")))
        return firsts.groupBy(*keys).agg(
            F.array_join(F.transform(items, lambda s: s["_part"]), separator).alias(out)
        )
    distinct = parts.select(*keys, "_part").distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("_part")), separator).alias(out))


def collapse_edges(
    edges: DataFrame, source: str, target: str, weight: str, joined: Sequence[str] = (), order: str | None = None
) -> DataFrame:
    """One signed edge per pair of names: mean weight, edge and sign counts, conflict flag, regulation.

    Names meet trimmed and in capitals; the edge shows the first spelling by
    ``order`` (the least spelling without it). Edges without a name, and of
    weight 0 or none, are left out. ``joined`` names ``;``-separated text columns
    (resources, references, sign decisions) whose distinct parts are joined in
    the order of their first appearance.
    """
    keys = ["_source", "_target"]
    rows = edges.withColumn("_source", S.name_key(F.col(source).cast("string"))).withColumn("_target", S.name_key(F.col(target).cast("string")))
    rows = rows.where((F.col(weight) != 0) & (F.col("_source") != "") & (F.col("_target") != ""))
    first = (lambda c: F.min_by(c, order)) if order else F.min
    # Three marks instead of a distinct count, which would send every edge twice.
    odd = F.isnan(F.col(weight).cast("double"))
    n_signs = sum(F.max(mark.cast("bigint")) for mark in (odd, ~odd & (F.col(weight) > 0), ~odd & (F.col(weight) < 0)))
    grouped = rows.groupBy(*keys).agg(
        first(source).alias(source),
        first(target).alias(target),
        F.avg(weight).alias("mean_weight"),
        F.count(F.lit(1)).alias("n_edges"),
        n_signs.alias("n_signs"),
    )
    for c in joined:
        texts = joined_values(rows, keys, c, "_text", order)
        grouped = grouped.join(texts, keys, "left").withColumn(c, F.coalesce("_text", F.lit(""))).drop("_text")
    return (
        grouped.drop(*keys)
        .withColumn("sign_conflict", F.col("n_signs") > 1)
        .withColumn("sign", F.signum("mean_weight").cast("int"))
        .where(F.col("sign") != 0)
        .withColumn("regulation", F.when(F.col("sign") > 0, "activate").otherwise("repress"))
    )


def classify_evidence(
    evidence: DataFrame,
    regulator: str,
    target: str,
    experiment: str,
    score: str,
    above: float,
    min_share: float,
) -> DataFrame:
    """Targets with enough experiments scoring above the limit, with their score statistics."""
    total = evidence.groupBy(regulator).agg(F.countDistinct(experiment).alias("n_experiments"))
    stats = with_quantiles(
        evidence,
        [regulator, target],
        {"median_score": (score, 0.5)},
        [
            F.count_if(F.col(score) > above).alias("hit_count"),
            F.avg(score).alias("mean_score"),
            F.max(score).alias("max_score"),
        ],
    )
    needed = F.greatest(F.lit(1), F.ceil(F.col("n_experiments") * F.lit(min_share)))
    return (
        stats.join(total, regulator)
        .withColumn("hit_fraction", F.col("hit_count") / F.greatest("n_experiments", F.lit(1)))
        .where(F.col("hit_count") >= needed)
    )


def matrix_row_stats(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Non-zero, observed and missing shares and counts, and the median, of each matrix row."""
    observed = F.col(value).isNotNull()
    return with_quantiles(
        long,
        keys,
        {"median_value": (value, 0.5)},
        [
            F.avg(F.coalesce((F.col(value) > 0).cast("double"), F.lit(0.0))).alias("nonzero_ratio"),
            F.avg(observed.cast("double")).alias("observed_ratio"),
            F.avg((~observed).cast("double")).alias("missing_ratio"),
            F.count(value).alias("n_observed"),
            F.count_if(~observed).alias("n_missing"),
        ],
    )


def ensemble(
    folds: DataFrame,
    site: Sequence[str],
    prob: str,
    fold: str = "fold",
    expected_folds: int | None = None,
    population: bool = False,
) -> DataFrame:
    """Mean, deviation and count of the fold scores of each site.

    With ``expected_folds`` a site that misses a fold is an error.
    """
    std = F.stddev_pop if population else F.stddev_samp
    out = folds.groupBy(*site).agg(
        F.avg(prob).alias("mean_prob"), std(prob).alias("std_prob"), F.count(prob).alias("n_folds")
    )
    if expected_folds is not None:
        bad = out.where(F.col("n_folds") != expected_folds).limit(5).collect()
        if bad:
            raise InvalidInput(f"sites without all {expected_folds} folds: {[r[0] for r in bad]}")
    return out


def fold_columns(folds: DataFrame, site: Sequence[str], prob: str, fold: str, values: Sequence, prefix: str) -> DataFrame:
    """One column per fold, in the given order."""
    return (
        folds.groupBy(*site)
        .pivot(fold, list(values))
        .agg(F.avg(prob))
        .withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})
    )


def cross_tab(df: DataFrame, rows: str, columns: str, values: Sequence[str], row_order: DataFrame | None = None) -> DataFrame:
    """Counts with fixed columns, and fixed rows when given; absent pairs are 0."""
    table = df.groupBy(rows).pivot(columns, list(values)).count()
    if row_order is not None:
        table = row_order.select(rows).join(table, rows, "left")
    return table.na.fill(0, list(values))


def class_counts(df: DataFrame, label: str, group: str, classes: DataFrame) -> DataFrame:
    """Rows and distinct groups per class, also for classes without rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"))
    return classes.join(counts, label, "left").na.fill(0, ["n_rows", "n_groups"])


def names_by_count(df: DataFrame, name: str, at_least: int) -> DataFrame:
    """Names with at least the given number of rows, and how many names share each number.

    One row per name rather than one text per count, since most names may share one count.
    """
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= at_least)
    shared = counts.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_names"))
    return counts.join(shared, "n_rows")


def out_of_fold_scores(folds: DataFrame, site: Sequence[str], prob: str, label: str) -> DataFrame:
    """Site means over folds with the complement probability and class flags."""
    return (
        folds.groupBy(*site)
        .agg(F.avg(prob).alias("prob_positive"), F.count(prob).alias("n_folds"), F.max(label).alias(label))
        .withColumn("prob_negative", 1.0 - F.col("prob_positive"))
        .withColumn("is_positive", F.col(label) == 1)
    )


def votes(folds: DataFrame, site: Sequence[str], score: str) -> DataFrame:
    """Number of folds above and below zero."""
    return folds.groupBy(*site).agg(
        F.count_if(F.col(score) > 0).alias("votes_up"), F.count_if(F.col(score) < 0).alias("votes_down")
    )


def with_global_median(df: DataFrame, value: str, out: str = "global_median") -> DataFrame:
    """The median of the column on every row, through a one-row table."""
    one = quantiles(df, [], value, {out: 0.5})
    return df.crossJoin(F.broadcast(one))


def known_thresholds(df: DataFrame, score: str, known: str, up: str, down: str) -> DataFrame:
    """One row: the lowest score of the known class ``up`` and the highest of ``down``.

    The job fails when either class is empty.
    """
    row = df.agg(
        F.min(F.when(F.col(known) == up, F.col(score))).alias("up_threshold"),
        F.max(F.when(F.col(known) == down, F.col(score))).alias("down_threshold"),
    )

    def present(name: str, label: str) -> Column:
        return F.when(
            F.col(name).isNull(), F.raise_error(F.lit(f"no rows of class {label}")).cast("double")
        ).otherwise(F.col(name)).alias(name)

    return row.select(present("up_threshold", up), present("down_threshold", down))


def rule_counts(df: DataFrame, vote_minimums: Sequence[int] = (3, 4, 5)) -> DataFrame:
    """Sites per stability rule for several vote minimums; one pass, one row per minimum.

    ``df`` has mean_score, votes_up, votes_down, global_median, up_threshold, down_threshold.
    """
    aggs = []
    for v in vote_minimums:
        up, down = stability_flags(v)
        aggs.append(
            F.struct(
                F.lit(v).alias("min_votes"),
                F.count_if(up).alias("n_up"),
                F.count_if(down).alias("n_down"),
                F.count_if(up | down).alias("n_stable"),
            ).alias(f"_r{v}")
        )
    rows = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_r{v}") for v in vote_minimums])))
    return rows.withColumn("up_down_ratio", S.ratio("n_up", "n_down"))


def stability_flags(min_votes: int) -> tuple[Column, Column]:
    mean, median = F.col("mean_score"), F.col("global_median")
    up = (mean >= F.col("up_threshold")) & (F.col("votes_up") >= min_votes) & (mean > median)
    down = (mean < F.col("down_threshold")) & (F.col("votes_down") >= min_votes) & (mean < median)
    return up, down


def filter_audit(flagged: DataFrame, label: str, kept: str = "kept") -> DataFrame:
    """One row: complete, clean and excluded counts, prevalence before and after."""
    keep = F.col(kept)
    return flagged.agg(
        F.count(F.lit(1)).alias("n_complete"),
        F.count_if(keep).alias("n_clean"),
        F.count_if(~keep).alias("n_excluded"),
        F.avg(F.col(label).cast("double")).alias("prevalence_complete"),
        F.avg(F.when(keep, F.col(label).cast("double"))).alias("prevalence_clean"),
    )


def binary_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Size, ones, zeros and their shares by group."""
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(value) == 1).alias("n_ones"),
        F.count_if(F.col(value) == 0).alias("n_zeros"),
    )
    return out.withColumn("share_ones", S.ratio("n_ones", "n")).withColumn("share_zeros", S.ratio("n_zeros", "n"))


def arm_statistics(long: DataFrame, feature: str, group: str, value: str, groups: Sequence[str]) -> DataFrame:
    """Median, share of ones and size of every feature in each arm, as columns; and whether it is binary.

    The rows are read once, into counts of (feature, arm, value), from which all figures come.
    """
    number = F.col(value).cast("double")
    counts = settled(long.groupBy(feature, group, number.alias(value)).agg(F.count(F.lit(1)).alias("_c")))
    kinds = counts.groupBy(feature).agg(F.bool_and(F.col(value).isin(0.0, 1.0)).alias("is_binary"))
    ones = F.when(F.col(value) == 1, F.col("_c")).when(F.col(value).isNotNull(), 0)
    sizes = counts.groupBy(feature, group).agg(
        S.ratio(F.sum(ones), F.sum(F.when(F.col(value).isNotNull(), F.col("_c")))).alias("share"), F.sum("_c").alias("n")
    )
    steps = ladder(counts, [feature, group], value, {"_n": F.col("_c")})
    last = F.col("_n_total") - 1
    picks = [
        F.max(F.when((F.col("_n_before") <= k) & (k < F.col("_n_before") + F.col("_n")), F.col(value)))
        for k in (F.floor(last / 2), F.ceil(last / 2))
    ]
    medians = steps.groupBy(feature, group).agg(((picks[0] + picks[1]) / 2).alias("median"))
    stats = attach(sizes, medians, [feature, group])
    picked = stats.join(kinds, feature).withColumn(
        "statistic", F.when(F.col("is_binary"), F.col("share")).otherwise(F.col("median"))
    )
    wide = picked.groupBy(feature, "is_binary").agg(
        *[F.max(F.when(F.col(group) == g, F.col("n"))).alias(f"n_{g}") for g in groups],
        *[F.max(F.when(F.col(group) == g, F.col("statistic"))).alias(f"stat_{g}") for g in groups],
    )
    return wide


def close_relative(known: str | Column, new: str | Column, background: str | Column) -> Column:
    """Known and new arms on the same side of background and nearer to each other than either is to it.

    False if a statistic is missing or an arm does not differ from background.
    """
    known, new, background = (S.col(c) for c in (known, new, background))
    a, b = known - background, new - background
    return F.coalesce((F.signum(a) * F.signum(b) > 0) & (F.abs(known - new) < F.least(F.abs(a), F.abs(b))), F.lit(False))


def robustness_rollup(parts: DataFrame, keys: Sequence[str], effect: str, p: str, part: str) -> DataFrame:
    """Mean effect, least p, number of parts and share of parts with p < 0.05."""
    return parts.groupBy(*keys).agg(
        F.avg(effect).alias("mean_effect"),
        F.min(p).alias("min_p"),
        F.countDistinct(part).alias("n_parts"),
        F.avg((F.col(p) < 0.05).cast("double")).alias("share_significant"),
    )


def compare_modes(points: DataFrame, keys: Sequence[str], mode: str, value: str, plain: str, adjusted: str) -> DataFrame:
    """Unadjusted against adjusted value of each pair, and whether the sign flips."""
    wide = points.groupBy(*keys).agg(
        F.avg(F.when(F.col(mode) == plain, F.col(value))).alias("plain_value"),
        F.avg(F.when(F.col(mode) == adjusted, F.col(value))).alias("adjusted_value"),
    )
    both = wide.where(F.col("plain_value").isNotNull() & F.col("adjusted_value").isNotNull())
    return both.withColumn("change", F.col("adjusted_value") - F.col("plain_value")).withColumn(
        "sign_flip", F.signum("plain_value") * F.signum("adjusted_value") < 0
    )


def mode_rollup(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    return compared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.avg("plain_value").alias("mean_plain"),
        F.avg("adjusted_value").alias("mean_adjusted"),
        F.avg(F.col("sign_flip").cast("double")).alias("flip_share"),
        F.avg((F.col("adjusted_value") > 0).cast("double")).alias("share_positive"),
    )


def cohort_summary(sites: DataFrame, cohort: str, significant: str, known: str) -> DataFrame:
    return sites.groupBy(cohort).agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.count_if(F.col(significant)).alias("n_significant"),
        F.count_if(F.col(significant) & F.col(known)).alias("n_significant_known"),
        F.count_if(F.col(significant) & ~F.col(known)).alias("n_significant_new"),
    )


def cohort_order(summary: DataFrame, cohort: str, measure: str = "n_significant") -> DataFrame:
    """Rank of the cohorts by a count. One row per cohort, so one window is right."""
    return summary.withColumn(
        "cohort_rank", F.row_number().over(Window.orderBy(F.desc(measure), F.asc(cohort)))
    )


def bag_plan(
    df: DataFrame, label: str, target_ratio: float, min_bags: int, max_bags: int
) -> DataFrame:
    """Number and size of background bags from the class counts: one row."""
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_background")
    )
    wanted = F.greatest(F.lit(1), F.bround(F.col("n_positive") * F.lit(float(target_ratio))).cast("bigint"))
    bags = F.ceil(F.col("n_background") / F.col("bag_size"))
    return counts.withColumn("bag_size", F.least(wanted, F.greatest("n_background", F.lit(1)))).withColumn(
        "n_bags", F.least(F.lit(max_bags), F.greatest(F.lit(min_bags), bags)).cast("bigint")
    )


def class_weights(
    df: DataFrame, label: str, mode: str = "balanced", explicit: Mapping[int, float] | None = None
) -> DataFrame:
    """One weight per class: balanced, negative/positive ratio, or given."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if mode == "explicit":
        pairs = [F.lit(x) for k, v in (explicit or {}).items() for x in (k, float(v))]
        return counts.withColumn("weight", F.create_map(*pairs)[F.col(label)])
    totals = df.agg(
        F.count(F.lit(1)).alias("_all"),
        F.countDistinct(label).alias("_classes"),
        F.count_if(F.col(label) == 0).alias("_neg"),
        F.count_if(F.col(label) == 1).alias("_pos"),
    )
    joined = counts.crossJoin(F.broadcast(totals))
    if mode == "balanced":
        weight = F.col("_all") / (F.col("_classes") * F.col("n"))
    elif mode == "ratio":
        weight = F.when(F.col(label) == 1, F.col("_neg") / F.greatest("_pos", F.lit(1))).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown class weight mode {mode}")
    return joined.withColumn("weight", weight).drop("_all", "_classes", "_neg", "_pos")


def split_label_counts(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


def impute_summary(df: DataFrame, columns: Sequence[str], strategy: str = "median") -> DataFrame:
    """Strategy, fill value and missing rate of every feature."""
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = typed.unpivot([], list(columns), "feature", "value")
    rate = F.avg(F.col("value").isNull().cast("double")).alias("missing_rate")
    if strategy == "median":
        out = with_quantiles(long, ["feature"], {"fill_value": ("value", 0.5)}, [rate])
    elif strategy == "mean":
        out = long.groupBy("feature").agg(rate, F.avg("value").alias("fill_value"))
    else:
        out = long.groupBy("feature").agg(rate).withColumn("fill_value", F.lit(0.0))
    return out.withColumn("strategy", F.lit(strategy))


def with_weights(df: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    return attach(df, weights.select(label, "weight"), [label])
