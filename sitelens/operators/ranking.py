"""Ranks, percentiles, running ratios, enrichment, clusters, top-k, FDR."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.functions.draws import draw_key
from sitelens.operators.ordered import (
    attach,
    gap_runs,
    hot_groups,
    is_small,
    ladder,
    quantiles,
    reverse_running_min,
    row_rank,
    settle,
)


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """One row per key: the highest score, ties by the smallest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.asc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """At most n rows per group; each task sends at most n rows of a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def global_rank(df: DataFrame, score: str, tie: str, rank: str = "global_rank", percent: str = "global_percentile") -> DataFrame:
    """Rank of every row by falling score and its share of the table.

    A large table is ranked in slices of the score, never in one task.
    """
    ranked = row_rank(df, [], score, tie, rank, size="_size")
    return ranked.withColumn(percent, F.col(rank) / F.col("_size")).drop("_size")


def rank_within(df: DataFrame, keys: Sequence[str], score: str, tie: str, rank: str = "rank_in_group", size: str = "group_size") -> DataFrame:
    return row_rank(df, keys, score, tie, rank, size)


def running_class_share(df: DataFrame, score: str, tie: str, flag: str) -> DataFrame:
    """Rank, running class counts and running share of the flagged class down the ranking."""
    ranked = row_rank(df.withColumn("_flag", F.col(flag).cast("bigint")), [], score, tie, "rank", size="n_rows")
    steps = ladder(ranked, [], "rank", {"_hits": F.col("_flag")}).select(
        "rank", (F.col("_hits_before") + F.col("_hits")).alias("n_flagged")
    )
    return (
        ranked.join(steps, "rank")
        .withColumn("n_other", F.col("rank") - F.col("n_flagged"))
        .withColumn("flagged_share", F.col("n_flagged") / F.col("rank"))
        .withColumn("rank_percentile", 100.0 * F.col("rank") / F.col("n_rows"))
        .drop("_flag")
    )


def top_fraction_enrichment(ranked: DataFrame, flag: str, fractions: Sequence[float]) -> DataFrame:
    """Share of the flagged class in the top fractions against its overall share.

    ``ranked`` has rank and n_rows. One pass: each row counts for the fractions it is in.
    """
    hit = F.col(flag).cast("boolean")

    def cut(f: float) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col("n_rows") * F.lit(f)))

    aggs = [
        F.struct(
            F.lit(float(f)).alias("fraction"),
            F.max(cut(f)).alias("top_n"),
            F.count_if((F.col("rank") <= cut(f)) & hit).alias("n_hits"),
        ).alias(f"_f{i}")
        for i, f in enumerate(fractions)
    ]
    totals = ranked.agg(*aggs, F.count_if(hit).alias("n_flagged"), F.count(F.lit(1)).alias("n_rows"))
    rows = totals.select(
        "n_flagged", "n_rows", F.inline(F.array(*[F.col(f"_f{i}") for i in range(len(fractions))]))
    )
    return rows.withColumn("share_in_top", S.ratio("n_hits", "top_n")).withColumn(
        "enrichment", S.ratio(F.col("share_in_top"), S.ratio("n_flagged", "n_rows"))
    )


def gap_clusters(
    df: DataFrame, keys: Sequence[str], pos: str, gap: float, manual: str | None = None, out: str = "cluster_id"
) -> DataFrame:
    """Cluster id of every row: a new cluster starts when the gap to the previous position is larger.

    A manual id wins where it is given.
    """
    runs = gap_runs(df, keys, pos, gap, "_run")
    joined = attach(df, runs, [*keys, pos])
    auto = F.concat(
        *[F.concat(S.safe_name(k), F.lit("_")) for k in keys], F.lit("C"), F.lpad(F.col("_run").cast("string"), 2, "0")
    )
    auto = F.when(F.col("_run") > 99, F.concat(*[F.concat(S.safe_name(k), F.lit("_")) for k in keys], F.lit("C"), F.col("_run").cast("string"))).otherwise(auto)
    given = F.nullif(S.clean_text(manual), F.lit("")) if manual else F.lit(None).cast("string")
    return joined.withColumn(out, F.coalesce(given, auto)).drop("_run")


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str, q: str = "q_value") -> DataFrame:
    """False-discovery q-values within each group; NULL p-values are kept and not counted.

    One ordered pass per group. A hot group is worked on as distinct p-values with their counts,
    since equal p-values share one q-value; those are cut into slices where they are too many.
    """
    keys = list(keys)
    small = is_small(df)
    df = df if small else settle(df)
    if small or not hot_groups(df, keys):
        group = Window.partitionBy(*keys)
        upward = group.orderBy(F.col(p).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        downward = group.orderBy(F.col(p).desc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        raw = F.col(p) * F.count(p).over(group) / F.count(p).over(upward)
        stepped = df.withColumn("_raw", raw).withColumn(q, F.least(F.min("_raw").over(downward), F.lit(1.0)))
        return stepped.withColumn(q, F.when(F.col(p).isNotNull(), F.col(q))).drop("_raw")
    steps = ladder(df.select(*keys, p), keys, p, {"_n": F.lit(1)})
    raw = steps.select(
        *keys, p, (F.col(p) * F.col("_n_total") / (F.col("_n_before") + F.col("_n"))).alias("_raw")
    )
    stepped = reverse_running_min(raw, keys, p, "_raw", q).drop("_raw")
    return attach(df, stepped.withColumn(q, F.least(F.col(q), F.lit(1.0))), [*keys, p])


def seeded_pick(df: DataFrame, keys: Sequence[str], row_key: Sequence[str], k: int, seed: int) -> DataFrame:
    """k rows per group without replacement, the same for any partitioning."""
    order = [draw_key(seed, *row_key), *[F.col(c) for c in row_key]]
    return top_per_group(df, keys, order, k, "_pick").drop("_pick")


def ordered_rows(df: DataFrame, order: Sequence[Column], rank: str = "row_order", keys: Sequence[str] = ()) -> DataFrame:
    """Position of every row in a multi-key order.

    A large table without keys is sorted by ranges and written once; rows are
    then numbered inside their partition and moved up by the rows of the
    partitions before it, so no task sees the whole table.
    """
    if keys:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    if is_small(df):
        return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    marked = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    # The id holds the partition in its upper bits and the row in its lower 33.
    placed = settle(marked).withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(2**33 - 1))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return attach(placed, offsets, ["_part"], small=True).withColumn(
        rank, F.col("_ahead") + F.col("_row") + 1
    ).drop("_id", "_part", "_row", "_ahead")


def cohort_sequence(rows: DataFrame, cohorts: DataFrame, cohort: str, significant: str, p: str, delta: str) -> DataFrame:
    """Cohorts of one site: significant first, then p, size of the change, name; unseen ones last."""
    joined = cohorts.select(cohort).join(rows, cohort, "left")
    return ordered_rows(
        joined,
        [
            F.coalesce(F.col(significant), F.lit(False)).desc(),
            F.col(p).asc_nulls_last(),
            F.abs(F.col(delta)).desc_nulls_last(),
            F.asc(cohort),
        ],
        "cohort_order",
    )


def cohorts_with_pairs(points: DataFrame, cohort: str, at_least: int) -> DataFrame:
    return points.groupBy(cohort).agg(F.count(F.lit(1)).alias("n_pairs")).where(F.col("n_pairs") >= at_least)


def combined_site_table(sites: DataFrame, cohort: str, site: str, p: str, known: str, cut: float = 0.05, per_cohort: int = 10) -> DataFrame:
    """Significance flag and rank, cohort rank, in-figure flag and row order of all sites; ``site`` is a unique number."""
    flagged = sites.withColumn("is_significant", F.coalesce(F.col(p) < cut, F.lit(False))).withColumn(
        "status", F.when(F.col(known), "Known").otherwise("New")
    )
    order = flagged.groupBy(cohort).agg(F.count_if("is_significant").alias("n_significant")).withColumn(
        "cohort_rank", F.row_number().over(Window.orderBy(F.desc("n_significant"), F.asc(cohort)))
    )
    ranked = flagged.join(order, cohort).withColumn("star_rank", S.star_rank(p))
    return row_rank(ranked, [cohort], p, site, "site_rank", ascending=True).withColumn(
        "in_figure", F.col("is_significant") & (F.col("site_rank") <= per_cohort)
    )


def percentile_of(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    return quantiles(df, [], value, probs)
