"""Ordered statistics inside groups of any size.

Ranks, running totals, neighbours and exact quantiles need the rows of a group
in order. A plain window does that in one task per group, which is right for
ordinary groups and wrong for a group that holds a large part of the table.

So every operator here first looks for *hot* groups. Inputs that are small as a
whole skip the look. A hot group is cut into slices of its value range; a task
then handles one slice, and what the slice must know about its neighbours comes
from a table with one row per slice. Every group above the limit is cut, into as
many slices as it holds limits, so there are at most rows / limit hot groups and
about as many cut points. They are collected once, so that all branches of the
plan see the same cuts.

The result never depends on whether a group was cut.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"
#: Begin of the names of the folders that ``settle`` writes.
SETTLED = "settled-"
HOT_ROWS_KEY = "spark.sitelens.hotGroupRows"
SMALL_BYTES_KEY = "spark.sitelens.smallInputBytes"
HOT_ROWS = 2_000_000
SMALL_BYTES = 64 * 1024 * 1024


def _setting(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(key, str(default)))


def input_bytes(df: DataFrame) -> float:
    """Size of all the tables a plan reads, as the optimizer knows it."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        # A written intermediate may carry the estimate of the joins behind it, which multiplies beyond any float.
        return float(
            sum(min(int(str(leaves.apply(i).stats().sizeInBytes())), 1 << 62) for i in range(leaves.size()))
        )
    except AttributeError:  # a session that has no plan at hand counts as large
        return float("inf")


def is_small(df: DataFrame, growth: float = 1.0) -> bool:
    """True when the whole input fits one task; ``growth`` is the plan's row multiplier."""
    limit = _setting(df, SMALL_BYTES_KEY, SMALL_BYTES)
    return limit > 0 and input_bytes(df) * growth <= limit


def settle(df: DataFrame) -> DataFrame:
    """Write a large intermediate table once, so that the jobs after it read it instead of redoing it.

    It is written as Parquet: ``checkpoint()`` works its last stage out twice, once to count and once to write. Only
    columns that Parquet cannot hold (void, intervals, names that differ in case alone) still go that way. Uses the checkpoint folder of the session. A cluster session must name one in
    ``spark.checkpoint.dir``; a local session without one gets a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="sitelens-")
        context.setCheckpointDir(folder)
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or any(t in df.schema.simpleString() for t in ("void", "interval")):
        return df.checkpoint()
    path = f"{context.getCheckpointDir().rstrip('/')}/{SETTLED}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The table itself where the whole input is small, otherwise written once."""
    return df if is_small(df) else settle(df)


def merge_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", growth: float = 1.0) -> DataFrame:
    """Join that is merged unless the whole input is small, so that neither side is collected by the driver.

    Spark's own check takes a side's size from its compressed files, which hold a row of a settled table in about a byte,
    and does not see how many rows come out of an explode. For the same reason an input with a settled table is not small.
    """
    plain = left.join(right, list(on), how)
    small = is_small(plain, growth) and not any(f"/{SETTLED}" in f for f in plain.inputFiles())
    return plain if small else left.join(right.hint("merge"), list(on), how)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right["_r_" + n])
    return cond


def attach(left: DataFrame, right: DataFrame, names: Sequence[str], small: bool = False) -> DataFrame:
    """Left join on null-safe keys, keeping the left key columns only."""
    renamed = right.select(
        *[F.col(n).alias("_r_" + n) for n in names],
        *[F.col(c) for c in right.columns if c not in names],
    )
    if small:
        renamed = F.broadcast(renamed)
    return left.join(renamed, _same(left, renamed, names), "left").drop(*["_r_" + n for n in names])


@dataclass(frozen=True)
class Layout:
    """Rows with their slice number, and whether any group was cut."""

    df: DataFrame
    keys: tuple[str, ...]
    cut: bool

    def part(self) -> list[str]:
        if self.cut:
            return [*self.keys, SLICE]
        return list(self.keys)


def hot_groups(df: DataFrame, keys: Sequence[str]) -> list:
    """The groups above the row limit, each with its number of rows; at most rows / limit of them."""
    limit = _setting(df, HOT_ROWS_KEY, HOT_ROWS)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limit).collect()


def lay_out(df: DataFrame, keys: Sequence[str], value: str, growth: float = 1.0) -> Layout:
    """Cut the hot groups of ``df`` along the numeric column ``value``."""
    keys = list(keys)
    if is_small(df, growth):
        return Layout(df, tuple(keys), False)
    df = settle(df)
    hot = hot_groups(df, keys)
    if not hot:
        return Layout(df, tuple(keys), False)

    limit = _setting(df, HOT_ROWS_KEY, HOT_ROWS)
    spark = df.sparkSession
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("_want", T.IntegerType())])
    wanted = spark.createDataFrame(
        [(*[r[k] for k in keys], int(-(-r["_n"] // limit))) for r in hot], schema
    )
    slices = max(2, max(-(-r["_n"] // limit) for r in hot))
    probs = [i / slices for i in range(1, slices)]
    as_double = F.col(value).cast("double")
    points = (
        attach(df, wanted, keys, small=True)
        .where(F.col("_want").isNotNull())
        .groupBy(*keys)
        .agg(
            F.percentile_approx(as_double, probs, 20 * slices).alias("_q"),
            F.max("_want").alias("_want"),
        )
    ).collect()

    # Blocks as wide as there are blocks, so that neither search is long.
    width = max(2, math.isqrt(slices))
    rows = []
    for r in points:
        stride = max(1, len(r["_q"]) // max(1, r["_want"]))
        chosen = sorted(set(r["_q"][stride - 1 :: stride]))
        blocks = [chosen[i : i + width] for i in range(0, len(chosen), width)]
        rows.append((*[r[k] for k in keys], blocks))
    cut_schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in fields]
        + [T.StructField("_cuts", T.ArrayType(T.ArrayType(T.DoubleType())))]
    )
    cuts = spark.createDataFrame(rows, cut_schema)

    # Two short searches instead of one long one: which block, then where in it.
    joined = attach(df, cuts, keys, small=True)
    block = F.greatest(
        F.size(F.filter("_cuts", lambda b: b[0] < as_double)), F.lit(1)
    )
    inside = F.size(F.filter(F.element_at("_cuts", F.col("_block")), lambda c: c < as_double))
    sliced = (
        joined.withColumn("_block", block)
        .withColumn(
            SLICE,
            F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise((F.col("_block") - 1) * width + inside + 1),
        )
        .drop("_cuts", "_block")
    )
    return Layout(sliced, tuple(keys), True)


def _slice_rows(layout: Layout, aggs: Sequence[Column]) -> DataFrame:
    """One row per slice of the hot groups; bounded by the number of cut points."""
    return layout.df.where(F.col(SLICE) > 0).groupBy(*layout.keys, SLICE).agg(*aggs)


def ladder(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Mapping[str, Column],
    growth: float = 1.0,
) -> DataFrame:
    """One row per (keys, value) with prefix sums over the smaller values.

    For each weight ``w`` the result has ``w`` (its sum at this value),
    ``w_before`` (its sum over smaller values of the group) and ``w_total``.
    Rows with a NULL value are left out. Rows are combined before the shuffle.
    """
    keys = list(keys)
    names = list(weights)
    steps = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(weights[n]).alias(n) for n in names])
    )
    layout = lay_out(steps, keys, value, growth)
    ordered = Window.partitionBy(*layout.part()).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*layout.part())
    out = layout.df.select(
        "*",
        *[F.coalesce(F.sum(n).over(ordered), F.lit(0)).alias(n + "_before") for n in names],
        *[F.sum(n).over(whole).alias(n + "_total") for n in names],
    )
    if not layout.cut:
        return out

    along = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    carry = _slice_rows(layout, [F.sum(n).alias("_s_" + n) for n in names]).select(
        *keys,
        SLICE,
        *[F.coalesce(F.sum("_s_" + n).over(along), F.lit(0)).alias("_c_" + n) for n in names],
        *[F.sum("_s_" + n).over(group).alias("_t_" + n) for n in names],
    )
    joined = attach(out, carry, [*keys, SLICE], small=True)
    for n in names:
        joined = joined.withColumn(
            n + "_before", F.col(n + "_before") + F.coalesce("_c_" + n, F.lit(0))
        ).withColumn(n + "_total", F.coalesce("_t_" + n, n + "_total"))
    return joined.drop(SLICE, *["_c_" + n for n in names], *["_t_" + n for n in names])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str = "avg_rank") -> DataFrame:
    """Rank of every distinct value in its group, ties sharing the mean of their ranks."""
    steps = ladder(df, keys, value, {"n_tied": F.lit(1)})
    return steps.withColumn(rank, F.col("n_tied_before") + (F.col("n_tied") + 1) / 2.0)


def row_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    rank: str = "rank",
    size: str | None = None,
    ascending: bool = False,
    growth: float = 1.0,
) -> DataFrame:
    """1, 2, 3, ... inside each group by ``value``, ties broken by the unique numeric ``tie``.

    NULL values come last. ``size`` adds the number of rows of the group.
    """
    keys = list(keys)
    sign = F.lit(1) if ascending else F.lit(-1)
    work = df.withColumn("_v", F.coalesce(sign * F.col(value), F.lit(float("inf"))))
    layout = lay_out(work, keys, "_v", growth)
    work = layout.df.drop(SLICE)
    if not layout.cut:
        out = work.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy("_v", tie)).cast("bigint"))
        if size:
            out = out.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        return out.drop("_v")

    # Rows before the value, plus rows of the same value before the tie-break.
    steps = ladder(work, keys, "_v", {"_n": F.lit(1)}, growth).select(
        *keys, "_v", F.col("_n_before").alias("_rr_below"), F.col("_n_total").alias("_rr_size")
    )
    ties = ladder(work, [*keys, "_v"], tie, {"_m": F.lit(1)}, growth).select(
        *keys, "_v", tie, F.col("_m_before").alias("_rr_ahead")
    )
    out = attach(attach(work, steps, [*keys, "_v"]), ties, [*keys, "_v", tie])
    out = out.withColumn(rank, F.col("_rr_below") + F.col("_rr_ahead") + 1)
    if size:
        out = out.withColumn(size, F.col("_rr_size"))
    return out.drop("_v", "_rr_below", "_rr_ahead", "_rr_size")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], growth: float = 1.0
) -> DataFrame:
    """Exact, linearly interpolated quantiles of each group: one row per group.

    ``percentile`` keeps a group's distinct values in memory, so it is used
    only when no group is hot; a hot group is ranked in slices and the rows at
    the wanted positions are picked.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, value)
    layout = lay_out(present, keys, value, growth)
    present = layout.df.drop(SLICE)
    if not layout.cut:
        return present.groupBy(*keys).agg(*[F.percentile(value, p).alias(name) for name, p in probs.items()])
    steps = ladder(present, keys, value, {"_n": F.lit(1)})
    picks = []
    for name, p in probs.items():
        at = (F.col("_n_total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        here = lambda k: (F.col("_n_before") <= k) & (k < F.col("_n_before") + F.col("_n"))
        picks += [
            F.max(F.when(here(low), F.col(value).cast("double"))).alias("_lo_" + name),
            F.max(F.when(here(high), F.col(value).cast("double"))).alias("_hi_" + name),
            F.max(at - low).alias("_w_" + name),
        ]
    return (
        steps.groupBy(*keys)
        .agg(*picks)
        .select(
            *keys,
            *[
                (F.col("_lo_" + n) * (1 - F.col("_w_" + n)) + F.col("_hi_" + n) * F.col("_w_" + n)).alias(n)
                for n in probs
            ],
        )
    )


def with_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], aggs: Sequence[Column] = ()
) -> DataFrame:
    """Group aggregates next to exact quantiles, ``{name: (column, share)}``.

    One aggregation where the groups allow it; with a hot group each quantile
    column is ranked in slices and joined on.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    layout = lay_out(df, keys, columns[0])
    df = layout.df.drop(SLICE)
    if not layout.cut:
        return df.groupBy(*keys).agg(*aggs, *[F.percentile(c, p).alias(n) for n, (c, p) in wanted.items()])
    out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    for c in columns:
        probs = {n: p for n, (column, p) in wanted.items() if column == c}
        out = attach(out, quantiles(df, keys, c, probs), keys)
    return out


def neighbours(points: DataFrame, keys: Sequence[str], value: str, marked: str) -> DataFrame:
    """Nearest marked value at or below, and at or above, every distinct value.

    ``marked`` is a boolean column; the result has one row per (keys, value)
    with ``below`` and ``above`` (NULL when there is none).
    """
    keys = list(keys)
    steps = (
        points.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.max(F.when(F.col(marked), F.col(value))).alias("_mark"))
    )
    layout = lay_out(steps, keys, value)
    down = Window.partitionBy(*layout.part()).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*layout.part()).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = layout.df.withColumn("below", F.max("_mark").over(down)).withColumn("above", F.min("_mark").over(up))
    if layout.cut:
        before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
        carry = _slice_rows(layout, [F.max("_mark").alias("_hi"), F.min("_mark").alias("_lo")]).select(
            *keys, SLICE, F.max("_hi").over(before).alias("_cb"), F.min("_lo").over(after).alias("_ca")
        )
        out = attach(out, carry, [*keys, SLICE], small=True)
        out = out.withColumn("below", F.coalesce("below", "_cb")).withColumn("above", F.coalesce("above", "_ca"))
        out = out.drop("_cb", "_ca", SLICE)
    return out.drop("_mark")


def gap_runs(df: DataFrame, keys: Sequence[str], value: str, gap: float, run: str = "run") -> DataFrame:
    """Number, per distinct value, the runs of values that are at most ``gap`` apart."""
    keys = list(keys)
    steps = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    layout = lay_out(steps, keys, value)
    ordered = Window.partitionBy(*layout.part()).orderBy(value)
    out = layout.df.withColumn("_prev", F.lag(value).over(ordered))
    if layout.cut:
        before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        last = _slice_rows(layout, [F.max(value).alias("_last")]).select(
            *keys, SLICE, F.max("_last").over(before).alias("_last")
        )
        out = attach(out, last, [*keys, SLICE], small=True)
        out = out.withColumn("_prev", F.coalesce("_prev", "_last")).drop("_last")
    out = out.withColumn("_new", F.when(F.col(value) - F.col("_prev") > gap, 1).otherwise(0)).drop("_prev")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    numbered = out.withColumn(run, F.sum("_new").over(running) + 1)
    if layout.cut:
        starts = (
            out.where(F.col(SLICE) > 0)
            .groupBy(*keys, SLICE)
            .agg(F.sum("_new").alias("_starts"))
            .select(*keys, SLICE, F.sum("_starts").over(before).alias("_starts"))
        )
        numbered = attach(numbered, starts, [*keys, SLICE], small=True)
        numbered = numbered.withColumn(run, F.col(run) + F.coalesce("_starts", F.lit(0))).drop("_starts", SLICE)
    return numbered.drop("_new")


def reverse_running_min(df: DataFrame, keys: Sequence[str], value: str, measure: str, out: str) -> DataFrame:
    """Minimum of ``measure`` over the rows whose ``value`` is at least this one's.

    ``df`` has one row per (keys, value).
    """
    keys = list(keys)
    layout = lay_out(df, keys, value)
    from_top = Window.partitionBy(*layout.part()).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    done = layout.df.withColumn(out, F.min(measure).over(from_top))
    if layout.cut:
        after = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
        carry = _slice_rows(layout, [F.min(measure).alias("_m")]).select(
            *keys, SLICE, F.min("_m").over(after).alias("_m")
        )
        done = attach(done, carry, [*keys, SLICE], small=True)
        done = done.withColumn(out, F.least(out, "_m")).drop("_m", SLICE)
    return done
