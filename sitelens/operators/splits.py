"""Group-aware splits, folds, chunks and bags.

Every split works on the histogram of groups (one row per group) and joins the
decision back, so rows of a group stay together and a hot group costs nothing
extra. Order among groups comes from a seeded hash. Balanced dealing is the greedy
rule on runs of equal groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.draws import draw_number
from sitelens.operators.clean import InvalidInput
from sitelens.operators.ordered import attach, row_rank
from sitelens.operators.resampling import repeated_draws


def group_histogram(df: DataFrame, group: str, label: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs.append((F.count_if(F.col(label) == 1) if label else F.lit(0).cast("bigint")).alias("n_positive"))
    return df.groupBy(group).agg(*aggs)


def _shuffled(groups: DataFrame, group: str, seed: int) -> DataFrame:
    """Groups with their place in a seeded order and the number of groups."""
    keyed = groups.withColumn("_u", draw_number(seed, group)).withColumn("_u2", draw_number(seed + 1, group))
    return row_rank(keyed, [], "_u", "_u2", "_place", size="_n_groups", ascending=True).drop("_u", "_u2")


def group_split(
    df: DataFrame, group: str, shares: dict[str, float], seed: int, rest: str = "train", out: str = "split"
) -> DataFrame:
    """Assign whole groups to parts by their share of the groups; what is left is ``rest``.

    Each listed part gets ``ceil(share * groups)`` groups, in the order given.
    """
    ordered = _shuffled(df.select(group).distinct(), group, seed)
    part: Column | None = None
    edge = F.lit(0)
    for name, share in shares.items():
        edge = edge + F.ceil(F.col("_n_groups") * F.lit(float(share)))
        part = F.when(F.col("_place") <= edge, name) if part is None else part.when(F.col("_place") <= edge, name)
    chosen = ordered.select(group, part.otherwise(rest).alias(out))
    return attach(df, chosen, [group])


def _lightest(state: np.ndarray, item: np.ndarray, totals: np.ndarray) -> int:
    """The hand with the fewest rows, the first of equals."""
    return int(np.argmin(state.sum(1)))


def _evenest(state: np.ndarray, item: np.ndarray, totals: np.ndarray) -> int:
    """The hand that leaves the classes' shares most alike over the hands; then the one with fewer rows, then the first."""
    shares = state / totals
    after = shares[None] + np.eye(len(state))[:, :, None] * (item / totals)
    spread = np.round(after.std(1).mean(1), 9)
    return min(range(len(state)), key=lambda f: (spread[f], state[f].sum(), f))


def greedy_hands(profiles: Sequence[tuple[tuple[int, ...], int]], k: int, choose) -> list[list[tuple[int, int, list[int]]]]:
    """For every run of equal groups the hands they get, one group after the other: (start, end, hands in turn).

    ``profiles``: rows by class and number of groups of each run, in the order of
    dealing. Equal groups soon go round some of the hands in a fixed order; such
    rounds are taken many at a time, as long as the next round would be the same, so
    the work follows the number of different profiles and not of groups.
    """
    state = np.zeros((k, len(profiles[0][0]) if profiles else 1))
    totals = np.maximum(sum((np.array(v, float) * n for v, n in profiles), np.zeros(state.shape[1])), 1)
    out = []
    for vector, count in profiles:
        item, runs, at, start, picks = np.array(vector, float), [], 0, 0, []

        def rounds(cycle: list[int], times: int) -> bool:
            """Whether after so many more rounds the next one is the same."""
            ahead = state.copy()
            ahead[cycle] += item * times
            for f in cycle:
                if choose(ahead, item, totals) != f:
                    return False
                ahead[f] += item
            return True

        while at < count:
            f = choose(state, item, totals)
            state[f] += item
            picks.append(f)
            at += 1
            for c in range(1, min(k, len(picks) // 2) + 1):
                cycle = picks[-c:]
                if cycle != picks[-2 * c : -c] or len(set(cycle)) < c or count - at < 2 * c:
                    continue
                most, good = (count - at) // c, 0
                if rounds(cycle, most):
                    good = most
                else:
                    step = 1
                    while good + step < most and rounds(cycle, good + step):
                        good, step = good + step, step * 2
                    while step:
                        if good + step < most and rounds(cycle, good + step):
                            good += step
                        step //= 2
                if good:
                    runs += [(start, at, picks), (at, at + good * c, cycle)]
                    state[cycle] += item * good
                    at += good * c
                    start, picks = at, []
                break
        if picks:
            runs.append((start, at, picks))
        out.append(runs)
    return out


def deal_groups(groups: DataFrame, group: str, k: int, seed: int, out: str, stratify: bool = False) -> DataFrame:
    """Deal groups to k hands by the greedy rule: each to the hand with the fewest rows, larger groups first.

    With ``stratify`` groups go by falling difference of their class counts to the hand that leaves
    the class shares most alike. Equal groups go in a seeded order. Only the different
    (n_rows, n_positive) profiles reach the driver.
    """
    profile = ["n_rows", "n_positive"] if stratify else ["n_rows"]
    rows = groups.groupBy(*profile).agg(F.count(F.lit(1)).alias("n")).collect()
    if stratify:
        rows.sort(key=lambda r: (-abs(2 * r["n_positive"] - r["n_rows"]), -r["n_rows"], -r["n_positive"]))
        vectors = [((r["n_rows"] - r["n_positive"], r["n_positive"]), r["n"]) for r in rows]
    else:
        rows.sort(key=lambda r: -r["n_rows"])
        vectors = [((r["n_rows"],), r["n"]) for r in rows]
    hands = greedy_hands(vectors, k, _evenest if stratify else _lightest)
    kinds = ", ".join(f"{c} bigint" for c in profile) + ", _runs array<struct<start: bigint, stop: bigint, hands: array<int>>>"
    table = groups.sparkSession.createDataFrame([(*[r[c] for c in profile], h) for r, h in zip(rows, hands)], kinds)
    keyed = groups.withColumn("_u", draw_number(seed, group)).withColumn("_u2", draw_number(seed + 1, group))
    ranked = row_rank(keyed, profile, "_u", "_u2", "_place", ascending=True).join(table, profile)
    place = F.col("_place") - 1
    run = F.filter("_runs", lambda x: (x["start"] <= place) & (place < x["stop"]))[0]
    at = ((place - run["start"]) % F.size(run["hands"])).cast("int")
    return ranked.withColumn(out, F.get(run["hands"], at)).drop("_u", "_u2", "_place", "_runs")


def group_folds(
    df: DataFrame, group: str, k: int, seed: int, label: str | None = None, out: str = "fold"
) -> DataFrame:
    """k folds of whole groups; with a label, class shares are kept alike."""
    groups = group_histogram(df, group, label)
    dealt = deal_groups(groups, group, k, seed, out, stratify=label is not None).select(group, out)
    return attach(df, dealt, [group])


def fixed_holdout(df: DataFrame, group: str, size: float, seed: int, label: str | None = None, out: str = "is_test") -> DataFrame:
    """One of round(1/size) folds as the fixed test part."""
    k = max(2, round(1.0 / size))
    return group_folds(df, group, k, seed, label, "_fold").withColumn(out, F.col("_fold") == 0).drop("_fold")


def development_folds(df: DataFrame, group: str, k: int, seed: int, label: str | None = None, share: float = 0.2) -> DataFrame:
    """k folds, or one train/val split when k is 1."""
    if k > 1:
        return group_folds(df, group, k, seed, label)
    return group_split(df, group, {"val": share}, seed).withColumn("fold", F.when(F.col("split") == "val", 0).otherwise(-1)).drop("split")


def three_way_split(df: DataFrame, group: str, train: float, val: float, test: float, seed: int) -> DataFrame:
    """Train, val and test parts of whole groups in one pass."""
    if abs(train + val + test - 1.0) > 1e-6:
        raise InvalidInput("train, val and test shares must add up to 1")
    return group_split(df, group, {"test": test, "val": val}, seed)


def inner_split(df: DataFrame, group: str, seed: int, share: float = 0.2) -> DataFrame:
    return group_split(df, group, {"val": share}, seed)


def leaking_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one part; empty for a sound split."""
    return (
        df.groupBy(group)
        .agg(F.countDistinct(split).alias("n_parts"))
        .where(F.col("n_parts") > 1)
    )


def assert_no_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    bad = leaking_groups(df, group, split).limit(5).collect()
    if bad:
        raise InvalidInput(f"groups in more than one part: {[r[0] for r in bad]}")
    return df


def balanced_chunks(df: DataFrame, group: str, k: int, seed: int, out: str = "chunk") -> DataFrame:
    """Whole groups over k chunks of nearly equal size."""
    dealt = deal_groups(group_histogram(df, group), group, k, seed, out).select(group, out)
    return attach(df, dealt, [group])


def sample_bags(df: DataFrame, key: str, n_bags: int, size: int, seed: int, replace: bool = False) -> DataFrame:
    """``n_bags`` samples of ``size`` rows each, with a bag number; ``key`` is a unique number."""
    numbered = row_rank(df, [], key, key, "_pos", ascending=True)
    request = df.agg(F.count(F.lit(1)).alias("_size")).withColumn("_want", F.lit(size).cast("bigint"))
    if not replace:
        request = request.withColumn("_want", F.least("_want", "_size"))
    drawn = repeated_draws(request, numbered.withColumnRenamed("_pos", "position"), [], "_size", "_want", n_bags, seed, replace)
    return drawn.withColumnRenamed("iteration", "bag").drop("_size", "_want", "slot", "position")


def positive_unlabelled_bags(positives: DataFrame, bags: DataFrame, n_bags: int, label: str = "label") -> DataFrame:
    """All positives with every bag of unlabelled rows."""
    repeated = positives.withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(n_bags)).cast("array<bigint>")))
    return repeated.withColumn(label, F.lit(1)).unionByName(bags.withColumn(label, F.lit(0)), allowMissingColumns=True)


def labelled_parts(parts: dict[str, DataFrame], key: Sequence[str], group: str = "group") -> DataFrame:
    """Union of named parts, one row per key and part."""
    out: DataFrame | None = None
    for name, df in parts.items():
        tagged = df.select(*key).withColumn(group, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise InvalidInput("no parts given")
    return out.distinct()


def background_with_fallback(
    rows: DataFrame, group: str, cluster: str, in_cluster: str, in_other: str, is_known: str
) -> DataFrame:
    """Background rows of each cluster, from the strictest pool that is not empty.

    ``rows`` has one row per (cluster, candidate of its protein) with boolean
    flags. Strict: neither known nor in any cluster. Relaxed: neither known nor in
    this cluster. Minimal: not in this cluster. The mode is recorded.
    """
    strict = ~F.col(is_known) & ~F.col(in_cluster) & ~F.col(in_other)
    relaxed = ~F.col(is_known) & ~F.col(in_cluster)
    minimal = ~F.col(in_cluster)
    available = rows.groupBy(cluster).agg(
        F.bool_or(strict).alias("_s"), F.bool_or(relaxed).alias("_r"), F.bool_or(minimal).alias("_m")
    )
    mode = (
        F.when(F.col("_s"), "strict")
        .when(F.col("_r"), "relaxed_without_other_clusters")
        .when(F.col("_m"), "minimal_without_current_cluster")
        .otherwise("unavailable")
    )
    picked = attach(rows, available.select(cluster, mode.alias("pool_mode")), [cluster])
    keep = (
        ((F.col("pool_mode") == "strict") & strict)
        | ((F.col("pool_mode") == "relaxed_without_other_clusters") & relaxed)
        | ((F.col("pool_mode") == "minimal_without_current_cluster") & minimal)
    )
    return picked.where(keep)
