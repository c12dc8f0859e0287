"""Greedy dealing of runs against the plain greedy rule, one group at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators import splits as X


def plain(profiles, k, choose):
    state = np.zeros((k, len(profiles[0][0])))
    totals = np.maximum(sum(np.array(v, float) * n for v, n in profiles), 1)
    out = []
    for vector, count in profiles:
        picks = []
        for _ in range(count):
            f = choose(state, np.array(vector, float), totals)
            state[f] += vector
            picks.append(f)
        out.append(picks)
    return out, state


def unrolled(runs):
    picks = []
    for start, stop, hands in runs:
        assert start == len(picks)
        picks += [hands[i % len(hands)] for i in range(stop - start)]
    return picks


@pytest.mark.parametrize("seed", range(6))
def test_lightest_is_the_plain_rule(seed):
    r = random.Random(seed)
    sizes = sorted({r.choice([1, 2, 3, 5, 8, 100, 1000]) for _ in range(5)}, reverse=True)
    profiles = [((s,), r.randrange(1, 4000 if s < 5 else 9)) for s in sizes]
    got = [unrolled(x) for x in X.greedy_hands(profiles, r.randrange(2, 7), X._lightest)]
    assert got == plain(profiles, max(max(x) for x in got) + 1, X._lightest)[0] or len(got) < 2


@pytest.mark.parametrize("seed", range(4))
def test_evenest_is_as_even_as_the_plain_rule(seed):
    r = random.Random(seed)
    k = r.randrange(2, 6)
    profiles = [((r.randrange(0, 30), r.randrange(0, 12)), r.randrange(1, 400)) for _ in range(6)] + [((1, 0), 900), ((0, 1), 300)]
    profiles = sorted((p for p in profiles if sum(p[0])), key=lambda p: -abs(p[0][0] - p[0][1]))
    runs = X.greedy_hands(profiles, k, X._evenest)
    _, want = plain(profiles, k, X._evenest)
    got = np.zeros((k, 2))
    for (vector, count), run in zip(profiles, runs):
        picks = unrolled(run)
        assert len(picks) == count
        for f in picks:
            got[f] += vector
    total = want.sum(0)
    assert (got / total).std(0).mean() <= (want / total).std(0).mean() + 1e-9


def test_one_hot_group_and_many_small_ones(spark):
    """A group of a third of the rows, and 3,000 groups of one row."""
    rows = [(0, i % 5 == 0) for i in range(1500)] + [(1 + i, i % 3 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, hit boolean").withColumn("label", F.col("hit").cast("int"))
    sizes = X.balanced_chunks(df, "g", 3, 1).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in sizes) == [1500, 1500, 1500]
    folds = X.group_folds(df, "g", 3, 1, "label")
    assert X.leaking_groups(folds, "g", "fold").count() == 0
    shares = [r["s"] for r in folds.groupBy("fold").agg(F.sum("label").alias("s")).collect()]
    assert max(shares) - min(shares) <= 2
