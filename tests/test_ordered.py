"""Ordered statistics: cut and uncut groups give the same, brute-force result."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators import joins, ordered, ranking


@pytest.fixture(params=["plain", "hot"])
def mode(request, spark):
    if request.param == "hot":
        request.getfixturevalue("hot")
    return request.param


def sample(n=300, seed=1, groups="aaaab", values=40):
    rng = random.Random(seed)
    return [(rng.choice(groups), float(rng.randrange(values)), i) for i in range(n)]


def frame(spark, rows, schema="g string, v double, id long"):
    return spark.createDataFrame(rows, schema)


def by_group(rows):
    out = defaultdict(list)
    for g, v, i in rows:
        out[g].append((v, i))
    return out


def test_average_ranks(spark, mode):
    rows = sample()
    got = {(r.g, r.v): r.avg_rank for r in ordered.average_ranks(frame(spark, rows), ["g"], "v").collect()}
    for g, items in by_group(rows).items():
        values = [v for v, _ in items]
        for v in set(values):
            below = sum(x < v for x in values)
            assert got[(g, v)] == below + (values.count(v) + 1) / 2


def test_row_rank(spark, mode):
    rows = sample(values=5)
    got = {r.id: (r["rank"], r.n) for r in ordered.row_rank(frame(spark, rows), ["g"], "v", "id", size="n").collect()}
    for items in by_group(rows).values():
        for place, (_, i) in enumerate(sorted(items, key=lambda x: (-x[0], x[1])), 1):
            assert got[i] == (place, len(items))


def test_global_rank(spark, mode):
    rows = sample()
    got = {r.id: r.global_rank for r in ranking.global_rank(frame(spark, rows), "v", "id").collect()}
    for place, (_, _, i) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1):
        assert got[i] == place


def test_quantiles(spark, mode):
    rows = sample(values=1000)
    got = {r.g: r for r in ordered.quantiles(frame(spark, rows), ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}).collect()}
    for g, items in by_group(rows).items():
        want = np.quantile([v for v, _ in items], [0.1, 0.5, 0.99])
        assert np.allclose([got[g].a, got[g].m, got[g].z], want)


def test_nearest_distance(spark, mode):
    rows, refs = sample(200, 2, values=500), sample(30, 3, groups="a", values=500)
    out = joins.nearest_distance(frame(spark, rows), frame(spark, refs), ["g"], "v")
    marks = by_group(refs)
    for r in out.collect():
        want = min((abs(r.v - m) for m, _ in marks.get(r.g, [])), default=None)
        assert r.distance == want


def test_distance_limit_is_exclusive(spark):
    rows = frame(spark, [("a", 10.0, 1), ("a", 11.0, 2), ("b", 5.0, 3)])
    refs = frame(spark, [("a", 0.0, 9)])
    kept = {r.id for r in joins.far_from(rows, refs, ["g"], "v", 10).collect()}
    assert kept == {2, 3}
    assert {r.id for r in joins.far_from(rows, refs, ["g"], "v", 10, True).collect()} == {2}


def test_gap_clusters(spark, mode):
    rows = sample(120, 4, values=400)
    out = ranking.gap_clusters(frame(spark, rows), ["g"], "v", 5)
    got = {r.id: r.cluster_id for r in out.collect()}
    for g, items in by_group(rows).items():
        run, last = 1, None
        for v, i in sorted(items):
            if last is not None and v - last > 5:
                run += 1
            assert got[i] == f"{g}_C{run:02d}"
            last = v


def test_gap_exactly_at_limit_stays_together(spark):
    df = frame(spark, [("a", 1.0, 1), ("a", 31.0, 2), ("a", 62.0, 3)])
    assert {r.id: r.cluster_id for r in ranking.gap_clusters(df, ["g"], "v", 30).collect()} == {1: "a_C01", 2: "a_C01", 3: "a_C02"}


def test_benjamini_hochberg(spark, mode):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), None if i % 11 == 0 else round(rng.random(), 2), i) for i in range(150)]
    got = {r.id: r.q_value for r in ranking.benjamini_hochberg(frame(spark, rows), ["g"], "v").collect()}
    for g in "ab":
        items = sorted((v, i) for k, v, i in rows if k == g and v is not None)
        best, m = 1.0, len(items)
        for place in range(m, 0, -1):
            p, i = items[place - 1]
            best = min(best, p * m / place)
            assert got[i] == pytest.approx(best)
    assert all(got[i] is None for _, v, i in rows if v is None)
    assert all(0 <= q <= 1 for q in got.values() if q is not None)


def test_cut_groups_are_really_cut(hot):
    layout = ordered.lay_out(frame(hot, sample(values=1000)), ["g"], "v")
    assert layout.cut
    assert layout.df.select("_slice").distinct().count() > 3


def test_ordered_rows(spark, mode):
    rows = sample(values=7)
    got = {r.id: r.row_order for r in ranking.ordered_rows(frame(spark, rows), [F.asc("g"), F.desc("v"), F.asc("id")]).collect()}
    for place, (_, _, i) in enumerate(sorted(rows, key=lambda r: (r[0], -r[1], r[2])), 1):
        assert got[i] == place
