"""The tiled product against a join of all pairs, and the wide reductions against dense ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators import vectors as V
from sitelens.operators.products import masked_product


def brute(left, right, wanted):
    values = {}
    for k, i, c, v in right:
        values.setdefault((k, i), []).append((c, v))
    out = {}
    for k, r, i, p in left:
        for c, v in values.get((k, i), []):
            if (k, r, c) in wanted and p in ("x", "y"):
                t, n, rows = out.get((k, r, c, p), (0.0, 0, 0))
                out[(k, r, c, p)] = (t + (v or 0.0), n + (v is not None), rows + 1)
    return {k: (round(t, 9) if n else None, n, rows) for k, (t, n, rows) in out.items()}


@pytest.mark.parametrize("tile, inner", [(512, 1024), (3, 4)])
def test_masked_product(spark, tile, inner):
    r = random.Random(tile)
    left = [(r.choice(["a", "b", None]), r.randrange(12), f"i{r.randrange(15)}", r.choice(["x", "y", "z"])) for _ in range(150)]
    right = [(r.choice(["a", "b"]), f"i{r.randrange(15)}", f"c{r.randrange(9)}", r.choice([None, 1.5, -2.25, r.random()])) for _ in range(200)]
    wanted = {(r.choice(["a", "b"]), r.randrange(12), f"c{r.randrange(9)}") for _ in range(60)}
    got = masked_product(
        spark.createDataFrame(left, "k string, row int, inner string, part string").repartition(3),
        spark.createDataFrame(right, "k string, inner string, col string, v double").repartition(4),
        spark.createDataFrame(sorted(wanted), "k string, row int, col string"),
        ["k"], "row", "inner", "col", "v", "part", ["x", "y"], tile, inner,
    ).collect()
    found = {(g["k"], g["row"], g["col"], g["part"]): (None if g["total"] is None else round(g["total"], 9), g["n"], g["n_rows"]) for g in got}
    assert len(found) == len(got) and found == brute(left, right, wanted)
    none = spark.createDataFrame([], "k string, row int, col string")
    empty = masked_product(spark.createDataFrame(left, "k string, row int, inner string, part string"), spark.createDataFrame(right, "k string, inner string, col string, v double"), none, ["k"], "row", "inner", "col", "v", "part", ["x", "y"])
    assert empty.count() == 0


def vectors(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), float(k)) for i, (v, k) in enumerate(zip(x, y))], "id long, x array<double>, y double").repartition(3)


def test_principal_axes_wide_and_narrow_agree(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 64)) * np.linspace(3, 0.5, 64) + 5
    df = vectors(spark, x, x[:, 0])
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    want = axes[:, ::-1][:, :6]
    narrow = V.principal_axes(df, "x", 6, 64)
    monkeypatch.setattr(V, "GRAM_DIMS", 8)
    wide = V.principal_axes(df, "x", 6, 64)
    for got in (narrow, wide):
        assert np.abs(np.abs((got * want).sum(0)) - 1).max() < 1e-9
    assert np.abs(narrow - wide).max() < 1e-6
    rotation = V.pls_rotation(df, "x", "y", 4, 64)
    monkeypatch.setattr(V, "GRAM_DIMS", 1024)
    assert np.allclose(rotation, V.pls_rotation(df, "x", "y", 4), atol=1e-8)


def test_wide_vectors_never_make_a_square(spark):
    r = np.random.default_rng(4)
    hidden, mix = r.normal(size=(60, 3)) * [9, 5, 3], r.normal(size=(3, 20_000)) / 100
    x = hidden @ mix
    df = vectors(spark, x, hidden[:, 0])
    axes = V.principal_axes(df, "x", 3, 20_000)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert axes.shape == (20_000, 3) and np.abs(np.abs((axes * vt[:3].T).sum(0)) - 1).max() < 1e-8
    assert V.pls_rotation(df, "x", "y", 2, 20_000).shape == (20_000, 2)
