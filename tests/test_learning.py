"""The registered learners see whole vectors and the operators' own settings."""

import numpy as np
import pytest

from sitelens.catalog import learning
from sitelens.catalog.registry import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = np.random.default_rng(1)
    labels = np.arange(300) % 10
    x = r.normal(size=(300, 64))
    x[:, 63] = np.where(labels < 5, 2.0, -2.0) + 0.1 * x[:, 63]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_out_of_fold_sees_the_last_component(spark, tables):
    rows = QUERIES["out_of_fold_models"](spark, tables).collect()
    assert len(rows) == 300 and all((r["prob"] > 0.5) == (r["label"] == 1) for r in rows)


def test_fusion_has_every_component_in_one_branch(spark, tables, monkeypatch):
    seen = []
    plain = learning.L.out_of_fold
    monkeypatch.setattr(learning.L, "out_of_fold", lambda rows, columns, *a, **b: seen.append(columns) or plain(rows, columns, *a, **b))
    QUERIES["fusion_three_ways"](spark, tables).collect()
    assert len(seen) == 3 and sorted(sum(seen, []), key=lambda c: int(c[1:])) == [f"x{i}" for i in range(64)]


def test_base_classifiers_keep_the_operators_settings(spark, tables, monkeypatch):
    seen = []
    plain = learning.L.fit_classifier
    monkeypatch.setattr(learning.L, "fit_classifier", lambda train, columns, kind, **b: seen.append((len(columns), set(b))) or plain(train, columns, kind, **b))
    assert QUERIES["base_classifiers"](spark, tables).count() == 100
    assert seen == [(64, {"balance"})] * 5


def test_folds_fitted_together_are_the_models_fitted_alone(spark, tables):
    """Same objective and same coefficients as Spark ML's logistic regression on the other folds."""
    from pyspark.sql import functions as F

    from sitelens.operators import learners as L

    rows = spark.read.parquet(f"{tables}/embeddings.parquet").select(
        (F.col("label") % 2).cast("double").alias("label"), (F.col("vec_id") % 3).alias("fold"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(5)], F.lit(2.0).alias("x5")
    )
    columns = [f"x{i}" for i in range(6)]
    models = L.logistic_folds(rows, columns, fold="fold", folds=[0, 1, 2])
    for k in range(3):
        alone = L.fit_classifier(rows.where(F.col("fold") != k), columns, "logistic", tol=1e-12, maxIter=300).stages[-1]
        assert np.allclose(models[k][:-1], alone.coefficients.toArray(), atol=1e-6) and models[k][-1] == pytest.approx(alone.intercept, abs=1e-6)
    scored = L.out_of_fold(rows, columns, "fold", [0, 1, 2], "logistic").collect()
    assert len(scored) == 300
    r = scored[0]
    margin = sum(models[r["fold"]][i] * r[f"x{i}"] for i in range(6)) + models[r["fold"]][6]
    assert r["prob"] == pytest.approx(1 / (1 + np.exp(-margin)))
