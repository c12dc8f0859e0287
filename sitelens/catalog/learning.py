"""Calibration, base classifiers, out-of-fold scores and fusion on labelled documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.catalog.registry import Tables, query, rounded
from sitelens.operators import learners as L

DIMS = 64
COLUMNS = [f"x{i}" for i in range(DIMS)]


def examples(t: Tables) -> DataFrame:
    """Embedding dimensions as features, label group as class, a fold by row number."""
    return t.embeddings.select(
        "vec_id", (F.col("label") < 5).cast("double").alias("label"), (F.col("vec_id") % 3).alias("fold"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COLUMNS)],
    )


def flagged_lengths(t: Tables) -> DataFrame:
    """Shortness of each labelled document as score, low quality as label."""
    rows = t.documents.select("doc_id", (-F.log1p(F.col("n_chars").cast("double"))).alias("score")).join(t.labels, "doc_id")
    return rows.withColumn("label", (F.col("quality") == 0).cast("int"))


@query("platt_coefficients", """WITH RECURSIVE rows AS (SELECT -ln(1 + n_chars::DOUBLE) AS s, (quality = 0)::INT AS y FROM documents JOIN labels USING (doc_id)),
fit AS (SELECT 0 AS step, 0::DOUBLE AS a, 0::DOUBLE AS b UNION ALL
  SELECT step + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM
    (SELECT step, a, b, sum((p - y) * s) AS g1, sum(p - y) AS g2, sum(p * (1 - p) * s * s) AS h11, sum(p * (1 - p) * s) AS h12, sum(p * (1 - p)) AS h22 FROM
      (SELECT step, a, b, s, y, 1 / (1 + exp(-a * s - b)) AS p FROM fit, rows WHERE step < 25) GROUP BY step, a, b))
SELECT round(a, 5) AS slope, round(b, 5) AS intercept FROM fit WHERE step = 25""")
def platt_coefficients(t: Tables) -> DataFrame:
    slope, intercept = L.platt_fit(flagged_lengths(t), "score", "label")
    return rounded(t.labels.sparkSession.createDataFrame([(slope, intercept)], "slope double, intercept double"), digits=5)


@query("platt_calibration")
def platt_calibration(t: Tables) -> DataFrame:
    flagged = flagged_lengths(t)
    slope, intercept = L.platt_fit(flagged, "score", "label")
    return rounded(L.calibration_report(flagged, "score", "label", slope, intercept), digits=4)


@query("base_classifiers")
def base_classifiers(t: Tables) -> DataFrame:
    rows = examples(t)
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    out = test.select("vec_id", "label")
    for kind in L.KINDS:
        balance = "balanced" if kind in ("logistic", "svm", "forest") else None
        model = L.fit_classifier(train, COLUMNS, kind, balance=balance)
        out = out.join(L.probabilities(model, test, kind).select("vec_id", kind), "vec_id")
    return rounded(out, digits=4)


@query("out_of_fold_models")
def out_of_fold_models(t: Tables) -> DataFrame:
    oof = L.out_of_fold(examples(t), COLUMNS, "fold", [0, 1, 2], "logistic")
    return rounded(oof.select("vec_id", "fold", "label", "prob"), digits=4)


@query("fusion_three_ways")
def fusion_three_ways(t: Tables) -> DataFrame:
    rows = examples(t)
    branches = {"b1": COLUMNS[:21], "b2": COLUMNS[21:42], "b3": COLUMNS[42:]}
    oof = None
    for name, columns in branches.items():
        part = L.out_of_fold(rows, columns, "fold", [0, 1, 2], "logistic", out=name, check=False)
        part = part.select("vec_id", "label", "fold", name) if oof is None else part.select("vec_id", name)
        oof = part if oof is None else oof.join(part, "vec_id")
    fused = L.fuse_three_ways(oof.where("fold <> 0"), oof.where("fold = 0"), list(branches), ["vec_id"])
    return rounded(L.fusion_metrics(fused, [*branches, "stacked", "fused_mean", "fused_weighted"]), digits=4)
