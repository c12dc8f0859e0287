"""Joint direction score: supplier = site, ship month = fold, discount = probability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.catalog.registry import Tables, query, rounded, whole
from sitelens.operators import aggregates as A
from sitelens.operators import ensembles as E
from sitelens.operators import metrics as M
from sitelens.operators import ranking as R


def fold_predictions(t: Tables) -> DataFrame:
    """(site, fold, prob): mean discount of a supplier's items per fold, as a share of the highest."""
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("site"), (F.month("l_shipdate") % 5 + 1).alias("fold"), "l_discount"
    )
    return rows.groupBy("site", "fold").agg(F.round(F.avg("l_discount") * 10, 8).alias("prob"))


FOLDS = """folds AS (SELECT l_suppkey AS site, month(l_shipdate) % 5 + 1 AS fold,
  round(avg(l_discount) * 10, 8) AS prob FROM lineitem GROUP BY 1, 2)"""


def functional_scores(t: Tables) -> DataFrame:
    """(site, functional_prob, known direction): account balance as a share, two of three suppliers known."""
    part = F.col("s_suppkey") % 3
    return t.supplier.select(
        F.col("s_suppkey").alias("site"),
        F.round((F.col("s_acctbal") + 1000) / 11000, 8).alias("functional_prob"),
        F.when(part == 0, "Known Import").when(part == 1, "Known Export").alias("known"),
    )


FUNCTIONAL = """functional AS (SELECT s_suppkey AS site, round((s_acctbal + 1000) / 11000, 8) AS functional_prob,
  CASE s_suppkey % 3 WHEN 0 THEN 'Known Import' WHEN 1 THEN 'Known Export' END AS known FROM supplier)"""


def joint_sites(t: Tables) -> DataFrame:
    sites = functional_scores(t)
    folds = E.joint_fold_scores(fold_predictions(t), sites, ["site"], "prob", "functional_prob")
    scored = E.joint_site_scores(folds, ["site"])
    return scored.join(sites.select("site", "known"), "site")


JOINT = f"""{FOLDS}, {FUNCTIONAL},
foldscores AS (SELECT f.site, f.fold, 2 * prob - 1 AS raw, (2 * prob - 1) * functional_prob AS score, known
  FROM folds f JOIN functional USING (site)),
joint AS (SELECT site, any_value(known) AS known, avg(raw) AS mean_raw, stddev_samp(raw) AS std_raw,
  round(avg(score), 12) AS mean_score, stddev_samp(score) AS std_score, abs(avg(score)) AS abs_score,
  count(*) FILTER (score > 0) AS votes_up, count(*) FILTER (score < 0) AS votes_down
  FROM foldscores GROUP BY site)"""

LIMITS = """limits AS (SELECT min(mean_score) FILTER (known = 'Known Import') AS up_threshold,
  max(mean_score) FILTER (known = 'Known Export') AS down_threshold, median(mean_score) AS global_median FROM joint)"""


@query("joint_scores", f"""WITH {JOINT}
SELECT site, known, round(mean_raw, 6) AS mean_raw, round(std_raw, 6) AS std_raw, round(mean_score, 6) AS mean_score,
  round(std_score, 6) AS std_score, round(abs_score, 6) AS abs_score, votes_up, votes_down FROM joint""")
def joint_scores(t: Tables) -> DataFrame:
    return rounded(joint_sites(t))


@query("stable_directions", f"""WITH {JOINT}, {LIMITS}
SELECT site, known, round(mean_score, 6) AS mean_score, votes_up, votes_down,
  CASE WHEN mean_score >= up_threshold AND votes_up >= 3 AND mean_score > global_median THEN 'Predicted Import'
       WHEN mean_score < down_threshold AND votes_down >= 3 AND mean_score < global_median THEN 'Predicted Export'
       ELSE 'Unselected' END AS stable_direction
FROM joint, limits""")
def stable_directions(t: Tables) -> DataFrame:
    labelled = E.stability_filter(joint_sites(t), "known", "Known Import", "Known Export", min_votes=3)
    return rounded(
        labelled.select("site", "known", "mean_score", "votes_up", "votes_down", "stable_direction")
    )


@query("stability_rule_counts", f"""WITH {JOINT}, {LIMITS},
flags AS (SELECT v AS min_votes,
  mean_score >= up_threshold AND votes_up >= v AND mean_score > global_median AS up,
  mean_score < down_threshold AND votes_down >= v AND mean_score < global_median AS down
  FROM joint, limits, (VALUES (3), (4), (5)) r(v))
SELECT min_votes, count(*) FILTER (up) AS n_up, count(*) FILTER (down) AS n_down,
  count(*) FILTER (up OR down) AS n_stable,
  round(CASE WHEN count(*) FILTER (down) > 0 THEN count(*) FILTER (up) / count(*) FILTER (down) END, 6) AS up_down_ratio
FROM flags GROUP BY 1""")
def stability_rule_counts(t: Tables) -> DataFrame:
    sites = joint_sites(t)
    limits = A.known_thresholds(sites, "mean_score", "known", "Known Import", "Known Export")
    wide = A.with_global_median(sites, "mean_score").crossJoin(F.broadcast(limits))
    return rounded(A.rule_counts(wide))


@query("known_score_limits", f"""WITH {JOINT}, {LIMITS}
SELECT round(up_threshold, 6) AS up_threshold, round(down_threshold, 6) AS down_threshold FROM limits""")
def known_score_limits(t: Tables) -> DataFrame:
    return rounded(A.known_thresholds(joint_sites(t), "mean_score", "known", "Known Import", "Known Export"))


@query("direction_by_sign", f"""WITH {JOINT}
SELECT site, CASE WHEN mean_score > 0 THEN 'import' WHEN mean_score < 0 THEN 'export' ELSE 'neutral' END AS pred_direction,
  round(greatest(mean_score, 0), 6) AS import_score, round(greatest(-mean_score, 0), 6) AS export_score,
  round(abs(mean_score), 6) AS margin FROM joint""")
def direction_by_sign(t: Tables) -> DataFrame:
    signed = E.direction_by_sign(joint_sites(t), "mean_score")
    return rounded(signed.select("site", "pred_direction", "import_score", "export_score", "margin"))


@query("top_joint_scores", f"""WITH {JOINT}
SELECT site, round(mean_score, 6) AS mean_score FROM joint ORDER BY abs(joint.mean_score) DESC, site LIMIT 10""")
def top_joint_scores(t: Tables) -> DataFrame:
    best = joint_sites(t).orderBy(F.abs("mean_score").desc(), "site").limit(10)
    return rounded(best.select("site", "mean_score"))


@query("score_selection_filled", f"""WITH {JOINT}, known_only AS (SELECT site, functional_prob FROM functional WHERE functional_prob >= 0.5)
SELECT j.site, round(j.mean_score, 6) AS mean_score, round(coalesce(k.functional_prob, 0), 6) AS functional_prob
FROM joint j LEFT JOIN known_only k USING (site) WHERE coalesce(k.functional_prob, 0) >= 0.6""")
def score_selection_filled(t: Tables) -> DataFrame:
    strong = functional_scores(t).where("functional_prob >= 0.5")
    left = joint_sites(t).select("site", "mean_score")
    return rounded(E.select_scores(left, strong, ["site"], "functional_prob", 0.6, fill_zero=True))


@query("fold_ensemble", f"""WITH {FOLDS}
SELECT site, round(avg(prob), 6) AS mean_prob, round(stddev_samp(prob), 6) AS std_prob, count(*) AS n_folds
FROM folds GROUP BY site""")
def fold_ensemble(t: Tables) -> DataFrame:
    return rounded(A.ensemble(fold_predictions(t), ["site"], "prob", expected_folds=5))


@query("bag_ensemble", f"""WITH {FOLDS}
SELECT site, round(avg(prob), 6) AS mean_prob, round(stddev_pop(prob), 6) AS std_prob, count(*) AS n_folds
FROM folds GROUP BY site""")
def bag_ensemble(t: Tables) -> DataFrame:
    return rounded(A.ensemble(fold_predictions(t), ["site"], "prob", population=True))


@query("fold_columns", f"""WITH {FOLDS}
SELECT site, round(avg(prob) FILTER (fold = 1), 6) AS prob_fold_1, round(avg(prob) FILTER (fold = 2), 6) AS prob_fold_2,
  round(avg(prob) FILTER (fold = 3), 6) AS prob_fold_3, round(avg(prob) FILTER (fold = 4), 6) AS prob_fold_4,
  round(avg(prob) FILTER (fold = 5), 6) AS prob_fold_5 FROM folds GROUP BY site""")
def fold_columns(t: Tables) -> DataFrame:
    return rounded(A.fold_columns(fold_predictions(t), ["site"], "prob", "fold", [1, 2, 3, 4, 5], "prob_fold_"))


@query("fold_votes", f"""WITH {FOLDS}
SELECT site, count(*) FILTER (prob > 0.5) AS votes_up, count(*) FILTER (prob < 0.5) AS votes_down FROM folds GROUP BY site""")
def fold_votes(t: Tables) -> DataFrame:
    return A.votes(fold_predictions(t).withColumn("score", F.col("prob") - 0.5), ["site"], "score")


@query("ensemble_labels", f"""WITH {FOLDS}, cut AS (SELECT avg(m) AS c FROM (SELECT fold, max(prob) - 0.05 AS m FROM folds GROUP BY fold))
SELECT site, round(avg(prob), 6) AS mean_prob, round(any_value(c), 6) AS final_threshold,
  (round(avg(prob), 10) >= round(any_value(c), 10))::INT AS pred_label FROM folds, cut GROUP BY site""")
def ensemble_labels(t: Tables) -> DataFrame:
    folds = fold_predictions(t)
    cuts = folds.groupBy("fold").agg((F.max("prob") - 0.05).alias("threshold"))
    mean = folds.groupBy("site").agg(F.round(F.avg("prob"), 10).alias("mean_prob"))
    scored = E.with_ensemble_threshold(mean, cuts, "threshold").withColumn(
        "final_threshold", F.round("final_threshold", 10)
    )
    return rounded(E.label_by_threshold(scored, "mean_prob"))


@query("ensemble_median_threshold", f"""WITH {FOLDS}, m AS (SELECT site, round(avg(prob), 10) AS mean_prob FROM folds GROUP BY site),
cut AS (SELECT median(mean_prob) AS final_threshold FROM m)
SELECT site, round(mean_prob, 6) AS mean_prob, round(final_threshold, 6) AS final_threshold,
  (mean_prob >= final_threshold)::INT AS pred_label FROM m, cut""")
def ensemble_median_threshold(t: Tables) -> DataFrame:
    mean = fold_predictions(t).groupBy("site").agg(F.round(F.avg("prob"), 10).alias("mean_prob"))
    return rounded(E.label_by_threshold(E.with_ensemble_threshold(mean, mean, "mean_prob", "median"), "mean_prob"))


@query("class_probability_names", f"""WITH {FOLDS}
SELECT site, fold, round(prob, 8) AS prob_import, round(1 - prob, 8) AS prob_export FROM folds""")
def class_probability_names(t: Tables) -> DataFrame:
    named = E.name_by_positive_class(fold_predictions(t), "prob", "import", "export")
    return rounded(named.select("site", "fold", "prob_import", "prob_export"), digits=8)


@query("out_of_fold_scores", f"""WITH {FOLDS}
SELECT f.site, round(avg(prob), 6) AS prob_positive, count(*) AS n_folds, max((s_nationkey < 12)::INT) AS label,
  round(1 - avg(prob), 6) AS prob_negative, max((s_nationkey < 12)::INT) = 1 AS is_positive
FROM folds f JOIN supplier ON f.site = s_suppkey GROUP BY f.site""")
def out_of_fold_scores(t: Tables) -> DataFrame:
    label = t.supplier.select(F.col("s_suppkey").alias("site"), (F.col("s_nationkey") < 12).cast("int").alias("label"))
    return rounded(A.out_of_fold_scores(fold_predictions(t).join(label, "site"), ["site"], "prob", "label"))


@query("platt_apply", f"""WITH {FOLDS}
SELECT site, fold, round(1 / (1 + exp(-(3.0 * prob - 1.5))), 6) AS calibrated FROM folds""")
def platt_apply(t: Tables) -> DataFrame:
    return rounded(E.platt_apply(fold_predictions(t), "prob", 3.0, -1.5).select("site", "fold", "calibrated"))


BRANCHES = f"""{FOLDS}, wide AS (SELECT site, avg(prob) FILTER (fold = 1) AS b1, avg(prob) FILTER (fold = 2) AS b2,
  avg(prob) FILTER (fold = 3) AS b3 FROM folds GROUP BY site),
rows AS (SELECT w.*, (s_nationkey < 12)::INT AS label FROM wide w JOIN supplier ON site = s_suppkey)"""


def branch_rows(t: Tables) -> DataFrame:
    wide = A.fold_columns(fold_predictions(t), ["site"], "prob", "fold", [1, 2, 3], "b")
    label = t.supplier.select(F.col("s_suppkey").alias("site"), (F.col("s_nationkey") < 12).cast("int").alias("label"))
    return wide.join(label, "site")


def auroc_sql(source: str, score: str, label: str, key: str | None = None) -> str:
    """AUROC by average ranks of a table, as a subquery with columns (key,) auroc."""
    part = f"PARTITION BY {key}" if key else ""
    head = f"{key}, " if key else ""
    tail = f"GROUP BY {key}" if key else ""
    return f"""(SELECT {head}CASE WHEN sum({label}) > 0 AND sum({label}) < count(*) THEN
      (sum(r) FILTER ({label} = 1) - sum({label}) * (sum({label}) + 1) / 2) / (sum({label}) * (count(*) - sum({label})))::DOUBLE END AS auroc
      FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {key + ', ' if key else ''}{score}) - 1) / 2 AS r
            FROM {source}) {tail})"""


@query("weighted_fusion", f"""WITH {BRANCHES}
SELECT site, round(0.5 * b1 + 0.3 * b2 + 0.2 * b3, 6) AS fused, round((b1 + b2 + b3) / 3, 6) AS fused_mean FROM rows""")
def weighted_fusion(t: Tables) -> DataFrame:
    rows = branch_rows(t)
    fused = E.mean_fusion(E.fuse(rows, {"b1": 5.0, "b2": 3.0, "b3": 2.0}), ["b1", "b2", "b3"])
    return rounded(fused.select("site", "fused", "fused_mean"))


ADAPTIVE = f"""WITH {BRANCHES}, long AS (UNPIVOT (SELECT label, b1, b2, b3 FROM rows) ON b1, b2, b3 INTO NAME branch VALUE score),
scored AS (SELECT branch, auroc, pow(greatest(coalesce(auroc, 0.5), 0.5), 2) AS w FROM {auroc_sql('long', 'score', 'label', 'branch')})"""


@query("adaptive_weights", f"""{ADAPTIVE}
SELECT branch, round(auroc, 6) AS auroc, round(w / sum(w) OVER (), 6) AS weight FROM scored""")
def adaptive_weights(t: Tables) -> DataFrame:
    return rounded(E.adaptive_weights(branch_rows(t), ["b1", "b2", "b3"], "label"))


@query("adaptive_fusion", f"""{ADAPTIVE}, ws AS (SELECT max(w) FILTER (branch = 'b1') AS w1, max(w) FILTER (branch = 'b2') AS w2,
  max(w) FILTER (branch = 'b3') AS w3 FROM scored)
SELECT site, round((w1 * b1 + w2 * b2 + w3 * b3) / (w1 + w2 + w3), 6) AS fused FROM rows, ws""")
def adaptive_fusion(t: Tables) -> DataFrame:
    rows = branch_rows(t)
    weights = E.adaptive_weights(rows, ["b1", "b2", "b3"], "label")
    return rounded(E.fuse_with_table(rows, weights, ["site"], ["b1", "b2", "b3"]).select("site", "fused"))


GRID_SQL = f"""WITH {BRANCHES}, grid AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS grid_id, i / 10 AS w_b1, j / 10 AS w_b2,
  (10 - i - j) / 10 AS w_b3 FROM range(11) a(i), range(11) b(j) WHERE i + j <= 10),
long AS (SELECT grid_id, label, round(w_b1 * b1 + w_b2 * b2 + w_b3 * b3, 12) AS score FROM rows, grid),
scored AS (SELECT * FROM {auroc_sql('long', 'score', 'label', 'grid_id')})
SELECT grid_id, round(w_b1, 6) AS w_b1, round(w_b2, 6) AS w_b2, round(w_b3, 6) AS w_b3, round(auroc, 6) AS auroc,
  grid_id = (SELECT first(grid_id ORDER BY round(auroc, 12) DESC, grid_id) FROM scored) AS is_best
FROM grid JOIN scored USING (grid_id)"""


@query("fusion_weight_search", GRID_SQL)
def fusion_weight_search(t: Tables) -> DataFrame:
    return rounded(E.search_weights(branch_rows(t), ["b1", "b2", "b3"], "label"))


@query("linear_fold_scores", """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS q, l_discount * 10 AS d, l_tax * 10 AS x FROM lineitem),
m AS (SELECT month(l_shipdate) % 5 + 1 AS fold, avg(l_discount) AS c1, avg(l_tax) AS c2, avg(l_quantity) / 100 AS c3 FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, l_linenumber, fold, q * c1 + d * c2 + x * c3 - 0.1 AS decision FROM x, m)
SELECT l_orderkey, l_linenumber, fold, round(sum(decision), 6) AS decision, round(sum(1 / (1 + exp(-decision))), 6) AS prob
FROM r GROUP BY ALL""")
def linear_fold_scores(t: Tables) -> DataFrame:
    li = t.lineitem
    feats = li.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("q"),
        (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("x"),
    )
    means = li.groupBy((F.month("l_shipdate") % 5 + 1).alias("fold")).agg(
        F.avg("l_discount").alias("q"), F.avg("l_tax").alias("d"), (F.avg("l_quantity") / 100).alias("x"),
        F.lit(-0.1).alias("(intercept)"),
    )
    coefs = means.unpivot(["fold"], ["q", "d", "x", "(intercept)"], "feature", "coef")
    return rounded(E.linear_score_sums(feats, coefs, ["l_orderkey", "l_linenumber"], ["q", "d", "x"]))


@query("score_or_model_mean", """SELECT l_orderkey, l_linenumber,
  round(coalesce(nullif(l_discount, 0.05), (l_tax + l_discount) / 2), 6) AS score FROM lineitem""")
def score_or_model_mean(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.05)).alias("raw_score"),
        F.col("l_tax").alias("model_1"), F.col("l_discount").alias("model_2"),
    )
    out = E.score_or_model_mean(rows, "raw_score", ["model_1", "model_2", "model_3"])
    return rounded(out.select("l_orderkey", "l_linenumber", "score"))


@query("collected_folds", f"""WITH {FOLDS} SELECT fold, count(*) AS n, round(avg(prob), 6) AS mean_prob FROM folds GROUP BY fold""")
def collected_folds(t: Tables) -> DataFrame:
    folds = fold_predictions(t)
    parts = {k: folds.where(F.col("fold") == k).drop("fold") for k in range(1, 6)}
    return rounded(E.collect_folds(parts).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob")))


@query("prediction_table", f"""WITH {FOLDS}
SELECT site, fold, (prob >= 0.5)::INT AS pred_label, CASE WHEN prob >= 0.5 THEN 'import' ELSE 'export' END AS pred_direction,
  (prob >= 0.5)::INT = (s_nationkey < 12)::INT AS correct FROM folds JOIN supplier ON site = s_suppkey""")
def prediction_table(t: Tables) -> DataFrame:
    label = t.supplier.select(F.col("s_suppkey").alias("site"), (F.col("s_nationkey") < 12).cast("int").alias("label"))
    out = M.prediction_table(fold_predictions(t).join(label, "site"), "prob", "label", 0.5, "import", "export")
    return out.select("site", "fold", "pred_label", "pred_direction", "correct")


@query("best_fold", f"""WITH {FOLDS} SELECT site, fold, round(prob, 6) AS prob FROM
  (SELECT *, row_number() OVER (PARTITION BY site ORDER BY prob DESC, fold) AS rn FROM folds) WHERE rn = 1""")
def best_fold(t: Tables) -> DataFrame:
    return rounded(M.best_fold(fold_predictions(t), ["site"], "prob", "fold"))


@query("score_percentiles", f"""WITH {JOINT}, r AS (SELECT site, known, mean_score, row_number() OVER (ORDER BY mean_score DESC, site) AS rank,
  count(*) OVER () AS n_rows FROM joint)
SELECT site, rank, n_rows, count(*) FILTER (known = 'Known Import') OVER (ORDER BY rank) AS n_flagged,
  rank - count(*) FILTER (known = 'Known Import') OVER (ORDER BY rank) AS n_other,
  round(count(*) FILTER (known = 'Known Import') OVER (ORDER BY rank) / rank, 6) AS flagged_share,
  round(100.0 * rank / n_rows, 6) AS rank_percentile FROM r""")
def score_percentiles(t: Tables) -> DataFrame:
    flagged = joint_sites(t).withColumn("is_import", F.coalesce(F.col("known") == "Known Import", F.lit(False)))
    out = R.running_class_share(flagged, "mean_score", "site", "is_import")
    return rounded(whole(out.select("site", "rank", "n_rows", "n_flagged", "n_other", "flagged_share", "rank_percentile"), "n_flagged", "n_other"))
