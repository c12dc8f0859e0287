"""Cohort validation: splits -> target contrasts -> tests, activity, controls, confounder sensitivity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.operators import cohort as C
from sitelens.operators import resampling as RS
from sitelens.operators.aggregates import collapse_edges
from sitelens.operators.clean import InvalidInput, ratio_values
from sitelens.operators.joins import supported_targets

#: The sensitivity modules that each mode of ``confounders`` runs, and the known covariates.
MODULES = {
    "none": (),
    "diagnostic": ("diagnostic",),
    "ratio": ("ratio",),
    "adjusted": ("adjusted",),
    "full": ("diagnostic", "ratio", "adjusted"),
}
COVARIATES = ("mrna", "protein", "purity")


@dataclass(frozen=True)
class CohortConfig:
    """Parameters of cohort validation."""

    split_mode: str = "median_nonmissing"
    min_group: int = 5
    fraction: float = 0.25
    min_targets: int = 3
    random_iterations: int = 100
    confounders: str = "full"
    covariates: tuple[str, ...] = ("protein",)
    min_samples: int = 10
    seed: int = 42


@dataclass(frozen=True)
class SensitivityResult:
    """Parts of the confounder analysis; a part that was not run is None."""

    abundance: DataFrame | None
    ratio_effects: DataFrame | None
    ratio_summary: DataFrame | None
    adjusted_targets: DataFrame | None
    adjusted_activity: DataFrame | None
    robustness: DataFrame


@dataclass(frozen=True)
class CohortResult:
    split_summary: DataFrame
    effects: DataFrame
    site_tests: DataFrame
    pooled_tests: DataFrame
    effect_summary: DataFrame
    activity: DataFrame
    activity_tests: DataFrame
    random_control: DataFrame
    sensitivity: SensitivityResult | None


SITE = ["cohort", "site"]


def _contrasts(members: DataFrame, targets: DataFrame, expression: DataFrame) -> DataFrame:
    """High minus low of every target of every site."""
    points = C.group_means(members, targets, expression, ["cohort"], ["site"], "sample", "gene", "value", ["direction", "regulation"])
    return C.target_effects(C.high_low_pairs(points, [*SITE, "gene", "direction", "regulation"]), "direction", "regulation")


def confounder_sensitivity(
    site_values: DataFrame,
    expression: DataFrame,
    targets: DataFrame,
    sites: DataFrame,
    members: DataFrame,
    summary: DataFrame,
    activity: DataFrame,
    protein: DataFrame | None = None,
    phenotype: DataFrame | None = None,
    config: CohortConfig = CohortConfig(),
) -> SensitivityResult | None:
    """Does the regulator's abundance explain what the site's values do?

    ``sites`` (site, regulator_gene, direction) names the regulator's gene in
    ``expression`` and ``protein`` (cohort, gene, sample, value); ``phenotype``
    (cohort, sample, purity). diagnostic: abundance of high against low samples and
    its correlation with the site's values. ratio: splits and contrasts once more
    on the site's value minus its protein's. adjusted: coefficient of the site's value on
    targets and on activity beside ``config.covariates``, NULL below
    ``config.min_samples`` complete samples. A module without its tables is left out.
    """
    if config.confounders not in MODULES:
        raise InvalidInput(f"confounders must be one of {sorted(MODULES)}")
    if not set(config.covariates) <= set(COVARIATES):
        raise InvalidInput(f"covariates must be among {COVARIATES}")
    modules = MODULES[config.confounders]
    if not modules:
        return None
    keys = [*SITE, "direction"]
    own = sites.select("site", F.col("regulator_gene").alias("gene")).distinct()
    way = sites.select("site", "direction").distinct()
    frame = site_values.where(F.col("value").isNotNull()).select(*SITE, "sample", "value").join(own, "site")
    tables = {"mrna": expression, **({"protein": protein} if protein is not None else {})}
    frame = C.covariate_frame(frame, tables, ["cohort", "gene", "sample"]).drop("gene")
    if phenotype is not None:
        frame = C.covariate_frame(frame, {"purity": phenotype}, ["cohort", "sample"], "purity")

    abundance = ratio_effects = ratio_summary = adjusted_targets = adjusted_activity = None
    if "diagnostic" in modules:
        rows = members.join(frame, [*SITE, "sample"])
        abundance = C.abundance_diagnostics(rows, SITE, "value", list(tables)).join(way, "site")
    if "ratio" in modules and protein is not None:
        moved = ratio_values(site_values.join(own, "site"), protein, ["cohort", "gene", "sample"]).drop("gene")
        again, _ = C.split_samples(moved, SITE, "sample", "value", config.split_mode, config.min_group, config.fraction)
        ratio_effects = _contrasts(again, targets, expression)
        ratio_summary = C.summarize_effects(ratio_effects, [*keys, "regulation"], config.min_targets)
    known = set(frame.columns)
    if "adjusted" in modules and set(config.covariates) <= known:
        covariates = list(config.covariates)
        done = summary.where("status = 'success'").select(*SITE)
        rows = frame.join(done, SITE, "left_semi")
        outcome = expression.select("cohort", "gene", "sample", F.col("value").alias("_outcome"))
        fits = C.adjusted_target_association(
            rows, targets, outcome, ["cohort"], ["site"], "sample", "gene", "_outcome", "value", covariates, [], config.min_samples, ["direction", "regulation"]
        )
        adjusted_targets = fits.withColumn("directional_coef", S.directional_effect("coef", "direction", "regulation"))
        adjusted_activity = C.adjusted_association(
            rows.join(activity.select(*keys, "sample", "activity"), [*SITE, "sample"]), keys, "activity", "value", covariates, [], config.min_samples
        )
    base = summary.where("status = 'success'").select(*SITE).join(way, "site").select(*keys).distinct()
    robustness = C.robustness_summary(
        base, keys, abundance, list(tables) if abundance is not None else (), ratio_summary, adjusted_targets, adjusted_activity
    )
    return SensitivityResult(abundance, ratio_effects, ratio_summary, adjusted_targets, adjusted_activity, robustness)


def validate_cohorts(
    site_values: DataFrame,
    expression: DataFrame,
    edges: DataFrame,
    sites: DataFrame,
    evidence: DataFrame | None = None,
    config: CohortConfig = CohortConfig(),
    protein: DataFrame | None = None,
    phenotype: DataFrame | None = None,
) -> CohortResult:
    """All cohorts and sites in one set of plans; the site is a key column.

    ``site_values`` (cohort, site, sample, value), ``expression`` (cohort, gene,
    sample, value), ``edges`` (source, target, weight), ``sites`` (site, regulator,
    direction, and regulator_gene where it differs from the name), ``evidence``
    (source, target) pairs that were observed. ``protein`` and ``phenotype`` as in
    ``confounder_sensitivity``.
    """
    members, summary = C.split_samples(
        site_values, SITE, "sample", "value", config.split_mode, config.min_group, config.fraction
    )
    signed = supported_targets(collapse_edges(edges, "source", "target", "weight"), evidence, "source", "target")
    names = sites.withColumn("_key", S.name_key("regulator"))
    measured = expression.select("gene").distinct().withColumn("_target", S.name_key("gene"))
    edges_by_name = signed.select(S.name_key("source").alias("_key"), S.name_key("target").alias("_target"), "regulation")
    targets = names.join(edges_by_name, "_key").join(measured, "_target").select("site", "direction", "gene", "regulation").distinct()
    effects = _contrasts(members, targets, expression)
    by_site = [*SITE, "direction", "regulation"]
    pooled = ["cohort", "direction", "regulation"]
    activity = C.regulator_activity(members, targets, expression, ["cohort"], ["site"], "sample", "gene", "value", by=["direction"])

    # Background of a site: every gene of its cohort that is not one of its targets.
    genes = expression.select("cohort", "gene").distinct()
    mine = targets.select("site", "gene").distinct()
    used = effects.select(*SITE, "direction", "regulation").distinct()
    others = used.join(genes, "cohort").join(mine, ["site", "gene"], "left_anti")
    background = _contrasts(members, others.select("site", "gene", "direction", "regulation").distinct(), expression)
    numbers = expression.select("gene").distinct().withColumn("member", F.row_number().over(Window.orderBy("gene")).cast("bigint"))
    background = background.join(numbers, "gene").select(*by_site, "member", "directional_effect")
    seen = effects.select(*by_site, "directional_effect")
    control = RS.matched_random_control(
        seen, background, by_site, "directional_effect", "member", config.random_iterations, config.seed, config.min_targets
    )
    located = sites if "regulator_gene" in sites.columns else sites.withColumn("regulator_gene", F.col("regulator"))
    return CohortResult(
        summary,
        effects,
        C.contrast_test(effects, by_site, "direction", "regulation", pooled, "gene", config.min_targets),
        C.contrast_test(effects, pooled, "direction", "regulation", [], "gene", config.min_targets, site="site"),
        C.summarize_effects(effects, by_site, config.min_targets),
        activity,
        C.activity_test(activity, [*SITE, "direction"], ["cohort", "direction"], config.min_group, "direction"),
        control,
        confounder_sensitivity(site_values, expression, targets, located, members, summary, activity, protein, phenotype, config),
    )
