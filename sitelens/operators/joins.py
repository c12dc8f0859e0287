"""Joins: checked, fallback, semi/anti pools, nearest distance, key expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.operators.clean import assert_unique
from sitelens.operators.ordered import attach, merge_join, neighbours

#: Tasks that share the edges of one target symbol.
SPREAD = 32


def one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "left") -> DataFrame:
    """Join whose two sides must have unique keys."""
    assert_unique(left, key)
    assert_unique(right, key)
    return left.join(right, list(key), how)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order.

    Spark keeps one row per key and partition before the shuffle, so a hot key
    sends few rows.
    """
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def one_per_key(table: DataFrame, key: str) -> DataFrame:
    """The least row of each key, in the order of its columns, so that the choice never depends on partitioning."""
    rest = [c for c in table.columns if c != key]
    if not rest:
        return table.distinct()
    return table.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")


def join_families(base: DataFrame, families: Sequence[DataFrame], key: str) -> DataFrame:
    """Left joins of several feature tables, each reduced to one row per key."""
    out = base
    for table in families:
        out = out.join(one_per_key(table, key), key, "left")
    return out


def with_group(
    sites: DataFrame, groups: DataFrame, key: str, group: str, prefix: str = "UNCLUSTERED_"
) -> DataFrame:
    """Left join of a group map; keys without a group get one of their own."""
    lookup = groups.select(key, group).where(F.col(group).isNotNull()).groupBy(key).agg(F.max(group).alias(group))
    return sites.join(lookup, key, "left").withColumn(
        group, F.coalesce(F.col(group).cast("string"), F.concat(F.lit(prefix), F.col(key).cast("string")))
    )


def split_matched(left: DataFrame, right: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a partner (joined) and rows without one."""
    return left.join(right, list(key), "inner"), left.join(right, list(key), "left_anti")


def with_match(left: DataFrame, right: DataFrame, key: Sequence[str], out: str = "matched") -> DataFrame:
    """Every row of ``left`` once, with ``out`` true where ``right`` has its key; a NULL key has no partner.

    The tables meet once, in a number of partitions that is not coalesced: keys are so few bytes
    that the partitions of many rows would be put together in one task.
    """
    key = list(key)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = right.select(*key).distinct().withColumn("_mark", F.lit(True))
    return left.repartition(parts, *key).join(marks, key, "left").withColumn(out, F.col("_mark").isNotNull()).drop("_mark")


def nearest_distance(
    rows: DataFrame, references: DataFrame, group: Sequence[str], pos: str, out: str = "distance"
) -> DataFrame:
    """Distance of every row to the nearest reference of its group; NULL if it has none."""
    group = list(group)
    marks = rows.select(*group, pos, F.lit(False).alias("_ref")).union(
        references.select(*group, pos, F.lit(True).alias("_ref"))
    )
    near = neighbours(marks, group, pos, "_ref").select(
        *group,
        pos,
        F.least(F.col(pos) - F.col("below"), F.col("above") - F.col(pos)).alias(out),
    )
    return attach(rows, near, [*group, pos])


def far_from(
    rows: DataFrame,
    references: DataFrame,
    group: Sequence[str],
    pos: str,
    distance: float,
    same_group_only: bool = False,
) -> DataFrame:
    """Rows farther than ``distance`` from every reference of their group."""
    base = rows.join(references.select(*group).distinct(), list(group), "left_semi") if same_group_only else rows
    measured = nearest_distance(base, references, group, pos, "_distance")
    return measured.where(F.col("_distance").isNull() | (F.col("_distance") > distance)).drop("_distance")


POOL_MODES = ("far", "other", "no_positive")


def background_pool(
    positives: DataFrame,
    candidates: DataFrame,
    mode: str,
    group: str,
    key: str,
    pos: str,
    distance: float = 0,
) -> DataFrame:
    """Candidates that may serve as negatives.

    ``far``: on a protein with a positive, not a positive, farther than ``distance``.
    ``other``: the same, with the distance rule only when it is above 0.
    ``no_positive``: on proteins without any positive.
    """
    if mode not in POOL_MODES:
        raise ValueError(f"mode must be one of {POOL_MODES}")
    usable = candidates.where(F.col(pos).isNotNull()) if mode != "no_positive" else candidates
    not_positive = usable.join(positives.select(key).distinct(), key, "left_anti")
    groups = positives.where(F.col(pos).isNotNull()).select(group).distinct()
    if mode == "no_positive":
        return not_positive.join(groups, group, "left_anti")
    inside = not_positive.join(groups, group, "left_semi")
    if mode == "other" and distance <= 0:
        return inside
    return far_from(inside, positives.where(F.col(pos).isNotNull()), [group], pos, distance)


def labelled_union(positives: DataFrame, pool: DataFrame, label: str = "LABEL") -> DataFrame:
    """Positives labelled 1 over the pool labelled 0."""
    return positives.withColumn(label, F.lit(1)).unionByName(pool.withColumn(label, F.lit(0)), allowMissingColumns=True)


def shared_background(pool: DataFrame, known: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Pool minus known minus predicted, as one anti join."""
    taken = known.select(key).union(predicted.select(key)).distinct()
    return pool.join(taken, key, "left_anti")


def new_predictions(scores: DataFrame, known: DataFrame, key: str, score: str, at_least: float) -> DataFrame:
    return scores.where(F.col(score) >= at_least).join(known.select(key).distinct(), key, "left_anti")


def excluding_two_keys(
    candidates: DataFrame, taken: DataFrame, group: str, key: str, pos: str
) -> DataFrame:
    """Candidates of the taken rows' groups without their exact and (group, position) keys."""
    inside = candidates.join(taken.select(group).distinct(), group, "left_semi")
    return inside.join(taken.select(key).distinct(), key, "left_anti").join(
        taken.select(group, pos).distinct(), [group, pos], "left_anti"
    )


def map_to_genes(
    predictions: DataFrame, id_map: DataFrame, genes: DataFrame, acc: str, gene: str, site_part: Column, score: str
) -> DataFrame:
    """Predictions with the first gene id of their accession, annotated genes only, best row per site."""
    first = id_map.groupBy(acc).agg(F.min(gene).alias(gene))
    mapped = (
        predictions.join(first, acc, "inner")
        .join(genes.select(gene).distinct(), gene, "left_semi")
        .withColumn("site", F.concat_ws("|", F.col(gene).cast("string"), site_part.cast("string")))
    )
    return first_per_key(mapped, ["site"], [F.col(score).desc_nulls_last(), F.col(acc)])


def sites_with_regulator(sites: DataFrame, genes: DataFrame, gene: str, name: str) -> DataFrame:
    """Sites with the name of their regulator; sites without one are dropped."""
    return sites.join(genes.select(gene, name).where(F.col(name).isNotNull()).distinct(), gene, "inner")


def supported_targets(
    edges: DataFrame, evidence: DataFrame | None, source: str, target: str
) -> DataFrame:
    """Signed edges, kept where the evidence names the same pair; names meet trimmed and in capitals."""
    if evidence is None:
        return edges
    names = {"_source": S.name_key(F.col(source).cast("string")), "_target": S.name_key(F.col(target).cast("string"))}
    return edges.withColumns(names).join(evidence.select(*[c.alias(n) for n, c in names.items()]).distinct(), list(names), "left_semi").drop(*names)


def targets_to_genes(
    edges: DataFrame, genes: DataFrame, expression: DataFrame, target: str, name: str, gene: str
) -> DataFrame:
    """Target symbols as gene ids (many to many), restricted to measured genes, distinct.

    Both sides are made distinct before they meet, so the pairs are neither shuffled nor stored; the edges of a
    frequent symbol are dealt to several tasks, each with a copy of the symbol's genes. The copies are merged, never
    broadcast: the size check does not see them.
    """
    ids = genes.select(S.name_key(name).alias("_n"), F.col(gene)).distinct().join(expression.select(gene).distinct(), gene, "left_semi")
    ids = ids.select("_n", gene, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_slot"))
    own = edges.distinct().select(S.name_key(target).alias("_n"), "*", F.pmod(F.xxhash64(*edges.columns), F.lit(SPREAD)).cast("int").alias("_slot"))
    return merge_join(own, ids, ["_n", "_slot"], growth=SPREAD).select(gene, *edges.columns)


def shared_samples(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().intersect(right.select(*keys).distinct())


def lookup_values(samples: DataFrame, matrix: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Values of an entity at the given samples, NULL where it was not measured."""
    side = matrix.select(*keys, F.col(value).alias(out))
    return samples.join(side, list(keys), "left")


def with_external_scores(
    base: DataFrame, externals: Sequence[tuple[DataFrame, str]], key: str, complete_only: bool = True, order: Sequence[str] = ()
) -> DataFrame:
    """Scores of other tools beside ours; of rows that repeat a key the first by ``order`` counts.

    Rows that agree in ``order`` are taken by the least score.
    """
    out = base
    names = []
    for table, column in externals:
        first = F.min_by(column, F.struct(*order, column))
        out = out.join(table.groupBy(key).agg(first.alias(column)), key, "left")
        names.append(column)
    return out.dropna(subset=names) if complete_only else out


def missing_scores(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias("missing_" + c) for c in columns],
        F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in columns]) == 0).alias("n_complete"),
    )


def flag_curated(scores: DataFrame, curated: DataFrame, key: str, label: str) -> DataFrame:
    """Curated flag, and whether the row stays (a negative that is curated does not)."""
    marks = curated.select(key).distinct().withColumn("_c", F.lit(True))
    return (
        scores.join(marks, key, "left")
        .withColumn("is_curated", F.coalesce("_c", F.lit(False)))
        .withColumn("kept", ~((F.col(label) == 0) & F.col("is_curated")))
        .drop("_c")
    )


def expand_keys(df: DataFrame, strict: Column, canonical: Column, out: str, mode: str = "both") -> DataFrame:
    """Strict key, canonical key, or both: two rows when they differ."""
    if mode == "strict":
        return df.withColumn(out, strict)
    if mode == "canonical":
        return df.withColumn(out, canonical)
    return df.withColumn(out, F.explode(F.array_distinct(F.array(strict, canonical))))


def weighted_by_average(
    rows: DataFrame, scores: DataFrame, key: str, score: str, out: str
) -> DataFrame:
    """Average score per key, 0 where there is none."""
    mean = scores.groupBy(key).agg(F.avg(score).alias(out))
    return rows.join(mean, key, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def restore_columns(rows: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Columns of the original table that the rows have lost."""
    lost = [c for c in original.columns if c not in rows.columns]
    return rows.join(one_per_key(original.select(key, *lost), key), key, "left")


def replace_columns(summary: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join whose right columns replace same-named ones."""
    clash = [c for c in extra.columns if c in summary.columns and c not in keys]
    return summary.drop(*clash).join(extra, list(keys), "left")


def join_dimension(
    facts: DataFrame, dimension: DataFrame, fact_name: str, dim_name: str, category: str, excluded: Sequence[str]
) -> DataFrame:
    """Join on normalised names, without the catch-all categories."""
    dim = dimension.where(~F.upper(F.col(category)).isin(*excluded)).withColumn("_n", S.name_key(dim_name))
    return facts.withColumn("_n", S.name_key(fact_name)).join(dim, "_n", "inner").drop("_n")


def annotate_known(rows: DataFrame, known: DataFrame, key: str, prefix: str = "known_") -> DataFrame:
    """Known columns under a prefix, and a Known/Unknown status."""
    columns = [c for c in known.columns if c != key]
    side = first_per_key(known, [key], [F.col(c).asc_nulls_last() for c in columns]).select(
        key, *[F.col(c).alias(prefix + c) for c in columns], F.lit(True).alias("_hit")
    )
    return (
        rows.join(side, key, "left")
        .withColumn("known_status", F.when(F.col("_hit"), "Known").otherwise("Unknown"))
        .drop("_hit")
    )


def values_by_group(members: DataFrame, features: DataFrame, key: str, group: str, columns: Sequence[str]) -> DataFrame:
    """Long (feature, group, key, value) of the members' features without missing values."""
    joined = members.select(key, group).join(features.select(key, *columns), key, "left")
    long = joined.unpivot([key, group], list(columns), "feature", "value")
    return long.where(F.col("value").isNotNull())
