"""Row cleaning: keys, validity, directions, filters by missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import scalars as S


class InvalidInput(ValueError):
    """A table breaks a rule that the operator must not repair."""


def examples(df: DataFrame, column: str, n: int = 10) -> list:
    """A few values for an error message."""
    return [r[0] for r in df.select(column).limit(n).collect()]


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InvalidInput(f"missing columns: {missing}")


def or_error(value: Column, bad: Column, message: str, detail: Column) -> Column:
    """The value, or an error raised by the job itself when a row is bad."""
    return F.when(bad, F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(detail.cast("string"), F.lit("null")))).cast("string")).otherwise(
        value.cast("string")
    )


def standardize_sites(df: DataFrame, acc: str = "ACC_ID", pos: str = "POSITION", key: str = "INDEX") -> DataFrame:
    """Trim keys, build a missing key from accession and position, make positions whole numbers.

    A position that is not a number is an error raised where the row is read.
    """
    require(df, [acc, pos])
    built = S.site_key(acc, pos)
    made = df.withColumn(key, S.clean_text(key) if key in df.columns else built)
    place = S.whole_number(pos)
    checked = or_error(place, place.isNull(), f"invalid {pos}", F.col(key))
    return made.withColumn(pos, checked.cast("bigint")).withColumn(acc, S.clean_text(acc))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate keys as an error with examples; returns the table itself."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if bad:
        raise InvalidInput(f"duplicate keys {list(keys)}: {[tuple(r)[:-1] for r in bad]}")
    return df


def invalid_reason(pos: str, sequence: str, key: str, enforce_residue: bool = True) -> Column:
    """First rule a site breaks, or NULL for a valid site."""
    letter = F.upper(F.substr(F.col(sequence), F.col(pos).cast("int"), F.lit(1)))
    expected = S.residue_from_key(key)
    reason = (
        F.when(F.col(pos).isNull(), "position_missing")
        .when(F.col(pos) < 1, "position_below_one")
        .when(F.col(sequence).isNull(), "sequence_missing")
        .when(F.col(pos) > F.length(sequence), "position_beyond_sequence")
        .when(expected.isNotNull() & (letter != expected), "residue_differs_from_key")
    )
    if enforce_residue:
        reason = reason.when(~letter.isin(*S.PHOSPHO_RESIDUES), "residue_not_allowed")
    return reason


def tag_invalid_sites(
    df: DataFrame, pos: str, sequence: str, key: str, enforce_residue: bool = True, reason: str = "drop_reason"
) -> DataFrame:
    typed = df.withColumn(pos, S.whole_number(pos))
    return typed.withColumn(reason, invalid_reason(pos, sequence, key, enforce_residue))


def drop_invalid_sites(
    df: DataFrame, pos: str = "POSITION", sequence: str = "FULL_SEQUENCE", key: str = "INDEX", enforce_residue: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Valid sites, and rejected sites with their reason."""
    tagged = tag_invalid_sites(df, pos, sequence, key, enforce_residue)
    return split_by_reason(tagged)


def split_by_reason(tagged: DataFrame, reason: str = "drop_reason") -> tuple[DataFrame, DataFrame]:
    return tagged.where(F.col(reason).isNull()).drop(reason), tagged.where(F.col(reason).isNotNull())


def reject_audit(tagged: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """Rows in, kept and dropped, and the dropped rows by reason: one row per reason."""
    return (
        tagged.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias(reason))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def combine_rejects(*parts: DataFrame) -> DataFrame:
    """Reject tables of several steps as one, missing columns filled with NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def tag_missing_inputs(
    sites: DataFrame, sequences: DataFrame, embedded: DataFrame, acc: str, pos: str, reason: str = "drop_reason"
) -> DataFrame:
    """First of: no embedding, no sequence, position out of range."""
    have = embedded.select(F.col(acc)).distinct().withColumn("_has_embedding", F.lit(True))
    seq = sequences.select(acc, F.length("sequence").alias("_len")).groupBy(acc).agg(F.max("_len").alias("_len"))
    joined = sites.join(have, acc, "left").join(seq, acc, "left")
    why = (
        F.when(F.col("_has_embedding").isNull(), "no_embedding")
        .when(F.col("_len").isNull(), "no_sequence")
        .when(F.col(pos).isNull() | (F.col(pos) < 1) | (F.col(pos) > F.col("_len")), "position_out_of_range")
    )
    return joined.withColumn(reason, why).drop("_has_embedding", "_len")


def tag_structure_availability(
    sites: DataFrame, residues: DataFrame, acc: str, pos: str, reason: str = "structure_reason"
) -> DataFrame:
    """Whether the protein has a structure file and the site's position occurs in it."""
    files = residues.select(acc).distinct().withColumn("_has_file", F.lit(True))
    places = residues.select(acc, pos).distinct().withColumn("_has_pos", F.lit(True))
    joined = sites.join(files, acc, "left").join(places, [acc, pos], "left")
    why = F.when(F.col("_has_file").isNull(), "missing_pdb_file").when(
        F.col("_has_pos").isNull(), "position_not_found_in_pdb"
    )
    return joined.withColumn(reason, why).drop("_has_file", "_has_pos")


def structure_audit(tagged: DataFrame, label: str, reason: str = "structure_reason") -> DataFrame:
    """Rows in, kept and removed per cause, by label."""
    return tagged.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(F.col(reason).isNull()).alias("n_kept"),
        F.count_if(F.col(reason) == "missing_pdb_file").alias("n_missing_file"),
        F.count_if(F.col(reason) == "position_not_found_in_pdb").alias("n_missing_position"),
    )


def normalize_direction(
    df: DataFrame, label: str, out: str, labels: Mapping[str, str] = S.DIRECTION_LABELS
) -> DataFrame:
    """Direction by label map; an unknown label is an error raised where the row is read."""
    mapped = S.map_label(label, labels)
    bad = F.col(label).isNotNull() & mapped.isNull()
    return df.withColumn(out, or_error(mapped, bad, "unknown label", F.col(label)))


def direction_from_first_column(df: DataFrame, candidates: Sequence[str], out: str) -> DataFrame:
    """Direction rules applied to the first candidate column the table has."""
    source = next((c for c in candidates if c in df.columns), None)
    value = F.lit(None).cast("string") if source is None else S.direction_from_text(source)
    return df.withColumn(out, value)


def select_task(df: DataFrame, direction: str, task: str | Sequence[str]) -> DataFrame:
    """Rows of one direction or of several."""
    wanted = [task] if isinstance(task, str) else list(task)
    return df.where(F.col(direction).isin(*wanted))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise InvalidInput(message)
    return df


def drop_conflicts(df: DataFrame, keys: Sequence[str], direction: str) -> DataFrame:
    """Remove every row of a key that carries more than one direction.

    The keys in conflict are found by a partial aggregate; the rows themselves
    are not grouped.
    """
    bad = (
        df.groupBy(*keys)
        .agg(F.min(direction).alias("_lo"), F.max(direction).alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select(*keys)
    )
    return df.join(bad, list(keys), "left_anti")


def binary_label(df: DataFrame, direction: str, positive: str, out: str = "label") -> DataFrame:
    return df.withColumn(out, (F.col(direction) == positive).cast("int"))


def relative_position(df: DataFrame, pos: str, length: str, out: str = "relative_position") -> DataFrame:
    """Position over length for rows with 0 < position <= length."""
    typed = df.withColumn("_p", S.number(pos)).withColumn("_l", S.number(length))
    return typed.where((F.col("_p") > 0) & (F.col("_p") <= F.col("_l"))).withColumn(out, F.col("_p") / F.col("_l")).drop(
        "_p", "_l"
    )


def keep_observed_rows(long: DataFrame, keys: Sequence[str], value: str, max_missing: float) -> DataFrame:
    """Entities of a long matrix whose share of missing values is at most the limit."""
    good = (
        long.groupBy(*keys)
        .agg(F.avg(F.col(value).isNull().cast("double")).alias("_missing"))
        .where(F.col("_missing") <= max_missing)
        .select(*keys)
    )
    return long.join(good, list(keys), "left_semi")


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its share of missing values; one pass over the table."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return rates.unpivot([], list(columns), "feature", "missing_rate")


def drop_sparse_columns(df: DataFrame, columns: Sequence[str], max_rate: float = 0.5) -> DataFrame:
    """Drop the listed columns whose missing rate is above the limit."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] is not None and row[c] > max_rate])


def binary_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which columns hold only 0 and 1 where present."""
    checks = [
        F.coalesce(F.bool_and(F.col(c).cast("double").isin(0.0, 1.0)), F.lit(False)).alias(c) for c in columns
    ]
    return df.agg(*checks).unpivot([], list(columns), "feature", "is_binary")


def mark_known(
    sites: DataFrame,
    known: DataFrame,
    identities: Sequence[str],
    direction: str,
    out: str = "is_known",
) -> DataFrame:
    """Mark sites of which any identity column is a known key for the same direction.

    ``known`` has columns (key, direction). When it holds no row of a direction,
    the keys of all directions count. Directions are a handful of words, so the
    collected sets stay short.
    """
    covered = known.agg(F.collect_set("direction").alias("_covered"))
    keys = known.groupBy("key").agg(F.collect_set("direction").alias("_ways"))
    flagged = sites.crossJoin(F.broadcast(covered))
    hits = F.lit(False)
    for i, c in enumerate(identities):
        side = keys.select(F.col("key").alias(f"_k{i}"), F.col("_ways").alias(f"_w{i}"))
        flagged = flagged.join(side, F.col(c) == F.col(f"_k{i}"), "left")
        counts = F.array_contains(f"_w{i}", F.col(direction)) | ~F.array_contains("_covered", F.col(direction))
        hits = hits | (F.col(f"_k{i}").isNotNull() & F.coalesce(counts, F.lit(False)))
    helpers = [f"_{x}{i}" for i in range(len(identities)) for x in "kw"]
    return flagged.withColumn(out, hits).drop("_covered", *helpers)


def score_column(df: DataFrame, candidates: Sequence[str], exclude: Sequence[str] = ()) -> str:
    """First candidate that exists, else the only numeric column."""
    for c in candidates:
        if c in df.columns:
            return c
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in
               ("double", "float", "integer", "long", "short", "byte", "decimal") and f.name not in exclude]
    if len(numeric) != 1:
        raise InvalidInput(f"cannot choose a score column among {numeric}")
    return numeric[0]


def unit_score(df: DataFrame, candidates: Sequence[str], exclude: Sequence[str] = (), out: str = "score") -> DataFrame:
    """The chosen score column, bounded to [0, 1]."""
    name = score_column(df, candidates, exclude)
    return df.withColumn(out, S.clip(S.number(name), 0.0, 1.0))


def analytic_columns(df: DataFrame, identifiers: Sequence[str]) -> list[str]:
    """All columns that are not identifiers, compared without case."""
    known = {c.lower() for c in identifiers}
    return [c for c in df.columns if c.lower() not in known]


def fallback_key(df: DataFrame, key: str, acc: str, residue: str | None, pos: str, out: str = "site_key") -> DataFrame:
    """Key column, else accession + residue + position, else accession + position."""
    parts = []
    if key in df.columns:
        parts.append(F.nullif(S.clean_text(key), F.lit("")))
    if residue and residue in df.columns:
        full = F.concat(S.clean_text(acc), F.lit("_"), F.nullif(F.upper(S.clean_text(residue)), F.lit("")),
                        S.whole_number(pos).cast("string"))
        parts.append(full)
    parts.append(F.concat_ws("_", S.clean_text(acc), S.whole_number(pos).cast("string")))
    return df.withColumn(out, F.coalesce(*parts))


def ratio_values(
    site_long: DataFrame, gene_long: DataFrame, keys: Sequence[str], value: str = "value", out: str = "value"
) -> DataFrame:
    """Site value minus the value of its own gene in the same sample."""
    base = gene_long.select(*keys, F.col(value).alias("_base"))
    joined = site_long.join(base, list(keys), "left")
    return joined.withColumn(out, F.col(value) - F.col("_base")).drop("_base")


def select_mode(points: DataFrame, mode: str, column: str = "expression_mode") -> DataFrame:
    return points.where(F.col(column) == mode)


def modes_to_build(adjust: str) -> list[str]:
    """Expression modes a run builds: raw, adjusted, or both."""
    return {"raw": ["raw"], "adjusted": ["adjusted"], "both": ["raw", "adjusted"]}[adjust]


