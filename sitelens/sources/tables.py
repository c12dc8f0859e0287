"""Delimited tables: site tables, matrices, id maps, annotations, evidence, edges, results."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import scalars as S
from sitelens.operators.clean import InvalidInput, require

# Chromosomes kept of a gene annotation.
CHROMOSOMES = [str(i) for i in range(1, 23)] + ["X", "Y"]


def read_table(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited file with a header as string columns; a byte-order mark is cut, a repeated name keeps its first column.

    The schema comes from the header line, so there is no inference pass.
    """
    first = spark.read.text(path).select(decoded("value", encoding)).first()
    if first is None:
        raise InvalidInput(f"{path} is empty")
    names = [n.strip().strip('"') for n in first[0].lstrip("﻿").rstrip("\r").split(sep)]
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    rows = (
        spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("enforceSchema", True)
        .option("quote", '"').option("escape", '"').schema(schema).csv(path)
    )
    firsts = {n: i for i, n in reversed(list(enumerate(names)))}
    return rows.select(*[F.col(f"_c{i}").alias(n) for n, i in sorted(firsts.items(), key=lambda kv: kv[1])])


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site table with whole-number positions and lengths."""
    df = read_table(spark, path)
    for c in ("POSITION", "LENGTH"):
        if c in df.columns:
            df = df.withColumn(c, S.whole_number(c))
    return df


def read_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Distinct string keys, such as those of a fixed test part."""
    return read_table(spark, path).select(S.clean_text(key).alias(key)).distinct()


def unpivot_matrix(wide: DataFrame, key: str, cohort: str | Column, value: str = "value") -> DataFrame:
    """Wide matrix (one column per sample) to (cohort, entity, sample, value); bad numbers become NULL."""
    samples = [c for c in wide.columns if c != key]
    typed = wide.select(F.col(key).alias("entity"), *[S.number(F.col(f"`{c}`")).alias(c) for c in samples])
    long = typed.unpivot(["entity"], [F.col(f"`{c}`") for c in samples], "sample", value)
    name = F.lit(cohort) if isinstance(cohort, str) else cohort
    return long.select(name.alias("cohort"), "entity", "sample", value)


def read_matrix(spark: SparkSession, path: str, cohort: str) -> DataFrame:
    """Tab-separated matrix whose first column is the entity."""
    wide = read_table(spark, path, "\t")
    return unpivot_matrix(wide, wide.columns[0], cohort)


def gene_entity(entity: str | Column = "entity") -> Column:
    """Entity id without its version."""
    return S.without_version(entity)


def site_entity(entity: str | Column = "entity") -> Column:
    """``gene.version|..|..|S12|..`` to ``gene|S12``."""
    text = S.col(entity)
    return F.concat_ws("|", S.without_version(F.split_part(text, F.lit("|"), F.lit(1))), F.split_part(text, F.lit("|"), F.lit(3)))


def drop_all_zero(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Leave out entities whose every value is 0; a missing value is not 0."""
    zero = long.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(value) == 0, F.lit(False))).alias("_zero")).where("_zero")
    return long.join(zero.select(*keys), list(keys), "left_anti")


def parse_id_map(rows: DataFrame, acc: str, kind: str, ident: str, wanted: str = "Ensembl") -> DataFrame:
    """Accession to gene id, one kind only, versions cut, distinct."""
    kept = rows.where(F.col(kind) == wanted).select(S.clean_text(acc).alias("ACC_ID"), S.without_version(ident).alias("gene_id"))
    return kept.where((F.col("ACC_ID") != "") & (F.col("gene_id") != "")).distinct()


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    schema = "acc string, kind string, ident string"
    return parse_id_map(spark.read.schema(schema).option("sep", "\t").csv(path), "acc", "kind", "ident")


def parse_annotation(rows: DataFrame, chromosomes: Sequence[str] = CHROMOSOMES) -> DataFrame:
    """Genes on the listed chromosomes with an upper-cased name key."""
    require(rows, ["gene_id", "gene_name", "chrom"])
    return rows.where(F.col("chrom").isin(*chromosomes)).withColumn("name_key", S.name_key("gene_name"))


def read_annotation(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return parse_annotation(read_table(spark, path, sep))


def parse_evidence(wide: DataFrame, regulator: Column, target: str, pattern: str = "SRX") -> DataFrame:
    """(regulator, target, experiment, score) of the columns whose name holds the pattern."""
    experiments = [c for c in wide.columns if pattern in c]
    if not experiments:
        return wide.select(regulator.alias("regulator"), F.col(target).alias("target"), F.lit(None).cast("string").alias("experiment"),
                           F.lit(None).cast("double").alias("score")).limit(0)
    typed = wide.select(regulator.alias("regulator"), F.col(target).alias("target"),
                        *[S.number(F.col(f"`{c}`")).alias(c) for c in experiments])
    return typed.unpivot(["regulator", "target"], [F.col(f"`{c}`") for c in experiments], "experiment", "score")


def parse_evidence_lines(lines: DataFrame, regulator: Column, pattern: str = "SRX", sep: str = "\t") -> DataFrame:
    """Evidence of many files at once from (file, line_order, value) lines; every file has its own header.

    The header line of each file is joined to its other lines and the cells are
    paired with their column names, so files may differ in their columns.
    """
    heads = lines.groupBy("file").agg(F.min("line_order").alias("_first"), F.min_by("value", "line_order").alias("_head"))
    body = lines.join(heads, "file").where(F.col("line_order") != F.col("_first"))
    trimmed = lambda c: F.split(F.regexp_replace(c, "\r$", ""), sep)
    cells = F.explode(F.arrays_zip(trimmed("_head").alias("name"), trimmed("value").alias("text")))
    rows = body.select(regulator.alias("regulator"), F.trim(F.element_at(trimmed("value"), 1)).alias("target"), cells.alias("_c"))
    return rows.where(F.contains("_c.name", F.lit(pattern))).select(
        "regulator", "target", F.col("_c.name").alias("experiment"), S.number("_c.text").alias("score")
    )


def read_evidence(spark: SparkSession, path: str | list[str], pattern: str = "SRX") -> DataFrame:
    """Evidence files, one per regulator, in one scan; the regulator is the file name up to its first dot.

    Empty files give no rows.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line_order")
    )
    return parse_evidence_lines(lines, F.split_part("file", F.lit("."), F.lit(1)), pattern)


def with_evidence(sites: DataFrame, evidence: DataFrame, regulator: str) -> DataFrame:
    """Sites whose regulator has any evidence."""
    return sites.join(evidence.select(F.col("regulator").alias(regulator)).distinct(), regulator, "left_semi")


def parse_edges(rows: DataFrame) -> DataFrame:
    """Signed edges with non-blank keys and a non-zero weight."""
    require(rows, ["source", "target", "weight"])
    typed = rows.withColumns({"source": S.clean_text("source"), "target": S.clean_text("target"), "weight": S.number("weight")})
    good = (F.col("source") != "") & (F.col("target") != "") & (F.col("weight") != 0)
    return typed.where(good).withColumn("sign", F.signum("weight").cast("int"))


def read_edges(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return parse_edges(read_table(spark, path, sep))


def parse_preamble_table(lines: DataFrame, order: str, text: str, starts: str = "GENE\tPROTEIN", sep: str = "\t") -> DataFrame:
    """Table inside a text file: from the first line that starts with the header on, trimmed, missing as ''.

    ``order`` is the line's place in the file. Only the header line comes to the driver.
    """
    head = lines.where(F.startswith(F.col(text), F.lit(starts))).orderBy(order).limit(1).collect()
    if not head:
        raise InvalidInput(f"no header line starting with {starts!r}")
    names = [n.strip() for n in head[0][text].rstrip("\r").split(sep)]
    parts = F.split(F.regexp_replace(F.col(text), "\r$", ""), sep)
    body = lines.where((F.col(order) > head[0][order]) & (F.trim(text) != ""))
    return body.select(*[F.trim(F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(""))).alias(n) for i, n in enumerate(names)])


def decoded(column: str, encoding: str) -> Column:
    """Text of raw bytes in an encoding; the text scan itself keeps bytes as they are."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        return F.col(column)
    return F.decode(F.col(column).cast("binary"), encoding)


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines of a text file with their order."""
    lines = spark.read.text(path).withColumn("line_order", F.monotonically_increasing_id())
    return lines.withColumn("value", decoded("value", encoding))


def read_curated(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Curated site table behind a preamble."""
    return parse_preamble_table(read_lines(spark, path, encoding), "line_order", "value")


def read_text_any(spark: SparkSession, path: str, fallback: str = "ISO-8859-1") -> DataFrame:
    """Lines as UTF-8, or in the fallback encoding when any line is not valid UTF-8."""
    lines = read_lines(spark, path)
    if lines.where(~F.is_valid_utf8("value")).isEmpty():
        return lines
    return read_lines(spark, path, fallback)


def parse_known_sites(rows: DataFrame) -> DataFrame:
    """Known positives: accession, residue and position (from the key where columns lack them), direction word."""
    def have(c: str) -> Column:
        return S.clean_text(c) if c in rows.columns else F.lit(None).cast("string")

    key = have("INDEX")
    text = F.coalesce(have("Transport_Direction"), have("LABEL"))
    direction = F.when(F.contains(F.lower(text), F.lit("import")), "Import").when(F.contains(F.lower(text), F.lit("export")), "Export")
    out = rows.select(
        F.coalesce(have("ACC_ID"), F.split_part(key, F.lit("_"), F.lit(1))).alias("ACC_ID"),
        F.coalesce(F.upper(have("RESIDUE")), S.residue_from_key(key)).alias("RESIDUE"),
        F.coalesce(S.whole_number(have("POSITION")), S.position_from_key(key)).alias("POSITION"),
        direction.alias("direction"),
    )
    return out.dropDuplicates()


def load_fold_metrics(runs: Mapping[str, DataFrame], fold: str, expected: int) -> DataFrame:
    """Per-fold metrics of several runs as one table; a run without all folds is an error."""
    out: DataFrame | None = None
    for i, (name, df) in enumerate(runs.items()):
        tagged = df.withColumn("run", F.lit(name)).withColumn("run_order", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise InvalidInput("no runs given")
    bad = out.groupBy("run").agg(F.countDistinct(fold).alias("n")).where(F.col("n") != expected).collect()
    if bad:
        raise InvalidInput(f"runs without {expected} folds: {[(r['run'], r['n']) for r in bad]}")
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Result table as parquet or as CSV with a header, one file per task."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def config_table(spark: SparkSession, config) -> DataFrame:
    """Run configuration as a one-row table with its JSON text."""
    values = asdict(config) if is_dataclass(config) else dict(config)
    return spark.range(1).select(F.lit(json.dumps(values, sort_keys=True, default=str)).alias("config"))
