"""Sequence and structure files as distributed text scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import scalars as S

# Three-letter residue names and their letters.
RESIDUE_LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def parse_sequence_records(records: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """(acc, sequence) of records "header, newline, body lines"; the last record of an accession counts."""
    body = F.regexp_replace(F.col(text), "^>", "")
    header = F.trim(F.regexp_replace(F.split_part(body, F.lit("\n"), F.lit(1)), "\r", ""))
    token = F.split_part(F.regexp_replace(header, r"\s+", " "), F.lit(" "), F.lit(1))
    acc = F.when(F.contains(token, F.lit("|")), F.split_part(token, F.lit("|"), F.lit(2))).otherwise(token)
    at = F.instr(body, F.lit("\n"))
    letters = F.when(at > 0, F.regexp_replace(F.substr(body, at + 1), r"\s+", "")).otherwise(F.lit(""))
    parsed = records.select(acc.alias("acc"), letters.alias("sequence"), F.struct(*order).alias("_o")).where(F.col("acc") != "")
    return parsed.groupBy("acc").agg(F.max_by("sequence", "_o").alias("sequence"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequence file or folder; records are split by Spark at line-start ``>``."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("_id", F.monotonically_increasing_id())
    return parse_sequence_records(rows, "value", ["_id"])


def accession_of_file(name: str | Column) -> Column:
    """``AF-<acc>-F1-model...`` gives acc; any other name its stem."""
    base = F.regexp_replace(S.col(name), r"^.*/", "")
    acc = F.regexp_extract(base, r"^AF-(.+?)-F1-model", 1)
    return F.when(acc != "", acc).otherwise(F.regexp_replace(base, r"\.[^.]*$", ""))


def resolve_files(files: DataFrame, accs: DataFrame, name: str = "name", acc: str = "acc") -> DataFrame:
    """Best file of every accession: the exact model names first, then the plain stem, then others of the accession.

    Names are matched by the accession they carry, an equi-join, then ranked.
    """
    base = F.regexp_replace(F.col(name), r"^.*/", "")
    named = files.withColumn(acc, accession_of_file(name)).withColumn(
        "_pref",
        F.when(F.rlike(base, F.lit(r"^AF-.+-F1-model_v4\.pdb$")), 0).when(F.rlike(base, F.lit(r"^AF-.+-F1-model")), 1).otherwise(2),
    )
    best = named.groupBy(acc).agg(F.min_by(name, F.struct("_pref", name)).alias(name))
    return accs.select(acc).distinct().join(best, acc, "left")


def parse_atom_lines(lines: DataFrame, text: str, file: str | Column) -> DataFrame:
    """Distinct (acc, pos) of ATOM lines with a whole residue number."""
    line = F.col(text)
    pos = F.trim(F.substring(line, 23, 4)).try_cast("int")
    rows = lines.where(F.startswith(line, F.lit("ATOM"))).select(accession_of_file(file).alias("acc"), pos.alias("pos"))
    return rows.where(F.col("pos").isNotNull()).distinct()


def read_structure_positions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"))
    return parse_atom_lines(lines, "value", "file")


def parse_ca_atoms(lines: DataFrame, text: str, file: str | Column) -> DataFrame:
    """Central atoms: residue letter (unknown X), coordinates and confidence; hetero residues are skipped."""
    line = F.col(text)
    letters = F.create_map(*[F.lit(x) for kv in RESIDUE_LETTERS.items() for x in kv])
    part = lambda start, size: F.trim(F.substring(line, start, size))
    rows = lines.where(F.startswith(line, F.lit("ATOM")) & (part(13, 4) == "CA")).select(
        accession_of_file(file).alias("acc"),
        part(23, 4).try_cast("int").alias("resseq"),
        F.coalesce(letters[F.upper(part(18, 3))], F.lit("X")).alias("aa"),
        part(31, 8).try_cast("double").alias("x"),
        part(39, 8).try_cast("double").alias("y"),
        part(47, 8).try_cast("double").alias("z"),
        part(61, 6).try_cast("double").alias("plddt"),
    )
    return rows.where(F.col("resseq").isNotNull())


def read_ca_atoms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"))
    return parse_ca_atoms(lines, "value", "file")
