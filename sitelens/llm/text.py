"""Column rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space, tab, line feed,
#: vertical tab, form feed and carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def bucket(id_column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall into 0."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(0))
