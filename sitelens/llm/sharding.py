"""Contiguous shards whose largest is as small as possible; equal texts stay together.

Main path: DataFrame functions only. Groups of equal texts are put in order of
their smallest id, running sums of bytes are taken over ranges of that order, and
the least capacity for which greedy filling needs no more than the wanted number
of shards is searched; the cuts of that filling are final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.store import settle

#: Capacities that one pass over the group ends tries together.
TRIES = 48


def _highest(ends: DataFrame, limits: list[int]) -> list[int]:
    """For each limit the largest group end that is not above it, or 0."""
    picks = [F.max(F.when(F.col("end") <= v, F.col("end"))).alias(f"e{i}") for i, v in enumerate(limits)]
    found = ends.filter(F.col("end") <= max(limits)).agg(*picks).first()
    return [int(v or 0) for v in found]


def _fill(ends: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """Greedy cuts for several capacities: the end of each shard, one list per capacity."""
    at = [0] * len(capacities)
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        at = _highest(ends, [a + c for a, c in zip(at, capacities)])
        for own, a in zip(cuts, at):
            own.append(a)
    return cuts


def least_capacity(ends: DataFrame, shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """The least capacity and its cuts, by a search that splits the range ``TRIES`` ways each time.

    A capacity of the mean plus the largest group always suffices; none below the
    mean or below the largest group does.
    """
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    cuts = None
    while low < high or cuts is None:
        step = max(1, -(-(high - low) // TRIES))
        tries = sorted({min(low + i * step, high) for i in range(TRIES + 1)})
        filled = _fill(ends, tries, shards)
        good = next(i for i, own in enumerate(filled) if own[-1] >= total)
        high, cuts = tries[good], filled[good]
        low = tries[good - 1] + 1 if good else high
    return high, cuts


def ordered_sums(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with ``end`` (running bytes) and ``place`` (running number) over the whole order.

    Ranges of the order are written once with their number; sums inside a range
    are windows, and one row per range carries the sums before it.
    """
    ranged = settle(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    parts = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumn("end", F.sum("size").over(inside))
        .withColumn("place", F.row_number().over(inside))
        .join(settle(parts, f"{name}-parts"), "part")
        .withColumn("end", F.col("end") + F.col("bytes_before"))
        .withColumn("place", F.col("place") + F.col("rows_before"))
        .drop("part", "bytes_before", "rows_before")
    )


def shard(docs: DataFrame, shards: int = 8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    size: UTF-8 bytes of the text (null: none) plus 1, so empty texts count. Groups
    are rows of equal text (by SHA-256; null texts are a group), ordered by smallest id, then
    digest; inside a group rows go by id. A group larger than the mean is kept
    whole and sets the capacity, so later shards may stay smaller or empty. Rows
    that repeat an id and text each get a slot of their own. crc32 of null is 0.
    An empty table gives an empty table. Other columns are not read.
    """
    value = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{doc}`").alias("doc_id"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(value.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.sha2(value, 256), F.lit("")).alias("digest"),
    )
    rows = settle(rows, "shard-rows")
    # Written on their own, so that the join can be split at a text with very many copies.
    groups = settle(rows.groupBy("digest").agg(F.min("doc_id").alias("first")), "shard-groups")
    members = rows.join(groups, "digest")
    order = ["first", "digest", "doc_id"]
    placed = settle(ordered_sums(members, order, "shard-order"), "shard-places")
    ends = settle(placed.groupBy("first", "digest").agg(F.max("end").alias("end"), F.sum("size").alias("bytes")), "shard-ends")
    facts = ends.agg(F.max("end"), F.max("bytes")).first()
    if facts[0] is None:
        return placed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    _, cuts = least_capacity(ends, shards, int(facts[0]), int(facts[1]))
    first_rows = placed.agg(*[F.count(F.when(F.col("end") <= c, 1)).alias(f"r{i}") for i, c in enumerate(cuts[:-1])]).first()
    starts = [0, *[int(v) for v in first_rows]]
    number: Column = F.lit(0)
    for c in cuts[:-1]:
        number = number + F.when(F.col("end") > c, 1).otherwise(0)
    start = F.element_at(F.array(*[F.lit(v).cast("bigint") for v in starts]), F.col("shard") + 1)
    return placed.withColumn("shard", number.cast("int")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - 1 - start).alias("slot")
    )
