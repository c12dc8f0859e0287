"""Mixing sources to target weights, by whole and Bernoulli copies of documents.

Main path: DataFrame functions only. Sizes are summed per source, targets follow
from them, and every document is emitted ``floor(rate)`` times plus one more time
with probability ``rate - floor(rate)``, drawn from a hash of seed and id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.draws import draw_uniform
from sitelens.llm.store import settle
from sitelens.llm.text import word_count

SEED = 11
WEIGHTS = (3, 1, 2)


def source_targets(
    sizes: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn. They share
    ``share`` times the sum of all sizes; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight until none is above.
    In the order of cap over weight the stopped sources come first, so running
    sums find the level at which the sharing ends. The windows hold one row per
    source. Sources of size 0 get 0; if the caps cannot hold the share, all stop.
    """
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("bigint").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ring = F.array(*[F.lit(int(w)) for w in weights])
    weighed = totals.withColumn("weight", F.get(ring, place % len(weights)).cast("bigint"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy((cap * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("k", F.row_number().over(by_cap))
        .withColumn("stopped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("rest", share * F.col("total") - cap * F.col("stopped"))
    )
    holds = cap * F.col("source_size") * F.col("open_weight") >= F.col("rest") * F.col("weight")
    found = F.min(F.when(holds, F.struct("k", "rest", "open_weight"))).over(everything)
    return levels.withColumn("level", found).select(
        "source",
        "source_size",
        F.when(
            F.col("level").isNotNull() & (F.col("k") >= F.col("level.k")),
            F.col("level.rest") * F.col("weight") / F.col("level.open_weight"),
        )
        .otherwise(cap * F.col("source_size"))
        .cast("double")
        .alias("target"),
    )


def copies(target: Column, source_size: Column, doc: Column, seed: int = SEED) -> Column:
    """Whole copies of one document: floor of the rate, and one more by a seeded draw."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    extra = F.when(draw_uniform(seed, doc) < rate - F.floor(rate), 1).otherwise(0)
    return (F.floor(rate) + extra).cast("bigint")


def mixed(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **rules
) -> DataFrame:
    """(row, size, source_size, target, copies): each document whole in ``row``, with its number of copies.

    Null text has size 0; a null source is a source of its own; documents with the
    same id (or none) share a draw. An empty table gives an empty table. The input's
    columns stay inside ``row``, so names that clash with the results do no harm.
    The target table is written once; Spark broadcasts it if its file is small
    enough and otherwise splits the join on hot sources at run time.
    """
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col(f"row.`{source}`").alias("source"), word_count(F.col(f"row.`{text}`")).alias("size")
    )
    targets = settle(source_targets(sized, "source", "size", **rules), "targets")
    known = targets.select(F.col("source").alias("known"), "source_size", "target")
    return sized.join(known, F.col("source").eqNullSafe(F.col("known"))).select(
        "row",
        "size",
        "source_size",
        "target",
        copies(F.col("target"), F.col("source_size"), F.col(f"row.`{doc}`"), seed).alias("copies"),
    )


def emitted(docs: DataFrame, **names) -> DataFrame:
    """The mix itself: the documents' own columns, each row as often as it is taken."""
    plan = mixed(docs, **names).filter("copies > 0")
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
