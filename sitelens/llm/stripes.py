"""Every asking vector against stored vectors of its own length, one stripe of them at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stripe_count(rows: int, least: int, most: int, cores: int) -> int:
    """Stripes of ``least`` to ``most`` rows; between them one a core, so that small tables use all cores."""
    return max(1, -(-rows // min(max(least, rows // max(cores, 1)), most)))


def in_stripes(rows: DataFrame, stripes: int) -> DataFrame:
    """``rows`` (id, v) with ``stripe``, by a hash, and ``width``, the vector's length."""
    return rows.withColumn("stripe", F.pmod(F.xxhash64("id", "v"), F.lit(stripes)).cast("int")).withColumn("width", F.size("v"))


def everywhere(asking: DataFrame, stripes: int) -> DataFrame:
    """Each asking row once for every stripe."""
    return asking.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))


def matrix(column, width: int) -> np.ndarray:
    """An array column whose rows all have ``width`` numbers."""
    return column.flatten().to_numpy().reshape(-1, width)


def _held(column, width: int) -> np.ndarray:
    if pa.types.is_list(column.type):
        return np.array(matrix(column, width))
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.array(column.to_numpy())


def meet(
    stored: DataFrame, asking: DataFrame, stripes: int, tile: int, match: Callable[[pa.RecordBatch, dict[str, np.ndarray], int, int], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Rows that ``match(asks, held, width, stripe)`` makes of up to ``tile`` asking rows and the stripe's stored rows of their length.

    Both tables have stripe and width; ``held`` has the other columns of
    ``stored`` as arrays. A task holds one stripe, asking rows pass by in tiles;
    lost tasks are done again from the shuffle.
    """
    own = [c for c in stored.columns if c not in ("stripe", "width")]
    theirs = [c for c in asking.columns if c not in ("stripe", "width")]
    kinds = {**{c: asking.schema[c].dataType for c in theirs}, **{c: stored.schema[c].dataType for c in own}}

    def side(df: DataFrame, number: int, has: list[str]) -> DataFrame:
        return df.select("stripe", "width", F.lit(number).alias("side"), *[(F.col(c) if c in has else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])

    both = side(stored, 0, own).union(side(asking, 1, theirs)).repartition(stripes, "stripe").sortWithinPartitions("stripe", "width", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, held = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("stripe", "width", "side")])
            cuts = np.flatnonzero((np.diff(marks, axis=1, prepend=marks[:, :1] - 1) != 0).any(0))
            for a, b in zip(cuts, np.append(cuts[1:], marks.shape[1])):
                part = batch.slice(a, b - a)
                stripe, width, asks = (int(x) for x in marks[:, a])
                if (stripe, width) != here:
                    here, parts, held = (stripe, width), [], None
                if not asks:
                    parts.append({c: _held(part.column(c), width) for c in own})
                    continue
                if held is None and parts:
                    held, parts = {c: np.concatenate([p[c] for p in parts]) for c in own}, []
                for at in range(0, part.num_rows, tile):
                    if held is not None:
                        yield from match(part.slice(at, tile), held, width, stripe)

    return both.mapInArrow(run, schema)
