"""Hard negatives by inner product, filtered with rotated one-bit codes.

Every vector x is rotated at random and written as the signs of its components, a
unit code vector o, together with its alignment <x, o>. For a query q whose rotated
components are rounded to whole steps, <o, q> is a sum of popcounts. Since
x = <x, o> o + r with r at right angles to o, Cauchy-Schwarz gives

    <x, q> = <x, o> <o, q> +- |r| sqrt(|q|^2 - <o, q>^2)

without any chance of error. Vectors whose interval can still matter are scored
with their whole numbers; the others are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.store import settle
from sitelens.llm.stripes import everywhere, in_stripes, matrix, meet, stripe_count
from sitelens.llm.vafile import usable, whole_numbers

#: Bits of a rotated query's components.
STEPS = 6
#: Rows of a stripe: at least, and at most. Between them a stripe a core, so that small tables use all of them.
STRIPE = (2048, 65536)
#: Anchors and vectors that are compared at once.
TILE, SLICE = 128, 8192
#: Share of the intervals' width that is added against rounding of the rotation.
SLACK = 1e-9


@lru_cache(maxsize=16)
def _signs(width: int) -> np.ndarray:
    """Three rows of signs for a rotation in ``width`` dimensions, the same in every task."""
    return np.random.default_rng(width).choice([-1.0, 1.0], (3, width))


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned at random in the next 64 * 2**k dimensions: three rounds of signs and Walsh-Hadamard sums."""
    width = 64
    while width < x.shape[1]:
        width *= 2
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for signs in _signs(width):
        out *= signs
        step = 1
        while step < width:
            pairs = out.reshape(len(x), -1, 2, step)
            out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(len(x), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, aligned, rest): signs packed into 64-bit words, <x, o>, and the length of what the code leaves."""
    turned = rotated(x)
    codes = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    aligned = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    rest = np.sqrt(np.maximum((turned**2).sum(1) - aligned**2, 0.0))
    return codes, aligned, rest


def intervals(q: np.ndarray, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every row of ``q`` with every coded vector."""
    turned = rotated(q)
    width = turned.shape[1]
    low, high = turned.min(1), turned.max(1)
    step = np.maximum((high - low) / ((1 << STEPS) - 1), 1e-300)
    whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    rounded = low[:, None] + step[:, None] * whole
    missed = np.sqrt(((turned - rounded) ** 2).sum(1))
    length = (rounded**2).sum(1)
    ones = np.zeros((len(q), len(codes)), np.int32)
    for bit in range(STEPS):
        plane = np.packbits(whole >> bit & 1, axis=1, bitorder="little").view(np.uint64)
        met = np.zeros(ones.shape, np.int32)
        for word in range(codes.shape[1]):
            met += np.bitwise_count(plane[:, word, None] & codes[None, :, word])
        ones += met << bit
    set_bits = np.bitwise_count(codes).sum(1, dtype=np.int64)
    # <o, q> = (sum of components at set bits - sum at the others) / sqrt(width)
    along = 2 * (low[:, None] * set_bits + step[:, None] * ones) - rounded.sum(1)[:, None]
    along /= np.sqrt(width)
    middle = along * aligned
    reach = rest * np.sqrt(np.maximum(length[:, None] - along**2, 0.0))
    size = np.sqrt(aligned**2 + rest**2)
    reach += size * (missed + SLACK * (np.sqrt(length) + 1))[:, None] + SLACK
    return middle - reach, middle + reach


def _score(q: np.ndarray, x: np.ndarray, able: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, whole-number inner product) of the pairs in ``able``."""
    a, b = np.nonzero(able)
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    exact = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53
    if len(a) * 8 > able.size and exact:
        return a, b, (q.astype(float) @ x.astype(float).T)[a, b].astype(np.int64)
    return a, b, np.einsum("ij,ij->i", q[a], x[b])


def _tighten(lower: np.ndarray, upper: np.ndarray, able: np.ndarray, q: np.ndarray, x: np.ndarray, count: int) -> None:
    """Score the ``count`` highest estimates of each row at once: their intervals become points, which raises the floors."""
    if lower.shape[1] <= count:
        return
    guess = np.where(able, lower + upper, -np.inf)
    b = np.argpartition(-guess, count - 1, axis=1)[:, :count].ravel()
    a = np.repeat(np.arange(len(q)), count)
    lower[a, b] = upper[a, b] = np.einsum("ij,ij->i", q[a], x[b])


def _best(keys: list[np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores (smaller ids first) under each combination of keys."""
    order = np.lexsort([ids, -scores, *keys[::-1]])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


def _floor(lower: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest lower bound among the able ones of each row; minus infinity where there are fewer."""
    if lower.shape[1] < k:
        return np.full(len(lower), -np.inf)
    return -np.partition(-np.where(able, lower, -np.inf), k - 1, axis=1)[:, k - 1]


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    k_positives: int = 5,
    k_negatives: int = 5,
    least_percent: int = 80,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) per anchor, positive and negative.

    Components become floor(scale * x); a score is an integer inner product, ties
    go to the smaller id. ``anchors`` marks the rows that ask. An anchor's
    positives are the ``k_positives`` highest other ids of its label; the
    negatives of a positive are the ``k_negatives`` highest rows of other labels with
    least_percent * positive_score <= 100 * score <= 100 * positive_score (none
    where the positive's score is negative). Fewer rows give fewer results; an
    anchor without positives, or a positive without negatives, gives none. Rows
    without id or label take no part, nor do vectors that are null, empty or hold
    null or non-finite components; an anchor meets the vectors of its own length.
    Rows that repeat an id are candidates each, and as anchors they share their
    positives. Scores are taken to stay below 2**53. An empty table gives an empty
    table; other columns are not read.

    Every anchor meets every row: the stripe of rows that a task holds is
    bounded, and anchors travel to all stripes. No row is dealt by its label.
    """
    v = F.col(f"`{vector}`")
    rows = vectors.select(
        F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), v.alias("raw"), F.coalesce(anchors, F.lit(False)).alias("asks")
    )
    rows = rows.filter(usable(F.col("raw")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select("id", "label", "asks", whole_numbers(F.col("raw"), scale).alias("v"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            for width in np.unique(lengths):
                part = batch.filter(pa.array(lengths == width))
                x = part.column("v").flatten().to_numpy().reshape(-1, width).astype(float)
                codes, aligned, rest = coded(x)
                yield part.append_column("codes", pa.array([c.tobytes() for c in codes], pa.binary())).append_column("aligned", pa.array(aligned)).append_column("rest", pa.array(rest))

    stored = rows.mapInArrow(encode, "id bigint, label bigint, asks boolean, v array<bigint>, codes binary, aligned double, rest double")
    stored = settle(stored, "one-bit-codes")
    stripes = stripe_count(stored.count(), *STRIPE, vectors.sparkSession.sparkContext.defaultParallelism)
    dealt = in_stripes(stored.drop("asks"), stripes)
    asking = stored.filter("asks").select("id", "label", "v", F.size("v").alias("width"))

    def slices(held: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        for at in range(0, len(held["id"]), SLICE):
            yield {c: x[at : at + SLICE] for c, x in held.items()}

    def bounds(q: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return intervals(q, np.ascontiguousarray(x["codes"]).view(np.uint64), x["aligned"], x["rest"])

    def nearest(asks: pa.RecordBatch, held: dict[str, np.ndarray], width: int, stripe: int) -> Iterator[pa.RecordBatch]:
        ids, labels, q = asks.column("id").to_numpy(), asks.column("label").to_numpy(), matrix(asks.column("v"), width)
        for x in slices(held):
            lower, upper = bounds(q, x)
            able = (labels[:, None] == x["label"]) & (ids[:, None] != x["id"])
            _tighten(lower, upper, able, q, x["v"], 2 * k_positives)
            able &= upper >= _floor(lower, able, k_positives)[:, None]
            a, b, score = _score(q, x["v"], able)
            keep = _best([ids[a]], score, x["id"][b], k_positives)
            yield pa.RecordBatch.from_pydict({"anchor_id": pa.array(ids[a][keep]), "positive_id": pa.array(x["id"][b][keep]), "positive_score": pa.array(score[keep])})

    near = meet(dealt, everywhere(asking, stripes), stripes, TILE, nearest, "anchor_id bigint, positive_id bigint, positive_score bigint")
    own = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    positives = near.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k_positives).drop("n")
    positives = settle(positives, "positives", thin=True)

    goals = positives.filter("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("goals"))

    def hardest(asks: pa.RecordBatch, held: dict[str, np.ndarray], width: int, stripe: int) -> Iterator[pa.RecordBatch]:
        ids, labels, q = asks.column("id").to_numpy(), asks.column("label").to_numpy(), matrix(asks.column("v"), width)
        more = asks.column("goals").to_pylist()
        place = np.repeat(np.arange(len(ids)), [len(m) for m in more])
        goal = np.array([(g["positive_id"], g["positive_score"]) for m in more for g in m], np.int64).reshape(-1, 2)
        top = goal[:, 1]
        for x in slices(held):
            lower, upper = bounds(q, x)
            other = labels[:, None] != x["label"]
            _tighten(lower, upper, other, q, x["v"], 2 * k_negatives)
            able = np.zeros(other.shape, bool)
            for n in range(len(goal)):  # a goal is an anchor's positive: at most k_positives times TILE
                i = place[n]
                bottom = -(-least_percent * top[n] // 100)
                inside = other[i] & (lower[i] >= bottom) & (upper[i] <= top[n])
                floor = bottom
                if inside.sum() >= k_negatives:
                    floor = max(floor, -np.partition(-lower[i][inside], k_negatives - 1)[k_negatives - 1])
                able[i] |= other[i] & (upper[i] >= floor) & (lower[i] <= top[n])
            a, b, score = _score(q, x["v"], able)
            starts, ends = np.searchsorted(a, place), np.searchsorted(a, place, side="right")
            taken = ends - starts
            n = np.repeat(np.arange(len(goal)), taken)
            at = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken) + np.repeat(starts, taken)
            found = (100 * score[at] >= least_percent * top[n]) & (score[at] <= top[n])
            n, at = n[found], at[found]
            keep = _best([n], score[at], x["id"][b[at]], k_negatives)
            n, at = n[keep], at[keep]
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor_id": pa.array(ids[place[n]]),
                    "positive_id": pa.array(goal[n, 0]),
                    "negative_id": pa.array(x["id"][b[at]]),
                    "positive_score": pa.array(top[n]),
                    "negative_score": pa.array(score[at]),
                }
            )

    wanted = asking.join(goals, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "width", "goals")
    schema = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    found = meet(dealt, everywhere(wanted, stripes), stripes, TILE, hardest, schema)
    rank = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(rank).cast("int")).filter(F.col("rank") <= k_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
