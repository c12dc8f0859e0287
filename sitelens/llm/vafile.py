"""Exact top-k search by inner product over a vector-approximation file.

Each component is quantised to a cell between two cut points of its dimension. A
first pass reads the cells only: they bound the inner product with each query
from both sides. The k-th best lower bound of a query, over all vectors, is what
a vector's upper bound must reach. A second pass reads exact vectors, and only
for the queries and stripes of vectors where some upper bound reaches it: in
the order of the bounds, until the k-th exact score is no smaller than the next bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.store import settle
from sitelens.llm.stripes import everywhere, in_stripes, matrix, meet, stripe_count

#: Cells per dimension; least and most vectors of a stripe; queries that are compared at once.
CELLS = 32
BLOCK, LARGEST = 4096, 65536
QUERY_BLOCK = 256
#: Rows that the cut points are fitted on, in the order of a hash; every row is indexed.
FIT_ROWS = 16384


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """Each component as floor(scale * x), computed on doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def _cells(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(cuts[d], data[:, d], side="right") for d in range(data.shape[1])], 1).astype(np.uint8)


def _bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every query's inner product with every vector, from the cells alone.

    A component adds at least min(q * low, q * high) and at most the larger one;
    whole numbers below 2**53 keep the sums exact in doubles.
    """
    d = np.arange(cells.shape[1])
    lo, hi = low[d, cells].astype(float), high[d, cells].astype(float)
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


class Cells:
    """Cut points of each dimension, with the least and greatest value of each cell."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        """``sample``: whole-number rows (or none); ``low`` and ``high``: extremes of every dimension over all rows."""
        sample = sample if len(sample) else np.stack([low, high])
        self.cuts = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="lower").T.astype(np.int64)
        self.low = np.hstack([low[:, None], self.cuts])
        self.high = np.maximum(np.hstack([self.cuts - 1, high[:, None]]), self.low)

    def of(self, x: np.ndarray) -> np.ndarray:
        return _cells(x, self.cuts)

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _bounds(queries, cells, self.low, self.high)


def _fitted(rows: DataFrame) -> dict[int, Cells]:
    """Cells for every length: extremes of all rows, cut points from at most FIT_ROWS rows in the order of a hash."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            for width in np.unique(lengths).tolist():
                x = batch.filter(pa.array(lengths == width)).column("v").flatten().to_numpy().reshape(-1, width)
                both = np.stack([x.min(0), -x.max(0)])
                found[width] = np.minimum(found[width], both) if width in found else both
        if found:
            yield pa.RecordBatch.from_pydict({"width": pa.array(list(found), pa.int32()), "ends": pa.array([x.ravel() for x in found.values()], pa.list_(pa.int64()))})

    def least(table: pa.Table) -> pa.Table:
        ends = np.stack([np.asarray(x.values) for x in table.column("ends")]).min(0)
        return pa.table({"width": table.column("width").slice(0, 1), "ends": pa.array([ends], pa.list_(pa.int64()))})

    schema = "width int, ends array<bigint>"
    ends = {r["width"]: np.array(r["ends"]).reshape(2, -1) for r in rows.select("v").mapInArrow(extremes, schema).groupBy("width").applyInArrow(least, schema).collect()}
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", "v")).limit(FIT_ROWS).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    return {width: Cells(np.array(sample.get(width, []), np.int64).reshape(-1, width), e[0], -e[1]) for width, e in ends.items()}


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row.

    ``queries`` marks the rows that ask; every row but the query's own id is a
    candidate. Ties go to the smaller id. Vectors that are null, empty, hold null
    or non-finite components or have no id take no part; a query meets the vectors of
    its own length. Fewer than k candidates give fewer rows; rows
    that repeat an id are candidates each, and as queries they are answered together. Other columns are not read.
    """
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{id}`").cast("bigint").alias("id"), v.alias("raw"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("raw")) & F.col("id").isNotNull())
    rows = settle(rows.select("id", "asks", whole_numbers(F.col("raw"), scale).alias("v")), "whole-vectors")
    count = rows.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    fitted = _fitted(rows)
    stripes = stripe_count(count, BLOCK, LARGEST, vectors.sparkSession.sparkContext.defaultParallelism)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            for width in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == width))
                cells = fitted[width].of(part.column("v").flatten().to_numpy().reshape(-1, width))
                yield part.append_column("cells", pa.array([c.tobytes() for c in cells], pa.binary()))

    stored = rows.mapInArrow(approximate, "id bigint, asks boolean, v array<bigint>, cells binary")
    stored = settle(in_stripes(stored, stripes), "approximations")
    asked = stored.filter("asks").select("id", "v", "width")
    near = candidate_stripes(stored, asked, stripes, k, fitted)

    def search(asks: pa.RecordBatch, held: dict[str, np.ndarray], width: int, stripe: int) -> Iterator[pa.RecordBatch]:
        """Exact scores in the order of the upper bounds, for vectors that can still be among the k best."""
        q_ids, q, floors = asks.column("id").to_numpy(), matrix(asks.column("v"), width), asks.column("floor").to_pylist()
        ids, x = held["id"], held["v"]
        _, hi = fitted[width].bounds(q, held["cells"])
        out: list[tuple[int, int, int]] = []
        for i, (own_id, floor) in enumerate(zip(q_ids.tolist(), floors)):
            able = ids != own_id if floor is None else (hi[i] >= floor) & (ids != own_id)
            order = np.flatnonzero(able)
            order = order[np.argsort(-hi[i, order], kind="stable")]
            best: list[tuple[int, int]] = []
            for at in range(0, len(order), 64):
                if len(best) == k and hi[i, order[at]] < best[0][0]:
                    break
                part = order[at : at + 64]
                for score, other in zip((x[part] @ q[i]).tolist(), ids[part].tolist()):
                    item = (score, -other)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            out += [(own_id, -o, s) for s, o in best]
        yield pa.RecordBatch.from_pydict({n: pa.array([o[j] for o in out], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    asking = asked.join(near, asked["id"] == near["query_id"]).select("id", "v", "width", "stripe", "floor")
    found = meet(stored.select("id", "v", "cells", "stripe", "width"), asking, stripes, QUERY_BLOCK, search, "query_id bigint, vec_id bigint, score bigint")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def candidate_stripes(stored: DataFrame, asked: DataFrame, stripes: int, k: int, fitted: dict[int, Cells]) -> DataFrame:
    """(query_id, stripe, floor): the stripes that can hold one of a query's k best, from the cells alone.

    ``floor`` is the k-th largest lower bound of the query over all vectors, null
    where there are fewer than k; a stripe counts if its largest upper bound reaches it.
    """

    def lower(asks: pa.RecordBatch, held: dict[str, np.ndarray], width: int, stripe: int) -> Iterator[pa.RecordBatch]:
        q_ids, ids = asks.column("id").to_numpy(), held["id"]
        lo, hi = fitted[width].bounds(matrix(asks.column("v"), width), held["cells"])
        own = q_ids[:, None] == ids[None, :]
        lo[own] = hi[own] = -np.inf
        best = -np.partition(-lo, min(k, lo.shape[1]) - 1, axis=1)[:, :k]
        top = hi.max(1)
        some = np.flatnonzero(np.isfinite(top))
        yield pa.RecordBatch.from_pydict(
            {
                "query_id": pa.array(q_ids[some]),
                "stripe": pa.array(np.full(len(some), stripe, np.int32)),
                "top": pa.array(top[some].astype(np.int64)),
                "lows": pa.array([b[np.isfinite(b)].astype(np.int64) for b in best[some]], pa.list_(pa.int64())),
            }
        )

    bounds = meet(stored.select("id", "cells", "stripe", "width"), everywhere(asked, stripes), stripes, QUERY_BLOCK, lower, "query_id bigint, stripe int, top bigint, lows array<bigint>")
    bounds = settle(bounds, "stripe-bounds")
    own = Window.partitionBy("query_id").orderBy(F.col("low").desc())
    floors = bounds.select("query_id", F.explode("lows").alias("low")).withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k)
    floors = floors.groupBy("query_id").agg(F.min("low").alias("least"), F.max("n").alias("n"))
    floors = floors.select("query_id", F.when(F.col("n") == k, F.col("least")).alias("floor"))
    near = bounds.groupBy("query_id", "stripe").agg(F.max("top").alias("top")).join(floors, "query_id")
    return near.filter(F.col("floor").isNull() | (F.col("top") >= F.col("floor"))).select("query_id", "stripe", "floor")
