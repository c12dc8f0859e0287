"""Sequence and vector windows, and their reductions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tokens of a one-hot window, unknown last.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWYX"


def text_window(sequence: str | Column, pos: str | Column, width: int) -> Column:
    """``width`` letters around a 1-based position, padded with X."""
    half = width // 2
    seq = F.col(sequence) if isinstance(sequence, str) else sequence
    place = F.col(pos) if isinstance(pos, str) else pos
    start = place.cast("int") - half
    left = F.greatest(F.lit(0), 1 - start)
    inner = F.substr(seq, F.greatest(start, F.lit(1)), F.greatest(F.lit(0), F.lit(width) - left))
    return F.rpad(F.concat(F.repeat(F.lit("X"), left), inner), width, "X")


def one_hot_window(window: str | Column) -> Column:
    """Array of one-hot token arrays; letters outside the alphabet count as X."""
    text = F.col(window) if isinstance(window, str) else window
    letters = F.split(text, "")
    size = len(AMINO_ACIDS)

    def encode(letter: Column) -> Column:
        at = F.instr(F.lit(AMINO_ACIDS), letter)
        index = F.when((at == 0) | (letter == ""), F.lit(size)).otherwise(at)
        return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i == index).cast("float"))

    return F.transform(F.filter(letters, lambda x: x != ""), encode)


def vector_window(
    sites: DataFrame, vectors: DataFrame, acc: Sequence[str], pos: str, vector: str, half: int, dims: int, key: Sequence[str], out: str = "window"
) -> DataFrame:
    """Vectors at pos-half..pos+half of every site in order, zeros where there is none.

    Each site asks for its 2*half+1 neighbours, an equi-join on (acc, pos).
    """
    zeros = F.array_repeat(F.lit(0.0), dims)
    asked = sites.select(*key, *acc, pos, F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_o"))
    asked = asked.withColumn("_p", F.col(pos) + F.col("_o"))
    side = vectors.select(*acc, F.col(pos).alias("_p"), F.col(vector).cast("array<double>").alias("_v"))
    joined = asked.join(side, [*acc, "_p"], "left")
    rows = F.sort_array(F.collect_list(F.struct("_o", F.coalesce("_v", zeros).alias("_v"))))
    return joined.groupBy(*key, *[c for c in (*acc, pos) if c not in key]).agg(
        F.transform(rows, lambda s: s["_v"]).alias(out)
    )


def window_mean(window: str | Column, dims: int) -> Column:
    """Mean vector of a window; padding counts."""
    rows = F.col(window) if isinstance(window, str) else window
    total = F.aggregate(rows, F.array_repeat(F.lit(0.0), dims), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(rows))


def window_centre(window: str | Column, half: int) -> Column:
    rows = F.col(window) if isinstance(window, str) else window
    return F.element_at(rows, half + 1)


def mean_and_centre(window: str, half: int, dims: int) -> Column:
    return F.concat(window_mean(window, dims), window_centre(window, half))


def flatten_window(window: str) -> Column:
    return F.flatten(F.col(window))


def require_inside(df: DataFrame, pos: str, length: str) -> DataFrame:
    """A centre outside its sequence is an error raised by the job."""
    bad = (F.col(pos) < 1) | (F.col(pos) > F.col(length))
    message = F.concat(F.lit("centre out of range: "), F.col(pos).cast("string"))
    return df.withColumn(pos, F.when(bad, F.raise_error(message).cast("bigint")).otherwise(F.col(pos)))


# ------------------------------------------------------------------ reduction


def scale_vectors(train: DataFrame, frames: Sequence[DataFrame], column: str) -> list[DataFrame]:
    """Array columns standardised by train's means and population deviations."""
    long = train.select(F.posexplode(column).alias("_i", "_x"))
    stats = long.groupBy("_i").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    row = stats.agg(F.sort_array(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_stats"))

    def scaled(df: DataFrame) -> DataFrame:
        value = F.zip_with(
            F.col(column), F.col("_stats"),
            lambda x, s: (x - s["_m"]) / F.when(s["_s"] > 0, s["_s"]).otherwise(F.lit(1.0)),
        )
        return df.crossJoin(F.broadcast(row)).withColumn(column, value).drop("_stats")

    return [scaled(f) for f in frames]


#: Dimensions up to which all products of two columns are summed in one pass; wider data are read once per product.
GRAM_DIMS = 1024
#: Further directions that are carried along, most passes over wide data, and the error of a component at which they end.
EXTRA, PASSES, TOLERANCE = 10, 40, 1e-9
#: Blocks of directions that the driver holds before it keeps the best of them only.
BLOCKS = 8
#: Dimensions whose sums are added up together.
BLOCK_ROWS = 512


def _sums(rows: DataFrame, right: np.ndarray | None, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X or X'(X right), column sums, rows) of the array column ``x``: dims numbers a column of ``right`` leave a task."""
    width = dims if right is None else right.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, columns, n = np.zeros((dims, width)), np.zeros(dims), 0
        step = max(1, (1 << 22) // dims)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, step):
                x = flat[at * dims : (at + step) * dims].reshape(-1, dims)
                total += x.T @ (x if right is None else x @ right)
                columns += x.sum(0)
                n += len(x)
        if n:
            full = np.hstack([total, columns[:, None], np.full((dims, 1), float(n))])
            for i in range(0, dims, BLOCK_ROWS):
                yield pa.RecordBatch.from_pydict({"i": pa.array([i]), "sums": pa.array([full[i : i + BLOCK_ROWS].ravel()], pa.list_(pa.float64()))})

    def add(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(0)
        return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    schema = "i bigint, sums array<double>"
    found = rows.mapInArrow(part, schema).groupBy("i").applyInArrow(add, schema).orderBy("i").collect()
    if not found:
        return np.zeros((dims, width)), np.zeros(dims), 0
    table = np.concatenate([np.array(r["sums"]).reshape(-1, width + 2) for r in found])
    return table[:, :-2], table[:, -2], int(table[0, -1])


def principal_axes(train: DataFrame, column: str, k: int, dims: int) -> np.ndarray:
    """The first k principal axes of an array column, one a column; each has its largest entry positive.

    Up to GRAM_DIMS dimensions the covariances come from one pass. Wider data are
    only multiplied: a block of directions goes through X'(X v), the span of all
    blocks so far gives the best axes in it (block Krylov), and passes end when the axes
    stand still. Memory follows dims, not its square.
    """
    rows = train.select(F.col(column).cast("array<double>").alias("x"))
    if dims <= GRAM_DIMS:
        gram, columns, n = _sums(rows, None, dims)
        mean = columns / max(n, 1)
        values, axes = np.linalg.eigh(gram - n * np.outer(mean, mean))
        axes = axes[:, ::-1][:, :k]
    else:
        block = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, min(k + EXTRA, dims))))[0]
        basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
        for _ in range(PASSES):
            image, columns, n = _sums(rows, block, dims)
            mean = columns / max(n, 1)
            image = image - n * np.outer(mean, mean @ block)
            basis, images = np.hstack([basis, block]), np.hstack([images, image])
            small = basis.T @ images
            values, turn = np.linalg.eigh((small + small.T) / 2)
            turn = turn[:, ::-1][:, : min(k, len(values))]
            axes, top = basis @ turn, np.maximum(values[::-1][: turn.shape[1]], 0)
            left = images @ turn - axes * top
            if np.linalg.norm(left, axis=0).max() <= TOLERANCE * max(top.max(), 1e-300) or basis.shape[1] + block.shape[1] > dims:
                break
            if basis.shape[1] > BLOCKS * (k + EXTRA):
                kept = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, : k + EXTRA]
                basis, images = basis @ kept, images @ kept
            rest = image
            for _ in range(2):
                rest = rest - basis @ (basis.T @ rest)
            block, size = np.linalg.qr(rest)
            block = block[:, np.abs(np.diag(size)) > 1e-12 * max(np.abs(size).max(), 1e-300)]
            if not block.shape[1]:
                break
    largest = np.abs(axes).argmax(0)
    return axes * np.where(axes[largest, np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def reduce_pca(train: DataFrame, frames: Sequence[DataFrame], column: str, k: int, dims: int, out: str) -> list[DataFrame]:
    """Principal components of a scaled array column; k is at most the rows and the dimensions."""
    rows = train.limit(min(k, dims)).count() if k > 1 else 1
    axes = principal_axes(train, column, max(1, min(k, dims, rows)), dims)
    return [project(f, column, axes, out) for f in frames]


def pls_rotation(train: DataFrame, column: str, response: str, components: int, dims: int | None = None) -> np.ndarray:
    """Rotation of a one-response partial least squares fit on centred data.

    The data enter only through X'y and X'(X r). Up to GRAM_DIMS dimensions X'X
    is summed in one pass; wider data are read once a component, and dims numbers leave a task.
    """
    mean = train.agg(F.avg(F.col(response).cast("double")).alias("_m"))
    y = F.col(response).cast("double") - F.col("_m")
    rows = train.crossJoin(F.broadcast(mean)).select(F.concat(F.col(column).cast("array<double>"), F.array(y)).alias("x"))
    if dims is None:
        dims = train.select(F.size(column).alias("n")).agg(F.max("n")).first()[0] or 0
    if dims <= GRAM_DIMS:
        table, _, _ = _sums(rows, None, dims + 1)
        gram, cross = table[:-1, :-1], table[:-1, -1]
        times = lambda r: gram @ r
    else:
        last = np.zeros((dims + 1, 1))
        last[-1] = 1.0
        cross = _sums(rows, last, dims + 1)[0][:-1, 0]
        times = lambda r: _sums(rows, np.append(r, 0.0)[:, None], dims + 1)[0][:-1, 0]
    weights, loadings = [], []
    left = cross.copy()
    for _ in range(min(components, dims)):
        norm = np.linalg.norm(left)
        if norm < 1e-12:
            break
        w = left / norm
        # Rotation of this component in terms of the original columns.
        r = w.copy()
        for p, q in zip(loadings, weights):
            r = r - (p @ w) * q
        image = times(r)
        tt = float(r @ image)
        if tt < 1e-12:
            break
        p = image / tt
        left = left - p * float(r @ cross)
        weights.append(r)
        loadings.append(p)
    return np.array(weights).T if weights else np.zeros((dims, 0))


def project(df: DataFrame, column: str, rotation: np.ndarray, out: str) -> DataFrame:
    """Array column times a small matrix, in Arrow batches."""
    matrix = np.asarray(rotation, dtype=float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def times(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.vstack(x.to_numpy()) @ matrix))

    return df.withColumn(out, times(F.col(column).cast("array<double>")))


def reduce_pls(
    train: DataFrame, frames: Sequence[DataFrame], column: str, response: str, k: int, out: str, dims: int | None = None
) -> list[DataFrame]:
    rotation = pls_rotation(train, column, response, k, dims)
    return [project(f, column, rotation, out) for f in frames]


def reduce_blocks(
    train: DataFrame, frames: Sequence[DataFrame], blocks: Sequence[str], dims: dict[str, int], k: int, response: str | None,
    joint: bool = False, scale: bool = True, scale_after: bool = False, out: str = "reduced",
) -> list[DataFrame]:
    """Reduce window and centre blocks one by one, or as one joined block, with scaling before and after."""
    work = [train, *frames]
    if joint:
        work = [w.withColumn("_joint", F.concat(*blocks)) for w in work]
        blocks, dims = ["_joint"], {"_joint": sum(dims[b] for b in blocks)}
    parts = []
    for b in blocks:
        if scale:
            work = scale_vectors(work[0], work, b)
        name = b + "_reduced"
        if response is None:
            work = reduce_pca(work[0], work, b, k, dims[b], name)
        else:
            work = reduce_pls(work[0], work, b, response, k, name, dims[b])
        if scale_after:
            work = scale_vectors(work[0], work, name)
        parts.append(name)
    done = [w.withColumn(out, F.concat(*parts)).drop(*parts, *(["_joint"] if joint else [])) for w in work]
    return done[1:]
