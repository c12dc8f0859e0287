"""Sums over pairs of sparse tables as a tiled matrix product of which only wanted cells are kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and columns of a tile of cells, and inner entries that are multiplied at once.
TILE, INNER = 512, 1024


def _tiles(df: DataFrame, keys: list[str], columns: dict[str, int]) -> dict[str, int]:
    """Tiles needed by each column so that no key has many more than its wanted number of distinct values in one."""
    per = df.groupBy(*keys).agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    most = per.agg(*[F.max(c).alias(c) for c in columns]).first()
    return {c: max(1, -(-(most[c] or 0) // size)) for c, size in columns.items()}


def masked_product(
    left: DataFrame,
    right: DataFrame,
    wanted: DataFrame,
    keys: Sequence[str],
    row: str,
    inner: str,
    column: str,
    value: str,
    part: str,
    parts: Sequence[str],
    tile: int = TILE,
    inner_tile: int = INNER,
) -> DataFrame:
    """(keys, row, column, part, total, n, n_rows): sums of ``value`` over the inner entries a row and a column share.

    ``left`` (keys, row, inner, part) says which inner entries belong to which
    part of a row; ``right`` (keys, inner, column, value) holds the values;
    ``wanted`` (keys, row, column) the distinct cells asked for. total sums the values that are not
    null, n counts them, n_rows counts all. Cells that share nothing are left out.
    """
    names = list(parts)
    number = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col(part)).cast("int") - 1
    marks = left.where(number >= 0).withColumn("_mark", number)

    def rights(values: np.ndarray) -> list[np.ndarray]:
        there = ~np.isnan(values[0])
        return [np.where(there, values[0], 0.0), there.astype(float), np.ones(len(there))]

    def finish(sums: list[np.ndarray]) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        for name, (total, n, n_rows) in zip(names, zip(*[iter(sums)] * 3)):
            at = np.flatnonzero(n_rows)
            total, n, n_rows = total[at], n[at], n_rows[at]
            yield at, {
                part: pa.array([name] * len(at), pa.string()), "total": pa.array(total, mask=n == 0),
                "n": pa.array(n.astype(np.int64)), "n_rows": pa.array(n_rows.astype(np.int64)),
            }

    return tiled_sums(
        marks, right, wanted, keys, row, inner, column, ["_mark"], [value],
        lambda values: [(values[0] == k).astype(float) for k in range(len(names))], rights,
        [(k, j) for k in range(len(names)) for j in range(3)], finish, f"`{part}` string, total double, n bigint, n_rows bigint", tile, inner_tile,
    )


def tiled_sums(
    left: DataFrame,
    right: DataFrame,
    wanted: DataFrame,
    keys: Sequence[str],
    row: str,
    inner: str,
    column: str,
    left_values: Sequence[str],
    right_values: Sequence[str],
    lefts: Callable[[np.ndarray], list[np.ndarray]],
    rights: Callable[[np.ndarray], list[np.ndarray]],
    products: Sequence[tuple[int, int]],
    finish: Callable[[list[np.ndarray]], Iterator[tuple[np.ndarray, dict[str, pa.Array]]]],
    fields: str,
    tile: int = TILE,
    inner_tile: int = INNER,
    centred: bool = False,
) -> DataFrame:
    """(keys, row, column, ``fields``) of the wanted cells from sums over the inner entries that a row and a column share.

    ``lefts`` and ``rights`` make weights of the value columns of each side's rows (one array a value column); a product
    (i, j) sums left weight i times right weight j. ``finish`` takes the products' sums at the wanted cells and yields
    the places of the cells to return with their columns. ``centred`` takes off each row's and each column's mean in
    the first block that has it, so that sums of squares stay exact far from zero.

    Rows of ``left`` travel once per tile of columns and rows of ``right`` once per
    tile of rows; no row is made for a pair of them. A task holds a tile's sums and one
    block of inner entries.
    """
    keys = list(keys)
    count = _tiles(wanted, keys, {row: tile, column: tile}) | _tiles(right, keys, {inner: inner_tile})

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(count[c])).cast("int")

    def every(c: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count[c] - 1)))

    kinds = {row: wanted.schema[row].dataType, inner: right.schema[inner].dataType, column: wanted.schema[column].dataType}

    def missing(*names: str) -> list[Column]:
        return [F.lit(None).cast(kinds[c]).alias(c) for c in names]

    def typed(*names: str) -> list[Column]:
        return [F.col(c).cast(kinds[c]).alias(c) for c in names]

    own_values, held_values = ([f"_{s}{i}" for i in range(len(v))] for s, v in (("a", left_values), ("b", right_values)))

    def weights(names: Sequence[str], values: Sequence[str]) -> list[Column]:
        return [F.col(v).cast("double").alias(n) for n, v in zip(names, values)]

    def nothing(names: Sequence[str]) -> list[Column]:
        return [F.lit(None).cast("double").alias(n) for n in names]

    tiled = ["_rt", "_ct", "_it", "_side"]
    asked = wanted.select(*keys, place(row).alias("_rt"), place(column).alias("_ct"), F.lit(-1).alias("_it"), F.lit(0).alias("_side"), row, *missing(inner), column, *nothing(own_values), *nothing(held_values))
    own = left.select(*keys, place(row).alias("_rt"), every(column).alias("_ct"), place(inner).alias("_it"), F.lit(1).alias("_side"), *typed(row, inner), *missing(column), *weights(own_values, left_values), *nothing(held_values))
    held = right.select(*keys, every(row).alias("_rt"), place(column).alias("_ct"), place(inner).alias("_it"), F.lit(2).alias("_side"), *missing(row), inner, *typed(column), *nothing(own_values), *weights(held_values, right_values))
    cells = [*keys, "_rt", "_ct"]
    ordered = asked.union(own).union(held).repartition(*cells).sortWithinPartitions(*cells, "_it", "_side")
    types = {c: to_arrow_type(wanted.schema[c].dataType) for c in keys}
    schema = ", ".join([*[f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in (*keys, row, column)], fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        here: tuple | None = None
        state: dict = {}

        def places(values: pa.ChunkedArray, of: pa.Array) -> np.ndarray:
            return pc.fill_null(pc.index_in(values, value_set=of), -1).combine_chunks().to_numpy(zero_copy_only=False)

        def begin(table: pa.Table) -> None:
            rows, columns = pc.unique(table[row]), pc.unique(table[column])
            at = places(table[row], rows), places(table[column], columns)
            state.update(rows=rows, columns=columns, at=at, table=table.select([row, column]), sums=[np.zeros((len(rows), len(columns))) for _ in products])
            state["shifts"] = [np.full((len(v), len(n)), np.nan) for v, n in ((own_values, rows), (held_values, columns))]

        def read(table: pa.Table, names: Sequence[str], at: np.ndarray, kept: np.ndarray, shift: np.ndarray) -> np.ndarray:
            values = np.array([table[c].to_numpy() for c in names], dtype=float).reshape(len(names), len(kept))[:, kept]
            for v, known in zip(values, shift) if centred else ():
                good = np.isfinite(v)
                n = np.bincount(at[good], minlength=len(known))
                new = np.isnan(known) & (n > 0)
                known[new] = np.bincount(at[good], v[good], len(known))[new] / n[new]
                v -= np.nan_to_num(known)[at]
            return values

        def add(table: pa.Table) -> None:
            a, b = (table.filter(pc.equal(table["_side"], s)) for s in (1, 2))
            if not (len(a) and len(b) and state):
                return
            entries = pc.unique(b[inner])
            r, i = places(a[row], state["rows"]), places(a[inner], entries)
            j, c = places(b[inner], entries), places(b[column], state["columns"])
            met, inside = (r >= 0) & (i >= 0), c >= 0
            r, i, j, c = r[met], i[met], j[inside], c[inside]
            shape, turned = (len(state["rows"]), len(entries)), (len(entries), len(state["columns"]))
            near = [np.bincount(r * shape[1] + i, w, shape[0] * shape[1]).reshape(shape) for w in lefts(read(a, own_values, r, met, state["shifts"][0]))]
            far = [np.bincount(j * turned[1] + c, w, turned[0] * turned[1]).reshape(turned) for w in rights(read(b, held_values, c, inside, state["shifts"][1]))]
            for total, (p, q) in zip(state["sums"], products):
                total += near[p] @ far[q]

        def close() -> Iterator[pa.RecordBatch]:
            if not state:
                return
            for found, made in finish([total[state["at"]] for total in state["sums"]]):
                picked = state["table"].take(pa.array(found))
                columns = {c: pa.array([v] * len(found), types[c]) for c, v in zip(keys, here)}
                columns |= {row: picked[row].combine_chunks(), column: picked[column].combine_chunks()}
                yield pa.RecordBatch.from_pydict(columns | made)
            state.clear()

        def flush() -> None:
            if block:
                table = pa.Table.from_batches(block)
                begin(table) if table["_it"][0].as_py() < 0 else add(table)
                block.clear()

        inner_here = None
        for batch in batches:
            if not len(batch):
                continue
            # Rows come sorted, so a cell's block of inner entries is a run; only the first row of each is looked at.
            turned = np.zeros(len(batch), dtype=bool)
            turned[0] = True
            for c in (*cells, "_it"):
                code = pc.fill_null(batch.column(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                turned[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(turned)
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)]):
                cell, it = tuple(batch.column(c)[start].as_py() for c in cells), batch.column("_it")[start].as_py()
                if cell != here or it != inner_here:
                    flush()
                    if cell != here:
                        yield from close()
                    here, inner_here = cell, it
                block.append(batch.slice(start, stop - start))
        flush()
        yield from close()

    return ordered.select(*keys, *tiled, row, inner, column, *own_values, *held_values).mapInArrow(run, schema)
