"""Removal of lines that many documents repeat, found with two Bloom filters.

A line's key is hashed where the document is read. The hashes are dealt to
segments, and each segment has a filter of hashes seen once and one of hashes seen
twice; both have a fixed size, and the number of segments grows with the text. Only
keys that the second filter holds, the suspected repeats, go on to the exact
count of documents and the choice of the one that keeps its lines. Keys that a task
itself meets in two documents are suspects at once: of those a segment
hears a single mark a task, so a line of a third of all documents is no hot spot.
No line's text leaves the task that reads it; what travels is a 128-bit BLAKE2b digest of the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sitelens.llm.store import settle

SPACE = b" \t\n\v\f\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Lines of a segment on average, bits of each of its two filters, and probes of a hash.
SEGMENT_LINES, FILTER_BITS, PROBES = 1 << 20, 24, 2
#: Lines that a task compares with each other before it sends them on.
CHUNK = 1 << 18


def digests(text: bytes | None, least: int = MIN_CHARS) -> list[bytes | None]:
    """For each line the digest of its key, or None where the key has fewer than ``least`` code points."""
    out: list[bytes | None] = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(SPACE)
        n = len(key)
        if n < least or (n < 4 * least and len(key.decode(errors="replace")) < least):
            out.append(None)
        else:
            out.append(blake2b(key.lower(), digest_size=16).digest())
    return out


class Filters:
    """A Bloom filter of the hashes seen once and one of those seen twice."""

    def __init__(self, bits: int = FILTER_BITS):
        self.bits = bits
        self.once, self.twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)

    def probes(self, hashes: np.ndarray) -> list[np.ndarray]:
        h, mask = hashes.view(np.uint64), np.uint64((1 << self.bits) - 1)
        return [(h >> np.uint64(i * self.bits)) & mask for i in range(PROBES)]

    def add(self, hashes: np.ndarray) -> None:
        """Take in hashes that differ from each other; a bit that is met again counts as seen twice."""
        for at in self.probes(hashes):
            self.twice[at[self.once[at]]] = True
            ordered = np.sort(at)
            self.twice[ordered[1:][ordered[1:] == ordered[:-1]]] = True
            self.once[at] = True

    def mark(self, hashes: np.ndarray) -> None:
        """Take in hashes that are known to occur in two documents."""
        for at in self.probes(hashes):
            self.once[at] = self.twice[at] = True

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.probes(hashes):
            found &= self.twice[at]
        return found


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def suspected_lines(docs: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, a, b): documents with the halves of the digests of keys that another document may hold too."""
    kind, id_type = docs.schema[doc].dataType.simpleString(), to_arrow_type(docs.schema[doc].dataType)
    own = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")).filter("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    segments = size // (SEGMENT_LINES * (min_chars + 1)) + 1

    def flush(ids: list, counts: list[int], found: list[bytes]) -> Iterator[pa.RecordBatch]:
        halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        a, b = halves[:, 0], halves[:, 1]
        holder = np.repeat(np.arange(len(ids)), counts)
        _, first, where, times = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
        again = times[where] > 1
        segment = (a.view(np.uint64) % np.uint64(segments)).astype(np.int64)
        spread = -1 - (holder + int(abs(int(a[0])))) % segments
        key = np.where(again, spread, segment)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=key[order][0] - 1))
        ends = np.append(cuts, len(order))
        who = pa.array([ids[i] for i in holder[order].tolist()], id_type)
        rows = len(cuts)
        yield pa.RecordBatch.from_pydict(
            {
                "segment": pa.array(key[order][cuts]),
                "marks": pa.array([False] * rows),
                "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), who),
                "a": _lists(a[order], ends),
                "b": _lists(b[order], ends),
            }
        )
        sure = first[times > 1]
        if len(sure):
            sure = sure[np.argsort(segment[sure], kind="stable")]
            cuts = np.flatnonzero(np.diff(segment[sure], prepend=-1))
            ends = np.append(cuts, len(sure))
            rows = len(cuts)
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array(segment[sure][cuts]),
                    "marks": pa.array([True] * rows),
                    "ids": pa.nulls(rows, pa.list_(id_type)),
                    "a": _lists(a[sure], ends),
                    "b": _lists(b[sure], ends),
                }
            )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, found = [], [], []
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = {d for d in digests(data.as_py(), min_chars) if d is not None}
                if keys:
                    ids.append(key)
                    counts.append(len(keys))
                    found += keys
                if len(found) >= CHUNK:
                    yield from flush(ids, counts, found)
                    ids, counts, found = [], [], []
        if found:
            yield from flush(ids, counts, found)

    def sift(table: pa.Table) -> pa.Table:
        asks = table.filter(pa.compute.invert(table.column("marks")))
        if table.column("segment")[0].as_py() >= 0:
            filters = Filters()
            for batch in table.to_batches():
                for marks, b in zip(batch.column("marks").to_pylist(), batch.column("b")):
                    (filters.mark if marks else filters.add)(np.asarray(b.values))
        flat = {n: asks.column(n).combine_chunks().flatten() for n in ("ids", "a", "b")}
        out = pa.table({"doc_id": flat["ids"], "a": flat["a"], "b": flat["b"]})
        if table.column("segment")[0].as_py() >= 0:
            out = out.filter(pa.array(filters.suspects(out.column("b").to_numpy())))
        return out

    asked = own.mapInArrow(look, f"segment bigint, marks boolean, ids array<{kind}>, a array<bigint>, b array<bigint>")
    return asked.groupBy("segment").applyInArrow(sift, f"doc_id {kind}, a bigint, b bigint")


def repeated_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, dropped): for each document that loses lines the distinct digests (a, b) of their keys."""
    suspects = settle(suspected_lines(docs, doc, text, min_chars), "suspected-lines")
    holders = suspects.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("keeper"))
    # Written on its own, so that the join below can be split at a line that very many documents hold.
    confirmed = settle(holders.filter(F.col("docs") >= min_docs).select("a", "b", "keeper"), "repeated-lines", thin=True)
    lost = suspects.join(confirmed, ["a", "b"]).filter(F.col("doc_id") < F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("dropped"))


def without_repeated_lines(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text) for every row of ``docs``; ``row`` holds all its columns.

    A text is split at line feeds; null and empty texts are one empty line. A
    line's key is the line without white space (space, tab, line feed, vertical
    tab, form feed, carriage return) at both ends, A-Z as small letters. Keys of at
    least ``min_chars`` code points that at least ``min_docs`` ids hold lose all
    their lines, also those repeated within a document, but for the rows of the
    largest id that holds them. Rows that repeat an id are one document
    here, each cleaned by itself; rows without an id count for nothing and lose
    nothing. An empty table gives an empty table. The filters never miss a repeat,
    and what they suspect wrongly does not reach ``min_docs``.

    Memory: a task holds CHUNK lines' digests and one text; a segment its filters
    and about SEGMENT_LINES digests; the digests of one document are held together.
    """
    lost = repeated_lines(docs, doc, text, min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("n_lines", F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(1).cast("bigint"))
    met = rows.join(lost, F.col("id") == F.col("doc_id"), "left")
    cut = _cut(F.when(F.col("dropped").isNotNull(), F.col("text").cast("binary")), F.col("dropped.a"), F.col("dropped.b"), min_chars)
    met = met.withColumn("cut", F.when(F.col("dropped").isNotNull(), cut))
    return met.select(
        "row",
        "n_lines",
        F.coalesce("cut.n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
        F.coalesce("cut.kept_text", "text", F.lit("")).alias("kept_text"),
    )


def _cut(text: Column, a: Column, b: Column, min_chars: int) -> Column:
    """(n_dropped, kept_text) of a text that loses the lines with these digests."""
    kind = pa.struct([("n_dropped", pa.int64()), ("kept_text", pa.string())])

    @F.arrow_udf("n_dropped bigint, kept_text string")
    def cut(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        for data, x, y in zip(texts, a, b):
            data = data.as_py()
            if data is None or not x.is_valid:
                out.append(None)
                continue
            lost = {bytes(k) for k in np.stack([np.asarray(x.values), np.asarray(y.values)], 1).astype("<i8")}
            keep = [line for line, d in zip(data.split(b"\n"), digests(data, min_chars)) if d is None or d not in lost]
            out.append({"n_dropped": data.count(b"\n") + 1 - len(keep), "kept_text": b"\n".join(keep).decode()})
        return pa.array(out, kind)

    return cut(text, a, b)
