"""Cost-balanced packing of tokenised documents into sequences.

The cost of a piece is estimated as ``linear * n + quadratic * n**2``. Within a
block of documents the remainders (what is left of a document after its whole
sequences) go in descending cost to the lowest-cost sequence that still has the
room; if none has, the one with most room takes a part and the rest goes on.
A block opens exactly as many full sequences as its tokens fill; what is left
over is dealt to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

CAPACITY = 1024
END_ID = 0
#: A block is closed at this many documents or tokens, whichever comes first.
BLOCK_DOCS, BLOCK_TOKENS = 4096, 1 << 21
#: Fixed value: how byte-level tokenizers of this kind cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside the blocks in which no version of Unicode will change what is a letter, a number or a space; long white space.
UNSETTLED = r"[^\x00-\u024f\u2000-\u206f]|\s{1000}"
_WORKER: dict[str, TextIds] = {}


def byte_characters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible ones stand for themselves, others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


def rank_encoder(path: str):
    """The same vocabulary as an encoder by ranks, which is faster on unseen words; None where the file is of another kind.

    The ranks of a byte-level vocabulary are its ids if every merge's result has the next id.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    merged = [("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    vocabulary, byte = model["vocab"], byte_characters()
    added = {t["content"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in added}
    if any(vocabulary.get(m) != 256 + i for i, m in enumerate(merged)) or sorted(ranks.values()) != list(range(len(ranks))):
        return None
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class TextIds:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    Ranks and the tokenizer's own file give the same ids. Texts with a character
    whose class Unicode may still change, with an added token or with a very long run of
    white space (the rank encoder's matcher has a bounded stack) are left to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.ranks = Tokenizer.from_file(path), rank_encoder(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.leave = re.compile("|".join([UNSETTLED, *map(re.escape, added)]))

    @classmethod
    def of_worker(cls, path: str) -> TextIds:
        """The one of this worker process, used again by its later tasks."""
        if path not in _WORKER:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on every core
            _WORKER[path] = cls(path)
        return _WORKER[path]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.ranks is None or self.leave.search(text):
                rest.append(i)
            else:
                out[i] = np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(x.ids, "<u4").tobytes()
        return out


def deal(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these token counts."""
    pieces, rest, sequences = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        pieces += [(d, k * capacity, capacity, sequences + k, 0) for k in range(whole)]
        sequences += whole
        if n % capacity:
            rest.append((d, whole * capacity, n % capacity))
    total = sum(n for _, _, n in rest)
    tail = [1 << b for b in range(capacity.bit_length(), -1, -1) if (total % capacity) >> b & 1]
    room = np.array([capacity] * (total // capacity) + tail, np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    queue = sorted(rest, key=lambda x: (-x[2], x[0]))
    at = 0
    while at < len(queue):
        d, start, n = queue[at]
        at += 1
        while n:
            fits = np.flatnonzero(room >= n)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            take = min(n, int(room[s]))
            pieces.append((d, start, take, sequences + s, int(size[s] - room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``).

    ``tokenizer``: path of a byte-level tokenizer file, on every executor. Every
    document, also a null or empty one, ends with id 0, so it has a token at
    least; null ids and repeated rows are packed like any others. Nothing is
    shuffled: blocks of a partition's rows are packed on their own and numbered
    from (partition, counter). A document is held whole by the task that encodes
    it; other memory is bounded by the block. Other columns are not read; an empty
    table gives an empty table.
    """
    kind = docs.schema[doc].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[doc].dataType)
    rows = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def close(keys: list, coded: list[bytes], base: int) -> tuple[pa.RecordBatch, int]:
        found = deal([len(b) // 4 for b in coded], capacity, linear, quadratic)
        parts = [coded[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in found]
        columns = {
            "doc_id": pa.array([keys[x[0]] for x in found], id_type),
            "start": pa.array([x[1] for x in found], pa.int64()),
            "length": pa.array([x[2] for x in found], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            "doc_tokens": pa.array([len(coded[x[0]]) // 4 for x in found], pa.int64()),
            "sequence_id": pa.array([base + x[3] for x in found], pa.int64()),
            "offset": pa.array([x[4] for x in found], pa.int64()),
        }
        if ids:
            columns["ids"] = pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns), base + (max(x[3] for x in found) + 1 if found else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = TextIds.of_worker(tokenizer), np.array([END_ID], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        keys, coded, tokens = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                keys += part.column(0).to_pylist()
                coded += [b + end for b in encode(texts)]
                tokens += sum(len(b) // 4 for b in coded[-part.num_rows :])
                if len(coded) >= BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                    out, base = close(keys, coded, base)
                    yield out
                    keys, coded, tokens = [], [], 0
        if coded:
            yield close(keys, coded, base)[0]

    return rows.mapInArrow(run, schema + (", ids array<int>" if ids else ""))
