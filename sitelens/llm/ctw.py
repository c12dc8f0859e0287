"""Language-model scoring by context-tree weighting over bytes.

A text is its words, A-Z as small letters, joined by single spaces and closed by a
line feed, which no word holds. Each byte is eight binary decisions; each decision
has a tree of the last 0 to ``DEPTH`` bytes before it. A node's
Krichevsky-Trofimov estimate depends on its counts only, so the model is a table
of n-gram counts summed over all training documents, worked through from the
deepest contexts to the root (evidence) and back (mixing weights):

    P_w(node) = (P_kt(node) + prod P_w(children)) / 2
    p(bit) = sum over depths d of w_d * kt_d(bit) * prod over e < d of (1 - w_e)

Documents meet the model in buckets of a bounded number of bytes. A bucket asks
for its own distinct n-grams and words only, so neither the model nor the corpus
is ever in one place. Questions and answers travel by a hash of the n-gram, as
compressed arrays. The tree is cut at contexts of ``root`` bytes: what is deeper
is worked out by one task for each group of such contexts, what is above them is a small table.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sitelens.llm.store import settle

DEPTH = 5
END = b"\n"
#: Bytes of text in a bucket, on average, and how many buckets there are beyond those.
BUCKET_BYTES, SPARE_BUCKETS = 12 << 20, 9
#: Bytes that are turned into n-gram codes at once, and n-grams whose trees are worked through at once.
CHUNK, TREE_CHUNK = 1 << 20, 200_000
#: Length of the contexts that the tree is cut at, and bytes of text from which it is one more.
ROOT, WIDE_BYTES = 2, 1 << 40


def stream(text: str | None) -> bytes:
    """The bytes that are modelled: words, single spaces, the end."""
    return b" ".join((text or "").encode().lower().split()) + END


def codes(streams: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """For every byte of every stream the number made of the ``depth`` bytes before it and itself.

    Before a stream stand line feeds, as after the end of another one.
    """
    pad = END * depth
    a = np.frombuffer(pad + pad.join(streams), np.uint8)
    n = len(a) - depth
    out = np.zeros(n, np.int64)
    for j in range(depth + 1):
        out = (out << 8) | a[j : n + j]
    lengths = np.array([len(s) for s in streams])
    real = np.ones(n, bool)
    gaps = np.cumsum(lengths[:-1] + depth) - depth
    for j in range(depth):
        real[gaps + j] = False
    return out[real]


def _chunks(streams: list[bytes]):
    part, size = [], 0
    for s in streams:
        part.append(s)
        size += len(s)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


class Places:
    """Places of keys in a sorted array: a table addressed by a hash, and a binary search where two keys share a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(10, int(4 * len(keys) + 1).bit_length())
        self.table = np.zeros(1 << self.bits, np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        found = self.table[self._slot(x)]
        other = np.flatnonzero(self.keys[found] != x)
        found[other] = np.searchsorted(self.keys, x[other])
        return found


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


def gram_counts(streams: list[bytes], trains: list[bool], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all streams with their counts in the training ones (0 for the others')."""
    keys, counts = [], []
    for flag in (True, False):
        for part in _chunks([s for s, t in zip(streams, trains) if t == flag]):
            u, n = np.unique(codes(part, depth), return_counts=True)
            keys.append(u)
            counts.append(n if flag else np.zeros_like(n))
            if len(keys) > 6:
                u, n = _summed(keys, counts)
                keys, counts = [u], [n]
    return _summed(keys, counts)


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as the differences between neighbours, byte by byte, compressed."""
    raw = np.diff(values.astype("<i8"), prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view("<i8")[:, 0])


def _shares(keys: np.ndarray, count: int) -> np.ndarray:
    """The share, from 0, that each key falls to by a hash."""
    mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    return (mixed % np.uint64(count)).astype(np.int64)


def _cuts(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(sorted_keys)]))


def turned(grams: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """N-grams with the bytes of the context in reverse order: the latest byte first, so a shorter context is a prefix."""
    out = grams & 255
    for j in range(1, depth + 1):
        out |= ((grams >> (8 * j)) & 255) << (8 * (depth + 1 - j))
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: recurrence to x + 8, then Stirling's series."""
    y = x + 8
    below = x.copy()
    for k in range(1, 8):
        below *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(below)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Branches:
    """The trees of one of the eight decisions, from the deepest contexts up to those of ``root`` bytes.

    A node is a number: its context, then the ``k`` bits that are known before the decision.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, k: int, root: int, depth: int = DEPTH):
        self.k, self.bit = k, (grams >> (7 - k)) & 1
        node = grams >> (8 - k)
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        self.deepest = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
        ones = np.add.reduceat(counts * self.bit, starts).astype(float)
        zeros = np.add.reduceat(counts, starts) - ones
        node, evidence, own, up = node[starts], _kt(zeros, ones), np.ones(len(starts)), None
        self.levels = [(zeros, ones, own, up)]
        for _ in range(depth - root):
            shorter = (node >> (8 + k) << k) | (node & ((1 << k) - 1))
            node, up = np.unique(shorter, return_inverse=True)
            zeros, ones, kids = (np.bincount(up, x, len(node)) for x in (zeros, ones, evidence))
            kt = _kt(zeros, ones)
            gap = kids - kt
            evidence = np.maximum(kt, kids) + np.log1p(np.exp(-np.abs(gap))) - math.log(2)
            own = 1 / (1 + np.exp(np.minimum(gap, 700.0)))
            self.levels.append((zeros, ones, own, up))
        self.context, self.prefix, self.evidence = node >> k, (node & ((1 << k) - 1)) | 1 << k, evidence

    def values(self, p: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's bit, from what the contexts above the roots have mixed and left over."""
        down = None
        for zeros, ones, own, up in reversed(self.levels):
            if down is not None:
                p, rest = p[down], rest[down]
            p = p + rest * own * ((ones + 0.5) / (zeros + ones + 1.0))
            rest, down = rest * (1 - own), up
        p = p[self.deepest]
        return np.log10(np.where(self.bit == 1, p, 1 - p))


def _tree_chunks(rows: pa.Table, root: int):
    """(places, n-grams, counts) of all rows, latest byte first and in order, cut between contexts of ``root`` bytes."""
    grams = turned(np.concatenate([_unsqueeze(x) for x in rows.column("keys").to_pylist()]))
    counts = np.concatenate([_unsqueeze(x) for x in rows.column("n").to_pylist()])
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    roots = _cuts(grams >> 8 * (DEPTH + 1 - root))
    at = 0
    for i, (_, end) in enumerate(roots):
        if end - at >= TREE_CHUNK or i == len(roots) - 1:
            yield order[at:end], grams[at:end], counts[at:end]
            at = end


def _roots_above(roots: DataFrame, root: int) -> DataFrame:
    """``roots`` with (p, rest): what the shorter contexts of each have mixed, and the weight they leave."""
    def kt(a: Column, b: Column) -> Column:
        return _log_gamma_column(a + 0.5) + _log_gamma_column(b + 0.5) - _log_gamma_column(a + b + 1.0) - math.log(math.pi)

    levels = [roots]
    for d in range(root - 1, -1, -1):
        up = levels[-1].groupBy(F.shiftright("context", 8).alias("context"), "prefix").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("evidence").alias("kids")
        )
        up = up.withColumn("kt", kt(F.col("a"), F.col("b"))).withColumn("gap", F.col("kids") - F.col("kt"))
        up = up.withColumn("evidence", F.greatest("kt", "kids") + F.log1p(F.exp(-F.abs("gap"))) - math.log(2))
        up = up.withColumn("own", 1 / (1 + F.exp(F.least("gap", F.lit(700.0)))))
        levels.append(settle(up.select("context", "prefix", "a", "b", "evidence", "own"), f"contexts-{d}", thin=True))
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    mixed = levels[-1].select("context", "prefix", (F.col("own") * one).alias("p"), (1 - F.col("own")).alias("rest"))
    for d in range(1, root):
        above = mixed.select(F.col("context").alias("shorter"), F.col("prefix").alias("same"), F.col("p").alias("p0"), F.col("rest").alias("rest0"))
        nodes = levels[root - d]
        met = nodes.join(above, (F.shiftright(nodes["context"], 8) == F.col("shorter")) & (F.col("prefix") == F.col("same")))
        mixed = met.select("context", "prefix", (F.col("p0") + F.col("rest0") * F.col("own") * one).alias("p"), (F.col("rest0") * (1 - F.col("own"))).alias("rest"))
    mixed = mixed.select(F.col("context").alias("shorter"), F.col("prefix").alias("same"), "p", "rest")
    return roots.join(mixed, (F.shiftright(roots["context"], 8) == F.col("shorter")) & (roots["prefix"] == F.col("same"))).select("part", "context", "prefix", "p", "rest")


def _log_gamma_column(x: Column) -> Column:
    """As ``_log_gamma``, for the small table of contexts above the roots."""
    y = x + 8
    below = x
    for k in range(1, 8):
        below = below * (x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(below)


def gram_values(asked: DataFrame, shares: int, root: int) -> DataFrame:
    """(share, keys, value): log10 probability of the last byte after the others for every distinct n-gram asked.

    ``asked``: (share, keys, n), n-grams with their training counts, dealt to
    shares by a hash; those with n = 0 teach nothing.
    """

    def merge(table: pa.Table) -> pa.Table:
        share = table.column("share")[0].as_py()
        grams, counts = _summed([_unsqueeze(x) for x in table.column("keys").to_pylist()], [_unsqueeze(x) for x in table.column("n").to_pylist()])
        part = _shares(turned(grams) >> 8 * (DEPTH + 1 - root), shares)
        order = np.argsort(part, kind="stable")
        part, grams, counts = part[order], grams[order], counts[order]
        cuts = _cuts(part)
        return pa.table(
            {
                "part": pa.array([int(part[a]) for a, _ in cuts], pa.int32()),
                "share": pa.array([share] * len(cuts), pa.int32()),
                "keys": pa.array([_squeeze(grams[a:b]) for a, b in cuts], pa.binary()),
                "n": pa.array([_squeeze(counts[a:b]) for a, b in cuts], pa.binary()),
            }
        )

    def up(table: pa.Table) -> pa.Table:
        part, out = table.column("part")[0].as_py(), []
        for _, grams, counts in _tree_chunks(table, root):
            for k in range(8):
                tree = Branches(grams, counts, k, root)
                out.append((tree.context, tree.prefix, tree.levels[-1][0], tree.levels[-1][1], tree.evidence))
        columns = [np.concatenate(x) for x in zip(*out)]
        named = dict(zip(("context", "prefix", "a", "b", "evidence"), map(pa.array, columns)))
        return pa.table({"part": pa.array(np.full(len(columns[0]), part, np.int32)), **named})

    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        known = (above.column("context").to_numpy() << 8) | above.column("prefix").to_numpy()
        order = np.argsort(known)
        known, p, rest = known[order], above.column("p").to_numpy()[order], above.column("rest").to_numpy()[order]
        keys = [_unsqueeze(x) for x in table.column("keys").to_pylist()]
        values = np.zeros(sum(map(len, keys)))
        for places, grams, counts in _tree_chunks(table, root):
            for k in range(8):
                tree = Branches(grams, counts, k, root)
                at = np.searchsorted(known, (tree.context << 8) | tree.prefix)
                values[places] += tree.values(p[at], rest[at])
        ends = np.cumsum([len(x) for x in keys])
        cells = [values[e - len(x) : e].astype("<f8").tobytes() for x, e in zip(keys, ends.tolist())]
        return pa.table({"share": table.column("share"), "keys": table.column("keys"), "value": pa.array(cells, pa.binary())})

    grams = settle(asked.groupBy("share").applyInArrow(merge, "part int, share int, keys binary, n binary"), "grams")
    roots = grams.groupBy("part").applyInArrow(up, "part int, context bigint, prefix bigint, a double, b double, evidence double")
    above = _roots_above(settle(roots, "roots"), root)
    return grams.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(down, "share int, keys binary, value binary")


def _encoded(docs: DataFrame, doc: str, text: str, train: Column, buckets: int) -> DataFrame:
    """(b, doc_id, train, data): modelled bytes of each document, compressed for the way to its bucket."""
    own = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{doc}`"), F.col(f"`{text}`")), F.lit(buckets)).cast("int").alias("b"),
        F.col(f"`{doc}`").alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )

    def run(batches):
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            data = [stream(t) for t in batch.column(3).to_pylist()]
            packed = [len(s).to_bytes(8, "little") + codec.compress(s, asbytes=True) for s in data]
            yield pa.RecordBatch.from_pydict({"b": batch.column(0), "doc_id": batch.column(1), "train": batch.column(2), "data": pa.array(packed, pa.binary())})

    kind = docs.schema[doc].dataType.simpleString()
    return own.mapInArrow(run, f"b int, doc_id {kind}, train boolean, data binary")


def _unpacked(column) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in _bytes(column)]


def _bytes(column) -> list[bytes]:
    return [x if isinstance(x, bytes) else x.as_py() for x in column]


def _bucket_counts(table: pa.Table, shares: int) -> pa.Table:
    """(b, share, is_word, keys, n) of one bucket: its distinct n-grams and words, dealt to shares by a hash."""
    b, trains = table.column("b")[0].as_py(), table.column("train").to_pylist()
    streams = _unpacked(table.column("data"))
    grams, counts = gram_counts(streams, trains)
    words: Counter = Counter()
    for s, t in zip(streams, trains):
        words.update(s.split() if t else dict.fromkeys(s.split(), 0))
    share = _shares(grams, shares)
    order = np.argsort(share, kind="stable")
    share, grams, counts = share[order], grams[order], counts[order]
    cuts = _cuts(share)
    dealt: dict[int, list[bytes]] = defaultdict(list)
    for w in words:
        dealt[crc32(w) % shares].append(w)
    keys = [_squeeze(grams[a:e]) for a, e in cuts] + [_joined(x) for x in dealt.values()]
    n = [_squeeze(counts[a:e]) for a, e in cuts] + [_squeeze(np.array([words[w] for w in x], np.int64)) for x in dealt.values()]
    return pa.table(
        {
            "b": pa.array([b] * len(keys), pa.int32()),
            "share": pa.array([int(share[a]) for a, _ in cuts] + list(dealt), pa.int32()),
            "is_word": pa.array([False] * len(cuts) + [True] * len(dealt)),
            "keys": pa.array(keys, pa.binary()),
            "n": pa.array(n, pa.binary()),
        }
    )


def _joined(words: list[bytes]) -> bytes:
    data = b" ".join(words)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _word_answers(table: pa.Table) -> pa.Table:
    """(b, keys, value, tokens, distinct): the count of every word asked; tokens and distinct ones of the share in the first row."""
    asked = [_unpacked([x])[0].split(b" ") for x in table.column("keys")]
    total: dict[bytes, int] = defaultdict(int)
    for words, n in zip(asked, table.column("n").to_pylist()):
        for w, c in zip(words, _unsqueeze(n).tolist()):
            total[w] += c
    first = [sum(total.values()), sum(c > 0 for c in total.values())]
    rest = [0] * (len(asked) - 1)
    return pa.table(
        {
            "b": table.column("b"),
            "keys": table.column("keys"),
            "value": pa.array([_squeeze(np.array([total[w] for w in words], np.int64)) for words in asked], pa.binary()),
            "tokens": pa.array([first[0], *rest], pa.int64()),
            "distinct": pa.array([first[1], *rest], pa.int64()),
        }
    )


def _gram_answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    """(b, keys, value): the values of every bucket's n-grams of one share."""
    keys = np.concatenate([_unsqueeze(x) for x in known.column("keys").to_pylist()])
    values = np.concatenate([np.frombuffer(x, "<f8") for x in known.column("value").to_pylist()])
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    cells = [values[np.searchsorted(keys, _unsqueeze(x))].tobytes() for x in asked.column("keys").to_pylist()]
    return pa.table({"b": asked.column("b"), "keys": asked.column("keys"), "value": pa.array(cells, pa.binary())})


def scored(docs: DataFrame, train: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) per row.

    ``train`` says which rows teach (null: no); all rows are scored. Tokens are
    words (A-Z as small letters) and one end per text. base_score adds
    log10((c + 0.1) / (N + 0.1 * (V + 1))) over the tokens; score is the
    context-tree model's log10 probability of the text, and bits_per_byte its code
    length. Null and empty texts are the end alone. Null ids are scored like
    others; repeated rows teach as often as they occur. Without training rows
    every bit has probability 1/2 and the base is 0. An empty table gives an empty
    table; other columns are not read.
    """
    kind = docs.schema[doc].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets, root = size // BUCKET_BYTES + 1 + SPARE_BUCKETS, ROOT if size < WIDE_BYTES else ROOT + 1
    encoded = _encoded(docs, doc, text, train, buckets)
    counts = encoded.groupBy("b").applyInArrow(lambda t: _bucket_counts(t, buckets), "b int, share int, is_word boolean, keys binary, n binary")
    counts = settle(counts, "bucket-counts")

    asked = counts.filter(~F.col("is_word")).drop("is_word")
    values = gram_values(asked.drop("b"), buckets, root)
    answers = asked.drop("n").groupBy("share").cogroup(values.groupBy("share")).applyInArrow(_gram_answers, "b int, keys binary, value binary")
    words = counts.filter("is_word").groupBy("share").applyInArrow(_word_answers, "b int, keys binary, value binary, tokens bigint, distinct bigint")
    words = settle(words, "word-counts")
    ends = docs.agg(F.count(F.when(train, 1))).first()[0]
    total, distinct = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n_all, v_all = int(total) + ends, int(distinct) + (ends > 0)
    scale = n_all + 0.1 * (v_all + 1)
    model = answers.select("b", F.lit(False).alias("is_word"), "keys", "value").union(words.select("b", F.lit(True), "keys", "value"))

    id_type = to_arrow_type(docs.schema[doc].dataType)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own_grams = right.filter(pc.invert(right.column("is_word")))
        keys = np.concatenate([_unsqueeze(x) for x in own_grams.column("keys").to_pylist()])
        values = np.concatenate([np.frombuffer(x, "<f8") for x in own_grams.column("value").to_pylist()])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        own_words = right.filter(right.column("is_word"))
        known: dict[bytes, int] = {}
        for x, n in zip(own_words.column("keys"), own_words.column("value").to_pylist()):
            known.update(zip(_unpacked([x])[0].split(b" "), _unsqueeze(n).tolist()))
        del right, own_grams, own_words, order
        place = Places(keys)
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for part in _chunks(_unpacked(left.column("data"))):
            lengths = np.array([len(s) for s in part])
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            out["score"].append(np.add.reduceat(values[place(codes(part))], at))
            out["n_bytes"].append(lengths)
            split = [s.split() for s in part]
            tokens = np.array([len(w) + 1 for w in split])
            c = np.fromiter((x for w in split for x in (*map(known.__getitem__, w), ends)), float, tokens.sum())
            at = np.concatenate([[0], np.cumsum(tokens)[:-1]])
            out["n_tokens"].append(tokens)
            out["n_known"].append(np.add.reduceat((c > 0).astype(np.int64), at))
            out["base_score"].append(np.add.reduceat(np.log10((c + 0.1) / scale), at))
        columns = {k: np.concatenate(v) for k, v in out.items()}
        return pa.table(
            {
                "doc_id": left.column("doc_id").cast(id_type),
                "train": left.column("train"),
                "n_tokens": pa.array(columns["n_tokens"], pa.int64()),
                "n_known": pa.array(columns["n_known"], pa.int64()),
                "train_tokens": pa.array(np.full(len(left), n_all, np.int64)),
                "base_score": pa.array(columns["base_score"]),
                "score": pa.array(columns["score"]),
                "n_bytes": pa.array(columns["n_bytes"], pa.int64()),
                "bits_per_byte": pa.array(-columns["score"] * math.log2(10) / columns["n_bytes"]),
            }
        )

    schema = f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"
    return encoded.groupBy("b").cogroup(model.groupBy("b")).applyInArrow(score, schema)
