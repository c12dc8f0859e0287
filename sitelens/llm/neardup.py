"""Near-duplicate documents by MinHash bands with sequential Bayesian verification.

1. Every text becomes its set of distinct word shingles (64-bit hashes) and a
   signature of minima. Texts with equal sets are one node, named by the
   smallest id.
2. Nodes that share a band of their signatures are candidates. A bucket is not
   expanded into its pairs. At first every node meets one member of its buckets,
   which joins groups of copies at a linear cost. Only those buckets go on which
   still hold more than one component. Their nodes are compared with all nodes of
   the large components there, block by block. Of the rest, nodes with too many
   shingles of their own to be similar to anything in a bucket leave it. Buckets
   that are still large are compared block by block too; in the others nodes meet
   a few centres, more of them each time, until every pair of a bucket is linked,
   compared or inside one component.
3. A candidate's signatures are compared batch by batch. It is dropped as soon
   as the posterior probability (uniform prior) that the similarity reaches the
   threshold falls below ``MISS``. Survivors are verified on their full sets.
4. Components of the verified links give the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.components import components
from sitelens.llm.store import discard, settle

#: 42 bands of 6 minima: a pair at similarity 0.8 shares none with probability 3e-6.
BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
#: Signature values looked at together, and the chance at which a pair is given up.
BATCH, MISS = 42, 1e-6
#: Rounds in which every node meets one member of its buckets only.
HOOKS = 1
#: Nodes from which on a component or bucket is large, and nodes in a block that meets others.
LARGE, MEETING = 32, 256
#: Rounds that sift out nodes which no member of a bucket can be similar to.
SIFTS = 1
#: Bytes of text that are hashed at once.
SLICE = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE * 2)
            grow = lambda b: np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, b, _U)]))
            self.up, self.down = grow(_BASE), grow(pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


def shingle_sets(texts: list[bytes], width: int, powers: Powers) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; capitals A-Z count as small.

    A text with fewer words than ``width`` has its whole sequence as one shingle,
    a text without words has none.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(data):
        return [np.zeros(0, _U) for _ in texts]
    data = _LOWER[data]
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    up, down = powers.get(len(data) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U)])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    limits = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, limits)
    rolled = words.copy()
    for j in range(1, width):
        rolled = rolled[:-1] * _U(0xFF51AFD7ED558CCD) + words[j:] if len(rolled) > 1 else rolled[:0]
        rolled = _mix(rolled)
    out, first = [], 0
    for last in cuts:
        n = last - first
        if n >= width:
            out.append(np.unique(rolled[first : last - width + 1]))
        elif n:
            one = _U(n)
            with np.errstate(over="ignore"):
                for w in words[first:last]:
                    one = _mix(np.array([one * _U(0xC4CEB9FE1A85EC53) + w]))[0]
            out.append(np.array([one]))
        else:
            out.append(np.zeros(0, _U))
        first = last
    return out


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Start and bytes of successive parts of about ``SLICE`` bytes."""
    start, part, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if part and size + len(b) > SLICE:
            yield start, part
            start, part, size = i, [], 0
        part.append(b)
        size += len(b)
    if part:
        yield start, part


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each of the hash functions ``a * x + b`` modulo 2**32."""
    x = (values >> _U(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(best, (x[at : at + 512, None] * a + b).min(0), out=best)
    return best


def hash_functions(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1), r.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


def summaries(docs: DataFrame, doc: str, text: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) per row; key and signature are null for empty sets and null ids."""
    kind = docs.schema[doc].dataType.simpleString()
    a, b = hash_functions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, part in _slices(texts):
                sets = shingle_sets(part, width, powers)
                own = ids.slice(start, len(part))
                used = [len(s) > 0 and i is not None for s, i in zip(sets, own.to_pylist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": own,
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if u else None for s, u in zip(sets, used)], pa.binary()),
                        "sig": pa.array([signature(s, a, b).tobytes() if u else None for s, u in zip(sets, used)], pa.binary()),
                    }
                )

    rows = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_key binary, sig binary")


def full_sets(docs: DataFrame, ids: DataFrame, doc: str, text: str, width: int) -> DataFrame:
    """(id, n, members): the full shingle sets of the documents in ``ids``, as sorted 64-bit values."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, part in _slices(texts):
                sets = shingle_sets(part, width, powers)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column(0).slice(start, len(part)),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "members": pa.array([s.tobytes() for s in sets], pa.binary()),
                    }
                )

    rows = docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(run, f"id {kind}, n bigint, members binary")


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of batches the least count of equal minima with which a pair goes on.

    With m of n equal the posterior of the similarity is Beta(m + 1, n - m + 1),
    so it reaches t with the probability that a Binomial(n + 1, t) is at most m.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            log = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
            total += math.exp(log + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold)) if threshold < 1 else 0.0
            if total >= miss or m == n:
                break
            m += 1
        out.append(m)
    return out


def plausible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that survive the sequential comparison, without the signatures."""
    limits = least_matches(threshold)
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b")]
            alive, met = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, least in enumerate(limits):
                part = slice(k * BATCH, (k + 1) * BATCH)
                met[alive] += (x[alive, part] == y[alive, part]).sum(1)
                alive = alive[met[alive] >= least]
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(pa.array(alive)) for c in ("a", "b")})

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, set_a, set_b) whose full sets reach the similarity, compared in whole numbers."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")})

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among candidate pairs: size bound, signatures, full sets."""
    left = sigs.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    signed = pairs.join(left, "a").join(right, "b")
    signed = signed.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    alive = settle(plausible(signed, percent / 100), "plausible", thin=True)
    with_sets = alive.join(sets.select(F.col("id").alias("a"), F.col("members").alias("set_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("members").alias("set_b")), "b"
    )
    return verified(with_sets, percent)


def _sifted(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (key, id) rows whose node can still have a link in that bucket.

    Shingles that a node shares with no other one of all these buckets are in no
    possible partner. What is left of it, and the least size of the bucket, bound
    the similarity with every member at once: an exact test at a linear cost.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in zip(batch.column("id").to_pylist(), batch.column("members").to_pylist()):
                x = np.frombuffer(blob, np.int64)
                yield pa.RecordBatch.from_pydict({"id": pa.array([i] * len(x), batch.column("id").type), "shingle": pa.array(x)})

    own = sets.join(members.select("id").distinct(), "id", "left_semi")
    kind = sets.schema["id"].dataType.simpleString()
    spreaded = own.select("id", "members").mapInArrow(spread, f"id {kind}, shingle bigint")
    lone = spreaded.groupBy("shingle").agg(F.count("*").alias("met"), F.min("id").alias("id")).filter("met = 1")
    lone = lone.groupBy("id").agg(F.count("*").alias("lone"))
    sized = own.groupBy("id").agg(F.max("n").alias("n")).join(lone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("common"))
    rows = settle(members.join(sized, "id"), "sized-members", thin=True)
    least = rows.groupBy("key").agg(F.min("n").alias("least"))
    able = (100 + percent) * F.col("common") >= percent * (F.col("n") + F.col("least"))
    return rows.join(least, "key").filter(able).select("key", "id")


def _blocks(rows: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(place, <name>, ids, owners, counts, shingles): nodes of each (place, id, component_id), dealt by hash to blocks of one row."""
    sizes = rows.groupBy("place").agg(F.ceil(F.count("*") / MEETING).cast("bigint").alias("of"))
    dealt = rows.join(sizes, "place").select("place", "id", "component_id", F.pmod(F.xxhash64("id"), "of").alias(name)).join(sets, "id")
    kind, place = sets.schema["id"].dataType.simpleString(), rows.schema["place"].dataType.simpleString()

    def gather(table: pa.Table) -> pa.Table:
        ids = pa.list_(table.column("id").type)
        return pa.table(
            {
                "place": table.column("place").slice(0, 1),
                name: table.column(name).slice(0, 1),
                "ids": pa.array([table.column("id").to_pylist()], ids),
                "owners": pa.array([table.column("component_id").to_pylist()], ids),
                "counts": pa.array([table.column("n").to_pylist()], pa.list_(pa.int64())),
                "shingles": pa.array([b"".join(table.column("members").to_pylist())], pa.binary()),
            }
        )

    schema = f"place {place}, {name} bigint, ids array<{kind}>, owners array<{kind}>, counts array<bigint>, shingles binary"
    return dealt.groupBy("place", name).applyInArrow(gather, schema)


def _met(asking: DataFrame, held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of asking nodes with held nodes of the same place that are in another component.

    Blocks meet blocks and compare full sets; a node gives one link per block and
    component it finds there, so no pair becomes a row.
    """
    names = {c: f"q_{c}" for c in ("ids", "owners", "counts", "shingles")}
    left = _blocks(asking, sets, "asker").withColumnsRenamed(names)
    met = left.join(settle(_blocks(held, sets, "holder"), "held-blocks"), "place").select(*names.values(), *names)
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_owners, q_counts, q_shingles, ids, owners, counts, shingles in zip(*[c.to_pylist() for c in batch.columns]):
                a, b, at = [], [], 0
                every, sizes, owners = np.frombuffer(shingles, _U), np.array(counts), np.array(owners)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                for i, owner, n in zip(q_ids, q_owners, q_counts):
                    own = np.frombuffer(q_shingles, _U, n, at * 8)
                    at += n
                    hit = own[np.minimum(np.searchsorted(own, every), n - 1)] == every
                    both = np.add.reduceat(hit.astype(np.int64), starts)
                    good = np.flatnonzero((100 * both >= percent * (n + sizes - both)) & (both > 0) & (owners != owner))
                    for k in np.unique(owners[good], return_index=True)[1]:
                        a.append(i)
                        b.append(ids[good[k]])
                id_type = batch.schema.field("q_ids").type.value_type
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, id_type), "b": pa.array(b, id_type)})

    return settle(met.mapInArrow(run, f"a {kind}, b {kind}"), "links", thin=True)


def _against_large(known: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of nodes with large components they share a bucket with, and the (key, id) rows of small components.

    Each such node is compared with all the component's nodes in open buckets. Of
    two large components the smaller one's nodes ask.
    """
    sizes = known.select("component_id", "id").distinct().groupBy("component_id").agg(F.count("*").alias("weight"))
    # Written on its own: few rows, and a join that the adaptive plan can split at a component of very many nodes.
    sizes = settle(sizes.filter(F.col("weight") >= LARGE), "large-components", thin=True)
    sized = known.join(sizes, "component_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    sized = settle(sized, "weighed-members", thin=True)
    large = sized.filter(F.col("weight") >= LARGE)
    present = large.select("key", F.col("component_id").alias("place"), F.col("weight").alias("place_weight")).distinct()
    ahead = F.struct("place_weight", "place") > F.struct("weight", "component_id")
    asking = sized.join(present, "key").filter((F.col("place") != F.col("component_id")) & ahead)
    asking = settle(asking.select("place", "id", "component_id").distinct(), "asking", thin=True)
    held = large.select(F.col("component_id").alias("place"), "id", "component_id").distinct()
    held = held.join(asking.select("place").distinct(), "place", "left_semi")
    small = settle(sized.filter(F.col("weight") < LARGE).select("key", "id"), "bucket-members", thin=True)
    return _met(asking, held, sets, percent), small


def _within_large(known: DataFrame, buckets: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links inside the open buckets that are large, and the (key, id) rows of the others."""
    opened = settle(known.join(buckets.select("key", "size"), "key"), "open-members", thin=True)
    inside = opened.filter(F.col("size") >= LARGE).select(F.col("key").alias("place"), "id", "component_id")
    small = settle(opened.filter(F.col("size") < LARGE).select("key", "id"), "bucket-members", thin=True)
    return _met(inside, inside, sets, percent), small


def links(docs: DataFrame, nodes: DataFrame, doc: str, text: str, width: int, percent: int) -> DataFrame | None:
    """(id, component_id) of the nodes (rep, n_shingles, sig) that are linked with others."""
    keyed = [F.struct(F.xxhash64(F.lit(i), F.substring("sig", 1 + 4 * ROWS * i, 4 * ROWS)).alias("key")) for i in range(BANDS)]
    bands = settle(nodes.select(F.col("rep").alias("id"), F.explode(F.array(*keyed)).alias("at")).select("at.key", "id"), "bands")
    shared = bands.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    members = settle(bands.join(shared, "key"), "bucket-members", thin=True)
    discard(bands)
    busy = settle(members.select("id").distinct(), "bucket-ids", thin=True)
    sigs = settle(nodes.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sig").join(busy, "id", "left_semi"), "bucket-signatures")
    sets = settle(full_sets(docs, busy, doc, text, width), "bucket-sets")
    found, labels, turn = None, None, -HOOKS
    while True:
        if labels is None:
            known = members.withColumn("component_id", F.col("id"))
        else:
            known = members.join(labels, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
        known = settle(known.select("key", "id", "component_id"), "bucket-components", thin=True)
        buckets = known.groupBy("key").agg(
            F.count("*").alias("size"), F.min("id").alias("first"), F.min("component_id").alias("lo"), F.max("component_id").alias("hi")
        )
        buckets = settle(buckets.filter("lo < hi").select("key", "size", "first", "lo"), "open-buckets", thin=True)
        if buckets.isEmpty():
            break
        if turn in (0, SIFTS + 1):
            if turn == 0:
                more, members = _against_large(known.join(buckets.select("key"), "key"), sets, percent)
            else:
                more, members = _within_large(known, buckets, sets, percent)
            turn += 1
            if not more.isEmpty():
                found = found.union(more)
                labels = components(found)
            continue
        if 0 < turn <= SIFTS:
            members = settle(_sifted(known.join(buckets, "key").select("key", "id"), sets, percent), "bucket-members", thin=True)
            turn += 1
            continue
        opened = known.join(buckets, "key")
        if turn < 0:
            away = opened.filter("component_id > lo").groupBy("id")
            target = F.min("lo") if labels is None else F.min_by("lo", F.xxhash64("id", "lo", F.lit(turn)))
            met = away.agg(target.alias("lo")).select(F.col("id").alias("a"), F.col("lo").alias("b"))
        else:
            likely = F.pmod(F.xxhash64("id", F.lit(turn)), F.col("size")) < 2 * 8 ** (turn - SIFTS - 2) - 1
            opened = settle(opened.withColumn("centre", (F.col("id") == F.col("first")) | likely), "open-members", thin=True)
            centres = opened.filter("centre").select("key", F.col("id").alias("a"), F.col("component_id").alias("own"))
            others = opened.select("key", F.col("id").alias("b"), "component_id", "centre")
            met = centres.join(others, "key").filter((F.col("own") != F.col("component_id")) & (~F.col("centre") | (F.col("a") < F.col("b"))))
            members = settle(opened.filter("not centre").select("key", "id"), "bucket-members", thin=True)
        pairs = settle(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs", thin=True)
        more = settle(_confirmed(pairs, sigs, sets, percent), "links", thin=True)
        turn += 1
        if found is None or not more.isEmpty():
            found = more if found is None else found.union(more)
            labels = components(found)
    return labels


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    Two rows are linked when their sets of ``width``-word shingles (whole texts,
    A-Z as small letters) have 100 * intersection >= percent * union, and neither
    is empty. component_id is the smallest id reachable. Null and empty texts have
    no shingle and stand alone. Rows without an id link with nothing and are kept
    (component_id null). An id whose rows differ in text stands for all of them: its
    rows get the smallest id that any of them reaches. An empty table gives an
    empty table; other columns are not read.
    """
    rows = settle(summaries(docs, doc, text, width), "summaries")
    reps = settle(rows.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "set-classes")
    firsts = rows.join(reps.select(F.col("set_key"), F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    nodes = firsts.select(F.col("doc_id").alias("rep"), "n_shingles", "sig")
    labels = links(docs, nodes, doc, text, width, percent)
    named = rows.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left")
    if labels is not None:
        named = named.join(labels.select(F.col("id").alias("rep"), F.col("component_id").alias("found")), "rep", "left")
    else:
        named = named.withColumn("found", F.col("rep"))
    component = F.coalesce("found", "rep", "doc_id")
    return named.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame, doc: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The documents' own columns for one row of each class; rows without an id all stay.

    Of rows that repeat the kept id one stays, by the order of their hash.
    """
    keep = classes(docs, doc, text, **rules).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc}`").alias("__id"))
    lone = packed.filter("__id is null").select("row.*")
    single = packed.join(keep, F.col("__id") == F.col("__kept"), "left_semi")
    return single.groupBy("__id").agg(F.min_by("row", F.xxhash64(F.col(f"row.`{text}`"))).alias("row")).select("row.*").union(lone)
