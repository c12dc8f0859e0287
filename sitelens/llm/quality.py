"""Quality scoring by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and so has each chosen pair. The
tables are sums of shallow trees, boosted feature by feature in turn on the
logistic loss. A score is the sum of the tables' entries, taken for a whole batch
at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample: labelled rows, chosen by hash.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
THRESHOLD = 0.7

FEATURES = (
    "log_words",
    "word_length",
    "distinct_words",
    "capitals",
    "marks",
    "digits",
    "mark_runs",
    "lone_marks",
    "top_word",
    "word_repeats",
    "line_repeats",
    "log_line_length",
    "capital_words",
    "capital_runs",
    "not_ascii",
    "log_longest_word",
)


def _classes() -> bytes:
    """Each byte as one of: lower letter, capital, digit, other ASCII, white space, beyond ASCII."""
    out = bytearray(b"." * 128 + b"z" * 128)
    for b in range(128):
        c = chr(b)
        out[b] = ord("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c in " \t\n\v\f\r" else ".")
    return bytes(out)


CLASSES = _classes()


def features(text: str | None) -> list[float]:
    """Features of a whole text, all 0 for null and empty ones."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = data.translate(CLASSES)
    n, size = len(words), len(data)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = kinds.count(b"a") + kinds.count(b"A")
    framed = b" " + kinds + b" "
    return [
        np.log1p(n),
        sum(map(len, words)) / n,
        len(counts) / n,
        kinds.count(b"A") / max(1, letters),
        kinds.count(b".") / size,
        kinds.count(b"0") / size,
        kinds.count(b"..") / n,
        framed.count(b" . ") / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(size / len(lines)),
        framed.count(b" A") / n,
        kinds.count(b"AA") / max(1, letters),
        kinds.count(b"z") / size,
        np.log1p(max(map(len, words))),
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def _leaf(g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    return g / (h + smooth)


def _gain(g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    return g * g / (h + smooth)


def line_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Step function over the bins of one feature from summed gradients and weights."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth and len(g) > 1:
        left_g, left_h = g.cumsum()[:-1], h.cumsum()[:-1]
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum()) + 1e-12:
            out[:cut], out[cut:] = line_tree(g[:cut], h[:cut], depth - 1), line_tree(g[cut:], h[cut:], depth - 1)
    return out


def grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best tree with one cut on each of two features, as a table, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, rows, columns = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return [a, rows - a, columns - a, c[-1, -1] - rows - columns + a]

    qg, qh = quarters(cg), quarters(ch)
    gain = sum(_gain(a, b) for a, b in zip(qg, qh))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    leaves = [float(_leaf(a[i, j], b[i, j])) for a, b in zip(qg, qh)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaves
    return out, float(gain[i, j])


class AdditiveModel:
    """Intercept, one table per feature, one table per chosen pair."""

    def __init__(self, width: int):
        self.edges: list[np.ndarray] = [np.zeros(0)] * width
        self.coarse: list[np.ndarray] = [np.zeros(0)] * width
        self.tables = [np.zeros(1)] * width
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.intercept = 0.0

    @staticmethod
    def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(values, np.arange(1, bins) / bins))

    def bins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        place = lambda cuts: [np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)]
        return place(self.edges), place(self.coarse)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2) -> AdditiveModel:
        """Cyclic boosting of the features, then of the pairs with the largest gain."""
        if not len(x):
            return self
        width = x.shape[1]
        self.edges = [self._cuts(x[:, k], BINS) for k in range(width)]
        self.coarse = [self._cuts(x[:, k], PAIR_BINS) for k in range(width)]
        fine, rough = self.bins(x)
        base = (y.sum() + 0.5) / (len(y) + 1)
        self.intercept = float(np.log(base / (1 - base)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        z = np.full(len(y), self.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for k, b in enumerate(fine):
                g, h = slopes()
                n = len(self.tables[k])
                step = rate * line_tree(np.bincount(b, g, n), np.bincount(b, h, n))
                self.tables[k] += step
                z += step[b]
        shape = [len(c) + 1 for c in self.coarse]
        usable = [k for k in range(width) if shape[k] > 1]

        def grid(pair: tuple[int, int]) -> tuple[np.ndarray, float, np.ndarray]:
            i, j = pair
            cell, n = rough[i] * shape[j] + rough[j], shape[i] * shape[j]
            g, h = slopes()
            table, gain = grid_tree(np.bincount(cell, g, n).reshape(shape[i], shape[j]), np.bincount(cell, h, n).reshape(shape[i], shape[j]))
            return table, gain, cell

        ranked = sorted(combinations(usable, 2), key=lambda p: (-grid(p)[1], p))[:PAIRS]
        self.pairs = {p: np.zeros((shape[p[0]], shape[p[1]])) for p in ranked}
        for _ in range(rounds // 2):
            for p in ranked:
                table, _, cell = grid(p)
                self.pairs[p] += rate * table
                z += rate * table.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self.bins(x)
        z = np.full(len(x), self.intercept)
        for table, b in zip(self.tables, fine):
            z += table[b]
        for (i, j), table in self.pairs.items():
            z += table[rough[i], rough[j]]
        return 1 / (1 + np.exp(-z))


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> AdditiveModel:
    """Fit on at most ``sample`` labelled documents, the first by a hash of the id.

    Null labels, ids and labels without a document teach nothing; without any
    the model answers 0.5. The chosen labels are at most ``sample`` rows, which
    bounds what is broadcast; their features are all that reaches the driver.
    """
    own = labels.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).filter("id is not null and label is not null")
    chosen = own.withColumn("draw", F.xxhash64(F.col("id").cast("string"))).orderBy("draw", "id", "label").limit(sample)
    rows = docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"label": batch.column(1), "draw": batch.column(2), "x": pa.array(list(x), pa.list_(pa.float64()))})

    measured = rows.select("text", "label", "draw").mapInArrow(measure, "label int, draw bigint, x array<double>")
    found = measured.orderBy("draw", "label", "x").limit(sample).collect()
    x = np.array([r["x"] for r in found], np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel(len(FEATURES)).fit(x, np.array([r["label"] for r in found], np.float64))


def scored(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """The rows, whole in ``row``, with their score (0 to 1, higher is better).

    Null and empty texts have features of 0 and are scored like others. Rows are
    judged one by one; the input's columns stay inside ``row``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(feature_matrix(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "score": pa.array(s, pa.float64())})

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", F.col(f"row.`{text}`").cast("string").alias("text")).mapInArrow(run, f"row {kind}, score double")


def accepted(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that score at least the threshold, with their own columns."""
    return scored(docs, model, text).filter(F.col("score") >= threshold).select("row.*")
