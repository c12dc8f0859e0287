"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter's maximum over the window is kept and a softmax layer decides. The
network is trained in numpy on windows of labelled texts. For prediction a text
is cut into windows that cover all its bytes, and the windows' probabilities are
averaged by the bytes they add.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.store import settle

UNKNOWN = "und"
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: Bounds of the training sample: documents per language, windows per document.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 600, 4
LETTER = regex.compile(r"\p{L}")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def windows(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows over all bytes, and how many bytes each adds to those before it.

    The last window of a long text ends with it; a short text is filled up with 0.
    """
    a = LOWER[np.frombuffer(data, np.uint8)]
    n = len(a)
    if n <= length:
        return np.pad(a, (0, length - n))[None], np.array([n])
    whole = n // length
    out, new = a[: whole * length].reshape(whole, length), np.full(whole, length)
    if n % length:
        out, new = np.vstack([out, a[None, n - length :]]), np.append(new, n % length)
    return out, new


class Network:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        f32 = np.float32
        self.embed = r.normal(0, 0.5, (256, EMBEDDING)).astype(f32)
        self.filters = [r.normal(0, 0.35, (w, EMBEDDING, FILTERS)).astype(f32) for w in WIDTHS]
        self.dense = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(f32)
        self.bias = np.zeros(classes, f32)

    def tables(self) -> list[list[np.ndarray]]:
        """What each byte adds to each filter, by width and place in the filter."""
        return [[self.embed @ k for k in kernel] for kernel in self.filters]

    @staticmethod
    def pooled(x: np.ndarray, tables: list[list[np.ndarray]], where: bool = False):
        """Largest filter values of each window (and their positions)."""
        best, places = [], []
        for own in tables:
            span = x.shape[1] - len(own) + 1
            total = own[0][x[:, :span]]
            for j, table in enumerate(own[1:], 1):
                total += table[x[:, j : j + span]]
            best.append(total.max(1))
            if where:
                places.append(total.argmax(1))
        return np.concatenate(best, 1), places

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        z = self.pooled(x, tables)[0] @ self.dense + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 3):
        """Adam on the mean log loss; gradients reach the filters only where a maximum was taken."""
        weights = [self.embed, *self.filters, self.dense, self.bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        r, step = np.random.default_rng(seed), 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                xb, rows = x[pick], np.arange(len(pick))
                h, places = self.pooled(xb, self.tables(), where=True)
                z = h @ self.dense + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[rows, y[pick]] -= 1
                p /= len(pick)
                back = p @ self.dense.T
                d_embed, d_filters = np.zeros_like(self.embed), []
                for k, (kernel, place) in enumerate(zip(self.filters, places)):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    d_kernel = np.zeros_like(kernel)
                    for j in range(len(kernel)):
                        met = np.zeros((256, FILTERS), np.float32)
                        np.add.at(met, (xb[rows[:, None], place + j], np.arange(FILTERS)[None]), g)
                        d_embed += met @ kernel[j].T
                        d_kernel[j] = self.embed.T @ met
                    d_filters.append(d_kernel)
                step += 1
                for w, d, m, v in zip(weights, [d_embed, *d_filters, h.T @ p, p.sum(0)], first, second):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def training_windows(docs: DataFrame, text: str, lang: str, doc: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels from at most ``DOCS_PER_LANGUAGE`` documents a language, chosen by hash.

    The count of a language gives the share of hash values that holds about twice
    that many, so few texts are moved, however many there are; the counts are written
    first, for Spark to know that they are small. Positions of the windows are drawn over the whole text, by a seed from the text.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{doc}`"), F.col(f"`{text}`")).alias("draw"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    reach = 2.0 * DOCS_PER_LANGUAGE / F.col("of") * 2.0**63
    counts = settle(rows.groupBy("lang").agg(F.count("*").alias("of")), "language-counts", thin=True)
    likely = rows.join(counts, "lang")
    likely = likely.filter(F.abs(F.col("draw").cast("double")) <= reach)
    own = Window.partitionBy("lang").orderBy("draw", "text")
    chosen = likely.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= DOCS_PER_LANGUAGE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for text, lang, draw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                data = text.encode()
                r = np.random.default_rng(draw & (2**63 - 1))
                for _ in range(WINDOWS_PER_DOC):
                    start = int(r.integers(0, max(1, len(data) - WINDOW + 1)))
                    out.append(windows(data[start : start + WINDOW], WINDOW)[0][0].tobytes())
                    langs.append(lang)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "window": pa.array(out, pa.binary())})

    found = chosen.select("text", "lang", "draw").mapInArrow(cut, "lang string, window binary").orderBy("lang", "window").collect()
    names = sorted({r["lang"] for r in found})
    x = np.array([np.frombuffer(r["window"], np.uint8) for r in found]).reshape(-1, WINDOW)
    return x, np.array([names.index(r["lang"]) for r in found], np.int64), names


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id") -> tuple[Network, list[str]]:
    """A network and its languages from labelled rows; null labels and texts without a letter teach nothing."""
    x, y, names = training_windows(docs, text, lang, doc)
    net = Network(len(names))
    return (net.fit(x, y) if len(names) > 1 else net), names


def predict(docs: DataFrame, model: tuple[Network, list[str]], text: str = "text") -> DataFrame:
    """The rows, whole in ``row``, with lang_pred and score (mean probability of the answer).

    Null texts and texts without a letter, and all texts if no language was
    learned, get ``und`` and 0. Each row is judged on its own, so ties, repeats
    and empty tables need no rule; the input's columns stay inside ``row``.
    """
    net, names = model
    tables = net.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            answers, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, t in enumerate(texts if names else []):
                if not t or not LETTER.search(t):
                    continue
                data, total = t.encode(), np.zeros(len(names))
                for start in range(0, len(data), WINDOW * 64):
                    x, new = windows(data[start : start + WINDOW * 64], WINDOW)
                    total += new @ net.probabilities(x, tables)
                best = int(total.argmax())
                answers[i], scores[i] = names[best], float(min(1.0, total[best] / len(data)))
            yield pa.RecordBatch.from_pydict(
                {"row": batch.column("row"), "lang_pred": pa.array(answers, pa.string()), "score": pa.array(scores, pa.float64())}
            )

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", F.col(f"row.`{text}`").cast("string").alias("text")).mapInArrow(run, f"row {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: tuple[Network, list[str]], least: float = 0.3, text: str = "text") -> DataFrame:
    """The documents whose language is known with at least this score, with their own columns."""
    return predict(docs, model, text).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
