"""Language identification, quality, context-tree scores and packing against brute force."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitelens.llm import ctw, langid, packing, quality
from sitelens.llm.text import bucket
from tests.llm.conftest import close, crc

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_windows_cover_every_byte_once():
    data = bytes(range(97, 123)) * 20
    x, new = langid.windows(data, 64)
    assert x.shape == (9, 64) and new.sum() == len(data)
    assert b"".join(w[-n:].tobytes() for w, n in zip(x, new)) == data
    short, n = langid.windows(b"AB", 5)
    assert short.tolist() == [[97, 98, 0, 0, 0]] and n.tolist() == [2]


def test_network_gradient_lowers_loss():
    r = np.random.default_rng(0)
    y = np.arange(80) % 2
    x = np.where(y[:, None] == 1, r.integers(97, 105, (80, 32)), r.integers(103, 112, (80, 32))).astype(np.uint8)
    net = langid.Network(2)
    before = -np.log(net.probabilities(x, net.tables())[np.arange(80), y]).mean()
    net.fit(x, y, epochs=5)
    after = -np.log(net.probabilities(x, net.tables())[np.arange(80), y]).mean()
    assert after < before / 2


def plain_probabilities(weights, window):
    """The network, one number at a time."""
    embed, *kernels, dense, bias = weights
    pooled = []
    for kernel in kernels:
        width, size, filters = kernel.shape
        for f in range(filters):
            pooled.append(max(sum(float(embed[window[p + j], e]) * float(kernel[j, e, f]) for j in range(width) for e in range(size)) for p in range(len(window) - width + 1)))
    z = [float(bias[c]) + sum(h * float(dense[i, c]) for i, h in enumerate(pooled)) for c in range(len(bias))]
    top = max(z)
    total = sum(math.exp(v - top) for v in z)
    return [math.exp(v - top) / total for v in z]


def test_network_forward_and_gradient_against_plain_sums():
    r = np.random.default_rng(1)
    x, y = r.integers(97, 110, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net = langid.Network(3)
    before = [w.astype(float) for w in (net.embed, *net.filters, net.dense, net.bias)]
    want = np.array([plain_probabilities(before, row) for row in x])
    assert np.abs(net.probabilities(x, net.tables()) - want).max() < 1e-5

    def loss(weights):
        return -np.mean([math.log(plain_probabilities(weights, row)[k]) for row, k in zip(x, y)])

    net.fit(x, y, epochs=1, batch=5)  # Adam's first step is the rate against the sign of each derivative
    after = [net.embed, *net.filters, net.dense, net.bias]
    checked = 0
    for i, w in enumerate(before):
        for at in r.permutation(w.size)[:12].tolist() + ([100 * 8 + 3] if i == 0 else []):
            place = np.unravel_index(at, w.shape)
            sides = []
            for step in (1e-4, -1e-4):
                moved = [v.copy() for v in before]
                moved[i][place] += step
                sides.append(loss(moved))
            slope = (sides[0] - sides[1]) / 2e-4
            change = float(after[i][place]) - float(w[place])
            if abs(slope) > 1e-3:
                assert change * slope < 0 and abs(abs(change) - 0.01) < 1e-3
                checked += 1
            elif slope == 0:
                assert abs(change) < 1e-7
    assert checked > 20


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.filter(bucket("doc_id", 4) != 2))
    found = langid.predict(docs, model).filter(bucket("row.doc_id", 4) == 2).select("row.lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98


def test_language_edges(odd, none):
    model = langid.train(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = r["row"]["text"] is not None and langid.LETTER.search(r["row"]["text"])
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        if r["row"]["doc_id"] is not None and r["row"]["doc_id"] < 60:
            assert r["lang_pred"] == r["row"]["lang"]
    untaught = langid.train(none)
    assert {r["lang_pred"] for r in langid.predict(odd, untaught).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0
    assert langid.accepted(odd, model).columns == odd.columns


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.filter(bucket("doc_id", 4) != 2))
    held = quality.scored(docs, model).select("row.doc_id", "score").join(labels, "doc_id").filter(bucket("doc_id", 4) == 2).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in held]) > 0.95


def plain_features(text):
    """The sixteen features by loops over bytes and words."""
    data = (text or "").encode()
    words, word = [], b""
    for b in data + b" ":
        if b in b" \t\n\v\f\r":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    if not words:
        return [0.0] * 16
    lower = sum(97 <= b <= 122 for b in data)
    upper = [65 <= b <= 90 for b in data]
    white = [b in b" \t\n\v\f\r" for b in data]
    digit = [48 <= b <= 57 for b in data]
    mark = [b < 128 and not (97 <= b <= 122 or u or w or d) for b, u, w, d in zip(data, upper, white, digit)]

    def runs(flags):  # pairs that do not overlap, from the left
        n = i = 0
        while i + 1 < len(flags):
            if flags[i] and flags[i + 1]:
                n, i = n + 1, i + 2
            else:
                i += 1
        return n

    edge = [True, *white, True]
    lone, i = 0, 0
    while i + 2 < len(edge):
        if edge[i] and mark[i] and edge[i + 2]:
            lone, i = lone + 1, i + 3
        else:
            i += 1
    lines = []
    for line in data.split(b"\n"):
        if any(b not in b" \t\n\v\f\r" for b in line):
            lines.append(line)
    n, letters = len(words), max(1, lower + sum(upper))
    return [
        math.log(1 + n), sum(len(w) for w in words) / n, len(set(words)) / n, sum(upper) / letters, sum(mark) / len(data), sum(digit) / len(data),
        runs(mark) / n, lone / n, max(words.count(w) for w in set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), math.log(1 + len(data) / len(lines)), sum(u and edge[i] for i, u in enumerate(upper)) / n,
        runs(upper) / letters, sum(b >= 128 for b in data) / len(data), math.log(1 + max(len(w) for w in words)),
    ]


def test_quality_features_against_plain_loops(spark, odd_rows):
    texts = [r[1] for r in odd_rows if r[1] is None or len(r[1]) < 5000]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if len(r["text"] or "") < 5000]
    texts += ["A - B -- C\x0b\x1c. .. ... \u00e9\u00c9 1a2", "-", " . . ", "AAA AAAA", "a\na\n \nb"]
    assert np.allclose(quality.feature_matrix(texts), [plain_features(t) for t in texts], atol=1e-12)


def test_very_long_texts_are_scored_whole(spark):
    """Several MB: the last part decides as much as the first."""
    long = "abc abd " * 200_000 + "xyz xzy " * 500_000
    df = spark.createDataFrame([(1, long, "x"), (2, "abc abd " * 30, "a"), (3, "xyz xzy " * 30, "x")], "doc_id long, text string, lang string")
    net = langid.train(df.filter("doc_id > 1"))
    found = {r["row"]["doc_id"]: r for r in langid.predict(df, net).collect()}
    assert found[1]["lang_pred"] == "x" and abs(found[1]["score"] - 5 / 7) < 0.1
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert 0 <= quality.scored(df, quality.train(df, labels)).filter("row.doc_id = 1").first()["score"] <= 1


def test_additive_model_needs_its_pairs():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel(3).fit(x, y)
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x) > 0.5) == y) > 0.95
    z = model.intercept + sum(t[b] for t, b in zip(model.tables, model.bins(x)[0]))
    z = z + sum(t[model.bins(x)[1][i], model.bins(x)[1][j]] for (i, j), t in model.pairs.items())
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-z)))


def test_quality_edges(odd, none, labelled):
    model = quality.train(odd, labelled)
    rows = quality.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.scored(odd, quality.train(none, labelled)).collect()} == {0.5}
    assert quality.scored(none, model).count() == 0
    assert quality.accepted(odd, model).columns == odd.columns


class Trees:
    """Context-tree weighting by walking one bit at a time."""

    def __init__(self, streams, depth):
        self.depth, self.counts, self.kids = depth, collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
        for s in streams:
            q = b"\n" * depth + s
            for j in range(depth, len(q)):
                for prefix, bit in self.bits(q[j]):
                    for d in range(depth + 1):
                        key = (q[j - d : j], prefix)
                        self.counts[key][bit] += 1
                        if d < depth:
                            self.kids[key].add((q[j - d - 1 : j], prefix))
        self.memo = {}

    @staticmethod
    def bits(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weigh(self, key):
        """(ln P_w, weight of the node's own estimate)."""
        if key not in self.memo:
            e = self.kt(*self.counts[key])
            if len(key[0]) == self.depth:
                self.memo[key] = (e, 1.0)
            else:
                c = sum(self.weigh(k)[0] for k in self.kids[key])
                top = max(e, c)
                self.memo[key] = (top + math.log((math.exp(e - top) + math.exp(c - top)) / 2), 1 / (1 + math.exp(min(700, c - e))))
        return self.memo[key]

    def score(self, s):
        total, q = 0.0, b"\n" * self.depth + s
        for j in range(self.depth, len(q)):
            for prefix, bit in self.bits(q[j]):
                p, rest = 0.0, 1.0
                for d in range(self.depth + 1):
                    key = (q[j - d : j], prefix)
                    if key not in self.counts:
                        p, rest = p + rest / 2, 0.0
                        break
                    a, b = self.counts[key]
                    one, own = (b + 0.5) / (a + b + 1), self.weigh(key)[1]
                    p, rest = p + rest * own * (one if bit else 1 - one), rest * (1 - own)
                total += math.log10(p)
        return total


def test_context_tree_scores(odd, odd_rows):
    found = ctw.scored(odd, bucket("doc_id", 10) != 0).collect()
    streams = [(r[0], ctw.stream(r[1])) for r in odd_rows if r[0] != 67]
    long = [(r[0], ctw.stream(r[1])) for r in odd_rows if r[0] == 67]
    teaches = lambda i: i is not None and crc(i, 10) != 0
    taught = [s for i, s in streams + long if teaches(i)]
    trees = Trees(taught, ctw.DEPTH)
    words = collections.Counter(w for s in taught for w in [*s.split(), b"\n"])
    n, v = sum(words.values()), len(words)
    assert len(found) == len(odd_rows)
    for key in {i for i, _ in streams}:
        got = sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["train_tokens"]) for r in found if r["doc_id"] == key)
        want = []
        for i, s in streams:
            if i == key:
                tokens = [*s.split(), b"\n"]
                base = sum(math.log10((words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
                want.append((len(tokens), sum(words[t] > 0 for t in tokens), base, trees.score(s), n))
        for g, w in zip(got, sorted(want), strict=True):
            assert g[:2] == w[:2] and close(g[2], w[2]) and close(g[3], w[3], 1e-8) and g[4] == w[4]
    own = next(r for r in found if r["doc_id"] == 67)
    assert close(own["score"], trees.score(long[0][1]), 1e-8) and own["n_tokens"] == len(long[0][1].split()) + 1


def test_context_tree_is_cut_anywhere(odd, monkeypatch):
    whole = sorted((str(r["doc_id"]), r["score"]) for r in ctw.scored(odd, bucket("doc_id", 10) != 0).collect())
    monkeypatch.setattr(ctw, "WIDE_BYTES", 0)  # contexts of three bytes at the cut
    monkeypatch.setattr(ctw, "TREE_CHUNK", 50)
    again = sorted((str(r["doc_id"]), r["score"]) for r in ctw.scored(odd, bucket("doc_id", 10) != 0).collect())
    assert all(a[0] == b[0] and close(a[1], b[1], 1e-10) for a, b in zip(whole, again, strict=True))


def test_context_tree_without_training(odd, none):
    for r in ctw.scored(odd.limit(5), F.lit(False)).collect():
        assert r["base_score"] == 0 and close(r["bits_per_byte"], 8) and r["train_tokens"] == 0
    assert ctw.scored(none, F.lit(True)).count() == 0


def test_codes_hold_context_and_byte():
    assert ctw.codes([b"ab", b"c"], 2).tolist() == [0x0A0A61, 0x0A6162, 0x0A0A63]


def test_packing_is_a_round_trip(odd, odd_rows, none):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(odd, TOKENIZER, ids=True).collect()
    whole = collections.Counter()
    for r in odd_rows:
        coded = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        whole[(r[0], len(coded))] += 1
    tokens = collections.Counter()
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        tokens[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert tokens == collections.Counter({k: k[1] * n for k, n in whole.items()})
    for key in [66, 67, 68, 3]:
        own = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == key)
        text = next(r[1] for r in odd_rows if r[0] == key)
        assert [x for _, p in own for x in p] == tokenizer.encode(text, add_special_tokens=False).ids + [0]
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0
    assert packing.pack(none, TOKENIZER).count() == 0


def test_rank_ids_are_the_tokenizers_ids():
    tokenizer, ids = Tokenizer.from_file(TOKENIZER), packing.TextIds(TOKENIZER)
    assert ids.ranks is not None
    r = np.random.default_rng(6)
    letters = [*"abcXYZ019 .,!?'-_/\n\n   \t\r\x0b\x0c\x1c\x85\xa0\u2003\u200b\u180e\u2028éßß中١½ǅɐ\U0001f600", "<|endoftext|>", "'s", "'ll", " the ", " and\n", "\n\n"]
    texts = ["".join(r.choice(letters, r.integers(0, 60))) for _ in range(4000)]
    texts += [" " * 200_000 + "x", "\n" * 1001, "y" * 100_000, "ab " * 50_000, ""]
    for text, got in zip(texts, ids(texts), strict=True):
        assert got == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.rank_encoder(public_tokenizers.path("word_bpe_49k.json")) is None


def test_dealing_balances_cost():
    lengths = [500] * 40 + [200] * 60 + [30] * 100
    pieces = packing.deal(lengths, 1024, 1.0, 1 / 2048)
    cost, fill = collections.Counter(), collections.Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 2048
        fill[s] += n
    full = [cost[s] for s in fill if fill[s] == 1024]
    assert len(full) == sum(lengths) // 1024 and max(full) < 1.12 * min(full)
