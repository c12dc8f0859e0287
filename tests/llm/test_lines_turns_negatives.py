"""Line dedup, conversation repair and hard negatives against brute force."""

import functools
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import hardneg, linededup, repair

LINE = "A line of text that is long enough to be counted, number %d."


def brute_lines(rows, least=40, docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, lines in split:
        for line in lines:
            if i is not None and len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, lines in split:
        keep = [x for x in lines if i is None or len(holders.get(key(x), ())) < docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def cleaned(df):
    return sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in linededup.without_repeated_lines(df).collect()), key=str)


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(linededup, "CHUNK", 16)
    monkeypatch.setattr(linededup, "SEGMENT_LINES", 8)


def test_repeated_lines_edges(spark, odd, odd_rows, none, small_chunks):
    r = random.Random(5)
    rows = [list(x) for x in odd_rows]
    for x in rows:
        if x[1] and x[0] is not None:
            extra = [LINE % r.randrange(12) for _ in range(4)]
            x[1] = "\n".join([x[1], " \t" + extra[0].upper() + "\r", extra[1], "", "short", *extra[2:]])
    rows += [[100 + i, "é" * 39 + "\n" + "É" * 40 + "\n\n", None, None, 1, "", 1, "", ""] for i in range(6)]
    rows += [[110 + i, ("x" * 45 + "\n") * 5000, None, None, 1, "", 1, "", ""] for i in range(4)]  # four documents only
    rows.append([110, ("x" * 45 + "\n") * 3, None, None, 1, "", 1, "", ""])  # the same document again
    df = spark.createDataFrame([tuple(x) for x in rows], odd.schema).repartition(4)
    assert cleaned(df) == brute_lines([(x[0], x[1]) for x in rows])
    assert cleaned(none) == []
    kept = linededup.without_repeated_lines(df)
    assert kept.select("row.*").columns == odd.columns


def test_a_line_of_very_many_documents(spark, small_chunks):
    rows = [(i, "\n".join([LINE % -1, LINE % i, LINE % (i // 7)])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert cleaned(df) == brute_lines(rows)


def test_filters_never_miss_and_seldom_suspect():
    r = np.random.default_rng(3)
    hashes = r.integers(-(2**63), 2**63, 40_000)
    f = linededup.Filters(20)
    for i in range(0, len(hashes), 1000):
        f.add(hashes[i : i + 1000])
    assert f.suspects(hashes).mean() < 0.03
    f.add(hashes[:500])
    f.mark(hashes[600:700])
    assert f.suspects(hashes[:500]).all() and f.suspects(hashes[600:700]).all()


# conversations


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def brute_repair(rows):
    """rows: (turn, role, text) in order. Tries all edits, two inserts in a row at most, comparing whole audits."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}

    @functools.cache
    def best(i, state, inserted):
        options = []
        if i == len(rows):
            if state in ("", "ua"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, edits, done = best(i + 1, state, 0)
            options.append((cost + 4, "D" + edits, done))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                for now, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if now[:1] in step[state]:
                        cost, edits, done = best(i + 1, step[state][now[:1]], 0)
                        options.append((cost + price + extra, letter + edits, ((now, text), *done)))
        if inserted < 2:
            for now in ("user", "assistant"):
                if now[0] in step[state]:
                    cost, edits, done = best(i, step[state][now[0]], inserted + 1)
                    options.append((cost + 3, "I" + edits, ((now, ""), *done)))
        return min(options, key=lambda x: x[:2]) if options else (math.inf, "", ())

    cost, audit, done = best(0, "", 0)
    turns = sorted({t for t, _, _ in rows if t is not None})
    initials = [role[:1] for _, role, _ in rows]
    return (
        turns[-1] - turns[0] + 1 - len(turns) if turns else 0,
        *[faults.count(x) for x in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{a}:{b}" for a, b in done).encode()).hexdigest(),
    )


def brute_conversations(rows):
    ready, found = brute_damage(rows), {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in ready if r[0] == conv]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        found[conv] = brute_repair(own)
    return found


def repaired(df):
    return {r["conv"]: tuple(r)[1:] for r in repair.repair(repair.damaged(df)).collect()}


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, 9)):
            role = r.choices(["user", "assistant", "system", "tool", "", None, "User"], [9, 9, 3, 1, 1, 1, 1])[0]
            if r.random() < 0.6:
                role = "user" if turn % 2 == 0 else "assistant"
            text = r.choice(["Yes.", "No", "Why?", " \n", "", None, "Go on! \t", f"Number {turn}.", "x" * 50 + "…", "ß. "])
            rows.append((conv, turn * r.choice([1, 1, 1, 2]), role, text))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_repair_of_random_conversations(spark):
    rows = conversations(1, 400)
    assert repaired(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute_conversations(rows)


def test_repair_edges(spark):
    dropped = next(i for i in range(10_000, 20_000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 == 0 for t in (0,)))
    rows = [
        (dropped, 0, "user", "All rows of this one go."),
        (None, 3, "user", "No id."),
        (None, None, None, None),
        (1, None, "assistant", "No turn."),
        (1, None, "user", "No turn either."),
        (1, 5, "user", "Same turn."),
        (1, 5, "assistant", "Same turn!"),
        (1, 5, "assistant", "Same turn!"),
        (2, 7, "user", "Long. " * 300_000),
        (2, 9, "assistant", "y" * 100_000),
        *[(3, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)],
        (4, -2, "system", "Only this."),
    ]
    clash = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA + ", audit string, stage int").repartition(3)
    got = repaired(clash)
    want = {c: v for c, v in brute_conversations([r for r in rows if r[0] != 3]).items()}
    assert {c: v for c, v in got.items() if c != 3} == want
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[3][1] == sum(zlib.crc32(f"3:{t}".encode()) % 20 == 1 for t in range(3000))
    assert repair.repair(repair.damaged(clash.limit(0))).count() == 0


def test_every_short_signature_is_cheapest():
    letters = "uasxUAX-"
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    signatures = sorted(("".join(x) for n in range(5) for x in itertools.product(letters, repeat=n)), key=lambda s: s[::-1])
    walk = repair.SuffixWalk()
    for s in signatures:
        rows = [(i, names.get(c.lower(), "user"), "" if c == "-" else f"{i}" if c.isupper() else f"{i}.") for i, c in enumerate(s)]
        want = brute_repair(rows)
        assert walk(s) == (want[5], want[6]), s
    assert walk.made == len(signatures) - 1  # a node a distinct suffix, none twice


def test_the_repaired_rows_follow_the_audit(spark):
    rows = conversations(2, 60)
    ready = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    plans = repair.audits(repair.signatures(ready))
    texts = {}
    for r in sorted(repair.repaired_rows(ready, plans).collect(), key=lambda r: (r["conv"], r["place"])):
        texts.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    for conv, want in brute_conversations(rows).items():
        assert hashlib.sha256("\n".join(texts.get(conv, [])).encode()).hexdigest() == want[-1]


# hard negatives


def brute_negatives(rows, k=5):
    good = []
    for i, e, label in rows:
        if i is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        good.append((i, [math.floor(256 * x) for x in e], label))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a, v, label in good:
        if a % 10:
            continue
        met = [(score(v, w), i, other == label) for i, w, other in good if i != a and len(w) == len(v)]
        same = sorted((-s, i) for s, i, t in met if t)[:k]
        for p, i in same:
            fit = sorted((-s, j) for s, j, t in met if not t and 80 * -p <= 100 * s <= 100 * -p)[:k]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int, id string, v int, extra int"


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "STRIPE", (64, 64))
    monkeypatch.setattr(hardneg, "TILE", 7)
    monkeypatch.setattr(hardneg, "SLICE", 23)
    r = np.random.default_rng(2)
    centres = r.normal(size=(5, 70))
    rows = [(i, (centres[i % 5] * 0.3 + r.normal(size=70) * 0.2).astype("float32").tolist(), int(i * i % 3)) for i in range(300)]
    rows += [(300 + i, rows[i // 8][1], 1 + i % 2) for i in range(60)]  # ties
    rows += [
        (400, None, 1),
        (410, [], 1),
        (420, [0.5] * 69 + [float("nan")], 1),
        (430, [0.5] * 69 + [None], 1),
        (440, [0.0] * 70, 2),
        (441, [0.0] * 70, 2),
        (450, rows[0][1], None),
        (None, rows[0][1], 1),
        (460, [1.0, 2.0, -1.0], 1),
        (461, [1.0, 2.0, -0.9], 2),
        (462, [1.0, 2.0, -1.0], 1),
        (470, [-1.0], 0),
        (471, [1.0], 0),
        (472, [1.0], 1),
        (480, [3.0e4, 1.0], 5),
        (481, [2.9e4, 1.0], 5),
        (482, [2.8e4, 1.0], 6),
    ]
    want = brute_negatives(rows)
    assert mined(spark, rows) == want and len(want) > 100
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_intervals_hold_and_filter():
    r = np.random.default_rng(4)
    for width in (3, 64, 100):
        x, q = np.floor(r.normal(size=(500, width)) * 200), np.floor(r.normal(size=(40, width)) * 200)
        x[::50] = q[7] + np.floor(r.normal(size=(10, width)) * 3)
        x[1], q[1] = 0, 0
        low, high = hardneg.intervals(q, *hardneg.coded(x))
        true = q @ x.T
        assert (low <= true).all() and (true <= high).all()
        assert np.allclose((hardneg.rotated(x) ** 2).sum(1), (x**2).sum(1))
    able = np.ones(low.shape, bool)
    hardneg._tighten(low, high, able, q, x, 10)
    assert (low <= true).all() and (true <= high).all()
    floor = hardneg._floor(low, able, 5)
    assert (floor <= -np.sort(-true, axis=1)[:, 4]).all()
    assert (high[7] >= floor[7]).mean() < 0.05  # ten near copies stand out
