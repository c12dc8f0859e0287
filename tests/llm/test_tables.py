"""Near-duplicates, components, mixing, sharding, vectors, search and archives against brute force."""

import base64
import collections
import gzip
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import flatgraph, mixing, neardup, sharding, vafile, warc
from sitelens.llm.components import components
from sitelens.llm.store import settle, shared_folder


def brute_components(ids, edges):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(1000, 2000 + i) for i in range(50)]
    df = spark.createDataFrame(edges + [(7, 7), (None, 3)], "a bigint, b bigint")
    got = {x["id"]: x["component_id"] for x in components(df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    want = brute_components({i for e in real for i in e}, real)
    assert got == want
    assert components(df.limit(0)).count() == 0


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def brute_classes(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    edges = [
        (a, b)
        for (a, x), (b, y) in itertools.combinations(sets, 2)
        if x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    return brute_components({i for i, _ in sets}, edges)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_edges(odd, odd_rows, none, width):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = neardup.classes(odd, width=width).collect()
    want = brute_classes(rows, width)
    assert len(got) == len(rows)
    sizes = collections.Counter((i, len(shingles(t, width))) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.classes(none, width=width).count() == 0
    kept = neardup.deduplicated(odd, width=width)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Copies at every distance round the threshold, with all ways of comparing in use."""
    monkeypatch.setattr(neardup, "LARGE", 8)
    r = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(3):
        base = [r.choice(words) for _ in range(60)]
        for _ in range(70):
            text = base[:]
            for _ in range(r.randrange(0, 9)):
                text[r.randrange(60)] = r.choice(words)
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {x["doc_id"]: x["component_id"] for x in neardup.classes(df, width=2).collect()}
    assert got == brute_classes(rows, 2)


def test_posterior_limits():
    limits = neardup.least_matches(0.8)
    assert len(limits) == neardup.HASHES // neardup.BATCH and limits == sorted(limits)
    r = np.random.default_rng(0)
    for k, least in enumerate(limits):
        n = (k + 1) * neardup.BATCH
        t = r.beta(least, n - least + 2, 400_000)
        assert (t >= 0.8).mean() < 5e-5
        assert least < 0.8 * n


def test_unbounded_slices_join(odd_rows):
    powers = neardup.Powers()
    texts = [(r[1] or "").encode() for r in odd_rows]
    together = neardup.shingle_sets(texts, 3, powers)
    for t, s in zip(texts, together):
        alone = neardup.shingle_sets([t], 3, powers)[0]
        assert (alone == s).all() and len(s) == len(shingles(t.decode(), 3))


def test_mixing(odd, odd_rows, none):
    rows = mixing.mixed(odd).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert len(rows) == len(odd_rows)
    size = collections.Counter()
    for r in odd_rows:
        size[r[3]] += len((r[1] or "").encode().split())
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, rest, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: 2.0 * size[s] for s in over})
        rest -= sum(2 * size[s] for s in over)
        free -= over
    for r in rows:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= min(2, int(rate) + (rate > int(rate)))
    again = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.mixed(odd.repartition(5)).select("row.doc_id", "row.text", "copies").collect()}
    assert all(again[(r["doc_id"], r["text"])] == r["copies"] for r in rows)
    out = mixing.emitted(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mixed(none).count() == 0


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def test_sharding(odd, odd_rows, none):
    got = sharding.shard(odd, 4).collect()
    assert len(got) == len(odd_rows)
    groups = collections.defaultdict(list)
    for r in odd_rows:
        groups[r[1]].append((r[0], len((r[1] or "").encode()) + 1))
    first = lambda t: min((-1 if i is None else i for i, _ in groups[t] if i is not None), default=-1)
    order = sorted(groups, key=lambda t: (first(t), hashlib.sha256(t.encode()).hexdigest() if t is not None else ""))
    want = brute_capacity([sum(s for _, s in groups[t]) for t in order], 4)
    load = collections.Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        assert 0 <= r["shard"] < 4
    assert max(load.values()) == want
    for k in load:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    by_id = {r["doc_id"]: r for r in got}
    assert len({by_id[i]["shard"] for i in (3, 64, 65)}) == 1
    assert by_id[0]["text_crc32"] == zlib.crc32(odd_rows[0][1].encode())
    assert sharding.shard(none, 4).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, copies int, id string, key string"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    rows = []
    for g in range(30):
        base = r.normal(size=16)
        for _ in range(r.integers(1, 14)):
            x = base + r.normal(size=16) * r.choice([0.02, 0.15, 0.3])
            rows.append((len(rows), [float(np.float32(v)) for v in x], int(g % 3)))
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], 99), (n + 2, None, 1), (n + 3, [0.0] * 16, 1), (n + 4, [float("nan")] + [1.0] * 15, 1)]
    rows += [(n + 5, [1.0, None] + [1.0] * 14, 1), (n + 6, rows[0][1], None), (None, rows[0][1], 0), (n + 7, [1.0, 2.0], 1), (n + 8, [1.0, 2.0], 1), (n + 9, [], 1)]
    rows += [(0, rows[0][1], rows[0][2]), (n + 10, [float("inf")] * 16, 1)]
    return spark.createDataFrame([(i, v, k, 1, "a", "b") for i, v, k in rows], VECTORS).repartition(4), rows


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_vector_links(vectors, monkeypatch):
    monkeypatch.setattr(flatgraph, "SHARD_ROWS", 60)
    monkeypatch.setattr(flatgraph, "PART_ROWS", 50)
    df, rows = vectors
    usable = {i: (np.array(v, float), k) for i, v, k in rows if i is not None and k is not None and good(v) and any(v)}
    edges = []
    for (a, (x, k)), (b, (y, m)) in itertools.combinations(usable.items(), 2):
        if k == m and len(x) == len(y) and x @ y >= 0.93 * np.sqrt((x @ x) * (y @ y)):
            edges.append((a, b))
    degree = collections.Counter(i for e in edges for i in e)
    root = brute_components(usable, edges)
    got = flatgraph.near_vectors(df).collect()
    assert len(got) == len(rows)
    assert sum(min(degree[r["vec_id"]], r["n_links"]) for r in got) >= 0.97 * sum(degree[r["vec_id"]] for r in got)
    for r in got:
        assert r["n_links"] <= degree[r["vec_id"]]
        if r["vec_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == root.get(r["vec_id"], r["vec_id"]) and r["kept"] == (r["component_id"] == r["vec_id"])
    assert flatgraph.near_vectors(df.limit(0)).count() == 0


def border_pairs(r, n, pairs, near=0):
    """Unit vectors of 8 components at random, the first with a partner at cosine 0.94 each, and a group of near copies."""
    x = r.normal(size=(n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = r.normal(size=(pairs, 8))
    off -= (off * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    group = x[-1] + 0.01 * r.normal(size=(near, 8))
    return np.vstack([x, 0.94 * x[:pairs] + np.sqrt(1 - 0.94**2) * off, group])


@pytest.mark.parametrize("near", [0, 120])
def test_links_at_borders_are_all_found(spark, monkeypatch, near):
    """Rare links, which the first audit nodes do not show, and links beside a group that has nearly all of them."""
    for name, value in {"SHARD_ROWS": 16, "FIT_ROWS": 512, "AUDIT_ROWS": 128 if near else 2}.items():
        monkeypatch.setattr(flatgraph, name, value)
    x = border_pairs(np.random.default_rng(11), 300, 150 if near else 40, near)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.93
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(i, v.tolist(), 1, 1, "a", "b") for i, v in enumerate(x)], VECTORS).repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in flatgraph.near_vectors(df).collect()}
    share = [got[i] / d for i, d in enumerate(hit.sum(1).tolist()) if d]
    assert all(s <= 1 for s in share) and np.mean(share) >= 0.97


@pytest.mark.parametrize("linked", [0, 40])
def test_too_few_linked_audit_nodes_compare_everything(spark, monkeypatch, linked):
    """The sample may hold none of the linked nodes, or too few of them to tell."""
    for name, value in {"SHARD_ROWS": 16, "FIT_ROWS": 256, "AUDIT_ROWS": 16}.items():
        monkeypatch.setattr(flatgraph, name, value)
    x = border_pairs(np.random.default_rng(5), 400, max(linked, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.93
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(i, v.tolist(), 1, 1, "a", "b") for i, v in enumerate(x)], VECTORS).repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in flatgraph.near_vectors(df).collect()}
    assert got == dict(enumerate(hit.sum(1).tolist()))


def test_links_found_from_one_end_count_for_both(spark):
    """y is in both shards, x only in its own: x finds y, y cannot find x."""
    angles = {1: (36, 3), 2: (48, 5), 3: (2, 1), 4: (88, 1)}
    rows = [("2:a", i, n, [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]) for i, (d, n) in angles.items()]
    nodes = spark.createDataFrame(rows, "key string, id bigint, copies bigint, v array<double>")
    found = flatgraph._searched(nodes, {2: np.eye(2)}, 0.97, 0.12, 24)
    assert {r["id"]: r["n"] for r in found.filter("n is not null").groupBy("id").agg(F.sum("n").alias("n")).collect()} == {1: 5, 2: 3}


def test_graph_reaches_every_node():
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(size=(1, 8)) + 0.01 * r.normal(size=(40, 8)) for _ in range(12)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, medoid = flatgraph.build_graph(x)
    seen, front = {medoid}, [medoid]
    while front:
        front = [int(b) for a in front for b in graph[a] if b >= 0 and b not in seen and not seen.add(int(b))]
    assert len(seen) == len(x)
    found = flatgraph.range_search(x, graph, medoid, x, 0.93, 24)
    assert len(found) >= 0.99 * (x @ x.T >= 0.93).sum() and (np.einsum("nd,nd->n", x[found[:, 0]], x[found[:, 1]]) >= 0.93).all()


def test_exact_search(vectors, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 40)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 7)
    df, rows = vectors
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, _ in rows if i is not None and good(v) and len(v) == 16]
    want = set()
    for q, x in {i: v for i, v in whole if i % 10 == 0 and i > 0}.items():
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q))[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)}
    got = vafile.top_k(df, (F.col("vec_id") % 10 == 0) & (F.col("vec_id") > 0), 5).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = vafile.top_k(df.filter("vec_id in (1, 2, 3)"), F.col("vec_id") == 1, 5).collect()
    assert len(few) == 2
    assert vafile.top_k(df.limit(0), F.col("vec_id") == 1).count() == 0


def test_search_meets_every_length(spark):
    """One longer vector takes nothing from the others, and each query meets its own length."""
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=3 if i < 20 else 5).tolist()) for i in range(30)] + [(30, r.normal(size=6).tolist())]
    df = spark.createDataFrame([(i, v, 1, 1, "a", "b") for i, v in rows], VECTORS)
    want = set()
    exact = {i: np.floor(np.array(v, np.float32).astype(float) * 256).astype(int) for i, v in rows}
    for q in (1, 21, 30):
        scores = sorted((-int(exact[q] @ x), i) for i, x in exact.items() if i != q and len(x) == len(exact[q]))
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:4])}
    got = vafile.top_k(df, F.col("vec_id").isin(1, 21, 30), 4).collect()
    assert {tuple(x) for x in got} == want and len(want) == len(got) == 8


def test_search_reads_exact_vectors_only_where_a_bound_reaches(spark, monkeypatch):
    """Queries with close partners: most stripes cannot hold one of their best, and their exact vectors are not read."""
    from sitelens.llm import stripes

    r = np.random.default_rng(9)
    x = r.normal(size=(600, 16)) * 0.2
    x[:3] = r.normal(size=(3, 16))
    x[300:306] = np.repeat(x[:3], 2, axis=0) + 0.01 * r.normal(size=(6, 16))
    seen = []
    plain = vafile.candidate_stripes
    monkeypatch.setattr(vafile, "BLOCK", 30)
    monkeypatch.setattr(vafile, "LARGEST", 30)
    monkeypatch.setattr(vafile, "candidate_stripes", lambda stored, asked, n, k, fitted: seen.append((plain(stored, asked, n, k, fitted), n)) or seen[-1][0])
    df = spark.createDataFrame([(i, v.tolist(), 1, 1, "a", "b") for i, v in enumerate(x)], VECTORS)
    got = sorted(tuple(g) for g in vafile.top_k(df, F.col("vec_id") < 3, 2).collect())
    whole = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    want = []
    for q in range(3):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(600) if i != q)[:2]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    pairs, n = seen[0][0].count(), seen[0][1]
    assert n == stripes.stripe_count(600, 30, 30, 8) == 20 and 3 <= pairs <= 30  # of 60


def test_archives(spark, tmp_path):
    rows = [(i, f"http://Www.Host{i % 4}.example.com:80/p?b={i % 3}&a=1#x", f"<p>page {i % 7}</p>\r\n\r\nmore é\n") for i in range(40)]
    rows += [(40, None, None), (41, "", ""), (42, "http://[bad", "WARC/1.1\r\n\r\n"), (43, "http://x.org/a b\r\nc%20", "z" * 200_000), (None, "http://x.org/", "<p>page 1</p>\r\n\r\nmore é\n"), (None, "u", "alone")]
    rows += [(39, rows[39][1], rows[39][2])]
    df = spark.createDataFrame([(i, u, h, "k", "d") for i, u, h in rows], "page_id bigint, url string, html string, digest string, n string").repartition(3)
    folder = str(tmp_path / "archives")
    got = warc.captured_pages(df, folder).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", -1))
    want = collections.Counter()
    for i, u, h in rows:
        h, u = h or "", u or ""
        again = h in largest and i != largest[h]
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want[(None if i is None else str(i), u, len(h.encode()), digest, "revisit" if again else "response", str(largest[h]) if again else None)] += 1
    have = collections.Counter((r["page"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    assert have == want
    ordered = sorted(got, key=lambda r: r["position"])
    assert [r["position"] for r in ordered] == list(range(len(rows)))
    keys = [(r["url_key"], r["captured"], r["page"] or "") for r in ordered]
    assert keys == sorted(keys)
    for _, rows_ in itertools.groupby(ordered, lambda r: r["url_key"]):
        group = list(rows_)
        assert [r["capture"] for r in group] == list(range(1, 1 + len(group)))
    for r in got:
        content = gzip.decompress((tmp_path / "archives" / r["archive"]).read_bytes())
        assert content[r["at"] :].startswith(b"WARC/1.1\r\n") and content[r["at"] + r["length"] - 4 : r["at"] + r["length"]] == b"\r\n\r\n"
    assert warc.captured_pages(df.limit(0), str(tmp_path / "empty")).count() == 0


def test_loser_tree():
    r = random.Random(1)
    for k in range(1, 9):
        lists = [sorted(r.randrange(50) for _ in range(r.randrange(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(lists)) == sorted(x for a in lists for x in a)
    assert list(warc.LoserTree([])) == []


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A/B?z=1&a=2#f") == "com,example)/a/b?a=2&z=1"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert settle(spark.range(3), "three").count() == 3
