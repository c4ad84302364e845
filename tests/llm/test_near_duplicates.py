"""SimHash, leaks and embeddings against brute force."""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tarnfold.llm import common, leaks, simhash, vectors
from tests.llm.cases import CLASHES, ROWS, docs, read


def brute_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(max(1, len(words) - size + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def check_simhash(df, size, radius):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t, size) for _, t in rows]
    root = brute_components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
    low = {c: min((rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None), default=None) for c in set(root)}
    want = sorted((str(rows[i][0]), f"{fps[i]:016x}", str(low[root[i]])) for i in range(len(rows)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df, size, radius).collect())
    assert got == want


def test_simhash_of_awkward_rows(spark):
    check_simhash(docs(spark), 4, 4)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_of_documents(spark):
    check_simhash(read(spark, "documents"), 4, 4)


def test_trees_find_what_comparison_finds(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 12, np.uint64)
    values = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centres]))
    n = len(values)
    piece = rng.integers(0, 2, n)
    for first, second in ((0, 0), (0, 1)):
        on = [(i, j) for i in range(n) for j in range(i) if {piece[i], piece[j]} == {first, second} and int(values[i] ^ values[j]).bit_count() <= 3]
        want = list(range(n))
        for i, j in on:
            a, b = want[i], want[j]
            want = [min(a, b) if r in (a, b) else r for r in want]
        root = simhash.shard_roots(np.array([0]), np.array([n]), np.full(n, first), np.full(n, second), piece, values, 3)
        assert (root == want).all()
    same = np.zeros(n, int)
    trees = simhash.shard_roots(np.array([0]), np.array([n]), same, same, same, values, 3)
    monkeypatch.setattr(simhash, "SMALL", n + 1)
    assert (trees == simhash.shard_roots(np.array([0]), np.array([n]), same, same, same, values, 3)).all()


def test_forest_of_small_shards_finds_every_link():
    rng = np.random.default_rng(6)
    sizes = np.concatenate([rng.integers(1, simhash.SMALL + 1, 40), [1, 2, simhash.SMALL, simhash.SMALL + 30]])
    ends = np.cumsum(sizes)
    centres = rng.integers(0, 1 << 63, 30, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(ends[-1])], np.uint64)
    values = centres[rng.integers(0, 30, ends[-1])] ^ flips
    first = np.repeat(rng.integers(0, 2, len(sizes)), sizes)
    second = np.maximum(first, np.repeat(rng.integers(0, 2, len(sizes)), sizes))
    piece = np.where(rng.integers(0, 2, ends[-1]) == 0, first, second)
    for radius in (0, 3, 8):
        root = simhash.shard_roots(ends - sizes, ends, first, second, piece, values, radius)
        for a, b in zip(ends - sizes, ends):
            want = brute_components(b - a, lambda i, j: {piece[a + i], piece[a + j]} == {first[a], second[a]} and int(values[a + i] ^ values[a + j]).bit_count() <= radius)
            assert (root[a:b] - a == want).all()


def test_longer_keys_find_the_same_links(spark):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = np.unique([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))) for c in centres for _ in range(6)]).view(np.int64)
    root = brute_components(len(fps), lambda i, j: ((int(fps[i]) ^ int(fps[j])) & (1 << 64) - 1).bit_count() <= 5)
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, set()).add(int(fps[i]))
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fps}))
    for agree in (None, 2, 3, 4):
        got = {r.node: r.component for r in common.connected_components(simhash.fingerprint_links(nodes, 5, agree=agree)).collect()}
        assert want == {frozenset(k for k in got if got[k] == c) for c in set(got.values())}
    assert [simhash.agreeing(n, 8, 1024) for n in (10 ** 3, 10 ** 8, 10 ** 10)] == [2, 3, 5]


def test_shard_cut_in_pieces_loses_no_link(spark):
    rng = np.random.default_rng(4)
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.unique([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 5, replace=False))) for _ in range(150)]).view(np.int64)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fps}))
    got = {r.node: r.component for r in common.connected_components(simhash.fingerprint_links(nodes, 6, piece=16)).collect()}
    root = brute_components(len(fps), lambda i, j: ((int(fps[i]) ^ int(fps[j])) & (1 << 64) - 1).bit_count() <= 6)
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, set()).add(int(fps[i]))
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(k for k in got if got[k] == c) for c in set(got.values())}


def test_one_row_of_each_component_stays(spark):
    out = simhash.drop_near_duplicates(docs(spark), 4, 4)
    kept = out.select("doc_id", "text").collect()
    fps = [brute_fingerprint(t, 4) for _, t in ROWS]
    root = brute_components(len(ROWS), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert len(kept) == len(set(root)) and out.columns == docs(spark).columns and {r.doc_id for r in kept} >= {1, 4, 8}


def shingle_texts(text, size):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b, least=0.8):
    return a == b or len(a & b) >= least * len(a | b) - 1e-9


def test_rows_below_the_similarity_stay(spark):
    rows = sorted((r.doc_id, r.text) for r in read(spark, "documents", "/root/testdata/sf0.01").select("doc_id", "text").collect())
    fps = np.array([brute_fingerprint(t, 5) for _, t in rows], np.uint64)
    sets, n = [shingle_texts(t, 5) for _, t in rows], len(rows)
    near = [(i, j) for i in range(n) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 8)]
    assert sum(not alike(sets[i], sets[j]) for i, j in near) > 5

    def components(pairs):
        root = list(range(n))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root] if a != b else root
        return root

    candidate = components(near)
    groups = {}
    for i, c in enumerate(candidate):
        groups.setdefault(c, []).append(i)
    root = components([(i, j) for g in groups.values() for i in g for j in g if j < i and alike(sets[i], sets[j])])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (1024, 3):
        kept = {r.doc_id for r in simhash.drop_near_duplicates(df, piece=piece).collect()}
        assert kept == {rows[c][0] for c in set(root)}
    at = {r[0]: k for k, r in enumerate(rows)}
    for gone in {r[0] for r in rows} - kept:
        assert any(alike(sets[at[gone]], sets[k]) for k in range(n) if k != at[gone])


def test_bands_find_pairs_beyond_the_radius(spark):
    """With bands the rows that stay are those of all pairs of similarity 0.8 or more, compared one by one."""
    rows = sorted((r.doc_id, r.text) for r in read(spark, "documents", "/root/testdata/sf0.01").select("doc_id", "text").collect())
    rng, words = np.random.default_rng(4), [f"w{k}" for k in range(5000)]
    for k in range(60):  # planted: 200 words, the copy differs in one or two places
        base = list(rng.choice(words, 200))
        copy = list(base)
        for at in rng.choice(200, 1 + k % 2, replace=False):
            copy[at] = "other"
        rows += [(100000 + 2 * k, " ".join(base)), (100001 + 2 * k, " ".join(copy))]
    sets = [shingle_texts(t, 5) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for h in s:
            holders.setdefault(h, []).append(i)
    root = list(range(len(rows)))
    links = {(i, j) for held in holders.values() for i in held for j in held if j < i and alike(sets[i], sets[j])}
    links |= {(i, j) for i in range(len(rows)) for j in range(i) if not sets[i] and not sets[j]}
    for i, j in links:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root] if a != b else root
    fps = [brute_fingerprint(t, 5) for _, t in rows]
    assert sum((fps[i] ^ fps[j]).bit_count() > 8 for i, j in links) >= 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (1024, 2):
        assert {r.doc_id for r in simhash.drop_near_duplicates(df, piece=piece, banded=True).collect()} == {rows[c][0] for c in set(root)}


def test_bands_take_awkward_rows(spark):
    out = simhash.drop_near_duplicates(docs(spark), banded=True)
    assert out.columns == docs(spark).columns and out.count() == simhash.drop_near_duplicates(docs(spark)).count()
    assert simhash.drop_near_duplicates(docs(spark, []), banded=True).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 150), (201, 200)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 100, 201: 100}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def test_leaks(spark):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, "Alpha\nBETA gamma delta epsilon zeta")], "item_id long, text string")
    rows = [(1, "x " * 3000 + ITEM.upper() + " y" * 3000), (1, "nothing"), (2, ITEM.replace("nu", "no")), (3, ITEM.replace("eta theta", "eta x theta")), (4, None), (5, ""), (None, ITEM), (None, ITEM), (6, ITEM[:40])]
    df = docs(spark, rows)
    got = sorted((str(r.id), r.item_id, r.shared, r.item_shingles) for r in leaks.find_leaks(df, items.selectExpr("*", "'c' as s", "'c' as row")).collect())

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)}

    want = {(str(i), k, len(shingles(t) & shingles(x)), len(shingles(x))) for i, t in rows for k, x in ((1, ITEM), (4, "alpha beta gamma delta epsilon zeta"))
            if len(shingles(t) & shingles(x)) >= 0.8 * len(shingles(x))}
    assert got == sorted(want) and len(want) > 4
    kept = leaks.drop_leaks(df, items)
    assert kept.columns == df.columns and sorted(str(r.text)[:7] for r in kept.collect()) == sorted(str(t)[:7] for i, t in rows if str(i) + str(t)[:3] not in
                                                                                                    {w[0] + str(t)[:3] for w in want} or t == "nothing")
    assert leaks.find_leaks(docs(spark, []), items).count() == 0 and leaks.find_leaks(df, items.limit(0)).count() == 0


def test_sketch_never_misses_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    items, rows = [], []
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(int(rng.integers(5, 60)))]
        items.append((k, " ".join(words)))
        n = len(words) - 4
        rows.append((k, " ".join(words[:len(words) - int(0.2 * n)])))  # the longest cut that leaves four fifths
    found = leaks.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.id, r.item_id) for r in found.collect()} == {(k, k) for k in range(40)}


def brute_vectors(rows, least):
    units = []
    for _, v in rows:
        ok = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        u = np.array(v, float) / max(map(abs, v)) if ok else None
        units.append(u / np.linalg.norm(u) if ok else None)
    link = lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least
    root = brute_components(len(rows), link)
    low = {c: min(rows[i][0] for i in range(len(rows)) if root[i] == c) for c in set(root)}
    return sorted((rows[i][0], sum(link(i, j) for j in range(len(rows)) if j != i), low[root[i]], rows[i][0] == low[root[i]]) for i in range(len(rows)))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 16))
    rows = [(k, (base[k % 6] * rng.uniform(0.5, 9) + rng.normal(size=16) * 0.12).tolist()) for k in range(90)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, []), (104, [0.0] * 16), (105, [1.0] * 15 + [None]), (106, [1.0] * 15 + [float("nan")]), (107, [1.0, 2.0]), (108, [1.0, 2.0]),
             (109, [1e300] * 16), (110, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in CLASHES})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, pivots=24, near=8, piece=16).collect())
    want = brute_vectors(rows, 0.95)
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_every_dimension_is_searched(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TOGETHER", 3)
    pairs = (2, 300, 700, 1100, 1500)
    rows = [(d, [1.0] * d) for d in range(2, 1503)] + [(10_000 + d, [1.0] * (d - 1) + [1.01]) for d in pairs] + [(20_000, [1.0] * 9)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    for i, (n, c) in got.items():
        d = i - 10_000 if 10_000 < i < 20_000 else 9 if i == 20_000 else i
        assert (n, c) == ((1, d) if d in (*pairs, 9) else (0, i))
