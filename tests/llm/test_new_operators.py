"""Hard negatives, spelling variants and repeated passages against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import negatives, repeats, spelling
from tests.llm.cases import docs, read


# --- hard negatives ---------------------------------------------------------------------------------------------

def brute_negatives(rows, positives, fewest, lower=50, upper=95):
    """From (place, id, label, scaled vector, is anchor) rows."""
    out = []
    for a in rows:
        if not a[4]:
            continue
        scores = sorted(((int(np.dot(a[3], b[3])), -b[1], b) for b in rows if b[0] != a[0] and len(b[3]) == len(a[3])), key=lambda x: (-x[0], -x[1]))
        for score, _, p in [s for s in scores if s[2][2] == a[2]][:positives]:
            window = [s for s in scores if s[2][2] != a[2] and lower * score <= 100 * s[0] <= upper * score]
            out += [(a[1], p[1], k, n[2][1], score, n[0]) for k, n in enumerate(window[:fewest], 1)]
    return sorted(out)


def mined(df, anchor, **how):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in cols) for r in negatives.mine_hard_negatives(df, anchor, **how).collect())


def test_negatives_of_ties_and_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 4, 3) / 256.0 * 7], int(rng.integers(0, 3))) for i in range(60)]  # few distinct scores: ties everywhere
    rows += [(60, [0.0, 0.0, 0.0], 1), (61, None, 1), (62, [1.0, None, 0.0], 1), (63, [float("nan"), 1.0, 1.0], 1), (64, [float("inf"), 1.0, 1.0], 1),
             (65, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (66, [1.0, 1.0], 1), (67, [0.5, 0.5], 2), (68, [0.75, 1.0], 1), (5, [0.02, 0.02, 0.02], 2), (69, [], 1), (70, [1e300, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ["row", "id", "y", "v", "dim", "anchor", "slot", "score", "block", "part", "limits"]})
    known = [(k, i, y, np.floor(np.array(v) * 256), i % 5 == 0) for k, (i, v, y) in enumerate(rows)
             if i is not None and y is not None and v is not None and all(x is not None and abs(x) < 1e10 for x in v)]
    want = brute_negatives(known, 5, 3)
    assert len(want) > 30
    assert mined(df, F.col("vec_id") % 5 == 0) == want
    assert mined(df, F.col("vec_id") % 5 == 0, most=200) == want  # many blocks
    assert mined(df, F.col("vec_id") % 5 == 0, positives=2, negatives=1, lower=10, upper=100) == brute_negatives(known, 2, 1, 10, 100)
    assert mined(df.limit(0), F.col("vec_id") % 5 == 0) == []
    assert mined(df, F.lit(False)) == []


def test_negatives_of_embeddings(spark):
    rows = [(k, r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, np.float64)), r.vec_id % 50 == 0)
            for k, r in enumerate(read(spark, "embeddings").collect())]
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r[c] for c in cols) for r in negatives.op13_slots(spark, "/root/testdata/sf0.001").collect())
    assert got == brute_negatives(rows, 5, 3) and got


def test_best_takes_the_first_of_equal_scores():
    i, j = negatives.best(np.array([[1.0, 3, 3, 2, 3], [-np.inf] * 5]), 2)
    assert list(zip(i, j)) == [(0, 1), (0, 2)]


# --- spelling variants ------------------------------------------------------------------------------------------

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, fewest=3, shortest=5, ratio=2):
    words = {w: n for w, n in words.items() if n >= fewest and len(w) >= shortest}
    friends = {w: [v for v in words if near(v, w)] for w in words}
    best = {w: min(friends[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v is not None and words[v] >= ratio * words[w] else None for w, v in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, str(form[w]), root(w), n, len(friends[w]), words.get(form[w]) or 0) for w, n in words.items())


def told(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_words_are_counted_with_their_slips(spark):
    rows = [(i, " ".join(random.Random(i).choices(["House", "été", "naïve", "a×b", "x1y", "ÀÉ", "riverbank"], k=40))) for i in range(50)] + [(None, "House house HOUSE"), (7, None), (7, ""), (7, "12 34")]
    want = Counter()
    for i, text in rows:
        for run in spelling.RUN.findall((text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 7 == 0 else run] += 1
    got = {r.word: r.n for r in spelling.count_words(docs(spark, rows), drop_every=7).collect()}
    assert got == dict(want)
    assert {r.word: r.n for r in spelling.count_words(docs(spark, [(1, "Ab ab ÀB")])).collect()} == {"ab": 2, "Àb": 1}


@pytest.mark.parametrize("how", [{}, {"split": 0}, {"split": 0, "most": 5}, {"split": 5, "heavy": 10}, {"least": 3, "most": 3}])
def test_near_words_of_any_dictionary(spark, how):
    rng = random.Random(5)
    words = {}
    for _ in range(60):
        w = "".join(rng.choices("abà𝒳" if rng.random() < 0.2 else "ab", k=rng.randint(5, 9)))
        words[w] = rng.choice([2, 3, 3, 6, 12, 13, 30, 100])
        for _ in range(4):  # its neighbours
            i, c = rng.randrange(len(w) + 1), rng.choice("abc")
            words[rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]])] = rng.choice([2, 3, 6, 7])
    words |= {"aaaaa": 4, "aaaaaa": 8, "aaaaaaa": 16, "aaaaaaaa": 32, "aaaa": 50, "": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({c: F.lit("x") for c in ["form", "gram", "root", "a", "b", "size", "letters"]})
    assert told(spelling.spelling_variants(df, **how)) == brute_variants(words)


def test_variants_of_documents_and_of_nothing(spark):
    words = {r.word: r.n for r in spelling.count_words(read(spark, "documents"), drop_every=97).collect()}
    assert told(spelling.op12_grams(spark, "/root/testdata/sf0.001")) == brute_variants(words)
    assert spelling.spelling_variants(spelling.count_words(docs(spark, []))).count() == 0
    assert spelling.spelling_variants(spelling.count_words(docs(spark, [(1, None), (2, "one two")]))).count() == 0


def test_affected_grams_bound_every_edit():
    rng = random.Random(1)
    heavy = {"ab", "ba", "aba", "\x01a", "bb", "bbb"}
    for _ in range(2000):
        w = "".join(rng.choices("abc", k=rng.randint(5, 8)))
        i, c = rng.randrange(len(w)), rng.choice("abc")
        v = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]])
        grams, bound = spelling.decompose(w, heavy, 2, 4)
        shared = Counter(grams) & Counter(spelling.decompose(v, heavy, 2, 4)[0])
        assert bound < len(grams) and sum(shared.values()) >= len(grams) - bound


# --- repeated passages ------------------------------------------------------------------------------------------

def brute_repeats(texts, size):
    """(bytes, removed, spans, what is left) of each text."""
    seen = Counter(t[p:p + size] for t in texts for p in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - size + 1):
            if seen[t[p:p + size]] > 1:
                gone[p:p + size] = True
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def removed(df, **how):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(df, **how).collect())


def repeat_rows():
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choices("abcdefghijkl mnopé", k=n))

    passage, line = noise(300), noise(40)
    rows = [(i, noise(rng.randint(0, 300)) + passage[rng.randint(0, 60):rng.randint(150, 300)] + noise(rng.randint(0, 90))) for i in range(25)]
    rows += [(100 + i, noise(200) + line + noise(150)) for i in range(20)]  # a common line that is too short
    base = noise(900)
    rows += [(200 + i, base) for i in range(3)] + [(200, base)]
    for i in range(10):  # near copies
        k = rng.randrange(900)
        rows.append((300 + i, base[:k] + noise(rng.randint(0, 3)) + base[k + rng.randint(0, 2):]))
    rows += [(400, "z" * 500), (401, "z" * 149), (402, "z" * 100), (403, "ab" * 300), (404, "xyz" * 70), (405, None), (406, ""), (None, base[:200]), (None, None), (407, noise(99)), (408, noise(100)), (409, "ü" * 120)]
    return rows


@pytest.mark.parametrize("how", [{"size": 100, "gram": 32}, {"size": 100, "gram": 60, "step": 7}, {"size": 64, "gram": 8, "step": 1}, {"size": 100, "gram": 100, "step": 3}])
def test_repeats_are_removed(spark, how, monkeypatch):
    rows = repeat_rows()
    want = brute_repeats([(t or "").encode() for _, t in rows], how["size"])
    df = docs(spark, rows).repartition(7)
    left = {}
    for (i, t), w in zip(rows, want):
        left.setdefault((str(i), len((t or "").encode())), []).append(None if w[1] == 0 else w[3])
    expected = sorted((str(i), *w[:3]) for (i, _), w in zip(rows, want))
    assert removed(df, **how) == expected
    for r in repeats.remove_repeats(df, **how).collect():
        assert (bytes(r.kept) if r.kept is not None else None) in left[str(r.doc_id), r.n_bytes]
    monkeypatch.setattr(repeats, "FEW", -1)  # without broadcasts
    assert removed(df, **how) == expected


def test_runs_cover_every_window():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 400))).encode() for _ in range(30)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = [(int(t), int(s + i)) for t, s, n, _, _ in zip(*(np.concatenate(x) for x in zip(*repeats.runs(offsets, data, 20, 6)))) for i in range(n)]
    assert whole == [(k, offsets[k] + p) for k, t in enumerate(texts) for p in range(len(t) - 19)]
    grams = {}
    for _, s, n, p, h in zip(*(np.concatenate(x) for x in zip(*repeats.runs(offsets, data, 20, 6)))):
        for i in range(n):
            assert s + i <= p <= s + i + 14
            assert grams.setdefault(bytes(data[s + i:s + i + 20]), (h, p - s - i)) == (h, p - s - i)  # equal windows choose the same gram


def test_repeats_of_documents_and_of_nothing(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in read(spark, "documents").collect()]
    want = sorted((i, *w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(rows, brute_repeats([t for _, t in rows], 400)))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op11_radix(spark, "/root/testdata/sf0.001").collect())
    assert got == want
    assert repeats.remove_repeats(docs(spark, [])).count() == 0
