"""Language model, classifiers and personal data: brute force and held-out accuracy."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import language_model, pii, quality, toxicity
from tests.llm.cases import CLASHES, ROWS, docs, read

FOLD = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5


# --- language model -----------------------------------------------------------------------------------------------

def brute_scores(rows):
    """(counts, score of a text) with plain dictionaries; events in the same bins as the operator's."""
    tokens = [((t or "").encode().lower().split() + [None]) for _, t in rows]
    def count(folds):
        one, two = collections.Counter(), collections.Counter()
        for (i, _), w in zip(rows, tokens):
            if FOLD(i) in folds:
                one.update(w)
                two.update(zip([None, *w], w))
        return one, two

    kept, kept2 = count({0, 3, 4})
    full, full2 = count({0, 2, 3, 4})
    n_kept, n = sum(kept.values()), sum(full.values())
    bins = collections.defaultdict(lambda: [0, 0.0, 0.0])
    for (i, _), w in zip(rows, tokens):
        if FOLD(i) == 2:
            for h, x in zip([None, *w], w):
                f2, f1 = kept2[h, x] / kept[h] if kept[h] else 0.0, kept[x] / max(1, n_kept)
                code = [0 if f == 0 else min(199, 1 + math.floor(-2 * np.log2(f))) for f in (f2, f1)]
                b = bins[(kept[h].bit_length() * 200 + code[0]) * 200 + code[1]]
                b[0], b[1], b[2] = b[0] + 1, b[1] + f2, b[2] + f1
    keys = sorted(bins)
    m = np.array([bins[k][0] for k in keys], float)
    w = language_model.learn_weights(np.array(keys, int), m, np.array([bins[k][1] for k in keys]) / np.maximum(m, 1), np.array([bins[k][2] for k in keys]) / np.maximum(m, 1), len(kept))
    out = []
    for (i, _), t in zip(rows, tokens):
        score = sum(math.log10(w[full[h].bit_length()] @ np.array([full2[h, x] / full[h] if full[h] else 0, full[x] / max(n, 1), 1 / (len(full) + 1)])) for h, x in zip([None, *t], t))
        base = sum(math.log10((full[x] + 0.5) / (n + 0.5 * (len(full) + 1))) for x in t)
        out.append((str(i), FOLD(i) == 1, len(t), sum(full[x] > 0 for x in t), n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("block", [3000, 12 << 20])
def test_language_model_equals_dictionaries(spark, monkeypatch, block):
    monkeypatch.setattr(language_model, "BLOCK", block)
    real = [(r.doc_id, r.text) for r in read(spark, "documents").limit(80).collect()]
    rows = real + [(1000 + i if i is not None else None, t) for i, t in ROWS]
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in language_model.score_corpus(docs(spark, rows)).collect()]
    for g, w in zip(sorted(got), brute_scores(rows)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-5)


def test_language_model_of_nothing(spark):
    assert language_model.score_corpus(docs(spark, [])).count() == 0
    held = [i for i in range(60) if FOLD(i) == 1][:4]
    out = language_model.score_corpus(docs(spark, [(i, "some words") for i in held])).collect()
    assert len(out) == 4 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(language_model, "WINDOW", 64)
    words = [f"w{i * 7919 % 1000}" for i in range(5000)] + ["y" * 300]
    starts, hashes = language_model.word_hashes(" ".join(words).encode())
    by = {}
    for w, h in zip(words, hashes):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by) and len(starts) == len(words)


def test_weights_of_a_known_mixture():
    rng = np.random.default_rng(0)
    n = 20000
    f2, f1 = rng.uniform(0.001, 0.5, n), rng.uniform(0.0001, 0.1, n)
    truth = np.array([0.6, 0.3, 0.1])
    p = truth[0] * f2 + truth[1] * f1 + truth[2] / 101
    w = language_model.learn_weights(np.full(n, 5 * 40000), p / p.mean(), f2, f1, 100, rounds=500)
    assert w.shape == (language_model.BUCKETS, 3) and np.allclose(w.sum(axis=1), 1)
    gain = lambda v: (p * np.log(v[0] * f2 + v[1] * f1 + v[2] / 101)).sum()
    assert gain(w[5]) >= max(gain(v) for v in rng.dirichlet([1, 1, 1], 300)) - 1e-3 * abs(gain(truth))


# --- classifiers --------------------------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    stats = quality.statistics(read(spark, "documents", folder), keep_cols=("doc_id",)).cache()
    labels = read(spark, "labels", folder)
    model = quality.train_quality(stats, labels)
    rows = quality.score_quality(stats, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and sum((r.score >= 0.3) == r.quality for r in held) >= 0.93 * len(held)
    assert model.weights and all(len(rule) >= 1 for rule in model.weights)


def test_quality_of_awkward_rows(spark):
    df = docs(spark, [(i, t) for i, t in ROWS])
    stats = quality.statistics(df, keep_cols=("doc_id",))
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(stats, quality.train_quality(stats, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(13)] + [(2, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(stats, quality.train_quality(stats, one)).collect()
    assert len(out) == len(ROWS) and all(r.score > 0.99 for r in out)
    kept = quality.drop_low_quality(df.withColumns({c: F.lit("clash") for c in ("bars", "_w", "_text")}), one)
    assert kept.count() == len(ROWS) and kept.columns[-3:] == ["bars", "_w", "_text"]
    assert quality.drop_low_quality(df.limit(0), one.limit(0)).count() == 0


def test_rules_are_paths_of_trees(spark):
    rows = [(float(i % 2), *[float((i * (k + 3)) % 17) for k in range(len(quality.FEATURES) - 1)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in quality.FEATURES) + ", y int")
    model = quality.fit_rules(df, "y")
    scores = df.select("y", model.score().alias("s")).collect()
    assert all((r.s >= 0.5) == (r.y == 1) for r in scores)


def toy_labels(spark):
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abdegiklmnoprstu"), 6)) for _ in range(300)]
    rows = []
    for i in range(400):
        words = list(rng.choice(pool, 20))
        for k in range(2 * (i % 4 == 0)):
            words.insert(int(rng.integers(1, 20)), ["rotten", "vile"][k])
        rows.append((i, " ".join(words)))
    return rows, spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")


def test_toxic_spans(spark):
    rows, labels = toy_labels(spark)
    model = toxicity.train_toxicity(docs(spark, rows), labels)
    assert {"rotten", "vile"} <= set(model.word) and all(w.rstrip("^") in ("rotten", "vile") or w.rstrip("^") in "rotten vile" for w in model.word)
    test = [(1, "Well, ROTTEN!! and\nvile things"), (2, "nothing here"), (3, None), (4, ""), (5, "123 !!"), (None, "rotten"), (1, "rottenness"), (7, "calm " * 20000 + "rotten vile rotten" + " calm" * 20000)]
    out = toxicity.tag_toxic(docs(spark, test), model).collect()
    by = sorted(((str(r.doc_id), round(r.score, 3), [(s.start, s.end) for s in r.spans]) for r in out), key=str)
    hit = next(x for x in by if x[0] == "1" and x[2])
    assert (6, 12) in hit[2] or hit[2][0][0] == 6
    assert all(x[1] < 0.5 for x in by if x[0] in "2345") and len(by) == len(test)
    assert next(x for x in by if x[0] == "7")[2] == [(100000, 100018)]
    assert toxicity.tag_toxic(docs(spark, []), model).count() == 0
    none = toxicity.train_toxicity(docs(spark, rows), labels.limit(0))
    assert max(r.score for r in toxicity.tag_toxic(docs(spark, test), none).collect()) < 0.5


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(1)
    model = toxicity.ChainModel({"a": 2.0, "b": -1.0, "c": 5.0}, -3.0, np.array([0.3, -0.2]), np.array([[1.0, -0.5], [0.2, 0.9]]))
    step, start = np.array(model.step), np.array(model.start)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        own = [rng.choice(["a", "b", "c"]) if rng.random() < 0.2 else None for _ in range(n)]
        e = [np.array([1, math.exp(model.word[x] if x else -3.0)]) for x in own]
        a, b = [start * e[0]], [np.ones(2)]
        for t in range(1, n):
            a.append((a[-1] @ step) * e[t])
        for t in range(n - 1, 0, -1):
            b.append(step @ (e[t] * b[-1]))
        p = [(x * y)[1] / (x * y).sum() for x, y in zip(a, b[::-1])]
        places = [t for t in range(n) if own[t]]
        assert np.allclose(model.marginals(places, [math.exp(model.word[own[t]]) for t in places], n), [p[t] for t in places])


# --- personal data ------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def fine(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = sorted((m.start(), list(BASE).index(k), m.end(), k) for k in BASE for m in re.finditer(BASE[k], text) if fine(k, m[0]))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


TRICKY = ["a@b.c_d@e.f", "x@y.z..w@v.u", "a@b", "a@b.", "é a@b.c.d, q@-.-", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.02.003.4", "4111 1111 1111 1111", "4111  1111-1111--1111 4111-1111-1111-1111",
          "+1 (706) 555-3138 +12 3 +1234567890123456", "call +49 30 1234567 or 𝒳𝒴 +49 30 1234567", "12 " * 3000, "9" * 30000, "a.b." * 3000 + "@x.y", "q@" + "a." * 5000 + "b", "+1" * 500,
          "IBAN DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE00 1234 5678 9012 3456 78", "a@bc.d", "-1-2-3- 4-5--6", "a@b.c@d.e", "1.2.3.4.", "..a@b.c..", None, "", "4111111111111111 4111111111111111"]


def test_spans_equal_python_patterns(spark):
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("a1@.. -+9()_é"), 60)) for _ in range(200)]
    texts = TRICKY + noise + [t for _, t in ROWS]
    df = docs(spark, list(enumerate(texts)))
    out = {r.doc_id: r for r in pii.find_spans(df).select("doc_id", "pii_spans").collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in out[i].pii_spans if s.kind != "iban")
        assert base == brute_spans(t or ""), t
        assert all((t or "")[s.start:s.end] == s.match for s in out[i].pii_spans)
    ibans = [s.match for s in out[TRICKY.index(next(t for t in TRICKY if t and "IBAN" in t))].pii_spans if s.kind == "iban"]
    assert ibans == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert pii.find_spans(df.limit(0)).count() == 0


def test_context_moves_the_score(spark):
    rows = [(1, "credit card 4111111111111111 ok"), (2, "order serial 4111111111111111 ok"), (3, "just 4111111111111111 ok")]
    out = {r.doc_id: r.pii_spans[0].score for r in pii.find_spans(docs(spark, rows)).collect()}
    assert out[1] > out[3] > out[2]


def test_redaction(spark):
    rows = [(1, "mail a.b@c.de now"), (2, "card 4111111111111111, +49 30 1234567."), (3, None), (4, "clean"), (4, "clean"), (None, "1.2.3.4")]
    df = docs(spark, rows)
    out = pii.redact(df, count_col="n_chars")
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect())
    assert [g[1] for g in got] == ["mail [email] now", "card [card], [phone].", None, "clean", "clean", "[ip]"] and got[0][2] == len("mail [email] now")


def test_base_digest(spark):
    from tarnfold.llm.pii import op9_pii
    rows = {r.doc_id: r for r in op9_pii(spark, "/root/testdata/sf0.001").collect()}
    for r in read(spark, "documents").collect():
        base = brute_spans(r.text or "")
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and rows[r.doc_id].n_email == base.count("email:")


def test_clashing_names_are_left_alone(spark):
    assert set(CLASHES) <= set(pii.redact(docs(spark)).columns)
