"""Toxic spans by a linear-chain conditional random field (operator 8).

Tokens are runs of letters in lower case. Labelled tokens come from labelled documents: a word or a word's beginning whose
rate in toxic documents exceeds that in clean ones beyond chance (log-likelihood ratio) enters the lexicon and marks toxic
tokens in toxic documents; all tokens of clean documents are clean. Evidence counts distinct left neighbours, not occurrences,
so copies of one document add little. A two-state chain is trained on windows of such tokens; weights belong to the entries of
the lexicon (a token has that of its word, else of its longest known beginning) and to all other tokens together.

Because all other tokens share one weight, a run of them is a power of one 2 x 2 matrix: forward and backward passes visit
lexicon tokens only and stay exact on texts of any length. A document's score is a logistic function, fitted on the sample, of
the summed log-odds of its marginals above ``FAINT`` and of its length; offending offsets are runs of tokens with marginal 0.5
or more, in code points.

Only the fit uses a sample, bounded by ``toxic_docs``, ``clean_docs``, ``max_words`` and ``max_windows``; every text is scored
whole. Null labels are skipped; an id labelled more than once is toxic if the mean label is 0.5 or more. Without toxic or
without clean examples no word is toxic. Texts without letters score 0. Each row keeps its own row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import fold_of, keep, once, table

LETTERS = re.compile(r"[^\W\d_]+")
FAINT = 0.1
#: Lengths of the beginnings that may enter the lexicon; there they end with this sign.
HEADS, CUT = range(3, 8), "^"
#: Tokens on either side of a lexicon word in a training window.
SIDE = 4


def fold_case(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def entry_of(token: str, lexicon) -> str | None:
    """The entry of ``lexicon`` that a token has."""
    if token in lexicon:
        return token
    for n in range(min(len(token) - 1, HEADS[-1]), HEADS[0] - 1, -1):
        if (head := token[:n] + CUT) in lexicon:
            return head
    return None


class ChainModel:
    """States 0 (clean) and 1 (toxic). ``word``: log-odds of state 1 for each lexicon entry; ``other``: for any other token;
    ``level``: intercept, weight of the summed log-odds and weight of the length in a document's score."""

    def __init__(self, word: dict[str, float], other: float, start: np.ndarray, step: np.ndarray, level=(-3.0, 1.0, 0.0)):
        self.word, self.other, self.level = word, other, level
        self.start = [float(np.exp(x)) for x in start]
        run = np.exp(step) * np.exp([0.0, other])
        self.step, self.runs = np.exp(step).tolist(), []
        for _ in range(40):  # run^(2^k), scaled
            self.runs.append((run / run.sum()).ravel().tolist())
            run = run @ run / run.sum() ** 2

    def _run(self, v, n, back):
        """``v`` carried over ``n`` other words."""
        k = 0
        while n:
            if n & 1:
                a, b, c, d = self.runs[k]
                v = (a * v[0] + b * v[1], c * v[0] + d * v[1]) if back else (v[0] * a + v[1] * c, v[0] * b + v[1] * d)
                s = v[0] + v[1]
                v = (v[0] / s, v[1] / s)
            n >>= 1
            k += 1
        return v

    def _step(self, v, back, odds):
        """Over one word; going back, ``odds`` belongs to the word that is left."""
        (a, b), (c, d) = self.step
        if back:
            v = (v[0], v[1] * odds)
            return a * v[0] + b * v[1], c * v[0] + d * v[1]
        return v[0] * a + v[1] * c, (v[0] * b + v[1] * d) * odds

    def marginals(self, places: list[int], odds: list[float], n: int) -> list[float]:
        """Probability of state 1 at ``places`` (rising) of a text of ``n`` tokens; ``odds``: exp of the words' weights there."""
        ahead, v, last = [], None, -1
        for t, o in zip(places, odds):
            if v is None and t == 0:
                v = (self.start[0], self.start[1] * o)
            else:
                if v is None:
                    v, last = (self.start[0], self.start[1] * np.exp(self.other)), 0
                v = self._step(self._run(v, t - last - 1, False), False, o)
            last = t
            s = v[0] + v[1]
            v = (v[0] / s, v[1] / s)
            ahead.append(v)
        out, w, last, carried = [], (0.5, 0.5), n, None
        for t, o, v in zip(places[::-1], odds[::-1], ahead[::-1]):
            if carried is not None:
                w = self._step(w, True, carried)
            w = self._run(w, last - t - 1, True)
            s = w[0] + w[1]
            w = (w[0] / s, w[1] / s)
            one = v[1] * w[1]
            out.append(one / (one + v[0] * w[0]))
            last, carried = t, o
        return out[::-1]

    def evidence(self, text: str, finder):
        """(summed log-odds, spans) of a text; ``finder`` looks up lexicon entries."""
        low, hits = fold_case(text), {}
        if finder is not None:
            for end, size in finder.iter(low):
                a = end + 1 - size
                if a not in hits and (a == 0 or not LETTERS.match(low[a - 1])):
                    b = LETTERS.match(low, a).end()
                    if own := entry_of(low[a:b], self.word):
                        hits[a] = (b, float(np.exp(self.word[own])))
        if not hits:
            return 0.0, []
        hits = sorted((a, b, o) for a, (b, o) in hits.items())
        places, at, seen = [], 0, 0
        for a, b, _ in hits:
            seen += sum(1 for _ in LETTERS.finditer(low, at, a))
            places.append(seen)
            at, seen = b, seen + 1
        found = self.marginals(places, [x[2] for x in hits], seen + sum(1 for _ in LETTERS.finditer(low, at)))
        total, spans, last = 0.0, [], None
        for t, (a, b, _), p in zip(places, hits, found):
            p = min(p, 1 - 1e-9)
            if p > FAINT:
                total += math.log(p / (1 - p)) - math.log(FAINT / (1 - FAINT))
            if p >= 0.5:
                if last is not None and t == last + 1:
                    spans[-1] = (spans[-1][0], b, max(spans[-1][2], p))
                else:
                    spans.append((a, b, p))
                last = t
        return total, spans

    def score(self, total: float, text: str) -> float:
        if not LETTERS.search(text):
            return 0.0
        z = self.level[0] + self.level[1] * total + self.level[2] * math.log1p(len(text))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    def tag(self, text: str, finder):
        """(score, spans)."""
        total, spans = self.evidence(text, finder)
        return self.score(total, text), spans

    def finder(self):
        """Looks for all entries at once."""
        import ahocorasick
        found = ahocorasick.Automaton()
        for word in self.word:
            found.add_word(word.rstrip(CUT), len(word.rstrip(CUT)))
        found.make_automaton()
        return found


def fit_level(rows: list[tuple], weights: dict[int, float]) -> tuple[float, float, float]:
    """Logistic fit of (summed log-odds, length, label) rows, by Newton steps with a little ridge; evidence never counts against."""
    x = np.array([[1.0, r[0], math.log1p(r[1])] for r in rows])
    y, w = np.array([r[2] for r in rows], float), np.array([weights[r[2]] for r in rows])
    b = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (y - p)) - 1e-2 * b
        b += np.clip(np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), grad), -2, 2)
    return float(b[0]), max(float(b[1]), 1e-3), float(b[2])


def train_chain(ids: np.ndarray, labels: np.ndarray, words: int, rounds: int = 150, ridge: float = 0.1) -> tuple:
    """Fit on windows: ``ids`` (windows x tokens; 0: other word, -1: past the end, k: lexicon word k - 1) and 0/1 ``labels``.
    Gradient of the conditional log-likelihood by forward and backward passes over all windows at once, with Adam steps."""
    n, size = ids.shape
    real = ids >= 0
    w, start, step = np.zeros(words + 1), np.zeros(2), np.zeros((2, 2))
    params, m, v = [w, start, step], [0, 0, 0], [0, 0, 0]
    flat = np.where(real, ids, 0)
    pair = real[:, 1:] & real[:, :-1]
    seen_step = np.zeros((2, 2))
    np.add.at(seen_step, (labels[:, :-1][pair], labels[:, 1:][pair]), 1)
    seen_start = np.bincount(labels[:, 0], minlength=2)
    seen_w = np.bincount(flat[real], weights=labels[real], minlength=words + 1)
    for r in range(1, rounds + 1):
        odds, move = np.exp(w)[flat], np.exp(step)
        a = np.empty((size, n, 2))
        a[0] = np.exp(start) * np.stack([np.ones(n), odds[:, 0]], 1)
        a[0] /= a[0].sum(1, keepdims=True)
        for t in range(1, size):
            x = a[t - 1] @ move
            x[:, 1] *= odds[:, t]
            x /= x.sum(1, keepdims=True)
            a[t] = np.where(real[:, t, None], x, a[t - 1])
        back, exp_step, exp_w = np.full((n, 2), 0.5), np.zeros((2, 2)), np.zeros(words + 1)
        for t in range(size - 1, -1, -1):
            p = a[t] * back
            p /= p.sum(1, keepdims=True)
            exp_w += np.bincount(flat[:, t], weights=p[:, 1] * real[:, t], minlength=words + 1)
            if t:
                e = back * np.stack([np.ones(n), odds[:, t]], 1)
                two = a[t - 1][:, :, None] * move[None] * e[:, None, :]
                two /= two.sum((1, 2), keepdims=True)
                exp_step += (two * real[:, t, None, None]).sum(0)
                e = e @ move.T
                back = np.where(real[:, t, None], e / e.sum(1, keepdims=True), back)
            else:
                exp_start = p.sum(0)
        grads = [seen_w - exp_w - ridge * w, seen_start - exp_start - ridge * start, seen_step - exp_step - ridge * step]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            params[k] += 0.1 * (m[k] / (1 - 0.9 ** r)) / (np.sqrt(v[k] / (1 - 0.99 ** r)) + 1e-9)
    return w, start, step


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, toxic_docs: int, clean_docs: int):
    """(_id, y, text) of at most so many labelled documents of the training folds, the first by a hash of their ids; and how
    many there are of each label."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")) \
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("y")).filter(fold_of("_id") != 0)
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most) for y, most in ((1, toxic_docs), (0, clean_docs))]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    totals = {0: 0, 1: 0} | {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    return rows.join(F.broadcast(chosen), "_id").select("_id", "y", "text"), totals  # toxic_docs + clean_docs rows at most


def toxic_words(sample: DataFrame, most: int, ratio: float = 30.0) -> list[str]:
    """Words tied to toxic documents, the strongest first: their distinct left neighbours in either class, by likelihood ratio."""
    def pairs(batches):
        for b in (b.slice(k, 200) for b in batches for k in range(0, b.num_rows, 200)):
            own = set()
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = LETTERS.findall(fold_case(text))
                own.update(zip(tokens, ["", *tokens], repeat(label)))
            own |= {(t[:n] + CUT, before, label) for t, before, label in own for n in HEADS if n < len(t)}
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*own), (pa.string(), pa.string(), pa.int32()))]
                                             if own else [pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int32())], ["word", "before", "y"])

    rows = sample.select("y", "text").mapInArrow(pairs, "word string, before string, y int").distinct()
    counts = keep(rows.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c")))
    total = counts.agg(F.sum("t"), F.sum("c")).first()
    if not total[0] or not total[1]:
        return []
    share = total[0] / (total[0] + total[1])
    t, c, both = F.col("t").cast("double"), F.col("c").cast("double"), (F.col("t") + F.col("c")).cast("double")
    g = 2 * (t * F.log(t / (both * share)) + F.when(c > 0, c * F.log(c / (both * (1 - share)))).otherwise(0.0))
    found = counts.filter(t > 0).withColumn("g", g).filter((F.col("g") >= ratio) & (t > 5 * share * both) | (F.col("g") >= ratio) & (c * share < 0.05 * t * (1 - share)))
    return [r.word for r in found.orderBy(F.desc("g"), "word").limit(most).collect()]


def training_windows(sample: DataFrame, words: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows around lexicon words, and one from the head of each document: token ids and labels."""
    index = {None: 0} | {w: k + 1 for k, w in enumerate(words)}
    size = 2 * SIDE + 1

    def run(batches):
        for b in batches:
            ids, labels = [], []
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = [index[entry_of(t, index)] for t in LETTERS.findall(fold_case(text))]
                centres = [0] + [i for i, k in enumerate(own) if k]
                for i in centres:
                    window = own[max(0, i - SIDE):i + SIDE + 1]
                    if window:
                        ids.append(window + [-1] * (size - len(window)))
                        labels.append([int(bool(y) and k > 0) for k in ids[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int32()))], ["ids", "labels"])

    rows = sample.select("y", "text").mapInArrow(run, "ids array<int>, labels array<int>").orderBy(F.xxhash64("ids", "labels"), "ids", "labels").limit(most).collect()
    return np.array([r.ids for r in rows], np.int64).reshape(-1, size), np.array([r.labels for r in rows], np.int64).reshape(-1, size)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   toxic_docs: int = 2000, clean_docs: int = 6000, max_words: int = 2000, max_windows: int = 20000) -> ChainModel:
    sample, totals = _sample(docs, labels, id_col, text_col, label_col, toxic_docs, clean_docs)
    sample = keep(sample)
    words = toxic_words(sample, max_words)
    ids, y = training_windows(sample, words, max_windows) if words else (np.zeros((0, 1), np.int64),) * 2
    if not len(ids):
        return ChainModel({}, -20.0, np.zeros(2), np.zeros((2, 2)))
    w, start, step = train_chain(ids, y, len(words))
    model = ChainModel(dict(zip(words, w[1:].tolist())), float(w[0]), start, step)

    def run(batches):
        look = model.finder()
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([float(model.evidence(t, look)[0]) for t in texts], pa.float64()), pa.array(map(len, texts), pa.int64()), b.column(0)],
                                             ["total", "length", "y"])

    # a few numbers for each document of the bounded sample
    rows = [tuple(r) for r in sample.select("y", "text").mapInArrow(run, "total double, length long, y int").collect()]
    own = {k: sum(r[2] == k for r in rows) for k in (0, 1)}
    if own[0] and own[1]:
        model.level = fit_level(rows, {k: totals[k] / own[k] for k in (0, 1)})
    return model


def tag_toxic(docs: DataFrame, model: ChainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) for every row; spans: array of (start, end, p)."""
    mark = f"toxic {zlib.crc32(repr(sorted(model.word.items())).encode())}"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        look = once(mark, model.finder) if model.word else None
        for b in batches:
            tagged = [model.tag(t or "", look) for t in b.column(1).to_pylist()]
            spans = [[dict(zip(("start", "end", "p"), s)) for s in x[1]] for x in tagged]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(x[0]) for x in tagged], pa.float64()), pa.array(spans, span)], ["id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, spans array<struct<start:int,end:int,p:double>>").withColumnRenamed("id", id_col)


def op8_chain(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tagged = tag_toxic(docs, train_toxicity(docs, labels))
    return tagged.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES, ORACLES = {"op8_chain": op8_chain}, {}
