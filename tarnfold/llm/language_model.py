"""Deleted interpolation of n-gram estimates (operator 1).

The probability of a token is a mixture of maximum-likelihood estimates: of the token after its predecessor, of the token, and
of any token alike. The weights depend on how frequent the predecessor is (buckets by powers of two). They are learned by
expectation-maximisation on counts that were held out: one fold of the training documents is deleted from the counts, and its
tokens tell how well each estimate predicts. Scores use the counts of all training documents with these weights.

Counts are of the whole corpus and never gathered in one place. Documents are packed into blocks, kept once in the shared
folder. Each block asks for each of its distinct n-grams, as sorted 64-bit hashes with its own counts; requests are dealt by hash
range, summed there, and the totals go back to the block that asked. A frequent word is one request from each block, so no key
is hot. EM needs a histogram of bounded size (bucket and quantised estimates of the events), the only thing the driver gets.

Tokens are words between white space, A-Z in lower case, then one end for each text, which is also what precedes the first word.
Null and empty texts have the end only. Each row keeps its own row and repeated rows count again; extra columns are ignored. With no
training documents all estimates but the last are zero. Two words collide with probability 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import fold_of, keep, once, table, width

#: Bytes of text in a block (a longer text is a block of its own), and of text whose n-grams make one range of hashes.
BLOCK, RANGE = 12 << 20, 16 << 20
#: Parts of the corpus.
KEPT, DELETED, HELD_OUT = 0, 1, 2
WINDOW, BUCKETS, STEPS = 1 << 20, 40, 2
_ODD, _MULTIPLIER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed shuffling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(_MULTIPLIER)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(_MULTIPLIER)
    return x ^ (x >> np.uint64(32))


END = _mix(np.array([1], np.uint64))[0] & ~np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte value, powers of an odd number, and of its inverse, modulo 2^64."""
    def make():
        size = 1 << max(WINDOW.bit_length() + 1, n.bit_length())
        up, down = np.full(size, _ODD, np.uint64), np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64), np.multiply.accumulate(up), np.multiply.accumulate(down)

    return once(f"powers {max(WINDOW.bit_length() + 1, n.bit_length())}", make)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of lower-case bytes. A hash is a polynomial in the word's bytes modulo 2^64, mixed; its last bit is 0."""
    raw = np.frombuffer(text, np.uint8)
    gap = _BREAK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + WINDOW, "right")))
        a, b = starts[k], ends[j - 1]
        values, up, down = _powers(int(b - a) + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[raw[a:b]] * up[:b - a], out=sums[1:])
        out[k:j] = (sums[ends[k:j] - a] - sums[starts[k:j] - a]) * down[starts[k:j] - a]
        k = j
    return starts, _mix(out + np.uint64(7)) & ~np.uint64(1)


def block_ngrams(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, hash of each token after its predecessor, number of tokens of each document) of texts that stand
    one after another in ``text``, each with one white space behind it."""
    starts, words = word_hashes(text)
    of = np.searchsorted(np.cumsum(lengths + 1), starts, "right")
    n = np.bincount(of, minlength=len(lengths)).astype(np.int64)
    tokens = np.full(len(words) + len(lengths), END, np.uint64)
    tokens[np.arange(len(words)) + of] = words
    before = np.concatenate([[END], tokens[:-1]])
    return tokens, _mix(before * np.uint64(3) + (tokens >> np.uint64(1)) * np.uint64(_ODD)) | np.uint64(1), n + 1


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _expand(data: bytes, n: int, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).ravel()


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, part, ids, lengths, bytes, payload): documents of one part packed together."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        held, seq, id_type = {p: ([], []) for p in (KEPT, DELETED, HELD_OUT)}, 0, None
        size = dict.fromkeys(held, 0)

        def block(part):
            nonlocal seq
            ids, texts = held[part]
            held[part], size[part] = ([], []), 0
            payload = b"\n".join(texts) + b"\n"
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 24) + seq], pa.int64()), pa.array([part], pa.int32()), pa.array([ids], pa.list_(id_type)),
                                               pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([len(payload)], pa.int64()),
                                               pa.array([zstandard.ZstdCompressor(level=6).compress(payload)], pa.binary())],
                                              ["block", "part", "ids", "lengths", "bytes", "payload"])

        for b in batches:
            id_type = b.column(0).type
            for i, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                text = (text or b"").lower()
                if size[part] and size[part] + len(text) > BLOCK:
                    yield block(part)
                held[part][0].append(i), held[part][1].append(text)
                size[part] += len(text) + 1
        for part in held:
            if held[part][0]:
                yield block(part)

    fold = fold_of(id_col)
    part = F.when(fold == 1, HELD_OUT).when(fold == 2, DELETED).otherwise(KEPT)
    rows = docs.select(F.col(id_col).alias("id"), part.cast("int").alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"block long, part int, ids array<{kind}>, lengths array<long>, bytes long, payload binary")


def _open(lengths, payload) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return block_ngrams(zstandard.ZstdDecompressor().decompress(payload), np.array(lengths, np.int64))


def requests(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, block, part, n, keys, counts): each block's distinct n-grams, sorted, by hash range."""
    bounds = np.array([-(-(k << 64) // ranges) for k in range(1, ranges)], np.uint64)

    def run(batches):
        for b in batches:
            for row in b.select(["block", "part", "lengths", "payload"]).to_pylist():
                tokens, pairs, _ = _open(row["lengths"], row["payload"])
                keys, counts = np.unique(np.concatenate([tokens, pairs]), return_counts=True)
                cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                full = [(k, x, y) for k, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
                deltas = [np.diff(keys[x:y], prepend=np.uint64(0)) for _, x, y in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in full], pa.int32()), pa.array([row["block"]] * len(full), pa.int64()), pa.array([row["part"]] * len(full), pa.int32()),
                     pa.array([y - x for _, x, y in full], pa.int64()), pa.array([_squeeze(d) for d in deltas], pa.binary()),
                     pa.array([_squeeze(counts[x:y].astype(np.uint32)) for _, x, y in full], pa.binary())], ["range", "block", "part", "n", "keys", "counts"])

    return blocks.mapInArrow(run, "range int, block long, part int, n long, keys binary, counts binary")


def replies(asked: DataFrame) -> DataFrame:
    """(block, part, range, n, totals, deleted, tokens, types, kept_tokens, kept_types): for each request the counts over all
    training documents and over the deleted part; the range's own token and type counts stand in its first row."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        keys = [np.cumsum(_expand(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows]
        own, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros((2, len(own)), np.int64)
        at = np.cumsum([0] + [r["n"] for r in rows])
        for r, x, y in zip(rows, at, at[1:]):
            if r["part"] != HELD_OUT:
                sums[r["part"], place[x:y]] += _expand(r["counts"], r["n"], np.uint32)
        kept, deleted = sums
        words = own & np.uint64(1) == 0
        told = [int((kept + deleted)[words].sum()), int(((kept + deleted)[words] > 0).sum()), int(kept[words].sum()), int((kept[words] > 0).sum())]
        narrow = [np.minimum(x, (1 << 40) - 1).astype(np.uint64) for x in (kept + deleted, deleted)]
        blobs = [[_squeeze(x[place[a:b]]) for a, b in zip(at, at[1:])] for x in narrow]
        first = [[t] + [0] * (len(rows) - 1) for t in told]
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int32()),
                         "range": pa.array([r["range"] for r in rows], pa.int32()), "n": pa.array([r["n"] for r in rows], pa.int64()),
                         "totals": pa.array(blobs[0], pa.binary()), "deleted": pa.array(blobs[1], pa.binary()),
                         **{k: pa.array(v, pa.int64()) for k, v in zip(("tokens", "types", "kept_tokens", "kept_types"), first)}})

    return asked.groupBy("range").applyInArrow(run, "block long, part int, range int, n long, totals binary, deleted binary, tokens long, types long, kept_tokens long, kept_types long")


def _answered(left: pa.Table, right: pa.Table):
    """A block's row, document token counts, and for each token: its count and the deleted part of it, and the same of its pair."""
    row = left.to_pylist()[0]
    tokens, pairs, n = _open(row["lengths"], row["payload"])
    own, place = np.unique(np.concatenate([tokens, pairs]), return_inverse=True)
    got = right.sort_by("range").to_pylist()
    total, deleted = (np.concatenate([_expand(r[k], r["n"], np.uint64) for r in got]).astype(np.int64)[place] for k in ("totals", "deleted"))
    m = len(tokens)
    return row, n, (total[:m], deleted[:m]), (total[m:], deleted[m:])


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    """0 for no count, else 1 + floor(log2)."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def estimates(word: np.ndarray, pair: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count of the predecessor, estimate of the token after it, estimate of the token). The end, which each block ends with,
    also precedes its first word."""
    before = np.concatenate([word[-1:], word[:-1]])
    return before, np.where(before > 0, pair / np.maximum(before, 1), 0.0), word / max(tokens, 1)


def events(left: pa.Table, right: pa.Table, tokens: int) -> pa.Table:
    """Histogram of a deleted block's tokens under the counts without the deleted part."""
    _, _, word, pair = _answered(left, right)
    before, f2, f1 = estimates(word[0] - word[1], pair[0] - pair[1], tokens)
    bins = [np.where(f > 0, 1 + np.floor(-STEPS * np.log2(np.where(f > 0, f, 1.0))), 0).astype(np.int64).clip(0, 199) for f in (f2, f1)]
    code, place = np.unique((frequency_bucket(before) * 200 + bins[0]) * 200 + bins[1], return_inverse=True)
    return pa.table({"bin": pa.array(code), "n": pa.array(np.bincount(place).astype(np.int64)), "f2": pa.array(np.bincount(place, weights=f2)),
                     "f1": pa.array(np.bincount(place, weights=f1))})


def learn_weights(bins: np.ndarray, n: np.ndarray, f2: np.ndarray, f1: np.ndarray, types: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights (bucket x 3) by expectation-maximisation; f2 and f1 are means of a bin. A bucket borrows ten events from
    the weights of all buckets together, so that one with few events stays sound."""
    out = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    f = np.stack([f2, f1, np.full(len(n), 1 / (types + 1))], axis=1)

    def fit(rows, prior):
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            share = f[rows] * w
            share = share / share.sum(axis=1, keepdims=True) * n[rows, None]
            w = share.sum(axis=0) + prior
            w /= w.sum()
        return w

    bucket = bins // 40000
    if (bucket > 0).any():
        together = fit(np.flatnonzero(bucket > 0), np.full(3, 1e-3))
        for b in range(1, BUCKETS):
            rows = np.flatnonzero(bucket == b)
            out[b] = fit(rows, 10 * together) if len(rows) else together
    rows = np.flatnonzero(bucket == 0)  # no predecessor was seen: its estimate is zero
    if len(rows):
        w = fit(rows, np.array([0.0, 1.0, 1.0]))
        out[0] = [0.0, w[1] / (w[1] + w[2]), w[2] / (w[1] + w[2])]
    return out


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = keep(text_blocks(docs, id_col, text_col))
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(width(spark), -(-size // RANGE))
    told = keep(replies(requests(blocks, ranges)))
    total, types, kept, kept_types = [x or 0 for x in told.agg(*[F.sum(c) for c in ("tokens", "types", "kept_tokens", "kept_types")]).first()]

    def answered(wanted, fn, schema):
        left, right = (x.filter(F.col("part") == wanted) if wanted is not None else x for x in (blocks, told))
        return left.select("block", "part", "ids", "lengths", "payload").groupBy("block") \
            .cogroup(right.select("block", "range", "n", "totals", "deleted").groupBy("block")).applyInArrow(fn, schema)

    seen = answered(DELETED, lambda a, b: events(a, b, kept), "bin long, n long, f2 double, f1 double")
    got = seen.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("f2").alias("f2"), F.sum("f1").alias("f1")).toPandas().sort_values("bin")
    n = got["n"].to_numpy(np.float64)
    weights = learn_weights(got["bin"].to_numpy(), n, got["f2"].to_numpy() / np.maximum(n, 1), got["f1"].to_numpy() / np.maximum(n, 1), kept_types)

    def run(left, right):
        row, n, (word, _), (pair, _) = _answered(left, right)
        first = np.cumsum(n) - n
        before, f2, f1 = estimates(word, pair, total)
        w = weights[frequency_bucket(before)]
        score = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (types + 1))
        base = np.log10((word + 0.5) / (total + 0.5 * (types + 1)))
        return pa.table({"id": left["ids"].combine_chunks().flatten(), "held_out": pa.array([row["part"] == HELD_OUT] * len(n)), "n_tokens": pa.array(n),
                         "n_known": pa.array(np.add.reduceat(word > 0, first, dtype=np.int64)), "train_tokens": pa.array([total] * len(n), pa.int64()),
                         "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(score, first))})

    scored = answered(None, run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)


def op1_deleted_interpolation(spark, sf_dir):
    return score_corpus(table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op1_deleted_interpolation": op1_deleted_interpolation}, {}
