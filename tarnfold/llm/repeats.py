"""Repeated passages by a depth-limited radix sort of suffixes (operator 11).

A suffix is a place in a text; only its first ``size`` bytes count. Most-significant-digit passes put suffixes of equal digits into groups, and a
group of one falls out at once; groups that are left at depth ``size`` are exactly the repeated windows. The order between groups
decides nothing, so groups are told apart by hashes of their digits. Digits are read so that few suffixes need a row:

1. The first digit is a gram of ``gram`` bytes, the one of the least hash inside the window (the first of equal ones). Equal windows
   choose it at the same offset, and neighbours mostly choose the same one, so a run of some ``(size - gram) / 2`` suffixes travels as one
   row. A run whose gram occurs nowhere else falls out.
2. The second digit of a run is all that its windows hold. A run found twice is repeated as a whole: its windows are done. Runs that share a
   gram with another, different run stay open, with one run to stand for those found twice.
3. Open runs are cut into ``step`` suffixes, at offsets counted from the gram; their digit is what those windows have in common. A piece
   found once falls out.
4. The last digit of each suffix left is its whole window.

Texts are known by 96 bits of hashes, equal texts are one text that is found several times. Runs and digits are counted by partial
aggregation, so that a passage of a third of all texts is one row a task. A batch settles runs found twice within it and passes on one of
them: a text of one letter is one row, not one for each byte. The table is scanned four times instead of being copied: it must
read the same each time. Where the texts to cut are few by their count, their numbers are broadcast and other texts are not shuffled.

Null texts count as empty. Texts shorter than ``size`` bytes keep everything. Rows keep their own row, repeated rows too (they are copies of
each other). Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import keep, once, table

#: Places looked at together; places within are numbers of 24 bits.
CHUNK = 1 << 18
PLACE = np.uint64((1 << 24) - 1)
KEY = ["k1", "k2"]
#: Most texts, and most entries of their lists, that are broadcast.
FEW, FEW_ENTRIES = 500_000, 4_000_000


def _numbers(size: int, gram: int):
    """(number of each byte, powers of an odd number, powers of its inverse), for sums of bytes by place modulo 2 ** 64."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    odd, n = 0xD6E8FEB86659FD93, CHUNK + size + gram
    up, down = np.full(n, odd, np.uint64), np.full(n, pow(odd, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return x ^ (x >> np.uint64(31)), np.cumprod(up), np.cumprod(down)


def gram_hashes(data: np.ndarray, gram: int, numbers) -> np.ndarray:
    """A hash of the ``gram`` bytes that begin at each place."""
    of_byte, up, down = numbers
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of_byte[data] * down[:len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[:len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_minima(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of every ``wide`` values in a row, by running minima of blocks from both sides."""
    n = len(values)
    blocks = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - wide + 1], ahead[wide - 1:n])


def runs(offsets: np.ndarray, data: np.ndarray, size: int, gram: int):
    """(text, first place, suffixes, place of the gram, its hash) of the runs of each chunk of texts that lie one after another."""
    numbers = once(f"bytes {size} {gram}", lambda: _numbers(size, gram))
    long = np.diff(offsets) >= size
    begins, ends = offsets[:-1][long], offsets[1:][long] - size + 1  # places where windows begin
    for c in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        end = min(c + CHUNK, int(offsets[-1]) - size + 1)
        a, b = np.searchsorted(ends, c, "right"), np.searchsorted(begins, end, "left")
        if a >= b:
            continue
        first, last = np.maximum(begins[a:b], c) - c, np.minimum(ends[a:b], end) - c
        h = gram_hashes(data[c:end + size - 1], gram, numbers)
        owner = window_minima((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), size - gram + 1) & PLACE
        cut = np.zeros(len(owner) + 1, bool)
        cut[1:-1] = owner[1:] != owner[:-1]
        cut[first] = cut[last] = True
        inside = np.zeros(len(owner) + 1, np.int8)
        inside[first] += 1
        inside[last] -= 1
        at = np.flatnonzero(cut)
        good = np.cumsum(inside, dtype=np.int8)[at] > 0
        start, stop = at[good], at[np.flatnonzero(good) + 1]
        yield np.searchsorted(offsets, start + c, "right") - 1, start + c, stop - start, owner[start].astype(np.int64) + c, h[owner[start].astype(np.int64)].view(np.int64)


def _bytes(column):
    """(offsets, bytes) of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data if data is not None else b"", np.uint8)


def _batch(names: str, *columns):
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def first_digits(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """(gram, times) of the chosen grams of each batch; twice stands for more."""
    def run(batches):
        for b in batches:
            found = [x[4] for x in runs(*_bytes(b.column(0)), size, gram)]
            if found:
                values, times = np.unique(np.concatenate(found), return_counts=True)
                yield _batch("gram long, times int", values, np.minimum(times, 2))

    return texts.select("text").mapInArrow(run, "gram long, times int")


RUN = "k1 long, k2 int, start int, n int, lead int, times int, gram long, whole long"


def all_runs(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """A row for each run, or for each sort of equal runs of a batch (times 2). Runs so found twice are done: rows of times 0 name their places, joined where they
    touch."""
    def run(batches):
        for b in batches:
            offsets, data = _bytes(b.column(2))
            whole = memoryview(data)
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            found = list(runs(offsets, data, size, gram))
            if not found:
                continue
            text, start, n, place, hashes = (np.concatenate(x) for x in zip(*found))
            digests = np.array([xxhash.xxh3_64_intdigest(whole[s:e]) for s, e in zip(start.tolist(), (start + n + size - 1).tolist())], np.uint64).view(np.int64)
            _, first, which, times = np.unique(np.stack([hashes, digests]), axis=1, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(times[which.ravel()] > 1)
            lead, start = place - start, start - offsets[text]
            yield _batch(RUN, k1[text[first]], k2[text[first]], start[first], n[first], lead[first], np.minimum(times, 2), hashes[first], digests[first])
            if len(again):
                new = np.ones(len(again), bool)
                new[1:] = (text[again][1:] != text[again][:-1]) | (start[again][1:] != start[again][:-1] + n[again][:-1])
                at, total = again[new], np.add.reduceat(n[again], np.flatnonzero(new))
                zero = np.zeros(len(at), np.int64)
                yield _batch(RUN, k1[text[at]], k2[text[at]], start[at], total, zero, zero, hashes[at], zero)

    return texts.select("k1", "k2", "text").mapInArrow(run, RUN)


def open_pieces(asked: DataFrame, size: int, step: int) -> DataFrame:
    """Pieces of open runs: what their windows have in common as two numbers, and the bytes of the piece before and behind that. ``asked`` holds k1, k2, text
    and the open runs of the text; copies of a text are read once a task."""
    schema = "c1 long, c2 long, k1 long, k2 int, start int, n int, ahead binary, behind binary"

    def run(batches):
        seen = set()
        for b in batches:
            out = []
            for k1, k2, text, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                whole = memoryview(text)
                for r in wanted:
                    s, e, place = r["start"], r["start"] + r["n"] - 1, r["start"] + r["lead"]
                    for j in range((place - e) // step, (place - s) // step + 1):
                        top = place - j * step
                        low, high, end = max(s, top - step + 1), min(e, top), top - step + 1 + size
                        c = xxhash.xxh3_128_digest(whole[top:end], j)
                        out.append((int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True), k1, k2, low, high - low + 1,
                                    text[low:top], text[end:high + size]))
                if len(out) > 20_000:
                    yield _batch(schema, *zip(*out))
                    out = []
            if out:
                yield _batch(schema, *zip(*out))

    return asked.mapInArrow(run, schema)


def cut_text(text: bytes, starts, counts, size: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs of them, bytes left) where windows begin at ``counts`` places from each start on."""
    order = np.argsort(starts, kind="stable")
    begin, end = np.asarray(starts, np.int64)[order], (np.asarray(starts, np.int64) + counts + size - 1)[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    at = np.flatnonzero(new)
    begin, end = begin[at], reach[np.append(at[1:] - 1, len(reach) - 1)]
    left = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)]))
    return len(text) - len(left), len(begin), left


def remove_repeats(docs: DataFrame, size: int = 400, gram: int = 128, step: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row: ``kept`` is what is left of the text, null where it is the whole text."""
    rows, cuts = _repeats(docs, size, gram, step, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return _cut(rows, cuts, size, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary", lambda x: x, F.lit(None).cast("binary")).withColumnRenamed("id", id_col)


def _repeats(docs: DataFrame, size: int, gram: int, step: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text as bytes, k1, k2) and, per text with repeats, the places where repeated windows begin (start, n)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"))
    long = rows.filter(F.octet_length("text") >= size)
    grams = first_digits(long, size, gram).groupBy("gram").agg(F.sum("times").alias("of")).filter("of > 1")
    found = keep(all_runs(long, size, gram).join(grams, "gram", "left").filter("times = 0 or of is not null").drop("of"))
    place = F.struct(*KEY, "start", "n", "lead")
    sorts = keep(found.filter("times > 0").groupBy("gram", "whole").agg(F.sum("times").alias("times"), F.min(place).alias("at")))
    twice = sorts.filter("times > 1").select("gram", "whole")
    sure = found.filter("times = 1").join(twice, ["gram", "whole"]).select(*KEY, "start", "n")
    several = sorts.groupBy("gram").agg(F.count(F.lit(1)).alias("sorts")).filter("sorts > 1").select("gram")
    asked = keep(sorts.join(several, "gram").select("at.*").groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "lead")).alias("wanted")))
    pieces = keep(open_pieces(long.select(*KEY, "text").join(_few(asked, "wanted"), KEY), size, step))
    digit = ["c1", "c2"]
    sorts = keep(pieces.groupBy(*digit, "ahead", "behind").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*KEY, "start", "n")).alias("at")))
    twice = sorts.filter("times > 1").select(*digit, "ahead", "behind")
    whole = pieces.join(twice, [*digit, "ahead", "behind"]).select(*KEY, "start", "n")
    several = sorts.groupBy(*digit).agg(F.count(F.lit(1)).alias("sorts")).filter("sorts > 1").select(*digit)
    last = sorts.join(several, digit).select(*digit, "ahead", "behind", "at", F.explode(F.sequence(F.lit(0), F.col("at.n") - 1)).alias("i")) \
        .select(*digit, F.expr("substring(ahead, i + 1)").alias("ahead"), F.expr(f"substring(behind, 1, i - octet_length(ahead) + {step - 1})").alias("behind"), "at", "i")
    window = [F.xxhash64(F.lit(i), *digit, F.octet_length("ahead"), "ahead", "behind").alias(f"w{i}") for i in (1, 2)]
    windows = keep(last.select(*window, "at.k1", "at.k2", (F.col("at.start") + F.col("i")).alias("start")))
    repeated = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("of")).filter("of > 1").drop("of")
    single = windows.join(repeated, ["w1", "w2"]).select(*KEY, "start", F.lit(1).alias("n"))
    done = found.filter("times = 0").select(*KEY, "start", "n")
    return rows, keep(done.unionByName(sure).unionByName(whole).unionByName(single).groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("cuts")))


def _few(kept: DataFrame, entries: str) -> DataFrame:
    """``kept``, marked for broadcast if its rows and the entries of its lists are few."""
    n, m = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(entries)), F.lit(0))).first()
    return F.broadcast(kept) if n <= FEW and m <= FEW_ENTRIES else kept


def _cut(rows: DataFrame, cuts: DataFrame, size: int, schema: str, of_kept, of_whole) -> DataFrame:
    """``schema`` for every row, its last column from what is kept: ``of_kept(bytes)`` of cut texts, the column ``of_whole`` of others."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for text, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                removed, spans, left = cut_text(text, [x["start"] for x in at], [x["n"] for x in at], size)
                out.append((len(text), removed, spans, of_kept(left)))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*out))], names)

    none = F.lit(0).cast("long")
    whole = [F.octet_length("text").cast("long").alias(names[1]), none.alias(names[2]), none.alias(names[3]), of_whole.alias(names[4])]
    few = cuts.count() <= FEW
    met = rows.join(F.broadcast(cuts.select(*KEY, F.lit(True).alias("hit"))) if few else cuts.withColumn("hit", F.lit(True)), KEY, "left")
    plain = met.filter("hit is null").select("id", *whole)
    hit = met.filter("hit").select("id", "text", *KEY).join(cuts, KEY) if few else met.filter("hit")
    return plain.unionByName(hit.select("id", "text", "cuts").mapInArrow(run, schema))


def op11_radix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows, cuts = _repeats(docs, 400, 128, 32, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _cut(rows, cuts, 400, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda x: hashlib.sha256(x).hexdigest(), F.sha2("text", 256)) \
        .withColumnRenamed("id", "doc_id")


#: A document's bytes as two hexadecimal digits each, in overlapping parts so that a window is near its part's start.
SQL = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT r, c, substr(x, 2 * c + 1, 1198) AS x FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 399, 200)) AS c FROM d WHERE length(x) >= 800)),
w AS MATERIALIZED (SELECT r, c + p AS p, hash(substr(x, 2 * p + 1, 800)) AS h FROM (SELECT r, c, x, unnest(range(least(200, length(x) // 2 - 399))) AS p FROM part)),
hit AS (SELECT r, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
cut AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY p) AS span FROM (SELECT r, p, CASE WHEN p > lag(p, 1, -1000) OVER (PARTITION BY r ORDER BY p) + 400 THEN 1 ELSE 0 END AS new FROM hit)),
spans AS (SELECT r, span, min(p) AS a, max(p) + 400 AS b FROM cut GROUP BY r, span),
left_ AS (SELECT r, a, substr(x, 2 * since + 1, 2 * (a - since)) AS part FROM (SELECT r, a, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM spans) JOIN d USING (r)
  UNION ALL SELECT r, b, substr(x, 2 * b + 1) FROM (SELECT r, max(b) AS b FROM spans GROUP BY r) JOIN d USING (r)),
cutting AS (SELECT r, string_agg(part, '' ORDER BY a) AS rest FROM left_ GROUP BY r),
counts AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM d LEFT JOIN counts USING (r) LEFT JOIN cutting USING (r)"""

QUERIES, ORACLES = {"op11_radix": op11_radix}, {"op11_radix": SQL}
