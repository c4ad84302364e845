"""Spelling variants by a variable-length gram index (operator 12).

Words are counted over whole texts; two words are near if one inserted, deleted or replaced code point turns one into the other.
The near words come from a gram index:

* The dictionary is pruned by frequency. A gram of ``least`` code points whose list would be long (it occurs in more than ``split``
  words, and is among the ``heavy`` most frequent ones) is not a gram of its own: it is extended, code point by code point, until
  its list is short or it has ``most`` code points. No gram begins another one, so which gram begins at a place depends on the
  gram's own code points only.
* A word, with a mark before it and marks behind it, falls into the gram that begins at each place.
* One edit touches only grams that hold its place. The most grams that any place has is the word's affected-gram bound: a near word
  shares all its other grams, at the same place or one further. With grams in one order, rare ones first, two near words therefore
  share a gram among their first ``bound + 1``, and only these are put on the lists. ``most`` is at most as long as the shortest
  word, so the bound is below the number of grams and no word has an empty share.
* Lists are kept by gram, length and place; merging meets a list with those of equal length, and of one more code point at the same
  place or the next. What meets is verified by its edit distance, then pairs found on several lists become one.

Long lists are dealt by adaptive execution, as both sides of the merge are shuffled; the heavy grams, at most ``heavy`` short strings, are
the only thing every task gets. A word's form is its near word of largest count, if that is ``ratio`` times its own or more; the root
follows forms to the last one by pointer doubling (counts grow by ``ratio`` a step, so a chain has few steps).

A null or empty text has no words; a null id counts as the empty text in the checksum. Repeated rows count each time. Ties of count go to the smallest
word in code-point order. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import keep, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Marks that no word holds: one before a word, as many behind it as grams need.
BEFORE, BEHIND = "\x01", "\x02"
#: Words that a task counts before it passes them on.
HELD = 200_000


def count_words(docs: DataFrame, drop_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters, A-Z in lower case. With ``drop_every``, a run whose checksum with its document's id is a multiple
    of it loses the code point that the checksum names."""
    def run(batches):
        held = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found = Counter(RUN.findall((text or b"").lower().decode()))
                if drop_every:
                    start, changed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), []
                    for word in found:
                        h = zlib.crc32(word.encode(), start)
                        if h % drop_every == 0:
                            changed.append((word, word[:h % len(word)] + word[h % len(word) + 1:]))
                    moved = [(new, found.pop(word)) for word, new in changed]
                    for new, n in moved:
                        found[new] += n
                held.update(found)
                if len(held) > HELD:
                    yield batch(held)
                    held = Counter()
        if held:
            yield batch(held)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def heavy_grams(words: DataFrame, least: int, most: int, split: int, heavy: int) -> set:
    """The grams of ``least`` to ``most - 1`` code points in more than ``split`` words, the ``heavy`` most frequent of them."""
    if most <= least:
        return set()
    padded = F.concat(F.lit(BEFORE), F.col("word"), F.lit(BEHIND * (most - 1)))
    grams = F.concat(*[F.expr(f"transform(sequence(1, length(word) + 1), i -> substring(padded, i, {q}))") for q in range(least, most)])
    counts = words.select(padded.alias("padded"), "word").select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    return {r.gram for r in counts.filter(F.col("words") > split).orderBy(F.desc("words"), "gram").limit(heavy).collect()}


def decompose(word: str, heavy: set, least: int, most: int) -> tuple[list, int]:
    """(gram beginning at each place, affected-gram bound) of a word."""
    padded, grams = BEFORE + word + BEHIND * (most - 1), []
    for p in range(len(word) + 1):
        q = least
        while q < most and padded[p:p + q] in heavy:
            q += 1
        grams.append(padded[p:p + q])
    return grams, max(sum(p <= i < p + len(grams[p]) for p in range(max(0, i - most + 1), min(i + 1, len(grams)))) for i in range(1, len(word) + 1))


def near_words(words: DataFrame, least: int = 2, most: int = 4, split: int = 64, heavy: int = 65_536) -> DataFrame:
    """(a, a_n, b, b_n) for every two near words of the kept table ``words`` (word, n: distinct words of ``most`` code points or more), both ways round."""
    long = words.sparkSession.sparkContext.broadcast(heavy_grams(words, least, most, split, heavy))

    def grams_of(batches):
        for b in batches:
            told = [decompose(w, long.value, least, most) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t[0] for t in told], pa.list_(pa.string())), pa.array([t[1] for t in told], pa.int32())],
                                             ["word", "n", "grams", "bound"])

    told = keep(words.select("word", "n").mapInArrow(grams_of, "word string, n long, grams array<string>, bound int"))
    placed = told.select("word", "n", "bound", F.posexplode("grams").alias("place", "gram"))
    sizes = placed.groupBy("gram").agg(F.count(F.lit(1)).alias("size"))
    ordered = placed.join(sizes, "gram").groupBy("word", "n", "bound").agg(F.sort_array(F.collect_list(F.struct("size", "gram", "place"))).alias("grams"))
    lists = keep(ordered.select("word", "n", F.length("word").alias("letters"), F.explode(F.slice("grams", 1, F.col("bound") + 1)).alias("g"))
                 .select("word", "n", "letters", F.col("g.gram").alias("gram"), F.col("g.place").alias("place")))
    key = ["gram", "letters", "place"]
    asks = F.array(*[F.struct((F.col("letters") + l).alias("letters"), (F.col("place") + p).alias("place"), F.lit(l).alias("more")) for l, p in ((0, 0), (1, 0), (1, 1))])
    asking = lists.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "gram", F.explode(asks).alias("k")).select("a", "a_n", "gram", "k.*")
    met = asking.join(lists.select(F.col("word").alias("b"), F.col("n").alias("b_n"), *key), key)
    good = met.filter(((F.col("more") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    pairs = keep(good.select("a", "a_n", "b", "b_n").distinct())
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row (word, form): the last word that forms lead to. Each round doubles the steps taken; kept between rounds."""
    found = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = keep(found.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        found = further.select("word", "root")
        if not further.filter("moved").limit(1).count():
            return found


def spelling_variants(words: DataFrame, fewest: int = 3, shortest: int = 5, ratio: int = 2, **index) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word (word, n) of ``shortest`` code points or more that occurs ``fewest`` times or more."""
    words = keep(words.filter((F.length("word") >= shortest) & (F.col("n") >= fewest)).select("word", "n"))
    near = near_words(words, **{"most": min(4, shortest)} | index)
    best = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    told = keep(words.join(best, "word", "left").withColumn("form", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.form")))
                .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.when(F.col("form").isNotNull(), -F.col("best.less")).alias("form_n")))
    ends = roots(told.filter("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_grams(spark, sf_dir):
    return spelling_variants(count_words(table(spark, sf_dir, "documents"), drop_every=97))


#: crc32 by its table of 256 remainders, which follow from the polynomial.
SQL = """WITH RECURSIVE rest AS MATERIALIZED (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) s(b)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
held AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM held),
summed AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(0, length(hx), 2), lambda i: CAST('0x' || substr(hx, i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, rest),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS star, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM words, range(1, 200) s(i) WHERE i <= length(word)),
near AS (SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.star = b.star AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.short = b.word),
best AS (SELECT a AS word, count(*) AS n_near, min({'less': -n, 'form': b}) AS best FROM near GROUP BY a),
told AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.form END AS form, CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS at FROM told UNION ALL SELECT s.word, t.form FROM steps s JOIN told t ON t.word = s.at WHERE t.form IS NOT NULL)
SELECT t.word, t.form, s.at AS root, t.n, t.n_near, t.form_n FROM told t JOIN steps s USING (word) JOIN told e ON e.word = s.at AND e.form IS NULL"""

QUERIES, ORACLES = {"op12_grams": op12_grams}, {"op12_grams": SQL}
