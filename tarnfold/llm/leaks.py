"""Benchmark decontamination: size-partitioned MinHash containment search (operator 4). DataFrame functions only.

An item's shingles are hashed and its bottom-k MinHash sketch taken. k follows the item's size: an item of n shingles of
which a share t lies in a document misses at most floor((1 - t) n) of them there, so of its floor((1 - t) n) + 1 smallest
hashes at least one occurs in the document. Sketches are looked up in the shingles of documents, within size partitions
(powers of two): a document in a smaller partition than t n shingles cannot contain the item. The search thus finds every
pair at or above the threshold; each is then verified by the exact shingles, compared as text.

Words are cut at white space after A-Z are lowered. Items with fewer than ``size`` words have no shingle and match nothing.
A null text is empty, a null item id is skipped, and a null document id is reported as it is. Rows of one id with different
texts are judged one by one, repeated rows once. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.llm.common import WORD_BREAK, keep, lower_az, small, table


def _words(text):
    return F.filter(F.split(lower_az(F.coalesce(text.cast("string"), F.lit(""))), WORD_BREAK), lambda w: w != "")


def _shingles(rows: DataFrame, size: int, texts: bool, long_enough: bool = False) -> DataFrame:
    """``rows`` (row, ..., words) to one row per shingle position: h, and s (its text) if asked for. Rows known to be
    ``long_enough`` are not filtered: such a filter would be pushed below a join and cut every text into words there."""
    kept = [c for c in rows.columns if c != "words"]
    hashed = (rows if long_enough else rows.filter(F.size("words") >= size)).withColumn("_wh", F.transform("words", lambda w: F.xxhash64(w)))
    if not texts:
        hashed = hashed.drop("words")
    at = hashed.select("*", F.explode(F.sequence(F.lit(0), F.size("_wh") - size)).alias("_i"))
    h = F.xxhash64(*[F.col("_wh")[F.col("_i") + k] for k in range(size)]).alias("h")
    s = [F.concat_ws(" ", *[F.col("words")[F.col("_i") + k] for k in range(size)]).alias("s")] if texts else []
    return at.select(*kept, h, *s)


def _size_class(n):
    return F.floor(F.log2(n.cast("double"))).cast("int")


def item_sketches(items: DataFrame, size: int, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, n, h, s) of every distinct shingle, and (h, item, item_class) of the sketches."""
    rows = items.filter(F.col(id_col).isNotNull()) \
        .select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("item"), F.col(id_col).alias("item_id"), _words(F.col(text_col)).alias("words"))
    own = _shingles(rows, size, True).distinct()
    by = Window.partitionBy("item")
    own = own.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("_rank", F.row_number().over(by.orderBy("h", "s")))
    # floor and ceil with a little slack, so that the product's last bit never shortens a sketch
    spared = F.floor((1 - threshold) * F.col("n") + 1e-9)
    sketch = own.filter(F.col("_rank") <= spared + 1).select("h", "item", _size_class(F.ceil(threshold * F.col("n") - 1e-9)).alias("item_class"))
    return own.drop("_rank"), sketch.distinct()


def find_leaks(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row, id, item_id, shared, item_shingles, containment) for each document row that holds at least ``threshold`` of an
    item's distinct shingles; ``row`` is the hash of the document's id and text."""
    own, sketch = item_sketches(items, size, threshold, item_col, item_text_col)
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sized = rows.select("row", _words(F.col("text")).alias("words")).withColumn("doc_class", _size_class(F.size("words") - (size - 1)))
    found = keep(_shingles(sized, size, False).join(sketch, "h").filter(F.col("doc_class") >= F.col("item_class")).select("row", "item").distinct())
    some = rows.join(small(keep(found.select("row").distinct())), "row", "left_semi")
    some = some.select("row", "id", _words(F.col("text")).alias("words"))  # only texts with a candidate are cut into words again
    shared = _shingles(some, size, True, long_enough=True).join(own, ["h", "s"]).groupBy("row", "id", "item", "item_id", "n") \
        .agg(F.count_distinct("s").alias("shared")).filter(F.col("shared") >= F.ceil(threshold * F.col("n") - 1e-9))
    return shared.join(found, ["row", "item"]).groupBy("row", "id", "item_id") \
        .agg(F.max_by(F.struct("shared", "n"), F.col("shared") / F.col("n")).alias("best")) \
        .select("row", "id", "item_id", F.col("best.shared").alias("shared"), F.col("best.n").alias("item_shingles"),
                (F.col("best.shared") / F.col("best.n")).alias("containment"))


def drop_leaks(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    leaks = small(keep(find_leaks(docs, items, size, threshold, id_col, text_col).select(F.col("row").alias("_leak_row")).distinct()))
    tagged = docs.withColumn("_leak_row", F.xxhash64(F.col(id_col), F.col(text_col)))
    return tagged.join(leaks, "_leak_row", "left_anti").drop("_leak_row")


def op4_leaks(spark, sf_dir):
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "shared", "item_shingles", "containment")


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _duck_shingles(table_name: str, key: str) -> str:
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), {AZ}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return (f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s "
            f"FROM (SELECT {key}, {words} AS w FROM {table_name})")


QUERIES = {"op4_leaks": op4_leaks}
ORACLES = {"op4_leaks": f"""WITH d AS ({_duck_shingles('documents', 'doc_id')}), i AS ({_duck_shingles('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles"""}
