"""Hard negatives by slot-decomposed selection (operator 13).

An anchor's positives are the rows of its label that score highest against it; each positive opens a window of scores, from
``lower`` to ``upper`` hundredths of its own, in which the best rows of other labels are its hard negatives. Windows overlap, so
they are not searched one by one. Their upper limits, from high to low, cut an anchor's scores into disjoint slots; every block of
rows keeps the best ``negatives`` rows of each slot (a combiner), and the same selection merges the blocks' rows. As slots follow
each other downwards, a window's answer is the head of the list that begins at its own slot: one sorted list of
``slots * negatives`` rows answers all windows of an anchor, and rows below a window's lower limit fall off its end.

Anchors meet all rows in blocks on Spark, twice: for positives, then for negatives. No task holds more than one block of anchors
(``most`` bytes) and one part of the rows (``most`` bytes), and scores are formed in strips.

Scores are inner products of whole-numbered components, exact as long as they stay under 2 ** 53; higher ones come first, ties
by smaller id. Rows with a null id, label or vector, or with a component that is null, not finite or 2 ** 53 or more once scaled, take
no part. Vectors of different lengths do not meet. A repeated row is another row: it may be a positive of its copy, and an anchor that
occurs twice is answered twice. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import keep, table, width

#: Scores formed at a time.
STRIP = 1 << 22
#: Scores beyond this count as this, so that a hundred of them fit a long.
LARGEST = float(1 << 56)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten(), np.float64) for c in column.chunks] or [np.zeros(0)]).reshape(len(column), dim)


def best(scores: np.ndarray, most: int):
    """(row, column) of the ``most`` highest finite scores of every row; the first of equal ones. ``scores`` is used up."""
    found = []
    rows = np.arange(len(scores))
    for _ in range(min(most, scores.shape[1])):
        top = scores.argmax(axis=1)
        fine = scores[rows, top] > -np.inf
        if not fine.any():
            break
        found.append((rows[fine], top[fine]))
        scores[rows, top] = -np.inf
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _strips(left: dict, right: dict):
    """(rows of left, scores to all of right) in strips."""
    step = max(1, STRIP // max(1, len(right["id"])))
    for k in range(0, len(left["id"]), step):
        part = slice(k, k + step)
        yield part, left["v"][part] @ right["v"].T


def positive_rows(left: dict, right: dict, most: int) -> list:
    """Per anchor of ``left`` the best other rows of its label among ``right`` (sorted by id): (anchor, slot 0, id, score)."""
    out = []
    for part, scores in _strips(left, right):
        scores[(left["y"][part, None] != right["y"][None, :]) | (left["row"][part, None] == right["row"][None, :])] = -np.inf
        kept = scores.copy()
        i, j = best(scores, most)
        out.append((left["row"][part][i], np.zeros(len(i), np.int32), right["id"][j], kept[i, j]))
    return out


def negative_rows(left: dict, right: dict, most: int) -> list:
    """Per anchor and slot of ``left`` the best rows of other labels among ``right``. Slot k holds scores of at most limit k that
    exceed limit k + 1; unused limits are minus infinity."""
    out = []
    for part, scores in _strips(left, right):
        scores[left["y"][part, None] == right["y"][None, :]] = -np.inf
        limits = left["limits"][part]
        for k in range(limits.shape[1]):
            below = limits[:, k + 1, None] if k + 1 < limits.shape[1] else -np.inf
            slot = np.where((scores <= limits[:, k, None]) & (scores > below), scores, -np.inf)
            i, j = best(slot, most)
            out.append((left["row"][part][i], np.full(len(i), k, np.int32), right["id"][j], scores[i, j]))
    return out


def _meet(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int, most: int, find) -> DataFrame:
    """(anchor, slot, id, score): ``find`` over every block of anchors and part of the rows, then the best ``most`` of each slot."""
    names = [c for c in anchors.columns if c not in ("v", "dim")]
    slots = "limits" in names

    def read(t: pa.Table, dim: int) -> dict:
        out = {c: t.column(c).to_numpy() for c in ("row", "id", "y")} | {"v": _matrix(t.column("v"), dim)}
        order = np.argsort(out["id"], kind="stable")
        return {c: x[order] for c, x in out.items()} | ({"limits": _matrix(t.column("limits"), -1)[order]} if "limits" in t.column_names else {})

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, found = key[0].as_py(), []
        if left.num_rows and right.num_rows:
            found = find(read(left, dim), read(right, dim), most)
        cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0)] * 4
        cols[3] = cols[3].clip(-LARGEST, LARGEST)
        return pa.table([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int64)), pa.array(cols[3].astype(np.int64))],
                        ["anchor", "slot", "id", "score"])

    left = anchors.select("dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *names, "v")
    right = rows.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"),
                        "row", "id", "y", "v")
    if slots:
        left = left.withColumn("limits", F.transform("limits", lambda x: x.cast("double")))
    met = left.groupBy("dim", "block", "part").cogroup(right.groupBy("dim", "block", "part")).applyInArrow(run, "anchor long, slot int, id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def hundredths(part: int) -> Column:
    """``part`` hundredths of the column score, rounded down."""
    return F.expr(f"({part}L * score - pmod({part}L * score, 100L)) div 100L")


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95, scale: float = 256.0,
                        id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", most: int = 32 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row where ``is_anchor`` holds."""
    spark = rows.sparkSession
    scaled = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) < 2.0 ** 53 / scale), F.floor(x * F.lit(float(scale))).cast("double")))
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), scaled.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    known = keep(given.filter(fine).select(F.monotonically_increasing_id().alias("row"), "id", F.xxhash64("label").alias("y"), F.size("v").alias("dim"), "v", "anchor"))
    size = known.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.sum(F.col("dim") + F.lit(4)), F.lit(0))).first()
    mean = 8 * size[2] / max(1, size[0])
    parts = max(width(spark), int(size[0] * mean // most) + 1)
    blocks = int(size[1] * mean // most) + 1
    columns = ["row", "id", "y", "dim", "v"]
    everyone = known.select(*columns)
    asked = known.filter("anchor").select(*[F.col(c).alias(f"own_{c}") for c in columns]).toDF(*columns)  # names of its own, as it meets its table

    found = _meet(asked, everyone, blocks, parts, positives, positive_rows)
    windows = found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("place").alias("nth"),
                           hundredths(upper).alias("high"), (-hundredths(-lower)).alias("low"))
    windows = windows.filter("low <= high")
    windows = keep(windows.withColumn("slot", F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("high"))) - 1))
    limits = windows.groupBy("anchor").agg(F.sort_array(F.collect_set("high"), False).alias("limits"))
    padded = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("limits", i).cast("double"), F.lit(float("-inf"))))
    limited = asked.join(limits.withColumnRenamed("anchor", "row"), "row").withColumn("limits", padded)

    slots = _meet(limited, everyone, blocks, parts, negatives, negative_rows)
    lists = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("less"), "id"))).alias("list"))
    suffix = F.slice(F.filter("list", lambda e: e["slot"] >= F.col("slot")), 1, negatives)
    answers = windows.join(lists, "anchor").select("*", F.posexplode(F.filter(suffix, lambda e: -e["less"] >= F.col("low"))).alias("at", "e"))
    names = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return answers.join(names, "anchor").select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("negative_id"), "positive_score",
                                                (-F.col("e.less")).alias("negative_score"))


def op13_slots(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


SQL = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.y = b.y AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3"""

QUERIES, ORACLES = {"op13_slots": op13_slots}, {"op13_slots": SQL}
