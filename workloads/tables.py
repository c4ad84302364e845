"""The given tables in the roles the operators need, in Spark and as SQL common table expressions.

flows: lineitem as a labelled feature table, category = return flag with two rare groups by quantity, y = line status.
scored: events as scored rows of two models. truth: labels with documents. vectors / angles: embeddings.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions import vectors as V
from tarnfold.functions.hashing import MULTIPLIER, PRIME, SECOND
from tarnfold.operators.scaling import ANGLE_MAX, fit_minmax
from workloads.registry import table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RARE = ["bulk", "heavy"]
CATEGORIES = ["A", "N", "R", "bulk", "heavy"]
SCORED_GROUPS = ["click", "error", "purchase", "signup", "view"]
SCORED_RARE = ["error", "signup"]
DIM = 64


def flows(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), *NUMERIC,
        F.when(F.col("l_quantity") >= 50, "bulk").when(F.col("l_quantity") >= 49, "heavy")
        .otherwise(F.col("l_returnflag")).alias("category"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("y"), (F.col("l_suppkey") % 5).cast("int").alias("run"))


def flow_vectors(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf)
    return df.select(*KEY, "category", "y", "run", V.pack(NUMERIC).alias("features"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id", (F.col("user_id") % 5).cast("int").alias("run"), F.col("event_type").alias("grp"),
        F.when((F.col("user_id") % 3 == 0) | (F.col("event_type") == "error"), 1).otherwise(0).alias("y"),
        (F.col("value") / (F.col("value") + 50.0)).alias("prob_a"),
        (F.regexp_extract("props", r"(\d+)", 1).cast("double") / 100.0).alias("prob_b"),
        F.col("value")).withColumn("pred_a", (F.col("prob_a") >= 0.5).cast("int")) \
        .withColumn("pred_b", (F.col("prob_b") >= 0.5).cast("int"))


def scored_long(spark: SparkSession, sf: str) -> DataFrame:
    """Both models below each other: model, prob, pred."""
    s = scored(spark, sf)
    pair = F.array(F.struct(F.lit("a").alias("model"), F.col("prob_a").alias("prob"), F.col("pred_a").alias("pred")),
                   F.struct(F.lit("b").alias("model"), F.col("prob_b").alias("prob"), F.col("pred_b").alias("pred")))
    return s.select("event_id", "run", "grp", "y", F.inline(pair))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels")
    return lab.join(docs, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("pred_a"),
        (F.col("n_chars") > 1000).cast("int").alias("pred_b"), F.col("n_chars").cast("double").alias("score"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", (F.col("label") % 2).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("v"))


def angles(spark: SparkSession, sf: str) -> DataFrame:
    """The first four components scaled to [0, pi] over the table."""
    v = vectors(spark, sf)
    row = v.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(4) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    cells = [(F.col("v")[i] - F.lit(row[f"lo{i}"])) / F.lit(row[f"hi{i}"] - row[f"lo{i}"]) * F.lit(ANGLE_MAX) for i in range(4)]
    return v.select("vec_id", "label", "y", F.array(*cells).alias("x"))


def all_angles(spark: SparkSession, sf: str) -> DataFrame:
    """All components scaled to [0, pi] over the table."""
    v = vectors(spark, sf).withColumnRenamed("v", "x")
    return fit_minmax(v, "x", 0.0, ANGLE_MAX).apply(v, "x")


# --- the same in SQL --------------------------------------------------------------------------------------------

FLOWS = """flows AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         l_quantity, l_extendedprice, l_discount, l_tax,
         CASE WHEN l_quantity >= 50 THEN 'bulk' WHEN l_quantity >= 49 THEN 'heavy' ELSE l_returnflag END AS category,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, l_suppkey % 5 AS run
  FROM lineitem)"""

#: feature rows (pos, feature, x) next to the flow columns
FLOWS_LONG = FLOWS + """,
long AS (
  SELECT category, y, run, 0 AS pos, 'l_quantity' AS feature, l_quantity AS x FROM flows UNION ALL
  SELECT category, y, run, 1, 'l_extendedprice', l_extendedprice FROM flows UNION ALL
  SELECT category, y, run, 2, 'l_discount', l_discount FROM flows UNION ALL
  SELECT category, y, run, 3, 'l_tax', l_tax FROM flows)"""

SCORED = """scored AS (
  SELECT *, CASE WHEN prob_a >= 0.5 THEN 1 ELSE 0 END AS pred_a, CASE WHEN prob_b >= 0.5 THEN 1 ELSE 0 END AS pred_b
  FROM (SELECT event_id, user_id % 5 AS run, event_type AS grp,
               CASE WHEN user_id % 3 = 0 OR event_type = 'error' THEN 1 ELSE 0 END AS y,
               value / (value + 50.0) AS prob_a,
               CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) / 100.0 AS prob_b, value FROM events))"""

SCORED_LONG = SCORED + """,
models AS (
  SELECT event_id, run, grp, y, 'a' AS model, prob_a AS prob, pred_a AS pred FROM scored UNION ALL
  SELECT event_id, run, grp, y, 'b', prob_b, pred_b FROM scored)"""

TRUTH = """truth AS (
  SELECT l.doc_id, d.lang, d.source, l.quality AS y, 1 - l.toxic AS pred_a,
         CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS pred_b, CAST(d.n_chars AS DOUBLE) AS score
  FROM labels l JOIN documents d USING (doc_id))"""

VECTORS = """vectors AS (
  SELECT vec_id, label, label % 2 AS y, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""

VECTORS_LONG = VECTORS + """,
cells AS (
  SELECT vec_id, label, y, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM vectors)"""

ANGLES = VECTORS + """,
ranges AS (
  SELECT """ + ", ".join(f"min(v[{i + 1}]) AS lo{i}, max(v[{i + 1}]) AS hi{i}" for i in range(4)) + """ FROM vectors),
angles AS (
  SELECT vec_id, label, y, """ + ", ".join(
    f"(v[{i + 1}] - lo{i}) / (hi{i} - lo{i}) * {math.pi!r} AS x{i}" for i in range(4)) + """
  FROM vectors, ranges)"""


ALL_ANGLES = VECTORS_LONG + f""",
spans AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM cells GROUP BY pos),
angles AS (SELECT vec_id, label, y, pos, (x - lo) / (hi - lo) * {math.pi!r} AS x FROM cells JOIN spans USING (pos))"""


def sql_hash(values, seed) -> str:
    """The seeded hash as SQL text; values are nonnegative integer expressions."""
    acc = f"(CAST({seed} AS BIGINT) % {PRIME})"
    for v in values:
        acc = f"(({acc} * {MULTIPLIER} + (CAST({v} AS BIGINT) % {PRIME}) + 12345) % {PRIME})"
    sq = f"(({acc} * {acc}) % {PRIME})"
    return f"(((({sq} * {sq}) % {PRIME}) * {acc}) % {PRIME})"


def sql_rank(values, n: str, seed) -> str:
    """The draw of a rank 1..n."""
    return f"(1 + ({sql_hash(values, seed)} * {PRIME} + {sql_hash([*values, SECOND], seed)}) % {n})"


def sql_uniform(values, seed) -> str:
    return f"(({sql_hash(values, seed)} + 0.5) / {float(PRIME)!r})"


def sql_gaussian(values, seed) -> str:
    return (f"(sqrt(-2.0 * ln({sql_uniform([*values, 1], seed)})) * "
            f"cos({2.0 * math.pi!r} * {sql_uniform([*values, 2], seed)}))")


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"
