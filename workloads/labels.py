"""Inventory B: labels, lookups, filters, set differences, concatenation, clipping."""

from pyspark.sql import functions as F

from tarnfold.operators import labels as L
from tarnfold.operators import metrics
from tarnfold.session import bounded
from workloads import tables as t
from workloads.registry import query, table
from workloads.tables import FLOWS, SCORED, r


@query("b01_binary_label", """
SELECT o_orderstatus AS status, CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS label_binary, count(*) AS n
FROM orders GROUP BY ALL""")
def binary_label(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"))
    return o.withColumn("label_binary", L.binary_label("status", "O")).groupBy("status", "label_binary").agg(F.count("*").alias("n"))


@query("b02_category_lookup", """
SELECT c_custkey, coalesce(r_name, 'Unknown') AS category
FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
                         WHERE r_name <> 'ASIA') m ON c_nationkey = n_nationkey""")
def category_lookup(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    known = nation.join(bounded(region), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name <> 'ASIA'")
    out = L.lookup(table(spark, sf, "customer"), "c_nationkey", known, "n_nationkey", "r_name", "category")
    return out.select("c_custkey", "category")


FEATURES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("b03_feature_columns", f"WITH {FLOWS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, {r(f'max({c})', 'top')} FROM flows" for c in FEATURES))
def feature_columns(spark, sf):
    """Every column but the labels, with its filled rows and largest value."""
    df = t.flows(spark, sf)
    names = L.feature_columns(df, ["category", "y", "run"])
    row = df.agg(*[x for c in names for x in (F.count(c).alias(f"n_{c}"), F.max(F.col(c).cast("double")).alias(f"t_{c}"))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"t_{c}").alias("top")) for c in names])))


@query("b04_group_filter", f"""
WITH {FLOWS}
SELECT category, y, count(*) AS n, {r('sum(l_extendedprice)', 'total', 2)} FROM flows WHERE category IN ('bulk', 'heavy') GROUP BY ALL""", 2)
def group_filter(spark, sf):
    df = t.flows(spark, sf).filter(L.in_groups("category", t.RARE))
    return df.groupBy("category", "y").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"))


@query("b05_rare_mask", f"""
WITH {FLOWS}
SELECT run, count(*) AS n, count(*) FILTER (category IN ('bulk', 'heavy')) AS n_rare,
       {r("avg(l_tax) FILTER (category IN ('bulk', 'heavy'))", 'rare_tax')} FROM flows GROUP BY run""")
def rare_mask(spark, sf):
    df = L.group_mask(t.flows(spark, sf), "category", t.RARE)
    return df.groupBy("run").agg(F.count("*").alias("n"), F.count_if("is_rare").alias("n_rare"),
                                 F.avg(F.when(F.col("is_rare"), F.col("l_tax"))).alias("rare_tax"))


@query("b06_level_difference", """
WITH c AS (SELECT DISTINCT c_nationkey AS level FROM customer), s AS (SELECT DISTINCT s_nationkey AS level FROM supplier)
SELECT coalesce(c.level, s.level) AS level,
       CASE WHEN c.level IS NULL THEN 'only_in_right' WHEN s.level IS NULL THEN 'only_in_left' ELSE 'in_both' END AS side
FROM c FULL JOIN s ON c.level = s.level""")
def level_difference(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return L.level_difference(c, s, "k")


@query("b07_row_concat", """
SELECT part, count(*) AS n, round(sum(acctbal), 2) + 0.0 AS total FROM (
  SELECT 0 AS part, c_acctbal AS acctbal FROM customer UNION ALL SELECT 1, s_acctbal FROM supplier) GROUP BY part""", 2)
def row_concat(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_acctbal").alias("acctbal"))
    b = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("acctbal"))
    return L.concat_rows(a, b, tag="part").groupBy("part").agg(F.count("*").alias("n"), F.sum("acctbal").alias("total"))


@query("b08_column_concat", """
SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def column_concat(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", "n_chars")
    return L.concat_columns(left, table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


@query("b09_clip", """
SELECT l_returnflag, round(sum(greatest(0.02, least(0.06, l_tax))), 4) + 0.0 AS tax,
       round(sum(greatest(0.02, least(0.06, l_discount))), 4) + 0.0 AS discount FROM lineitem GROUP BY ALL""", 4)
def clip(spark, sf):
    df = L.clip_columns(table(spark, sf, "lineitem").select("l_returnflag", "l_tax", "l_discount"), ["l_tax", "l_discount"], 0.02, 0.06)
    return df.groupBy("l_returnflag").agg(F.sum("l_tax").alias("tax"), F.sum("l_discount").alias("discount"))


@query("b10_clip_report", """
SELECT feature, n, below, above, round((below + above) / n, 6) + 0.0 AS share FROM (
  SELECT 'l_tax' AS feature, count(*) AS n, count(*) FILTER (l_tax < 0.02) AS below, count(*) FILTER (l_tax > 0.06) AS above FROM lineitem
  UNION ALL
  SELECT 'l_discount', count(*), count(*) FILTER (l_discount < 0.02), count(*) FILTER (l_discount > 0.06) FROM lineitem)""")
def clip_report(spark, sf):
    return L.clip_report(table(spark, sf, "lineitem"), ["l_tax", "l_discount"], 0.02, 0.06)


@query("b11_unmapped_levels", """
SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY event_type""")
def unmapped_levels(spark, sf):
    known = spark.createDataFrame([("view",), ("click",)], "k string")
    return L.unmapped_levels(table(spark, sf, "events").select("event_type"), "event_type", known, "k")


@query("b12_zone_filter", f"""
WITH {SCORED}, p AS (SELECT prob_b AS score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY prob_b),
c AS (SELECT score, sum(neg) OVER (ORDER BY score DESC) * 1.0 / sum(neg) OVER () AS fpr,
             sum(pos) OVER (ORDER BY score DESC) * 1.0 / sum(pos) OVER () AS tpr FROM p)
SELECT {r('score', 'score')}, {r('fpr', 'fpr')}, {r('tpr', 'tpr')} FROM c WHERE fpr <= 0.10""")
def zone_filter(spark, sf):
    return metrics.roc_points(t.scored(spark, sf), [], "prob_b").filter("fpr <= 0.10")
