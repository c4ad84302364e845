"""Inventory A: every source and sink as a round trip over a whole table."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.operators import scaling
from tarnfold.operators.encoding import FrozenOneHot
from tarnfold.sources import readers as R
from tarnfold.sources import writers as W
from workloads import tables as t
from workloads.registry import query, scratch, table
from workloads.summaries import RESULTS, results
from workloads.tables import VECTORS, r

ORDERS = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
                       T.StructField("difficulty_level", T.StringType())])
TOTALS = f"SELECT o_orderstatus, count(*) AS n, {r('sum(o_totalprice)', 'total', 2)} FROM orders GROUP BY o_orderstatus"


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("difficulty_level"))


def totals(df):
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("a01_csv_without_header", TOTALS, 2)
def csv_without_header(spark, sf):
    path = scratch(spark)
    orders(spark, sf).write.csv(path)
    return totals(R.read_flow_csv(spark, path, ORDERS))


@query("a02_csv_with_header", TOTALS, 2)
def csv_with_header(spark, sf):
    path = scratch(spark)
    W.write_csv_once(orders(spark, sf), path)
    return totals(R.read_csv(spark, path, ORDERS))


@query("a03_parquet_drop_id", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def parquet_drop_id(spark, sf):
    df = R.read_parquet(spark, f"{sf}/orders.parquet", ["o_orderkey", "no_such_column"])
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a04_csv_written_once", TOTALS, 2)
def csv_written_once(spark, sf):
    path = scratch(spark)
    W.write_csv_once(orders(spark, sf), path)
    W.write_csv_once(orders(spark, sf).limit(1), path)  # already there: ignored
    return totals(R.read_csv(spark, path, ORDERS))


@query("a05_parquet_per_run", "SELECT user_id % 5 AS run, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM events GROUP BY 1", 2)
def parquet_per_run(spark, sf):
    path = scratch(spark)
    ev = table(spark, sf, "events").select("event_id", "value", (F.col("user_id") % 5).cast("int").alias("run"))
    W.write_parquet_once(ev, path, "run")
    return spark.read.parquet(path).groupBy("run").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


NESTED = f"WITH {RESULTS} SELECT model, count(*) AS n, {r('sum(f1)', 'f1_total')} FROM results GROUP BY model"


@query("a06_json_results", NESTED)
def json_results(spark, sf):
    path = scratch(spark)
    W.write_json_results(W.nested_results(results(spark, sf), ["model"], "runs"), path)
    back = spark.read.json(path)
    return back.select("model", F.inline("runs")).groupBy("model").agg(F.count("*").alias("n"), F.sum("f1").alias("f1_total"))


@query("a07_json_source", NESTED)
def json_source(spark, sf):
    path = scratch(spark)
    W.write_json_results(W.nested_results(results(spark, sf), ["model"], "runs"), path)
    back = spark.read.option("multiLine", False).json(path)
    flat = back.select("model", F.inline("runs"))
    again = scratch(spark)
    flat.groupBy("model").agg(F.collect_list(F.struct("run", "sigma", "f1")).alias("runs")).repartition(2, "model").write.json(again)
    # one document per file, read as whole documents
    return R.read_results(spark, again).select("model", F.inline("runs")).groupBy("model").agg(F.count("*").alias("n"), F.sum("f1").alias("f1_total"))


@query("a08_sample_reuse", "SELECT l.quality, count(*) AS n FROM labels l GROUP BY l.quality")
def sample_reuse(spark, sf):
    path = scratch(spark)
    lab = table(spark, sf, "labels")
    rows = lab.count()
    R.read_sample_or_build(spark, path, rows, lambda: lab.limit(1))  # wrong size: rebuilt below
    kept = R.read_sample_or_build(spark, path, rows, lambda: lab)
    return R.read_sample_or_build(spark, path, kept.count(), lambda: lab.limit(1)).groupBy("quality").agg(F.count("*").alias("n"))


@query("a09_parameters", """SELECT slot, CAST(count(*) AS BIGINT) AS hits FROM (SELECT 'o_orderstatus_' || o_orderstatus AS slot FROM orders UNION ALL SELECT 'o_orderpriority_' || o_orderpriority FROM orders) GROUP BY slot
UNION ALL SELECT 'top_price', CAST(round(max(o_totalprice)) AS BIGINT) FROM orders""")
def parameters(spark, sf):
    o = table(spark, sf, "orders")
    onehot = FrozenOneHot.fit(o, [], ["o_orderstatus", "o_orderpriority"])
    scaler = scaling.fit_minmax(o.withColumn("x", F.array("o_totalprice")), "x")
    path = scratch(spark)
    W.save_parameters(spark, path, onehot, {"unit": scaler}, {"kept": [0]})
    loaded, scalers, _ = W.load_parameters(spark, path)
    coded = loaded.transform(o)
    hits = coded.select(F.inline(F.arrays_zip(F.array(*[F.lit(n) for n in loaded.names]).alias("slot"), F.col("features").alias("hit"))))
    out = hits.groupBy("slot").agg(F.sum("hit").cast("long").alias("hits"))
    top = scalers["unit"].shift[0] + scalers["unit"].scale[0]
    return out.unionByName(spark.createDataFrame([("top_price", int(round(top)))], "slot string, hits bigint"))


@query("a10_vector_sink", f"WITH {VECTORS} SELECT label, count(*) AS n, {r('sum(list_sum(v))', 'total')} FROM vectors GROUP BY label")
def vector_sink(spark, sf):
    path = scratch(spark)
    W.write_vectors(t.vectors(spark, sf), path, ["vec_id"], "v", "label")
    back = spark.read.parquet(path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("a11_run_set_reload", "SELECT user_id % 5 AS run, count(*) AS n FROM events GROUP BY 1")
def run_set_reload(spark, sf):
    path = scratch(spark)
    W.write_parquet_once(table(spark, sf, "events").select("event_id", (F.col("user_id") % 5).cast("int").alias("run")), path, "run")
    return R.read_runs(spark, path, 5).groupBy("run").agg(F.count("*").alias("n"))
