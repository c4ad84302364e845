"""Inventory E: frozen one-hot, scalers, fitted reductions, grouped refits, noise."""

import math

from pyspark.sql import functions as F

from tarnfold.functions import vectors as V
from tarnfold.operators import encoding as E
from tarnfold.operators import reduction, scaling
from tarnfold.plans import reduction as plan
from tarnfold.plans import shift
from workloads import tables as t
from workloads.registry import query, table
from workloads.tables import FLOWS, r, sql_gaussian

CUTOFF = "1998-01-01"


def order_split(spark, sf):
    """Orders before the cutoff train the encoder, later ones test it."""
    o = table(spark, sf, "orders")
    return o.filter(F.col("o_orderdate") < CUTOFF), o.filter(F.col("o_orderdate") >= CUTOFF)


ONEHOT = """train AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), test AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
levels AS (SELECT 'o_orderstatus_' || o_orderstatus AS slot, 1 AS place FROM train UNION SELECT 'o_orderpriority_' || o_orderpriority, 2 FROM train),
named AS (SELECT slot, row_number() OVER (ORDER BY place, slot) - 1 AS pos FROM levels)"""


@query("e01_frozen_one_hot", f"""
WITH {ONEHOT}
SELECT slot, pos, CAST((SELECT count(*) FROM test WHERE slot IN ('o_orderstatus_' || o_orderstatus, 'o_orderpriority_' || o_orderpriority)) AS BIGINT) AS hits
FROM named""")
def frozen_one_hot(spark, sf):
    train, test = order_split(spark, sf)
    onehot = E.FrozenOneHot.fit(train, [], ["o_orderstatus", "o_orderpriority"])
    coded = onehot.transform(test)
    slots = F.arrays_zip(F.array(*[F.lit(n) for n in onehot.names]).alias("slot"), F.col("features").alias("hit"))
    long = coded.select(F.posexplode(slots).alias("pos", "z")).select("pos", "z.*")
    return long.groupBy("slot", "pos").agg(F.sum("hit").cast("long").alias("hits"))


@query("e02_align_columns", """
SELECT o_orderkey, o_totalprice + 0.0 AS o_totalprice, 0.0::DOUBLE AS missing FROM orders""", 2)
def align_columns(spark, sf):
    return E.align_columns(["o_totalprice", "missing"], table(spark, sf, "orders"), ["o_orderkey"])


@query("e03_min_max", f"""
WITH train AS (SELECT * FROM lineitem WHERE l_linestatus = 'F'), p AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_tax) AS lt, max(l_tax) AS ht FROM train),
s AS (SELECT l_returnflag, greatest(0, least(1, (l_extendedprice - lo) / (hi - lo))) AS price, greatest(0, least(1, (l_tax - lt) / (ht - lt))) AS tax FROM lineitem, p WHERE l_linestatus = 'O')
SELECT l_returnflag, {r('avg(price)', 'price')}, {r('max(price)', 'top')}, {r('avg(tax)', 'tax')} FROM s GROUP BY l_returnflag""")
def min_max(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_tax")
    out = scaling.minmax_columns(li.filter("l_linestatus = 'F'"), li.filter("l_linestatus = 'O'"), ["l_extendedprice", "l_tax"])
    return out.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("price"), F.max("l_extendedprice").alias("top"), F.avg("l_tax").alias("tax"))


@query("e04_angles", f"WITH {t.ALL_ANGLES} SELECT vec_id, pos, {r('x', 'x')} FROM angles")
def angle_scaling(spark, sf):
    """Every component of every vector."""
    return t.all_angles(spark, sf).select("vec_id", F.posexplode("x").alias("pos", "x"))


@query("e05_standardize", f"""
WITH p AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2 FROM lineitem)
SELECT l_returnflag, {r('avg((l_quantity - m) / s)', 'quantity', 5)}, {r('max((l_quantity - m) / s)', 'top', 5)}, {r('stddev_pop((l_extendedprice - m2) / s2)', 'price_sd', 5)}
FROM lineitem, p GROUP BY l_returnflag""", 5)
def standardize(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", V.pack(["l_quantity", "l_extendedprice"]).alias("x"))
    out = scaling.fit_standard(li, "x").apply(li, "x")
    return out.groupBy("l_returnflag").agg(F.avg(F.col("x")[0]).alias("quantity"), F.max(F.col("x")[0]).alias("top"),
                                           F.stddev_pop(F.col("x")[1]).alias("price_sd"))


# closed form of the two-feature PCA: eigenvalues and the axis of a 2 x 2 covariance
PAIR_PCA = FLOWS + """,
u AS (SELECT *, (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS a,
  (l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) AS b FROM flows),
cov AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS saa, var_samp(b) AS sbb, covar_samp(a, b) AS sab FROM u),
eig AS (SELECT *, (saa + sbb) / 2 + sqrt(((saa - sbb) / 2) ** 2 + sab * sab) AS l1, (saa + sbb) / 2 - sqrt(((saa - sbb) / 2) ** 2 + sab * sab) AS l2 FROM cov),
axis AS (SELECT *, sab / sqrt(sab * sab + (l1 - saa) ** 2) AS va, (l1 - saa) / sqrt(sab * sab + (l1 - saa) ** 2) AS vb FROM eig),
signed AS (SELECT *, CASE WHEN (CASE WHEN abs(va) >= abs(vb) THEN va ELSE vb END) < 0 THEN -1 ELSE 1 END AS sg FROM axis)"""


@query("e06_reduction_fit_apply", f"""
WITH {PAIR_PCA}, s AS (SELECT category, sg * (va * (a - ma) + vb * (b - mb)) AS s1 FROM u, signed),
g AS (SELECT category, (s1 - min(s1) OVER ()) / (max(s1) OVER () - min(s1) OVER ()) * {math.pi!r} AS angle FROM s)
SELECT category, {r('avg(angle)', 'mean_angle', 5)}, {r('min(angle)', 'low', 5)}, {r('max(angle)', 'high', 5)} FROM g GROUP BY category""", 5)
def reduction_fit_apply(spark, sf):
    df = t.flow_vectors(spark, sf).withColumn("features", F.slice("features", 1, 2))
    df = scaling.fit_minmax(df, "features").apply(df, "features")
    fitted = plan.fit_reduction(df, ["l_quantity", "l_extendedprice"], "y", 2, 1)
    out = fitted.to_angles(df).withColumn("angle", F.col("angles")[0])
    return out.groupBy("category").agg(F.avg("angle").alias("mean_angle"), F.min("angle").alias("low"), F.max("angle").alias("high"))


@query("e07_scores_before_angles", f"""
WITH {PAIR_PCA}, s AS (SELECT category, sg * (va * (a - ma) + vb * (b - mb)) AS s1 FROM u, signed)
SELECT category, {r('avg(s1)', 'mean_score', 5)}, {r('stddev_pop(s1)', 'sd_score', 5)} FROM s GROUP BY category""", 5)
def scores_before_angles(spark, sf):
    df = t.flow_vectors(spark, sf).withColumn("features", F.slice("features", 1, 2))
    df = scaling.fit_minmax(df, "features").apply(df, "features")
    fitted = plan.fit_reduction(df, ["l_quantity", "l_extendedprice"], "y", 2, 1)
    out = fitted.to_scores(df).withColumn("s", F.col("scores")[0])
    return out.groupBy("category").agg(F.avg("s").alias("mean_score"), F.stddev_pop("s").alias("sd_score"))


@query("e08_refit_per_run", f"""
WITH {FLOWS}, p AS (SELECT run, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_quantity) AS lq, max(l_quantity) AS hq FROM flows WHERE y = 1 GROUP BY run),
s AS (SELECT run, greatest(0, least(1, (l_extendedprice - lo) / (hi - lo))) AS price, greatest(0, least(1, (l_quantity - lq) / (hq - lq))) AS quantity
      FROM flows JOIN p USING (run) WHERE y = 0)
SELECT run, count(*) AS n, {r('avg(price)', 'price')}, {r('avg(quantity)', 'quantity')} FROM s GROUP BY run""")
def refit_per_run(spark, sf):
    df = t.flow_vectors(spark, sf).select("run", "y", "features")
    params = scaling.fit_minmax_by(df.filter("y = 1"), "features", ["run"])
    out = scaling.apply_minmax_by(df.filter("y = 0"), params, "features", ["run"])
    return out.groupBy("run").agg(F.count("*").alias("n"), F.avg(F.col("features")[1]).alias("price"), F.avg(F.col("features")[0]).alias("quantity"))


@query("e08_pca_per_run")
def pca_per_run(spark, sf):
    v = t.vectors(spark, sf).withColumn("run", F.col("label") % 5)
    out = shift.per_run_scores(v, v, "v", t.DIM, "run", 4)
    return out.groupBy("run").agg(F.count("*").alias("n"), *[F.var_samp(F.col("scores")[i]).alias(f"var{i}") for i in range(4)])


SIGMAS = [0.0, 0.05, 0.1, 0.15, 0.2]


@query("e09_gaussian_noise", f"""
WITH {t.ALL_ANGLES}, levels AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.05::DOUBLE), (2, 0.1::DOUBLE), (3, 0.15::DOUBLE), (4, 0.2::DOUBLE)) v(lev, sigma)),
noisy AS (SELECT vec_id, sigma, pos, x + sigma * {sql_gaussian(['vec_id', 'lev', 'pos'], 11)} AS x FROM angles, levels)
SELECT vec_id, {r('sigma', 'sigma')}, pos, {r(f'greatest(0.0, least({math.pi!r}, x))', 'x')} FROM noisy""")
def gaussian_noise(spark, sf):
    noisy = scaling.add_noise(t.all_angles(spark, sf), "x", t.DIM, SIGMAS, ["vec_id"], 11)
    limited = scaling.Scaler([0.0] * t.DIM, [math.pi] * t.DIM, 0.0, math.pi, True).apply(noisy, "x")
    return limited.select("vec_id", "sigma", F.posexplode("x").alias("pos", "x"))


@query("e10_pca_scores_pair", f"""
WITH {PAIR_PCA} SELECT l_orderkey, l_linenumber, l_partkey, {r('sg * (va * (a - ma) + vb * (b - mb))', 'score', 5)} FROM u, signed""", 5)
def pca_scores_pair(spark, sf):
    df = t.flow_vectors(spark, sf).withColumn("features", F.slice("features", 1, 2))
    df = scaling.fit_minmax(df, "features").apply(df, "features")
    pca = reduction.fit_pca(df, "features", 1)
    return pca.transform(df, "features").select("l_orderkey", "l_linenumber", "l_partkey", F.col("scores")[0].alias("score"))
