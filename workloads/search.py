"""Inventory F5-F8, F14-F21: choosing K and the number of components."""


from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnfold.operators import sampling
from tarnfold.operators import search as S
from tarnfold.plans import reduction as plan
from tarnfold.operators.resampling import Drawn, mean_intervals
from workloads import tables as t
from workloads.registry import query, table
from workloads.tables import FLOWS, r


def candidates(spark, sf):
    """One candidate per part size: v_n, s_n, dbi from the part table, q_n from the size; a result table of 50 rows."""
    p = table(spark, sf, "part").groupBy(F.col("p_size").alias("n")).agg(
        F.avg("p_retailprice").alias("price"), F.stddev_pop("p_retailprice").alias("sd"), F.count("*").alias("c"))
    whole = Window.partitionBy(F.lit(0))  # one row per size
    share = (F.col("price") - F.min("price").over(whole)) / (F.max("price").over(whole) - F.min("price").over(whole))
    return p.select("n", share.alias("v_n"), (F.col("c") / 10.0).alias("s_n"), (F.col("sd") / 100.0).alias("dbi"),
                    S.gate_cost(F.col("n"), 2, 50).alias("q_n"))


TOP = 50 * 2 + 5 * 2 * 50 * 49 / 2
CANDIDATES = f"""cand AS (SELECT p_size AS n, (avg(p_retailprice) - min(avg(p_retailprice)) OVER ()) / (max(avg(p_retailprice)) OVER () - min(avg(p_retailprice)) OVER ()) AS v_n, count(*) / 10.0 AS s_n, stddev_pop(p_retailprice) / 100.0 AS dbi,
  (p_size * 2 + 10 * (p_size * (p_size - 1) / 2)) / {TOP!r} AS q_n FROM part GROUP BY p_size),
norm AS (SELECT *, (s_n - min(s_n) OVER ()) / (max(s_n) OVER () - min(s_n) OVER ()) AS s_norm,
  1.0 - (dbi - min(dbi) OVER ()) / (max(dbi) OVER () - min(dbi) OVER ()) AS dbi_norm FROM cand)"""

# the same simplex points, in grid order
GRID = """grid AS (SELECT i * 31 + j AS point, i / 30.0::DOUBLE AS alpha, j / 30.0::DOUBLE AS beta, (30 - i - j) / 30.0::DOUBLE AS gamma
  FROM (SELECT unnest(range(0, 31)) AS i), (SELECT unnest(range(0, 31)) AS j)
  WHERE i + j <= 30 AND i / 30.0::DOUBLE >= 0.05 AND j / 30.0::DOUBLE >= 0.05 AND (30 - i - j) / 30.0::DOUBLE <= 0.5),
live AS (SELECT * FROM norm WHERE v_n >= 0.4),
f AS (SELECT point, alpha, beta, gamma, n, dbi, alpha * v_n + beta * s_norm - gamma * q_n AS f FROM grid, live),
log AS (SELECT point, alpha, beta, gamma, n AS best_n, dbi, f AS f_score FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY f DESC, n) AS rk FROM f) WHERE rk = 1),
won AS (SELECT * FROM log ORDER BY dbi, point LIMIT 1)"""


def gated(spark, sf):
    return S.variance_gate(S.normalize_metrics(candidates(spark, sf)), 0.4)


@query("f06_elbow", """
WITH m AS (SELECT p_size AS k, avg(p_retailprice) / 1000.0 AS f1_mean FROM part GROUP BY p_size), b AS (SELECT *, max(f1_mean) OVER () AS top FROM m)
SELECT min(k) FILTER (f1_mean >= top - 0.05) AS k_final, min(k) FILTER (f1_mean = top) AS k_optimal, round(max(f1_mean), 6) + 0.0 AS best_mean FROM b""")
def elbow(spark, sf):
    means = table(spark, sf, "part").groupBy(F.col("p_size").alias("k")).agg((F.avg("p_retailprice") / 1000.0).alias("f1_mean"))
    return S.elbow(means, slack=0.05)


@query("f14_gate_cost", f"""
SELECT DISTINCT p_size AS n, round((p_size * 3 + 15 * (p_size * (p_size - 1) / 2)) / {10 * 3 + 15 * 45.0!r}, 6) + 0.0 AS q_n FROM part""")
def gate_cost(spark, sf):
    return table(spark, sf, "part").select(F.col("p_size").alias("n")).distinct().withColumn("q_n", S.gate_cost(F.col("n"), 3))


@query("f15_normalize_metrics", f"WITH {CANDIDATES} SELECT n, {r('s_norm', 's_norm')}, {r('dbi_norm', 'dbi_norm')} FROM norm")
def normalize_metrics(spark, sf):
    return S.normalize_metrics(candidates(spark, sf)).select("n", "s_norm", "dbi_norm")


@query("f16_variance_gate", f"WITH {CANDIDATES} SELECT n, {r('v_n', 'v_n')} FROM norm WHERE v_n >= 0.4")
def variance_gate(spark, sf):
    return gated(spark, sf).select("n", "v_n")


@query("f17_weight_search", f"""WITH {CANDIDATES}, {GRID}
SELECT point, {r('alpha', 'alpha')}, {r('beta', 'beta')}, {r('gamma', 'gamma')}, best_n, {r('dbi', 'dbi')}, {r('f_score', 'f_score')} FROM log""")
def weight_search(spark, sf):
    return S.weight_search(gated(spark, sf))


@query("f17_best_weights", f"""WITH {CANDIDATES}, {GRID}
SELECT {r('alpha', 'alpha')}, {r('beta', 'beta')}, {r('gamma', 'gamma')}, best_n, {r('dbi', 'dbi')} FROM won""")
def best_weights(spark, sf):
    return S.best_weights(S.weight_search(gated(spark, sf)))


CHOSEN = CANDIDATES + ", " + GRID + """,
s AS (SELECT live.*, alpha * v_n + beta * s_norm - gamma * q_n AS f_n FROM live, (SELECT alpha, beta, gamma FROM won)),
c AS (SELECT *, n = first_value(n) OVER (ORDER BY f_n DESC, n) AS chosen FROM s),
front AS (SELECT n FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.v_n >= a.v_n AND b.s_norm >= a.s_norm AND b.q_n <= a.q_n
  AND (b.v_n > a.v_n OR b.s_norm > a.s_norm OR b.q_n < a.q_n)))"""


@query("f18_objective_choice", f"WITH {CHOSEN} SELECT n, {r('f_n', 'f_n')}, chosen FROM c")
def objective_choice(spark, sf):
    cand = gated(spark, sf)
    return S.choose(cand, S.best_weights(S.weight_search(cand))).select("n", "f_n", "chosen")


@query("f19_pareto_front", f"WITH {CHOSEN} SELECT n FROM front")
def pareto_front(spark, sf):
    return S.pareto_front(gated(spark, sf)).select("n")


@query("f21_candidate_report", f"""WITH {CHOSEN}
SELECT m.n, {r('m.v_n', 'v_n')}, CASE WHEN c.chosen THEN 'chosen' WHEN f.n IS NOT NULL THEN 'pareto' WHEN c.n IS NULL THEN 'rejected' ELSE 'candidate' END AS status
FROM norm m LEFT JOIN c ON c.n = m.n LEFT JOIN front f ON f.n = m.n""")
def candidate_report(spark, sf):
    return plan.pareto_choice(candidates(spark, sf), 0.4).select("n", "v_n", "status")


BOOT = FLOWS + f""",
ranked AS (SELECT y, l_quantity, row_number() OVER (ORDER BY {t.sql_hash(t.KEY, 42)}, {', '.join(t.KEY)}) AS rn FROM flows),
slots AS (SELECT id // 500 AS replicate, {t.sql_rank(['id'], '(SELECT count(*) FROM flows)', 43)} AS rn FROM (SELECT unnest(range(0, 20000)) AS id)),
drawn AS (SELECT replicate, y, l_quantity FROM slots JOIN ranked USING (rn))"""


@query("f20_bootstrap_rows", f"WITH {BOOT} SELECT replicate, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, {r('avg(l_quantity)', 'quantity')} FROM drawn GROUP BY replicate")
def bootstrap_rows(spark, sf):
    drawn = S.bootstrap_rows(t.flows(spark, sf), t.KEY, 40, 500)
    return drawn.groupBy("replicate").agg(
        F.sum("times").alias("n"), F.sum(F.col("times") * F.col("y")).alias("positives"),
        (F.sum(F.col("times") * F.col("l_quantity")) / F.sum("times")).alias("quantity"))


@query("f20_bootstrap_interval", f"""WITH {BOOT}, m AS (SELECT replicate, avg(l_quantity) AS q FROM drawn GROUP BY replicate)
SELECT {r('avg(q)', 'mean')}, {r('stddev_pop(q)', 'std')}, {r('quantile_cont(q, 0.025)', 'low')}, {r('quantile_cont(q, 0.975)', 'high')} FROM m""")
def bootstrap_interval(spark, sf):
    drawn = S.bootstrap_rows(t.flows(spark, sf), t.KEY, 40, 500)
    per = drawn.groupBy("replicate").agg((F.sum(F.col("times") * F.col("l_quantity")) / F.sum("times")).alias("q"))
    return S.interval(per, "q")


@query("f20_table_intervals")
def table_intervals(spark, sf):
    """Two hundred resamples as large as the table: means of four columns and the share of positives."""
    names = [*t.NUMERIC, "y"]
    return mean_intervals(Drawn(t.flows(spark, sf).select(*t.KEY, *t.NUMERIC, "y"), t.KEY), names)


@query("f20_objective_intervals")
def objective_intervals(spark, sf):
    v = t.vectors(spark, sf)
    metrics = plan.component_metrics(v, "v", "y", range(2, 9))
    cand = S.normalize_metrics(metrics)
    s = metrics.agg(F.min("s_n"), F.max("s_n")).first()
    return plan.objective_intervals(v, "v", "y", ["vec_id"], cand, {"alpha": 0.4, "beta": 0.4, "gamma": 0.2}, s[0], (s[1] - s[0]) or 1.0, 50, 500)


@query("f17_component_search")
def component_search(spark, sf):
    metrics = plan.component_metrics(t.vectors(spark, sf), "v", "y", range(2, 11))
    return plan.pareto_choice(metrics, 0.05)


def fold_vectors(spark, sf, k=3):
    """Embeddings with folds balanced on the class; y is the class half."""
    v = t.vectors(spark, sf).withColumn("y", (F.col("label") >= 5).cast("int")).withColumn("features", F.col("v"))
    return sampling.stratified_folds(v, k, "label", ["vec_id"])


KS = [4, 6, 8, 10, 12, 15, 20, 25, 30, 40, 50, t.DIM]


@query("f05_k_search")
def k_search(spark, sf):
    """Twelve feature counts, five folds: sixty converged fits in one plan."""
    names = [f"v{i}" for i in range(t.DIM)]
    return plan.k_search(fold_vectors(spark, sf, 5), names, "y", KS, "fold", 5)


@query("f07_ablation")
def ablation(spark, sf):
    """Five pipelines, five folds."""
    names = [f"v{i}" for i in range(t.DIM)]
    return plan.ablation(fold_vectors(spark, sf, 5), names, "y", 16, 4, "fold", 5)


