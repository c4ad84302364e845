"""Inventory K: shift experiments."""

import math

from pyspark.sql import functions as F

from tarnfold.operators import metrics, sampling, scaling
from tarnfold.operators import trainer as T
from tarnfold.plans import studies
from tarnfold.plans import shift as S
from workloads import tables as t
from workloads.registry import query
from workloads.sampling import POOLED_SAMPLE, counts, drawn
from workloads.summaries import RESULTS, results
from workloads.tables import ANGLES, FLOWS, KEY, SCORED_LONG, SCORED_RARE, r, sql_gaussian

SPLIT = SCORED_LONG + """, tested AS (SELECT *, CASE WHEN grp IN ('error', 'signup') THEN 'hard' ELSE 'standard' END AS split FROM models)"""


def tested(spark, sf):
    return t.scored_long(spark, sf).withColumn("split", F.when(F.col("grp").isin(SCORED_RARE), "hard").otherwise("standard"))


F1 = """coalesce(2 * count(*) FILTER (y = 1 AND pred = 1) / nullif(2 * count(*) FILTER (y = 1 AND pred = 1) + count(*) FILTER (y = 0 AND pred = 1) + count(*) FILTER (y = 1 AND pred = 0), 0), 0)"""


@query("k01_standard_vs_hard", f"""WITH {SPLIT}, f AS (SELECT run, model, split, {F1} AS f FROM tested GROUP BY ALL),
w AS (SELECT run, model, max(f) FILTER (split = 'standard') AS a, max(f) FILTER (split = 'hard') AS b FROM f GROUP BY ALL)
SELECT run, model, {r('a', 'f1_standard')}, {r('b', 'f1_hard')}, {r('a - b', 'drop_abs')}, {r('(a - b) / greatest(a, 1e-9) * 100', 'drop_pct')} FROM w""")
def standard_vs_hard(spark, sf):
    return S.standard_vs_hard(tested(spark, sf), ["run", "model"], average="binary")


@query("k01_hard_mcnemar", f"""WITH {t.SCORED}, c AS (SELECT run, 'b' AS baseline, count(*) FILTER (pred_a = y AND pred_b = y) AS both_right, count(*) FILTER (pred_a = y AND pred_b <> y) AS only_a,
  count(*) FILTER (pred_a <> y AND pred_b = y) AS only_b, count(*) FILTER (pred_a <> y AND pred_b <> y) AS both_wrong FROM scored WHERE grp IN ('error', 'signup') GROUP BY run)
SELECT *, {r('coalesce((abs(only_a - only_b) - 1) ** 2 / nullif(only_a + only_b, 0), 0)', 'statistic')} FROM c""")
def hard_mcnemar(spark, sf):
    return S.hard_test_mcnemar(tested(spark, sf), ["event_id"], "model", "a", ["run"]).drop("p_value")


@query("k02_run_matrix", f"""WITH {FLOWS}, p AS (SELECT run AS train_run, min(l_quantity) AS l0, max(l_quantity) AS h0, min(l_extendedprice) AS l1, max(l_extendedprice) AS h1 FROM flows WHERE y = 1 GROUP BY run),
s AS (SELECT train_run, run AS test_run, y, CASE WHEN 0.8::DOUBLE * (l_quantity - l0) / (h0 - l0) - 0.3::DOUBLE * (l_extendedprice - l1) / (h1 - l1) - 0.05::DOUBLE * (train_run + 1) > 0 THEN 1 ELSE 0 END AS pred FROM flows, p)
SELECT train_run, test_run, {r(F1, 'f1')}, {r('avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM s GROUP BY ALL""")
def run_matrix(spark, sf):
    df = t.flow_vectors(spark, sf).select("run", "y", F.slice("features", 1, 2).alias("x"))
    weights = df.select("run").distinct().select("run", F.array(F.lit(0.8), F.lit(-0.3)).alias("w"), (F.lit(-0.05) * (F.col("run") + 1)).alias("b"))
    out = S.run_matrix(df.filter("y = 1"), df, "x", "run", weights)
    return metrics.rates(metrics.confusion(out, ["train_run", "test_run"])).select("train_run", "test_run", "f1", "accuracy")


def run_pipelines(spark, sf):
    """Vectors by run, and for each run select 16 of 64 -> PCA to 4 -> angles -> classifier, learnt from that run alone."""
    v = t.vectors(spark, sf).withColumn("run", (F.col("vec_id") % 5).cast("int"))
    rows = T.study_rows(v, "v", "y", "run", "vec_id")
    return rows, studies.fitted_runs(rows, 16, 4)


@query("k02_fitted_matrix")
def fitted_matrix(spark, sf):
    """Every fitted run on the rows of every run."""
    return metrics.rates(studies.run_matrix(*run_pipelines(spark, sf))).select("train_run", "test_run", "f1", "accuracy")


@query("k03_fitted_noise")
def fitted_noise(spark, sf):
    """F1 of the fitted runs as their angles get noisier, and its slope."""
    rows, fits = run_pipelines(spark, sf)
    f1, slopes = S.noise_sweep(studies.noisy_scores(rows, fits, SIGMAS, ["vec_id"]), ["train_run"], average="binary")
    return f1.join(slopes.select("train_run", "slope"), "train_run").select("train_run", "sigma", "f1", "slope")


@query("e08_angles_by_run")
def angles_by_run(spark, sf):
    """Select, PCA and angles refitted on every run: ranges and sums of its angles."""
    v = t.vectors(spark, sf).withColumn("run", (F.col("vec_id") % 5).cast("int"))
    rows = T.study_rows(v, "v", "y", "run")
    moments = T.part_moments(rows)
    designs = studies.angle_designs(rows, moments, {frozenset([p]): {"run": p} for p in moments.parts}, 16, 4)
    out = T.project_designs(rows, designs, lambda d: set(d.learns)).select(F.col("part").alias("run"), F.posexplode("phi").alias("component", "angle"))
    return out.groupBy("run", "component").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.avg("angle").alias("mean"))


SIGMAS = [0.0, 0.05, 0.1, 0.15, 0.2]
NOISE = ANGLES + f""", levels AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.05::DOUBLE), (2, 0.1::DOUBLE), (3, 0.15::DOUBLE), (4, 0.2::DOUBLE)) v(lev, sigma)),
noisy AS (SELECT label % 5 AS run, y, sigma, CASE WHEN greatest(0.0, least({math.pi!r}, x0 + sigma * {sql_gaussian(['vec_id', 'lev', 0], 9)})) > {math.pi / 2!r} THEN 1 ELSE 0 END AS pred FROM angles, levels),
f AS (SELECT run, sigma, {F1} AS f1 FROM noisy GROUP BY ALL)"""


def noisy_predictions(spark, sf):
    noisy = scaling.add_noise(t.angles(spark, sf).withColumn("run", F.col("label") % 5), "x", 1, SIGMAS, ["vec_id"], 9)
    limited = scaling.Scaler([0.0], [math.pi], 0.0, math.pi, True).apply(noisy, "x")
    return limited.withColumn("pred", (F.col("x")[0] > math.pi / 2).cast("int"))


@query("k03_noise_sweep", f"WITH {NOISE} SELECT run, {r('sigma', 'sigma')}, {r('f1', 'f1')} FROM f")
def noise_sweep(spark, sf):
    return S.noise_sweep(noisy_predictions(spark, sf), ["run"], average="binary")[0]


@query("k03_noise_slope", f"WITH {NOISE} SELECT run, {r('regr_slope(f1, sigma)', 'slope')} FROM f GROUP BY run")
def noise_slope(spark, sf):
    return S.noise_sweep(noisy_predictions(spark, sf), ["run"], average="binary")[1]


@query("k04_prior_rebuild", f"""WITH {FLOWS}, {counts('flows', 'y')}, q1 AS (SELECT *, 150 AS quota FROM counts), {drawn('flows', 'q1', 42, 's1', 'y')},
q2 AS (SELECT y, n, CASE WHEN y = 1 THEN 210 ELSE 90 END AS quota FROM counts), {drawn('flows', 'q2', 43, 's2', 'y')},
c3 AS (SELECT category, count(*) AS n FROM flows WHERE category IN ('A', 'R') GROUP BY category), q3 AS (SELECT *, 150 AS quota FROM c3), {drawn('flows', 'q3', 44, 's3')},
u AS (SELECT 'half' AS distribution, l_orderkey, category, y FROM s1 UNION ALL SELECT 'seventy', l_orderkey, category, y FROM s2 UNION ALL SELECT 'only_R', l_orderkey, category, y FROM s3)
SELECT distribution, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM u GROUP BY distribution""")
def prior_rebuild(spark, sf):
    out = S.prior_rebuild(t.flows(spark, sf), 300, "y", "category", "A", "R", KEY)
    return out.groupBy("distribution").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.sum("l_orderkey").alias("key_sum"))


def _share_sql(i: int, share: float) -> str:
    return f"""z{i} AS (SELECT *, floor(least(max(CASE WHEN y = 0 THEN n END) OVER () / (1.0::DOUBLE - {share}::DOUBLE), max(CASE WHEN y = 1 THEN n END) OVER () / {share}::DOUBLE)) AS total FROM counts),
q{i} AS (SELECT y, n, CAST(least(CASE WHEN y = 0 THEN round_even(total * (1.0::DOUBLE - {share}::DOUBLE), 0) ELSE total - round_even(total * (1.0::DOUBLE - {share}::DOUBLE), 0) END, n) AS BIGINT) AS quota FROM z{i}),
{drawn('flows', f'q{i}', 42 + i, f's{i}', 'y')}"""


SHARES = [0.1, 0.5, 0.9]


@query("k05_prior_subsample", f"""WITH {FLOWS}, {counts('flows', 'y')}, {', '.join(_share_sql(i, s) for i, s in enumerate(SHARES))},
u AS ({' UNION ALL '.join(f"SELECT {s}::DOUBLE AS share, y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS pred FROM s{i}" for i, s in enumerate(SHARES))})
SELECT {r('share', 'share')}, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, {r(F1, 'f1')} FROM u GROUP BY share""")
def prior_subsample(spark, sf):
    out = S.prior_subsamples(t.flows(spark, sf), SHARES, "y", KEY).withColumn("pred", (F.col("l_quantity") > 25).cast("int"))
    f1 = metrics.rates(metrics.confusion(out, ["share"])).select("share", "f1", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"),
                                                                 (F.col("fn") + F.col("tp")).alias("positives"))
    return f1


@query("k06_invariance", f"WITH {RESULTS} SELECT count(*) AS \"rows\", 0.0::DOUBLE AS max_delta, 0 AS unmatched, true AS ok FROM results")
def invariance(spark, sf):
    """Results must not depend on how the rows are partitioned."""
    one = results(spark, sf)
    s = t.scored_long(spark, sf).repartition(13, "event_id")
    rows = s.withColumn("sigma", F.explode(F.array(*[F.lit(v) for v in SIGMAS])))
    rows = rows.withColumn("pred", (F.col("prob") >= F.lit(0.5) + F.col("sigma")).cast("int"))
    two = metrics.rates(metrics.confusion(rows, ["run", "model", "sigma"]))
    return S.unchanged(one, two, ["run", "model", "sigma"], "f1")


@query("k07_sample_of_shuffled_input", f"WITH {POOLED_SAMPLE} SELECT {', '.join(KEY)}, category, draw FROM sample")
def sample_of_shuffled_input(spark, sf):
    """The rows drawn do not depend on how the input is partitioned."""
    df = t.flows(spark, sf).repartition(13)
    return sampling.stratified_sample(df, 1000, "category", KEY, t.RARE, 50, "pooled", 42).select(*KEY, "category", "draw")
