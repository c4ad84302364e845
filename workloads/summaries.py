"""Inventory C: distributions, multi-run summaries, comparisons of result tables."""

from pyspark.sql import functions as F

from tarnfold.operators import metrics, ranking, sampling, scoring
from tarnfold.operators import summaries as S
from workloads import tables as t
from workloads.registry import query, table
from workloads.sampling import POOLED_SAMPLE
from workloads.tables import FLOWS, FLOWS_LONG, SCORED, SCORED_LONG, r

LEVELS = [0.0, 0.05, 0.1, 0.15, 0.2]


def results(spark, sf):
    """(run, model, sigma, f1): both models at thresholds 0.5 + sigma; one pass over the rows."""
    s = t.scored_long(spark, sf)
    rows = s.withColumn("sigma", F.explode(F.array(*[F.lit(v) for v in LEVELS])))
    rows = rows.withColumn("pred", (F.col("prob") >= F.lit(0.5) + F.col("sigma")).cast("int"))
    return metrics.rates(metrics.confusion(rows, ["run", "model", "sigma"])).select("run", "model", "sigma", "f1")


RESULTS = SCORED_LONG + """,
results AS (
  SELECT run, model, sigma, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM (
    SELECT run, model, sigma, count(*) FILTER (y = 1 AND prob >= 0.5 + sigma) AS tp,
           count(*) FILTER (y = 0 AND prob >= 0.5 + sigma) AS fp, count(*) FILTER (y = 1 AND prob < 0.5 + sigma) AS fn
    FROM models, (SELECT unnest([0.0::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE, 0.15::DOUBLE, 0.2::DOUBLE]) AS sigma)
    GROUP BY ALL))"""


@query("c01_label_distribution", f"""
WITH {FLOWS}, c AS (SELECT category, y, count(*) AS n FROM flows GROUP BY ALL)
SELECT category, y, n, {r('n * 100.0 / sum(n) OVER ()', 'percent')} FROM c""")
def label_distribution(spark, sf):
    return S.label_distribution(t.flows(spark, sf), ["category", "y"]).orderBy("category", "y")


@query("c02_share_comparison", f"""
WITH {POOLED_SAMPLE},
s AS (SELECT category, count(*) AS n_sample, count(*) * 100.0 / sum(count(*)) OVER () AS pct_sample FROM sample GROUP BY category),
o AS (SELECT category, count(*) AS n_source, count(*) * 100.0 / sum(count(*)) OVER () AS pct_source FROM flows GROUP BY category)
SELECT category, coalesce(n_sample, 0) AS n_sample, {r('coalesce(pct_sample, 0)', 'pct_sample')}, n_source,
       {r('pct_source', 'pct_source')}, category IN ('bulk', 'heavy') AND coalesce(pct_sample, 0) > pct_source + 2 AS oversampled
FROM o LEFT JOIN s USING (category)""")
def share_comparison(spark, sf):
    df = t.flows(spark, sf)
    sample = sampling.stratified_sample(df, 1000, "category", t.KEY, t.RARE, 50, "pooled", 42)
    return S.share_comparison(sample, df, "category", t.RARE)


@query("c03_run_summary", f"""
WITH {RESULTS}
SELECT model, {r('sigma', 'sigma')}, count(*) AS runs, {r('avg(f1)', 'f1_mean')}, {r('stddev_samp(f1)', 'f1_std')} FROM results GROUP BY model, sigma""")
def run_summary(spark, sf):
    return S.run_summary(results(spark, sf), ["model", "sigma"], ["f1"])


@query("c04_paired_drop", f"""
WITH {RESULTS}, w AS (SELECT run, model, max(f1) FILTER (sigma = 0.0) AS a, max(f1) FILTER (sigma = 0.2) AS b FROM results GROUP BY ALL)
SELECT run, model, {r('a', 'f1_standard')}, {r('b', 'f1_hard')}, {r('a - b', 'drop_abs')},
       {r('(a - b) / greatest(a, 1e-9) * 100', 'drop_pct')} FROM w""")
def paired_drop(spark, sf):
    wide = results(spark, sf).groupBy("run", "model").agg(
        F.max(F.when(F.col("sigma") == 0.0, F.col("f1"))).alias("f1_standard"),
        F.max(F.when(F.col("sigma") == 0.2, F.col("f1"))).alias("f1_hard"))
    return S.paired_drop(wide, "f1_standard", "f1_hard")


@query("c05_pivot", f"""
WITH {RESULTS}
SELECT run, {r('max(f1) FILTER (model = $$a$$)', 'a')}, {r('max(f1) FILTER (model = $$b$$)', 'b')} FROM results WHERE sigma = 0.0 GROUP BY run""")
def pivot(spark, sf):
    return S.to_wide(results(spark, sf).filter("sigma = 0.0"), ["run"], "model", ["a", "b"], "f1")


@query("c06_spread", f"""
WITH {RESULTS} SELECT run, model, {r('stddev_pop(f1)', 'spread')} FROM results GROUP BY ALL""")
def spread(spark, sf):
    return S.spread(results(spark, sf), ["run", "model"], "f1")


@query("c07_slope", f"""
WITH {RESULTS} SELECT run, model, {r('regr_slope(f1, sigma)', 'slope')} FROM results GROUP BY ALL""")
def slope(spark, sf):
    return S.slope(results(spark, sf), ["run", "model"], "sigma", "f1")


@query("c08_representative_run", f"""
WITH {RESULTS}, m AS (SELECT *, round(abs(f1 - avg(f1) OVER (PARTITION BY model)), 12) AS gap FROM results WHERE sigma = 0.0)
SELECT model, (array_agg(run ORDER BY gap, run))[1] AS nearest_mean, (array_agg(run ORDER BY f1 DESC, run))[1] AS best FROM m GROUP BY model""")
def representative_run(spark, sf):
    return S.representative_runs(results(spark, sf).filter("sigma = 0.0"), ["model"], "run", "f1")


@query("c09_quartiles", f"""
WITH {SCORED} SELECT grp, y, {r('quantile_cont(value, 0.25)', 'p25')}, {r('quantile_cont(value, 0.5)', 'median')},
  {r('quantile_cont(value, 0.75)', 'p75')} FROM scored GROUP BY ALL""")
def quartiles(spark, sf):
    return S.quartiles(t.scored(spark, sf), ["grp", "y"], "value")


@query("c10_marginal_gain", f"""
WITH {RESULTS}, m AS (SELECT model, sigma, avg(f1) AS f1_mean FROM results GROUP BY ALL)
SELECT model, {r('sigma', 'sigma')}, {r('f1_mean', 'f1_mean')}, round((f1_mean - lag(f1_mean) OVER w) / (sigma - lag(sigma) OVER w), 6) + 0.0 AS gain
FROM m WINDOW w AS (PARTITION BY model ORDER BY sigma)""")
def marginal_gain(spark, sf):
    means = results(spark, sf).groupBy("model", "sigma").agg(F.avg("f1").alias("f1_mean"))
    return S.marginal_gain(means, "sigma", "f1_mean", ["model"])


@query("c11_result_delta", f"""
WITH {RESULTS}, a AS (SELECT run, sigma, f1 FROM results WHERE model = 'a'), b AS (SELECT run, sigma, f1 FROM results WHERE model = 'b')
SELECT run, {r('sigma', 'sigma')}, {r('a.f1', 'f1_a')}, {r('b.f1', 'f1_b')}, {r('a.f1 - b.f1', 'f1_delta')} FROM a JOIN b USING (run, sigma)""")
def result_delta(spark, sf):
    res = results(spark, sf)
    return S.result_delta(res.filter("model = 'a'"), res.filter("model = 'b'"), ["run", "sigma"], ["f1"])


@query("c12_confusion_rebuild", f"""
WITH {SCORED_LONG} SELECT run, model, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM models GROUP BY ALL""")
def confusion_rebuild(spark, sf):
    rates = metrics.rates(metrics.confusion(t.scored_long(spark, sf), ["run", "model"]))
    published = rates.select("run", "model", "precision", "recall", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"),
                             (F.col("fn") + F.col("tp")).alias("n_pos"))
    return S.rebuild_confusion(published, "precision", "recall", "n", "n_pos").select("run", "model", "tn", "fp", "fn", "tp")


SCORE_TABLE = FLOWS_LONG + """,
stats AS (SELECT feature, pos, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY ALL),
grand AS (SELECT feature, sum(n * m) / sum(n) AS g FROM stats GROUP BY feature),
fscore AS (SELECT feature, pos, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score
           FROM stats JOIN grand USING (feature) GROUP BY feature, pos),
binned AS (SELECT feature, y, least((rank() OVER (PARTITION BY feature ORDER BY x) - 1) * 10 // count(*) OVER (PARTITION BY feature), 9) AS bin FROM long),
joint AS (SELECT feature, bin, y, count(*) AS c FROM binned GROUP BY ALL),
shares AS (SELECT feature, c * 1.0 / sum(c) OVER (PARTITION BY feature) AS p,
                  sum(c) OVER (PARTITION BY feature, bin) * 1.0 / sum(c) OVER (PARTITION BY feature) AS pb,
                  sum(c) OVER (PARTITION BY feature, y) * 1.0 / sum(c) OVER (PARTITION BY feature) AS pc FROM joint),
mi AS (SELECT feature, sum(p * ln(p / (pb * pc))) AS mi FROM shares GROUP BY feature)"""


@query("c13_rank_shift", f"""
WITH {SCORE_TABLE},
ranked AS (SELECT feature, row_number() OVER (ORDER BY f_score DESC, pos) AS rank_f,
                  rank() OVER (ORDER BY mi DESC) + (count(*) OVER (PARTITION BY mi) - 1) // 2 AS rank_mi FROM fscore JOIN mi USING (feature))
SELECT feature, rank_f, rank_mi, rank_f - rank_mi AS rank_shift FROM ranked""")
def rank_shift(spark, sf):
    f = scoring.anova(t.flow_vectors(spark, sf), "features", "y", t.NUMERIC, pvalues=False).select("feature", "pos", "f_score")
    mi = scoring.binned_mutual_information(t.flows(spark, sf), t.NUMERIC, "y").select("feature", "mutual_information")
    return S.rank_shift(f.join(mi, "feature"), "f_score", "mutual_information").select("feature", "rank_f", "rank_mi", "rank_shift")


@query("c14_extremes", """
WITH s AS (SELECT p_partkey, p_retailprice AS score FROM part)
(SELECT p_partkey, round(score, 6) + 0.0 AS score, 'top' AS "end" FROM s ORDER BY s.score DESC, p_partkey LIMIT 30)
UNION ALL (SELECT p_partkey, round(score, 6) + 0.0, 'bottom' FROM s ORDER BY s.score, p_partkey DESC LIMIT 20)""")
def extremes(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("score"))
    return S.extremes(df, "score", "p_partkey", 30, 20)


@query("c15_cost_summary", f"""
WITH {SCORED}, m AS (SELECT grp, run, avg(value) FILTER (prob_b < 0.9) AS seconds, avg(pred_a) AS f1 FROM scored GROUP BY ALL),
s AS (SELECT grp, avg(seconds) AS sm, stddev_samp(seconds) AS ss, avg(f1) AS vm, stddev_samp(f1) AS vs FROM m WHERE seconds IS NOT NULL GROUP BY grp)
SELECT grp, {r('sm', 'seconds_mean')}, {r('ss', 'seconds_std')}, {r('vm', 'value_mean')}, {r('vs', 'value_std')},
       {r('sm / (vm + 1e-9)', 'seconds_per_point')} FROM s""")
def cost_summary(spark, sf):
    s = t.scored(spark, sf).groupBy("grp", "run").agg(
        F.avg(F.when(F.col("prob_b") < 0.9, F.col("value"))).alias("seconds"), F.avg("pred_a").alias("f1"))
    return S.cost_summary(s, ["grp"], "seconds", "f1")


@query("c16_winners", f"""
WITH {SCORED_LONG}, b AS (SELECT model, avg((prob - y) * (prob - y)) AS brier, avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM models GROUP BY model),
l AS (SELECT 'brier' AS metric, model, brier AS value, brier AS ord FROM b UNION ALL SELECT 'accuracy', model, accuracy, -accuracy FROM b)
SELECT metric, (array_agg(model ORDER BY ord, model))[1] AS winner, {r('(array_agg(value ORDER BY ord, model))[1]', 'winning_value')} FROM l GROUP BY metric""")
def winners(spark, sf):
    b = t.scored_long(spark, sf).groupBy("model").agg(
        F.avg((F.col("prob") - F.col("y")) * (F.col("prob") - F.col("y"))).alias("brier"),
        F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))
    long = b.select("model", F.inline(F.array(F.struct(F.lit("brier").alias("metric"), F.col("brier").alias("value")),
                                              F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")))))
    return S.winners(long, ["metric"], "model", "value", F.col("metric") != "brier")


@query("c17_value_ranks", f"""
WITH {SCORED}
SELECT event_id, row_number() OVER (PARTITION BY run ORDER BY prob_b, {t.sql_hash(['event_id'], 0)}, event_id) AS rn FROM scored""")
def value_ranks(spark, sf):
    return ranking.value_ranks(t.scored(spark, sf), ["run"], "prob_b", ["event_id"]).select("event_id", "rn")
