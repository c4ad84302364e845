"""Inventory J: agreement, McNemar, effect sizes, rank tests."""


from pyspark.sql import functions as F

from tarnfold.operators import paired as P
from workloads import tables as t
from workloads import tails
from workloads.registry import query
from workloads.summaries import RESULTS, results
from workloads.tables import SCORED, SCORED_RARE, TRUTH, r

CELLS = """count(*) FILTER (pred_a = y AND pred_b = y) AS both_right, count(*) FILTER (pred_a = y AND pred_b <> y) AS only_a,
  count(*) FILTER (pred_a <> y AND pred_b = y) AS only_b, count(*) FILTER (pred_a <> y AND pred_b <> y) AS both_wrong"""
RARE = "grp IN ('error', 'signup')"


def rare():
    return F.col("grp").isin(SCORED_RARE)


@query("j01_agreement", f"WITH {SCORED} SELECT run, {CELLS} FROM scored GROUP BY run")
def agreement(spark, sf):
    s = t.scored(spark, sf)
    a = s.select("event_id", "run", "y", F.col("pred_a").alias("pred"))
    b = s.select("event_id", F.col("pred_b").alias("pred"))
    return P.agreement(P.pair_predictions(a, b, ["event_id"], ["run"]), ["run"])


@query("j01_rare_agreement", f"WITH {SCORED} SELECT run, {CELLS} FROM scored WHERE {RARE} GROUP BY run")
def rare_agreement(spark, sf):
    return P.agreement(t.scored(spark, sf), ["run"], where=rare())


@query("j02_only_a_right", f"WITH {SCORED} SELECT event_id, grp, {r('prob_a', 'prob_a')}, {r('prob_b', 'prob_b')} FROM scored WHERE pred_a = y AND pred_b <> y")
def only_a_right(spark, sf):
    return P.only_a_right(t.scored(spark, sf)).select("event_id", "grp", "prob_a", "prob_b")


STAT = "coalesce((abs(only_a - only_b) - 1) ** 2 / nullif(only_a + only_b, 0), 0)"


@query("j03_mcnemar_statistic", f"WITH {SCORED}, c AS (SELECT run, {CELLS} FROM scored GROUP BY run) SELECT run, only_a, only_b, {r(STAT, 'statistic')} FROM c")
def mcnemar_statistic(spark, sf):
    return P.mcnemar_chi2(P.agreement(t.scored(spark, sf), ["run"]), False).select("run", "only_a", "only_b", "statistic")


@query("j03_mcnemar_p_value", f"""WITH {TRUTH}, c AS (SELECT lang, {CELLS} FROM truth GROUP BY lang), s AS (SELECT lang, only_a, only_b, CAST({STAT} AS DOUBLE) AS x FROM c)
SELECT lang, only_a, only_b, {r('x', 'statistic')}, {r(tails.chi2_upper('x'), 'p_value')} FROM s""")
def mcnemar_p_value(spark, sf):
    return P.mcnemar_chi2(P.agreement(t.truth(spark, sf), ["lang"])).select("lang", "only_a", "only_b", "statistic", "p_value")


# exact two-sided sign test in SQL: 2 * sum of C(n, k) / 2^n up to the smaller cell, in logarithms
BINOMIAL = """tail AS (SELECT {g}, only_a, only_b, unnest(range(0, least(only_a, only_b) + 1)) AS k FROM c),
p AS (SELECT {g}, only_a, only_b, least(1.0, 2 * sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2.0)))) AS p_value FROM tail GROUP BY ALL)"""


@query("j04_mcnemar_exact", f"""WITH {TRUTH}, c AS (SELECT lang, {CELLS} FROM truth GROUP BY lang), {BINOMIAL.format(g='lang')}
SELECT lang, only_a, only_b, CASE WHEN only_a = only_b THEN 1.0::DOUBLE ELSE round(p_value + 1e-12, 6) + 0.0 END AS p_value FROM p""")
def mcnemar_exact(spark, sf):
    return P.mcnemar_exact(P.agreement(t.truth(spark, sf), ["lang"])).select("lang", "only_a", "only_b", "p_value")


@query("j05_pooled_cells", f"""WITH {SCORED}, c AS (SELECT run, {CELLS} FROM scored GROUP BY run)
SELECT CAST(sum(both_right) AS BIGINT) AS both_right, CAST(sum(only_a) AS BIGINT) AS only_a, CAST(sum(only_b) AS BIGINT) AS only_b, CAST(sum(both_wrong) AS BIGINT) AS both_wrong FROM c""")
def pooled_cells(spark, sf):
    return P.pooled(P.agreement(t.scored(spark, sf), ["run"]))


@query("j05_median_p_value", f"""WITH {TRUTH}, c AS (SELECT source, {CELLS} FROM truth GROUP BY source), {BINOMIAL.format(g='source')},
q AS (SELECT CASE WHEN only_a = only_b THEN 1.0 ELSE p_value END AS p FROM p) SELECT {r('median(p)', 'median_p')}, count(*) AS runs FROM q""")
def median_p_value(spark, sf):
    return P.median_pvalue(P.mcnemar_exact(P.agreement(t.truth(spark, sf), ["source"])))


WORDS = "CASE WHEN {d} IS NULL THEN 'undefined' WHEN abs({d}) < 0.2 THEN 'negligible' WHEN abs({d}) < 0.5 THEN 'small' WHEN abs({d}) < 0.8 THEN 'medium' ELSE 'large' END"


@query("j06_cohens_d", f"""WITH {SCORED}, s AS (SELECT grp, avg(prob_a) AS ma, avg(prob_b) AS mb, stddev_samp(prob_a) AS sa, stddev_samp(prob_b) AS sb, count(*) AS n FROM scored GROUP BY grp),
e AS (SELECT *, (ma - mb) / sqrt((sa * sa + sb * sb) / 2) AS d FROM s)
SELECT grp, {r('ma', 'mean_a')}, {r('mb', 'mean_b')}, {r('sa', 'std_a')}, {r('sb', 'std_b')}, n AS n_a, n AS n_b, {r('d', 'd')}, {WORDS.format(d='d')} AS effect FROM e""")
def cohens_d(spark, sf):
    return P.cohens_d(t.scored(spark, sf), "prob_a", "prob_b", ["grp"], nan_below=1e-12)


@query("j06_cohens_d_population", f"""WITH {SCORED}, s AS (SELECT run, avg(prob_a) AS ma, avg(prob_b) AS mb, sqrt((var_pop(prob_a) + var_pop(prob_b)) / 2) AS p FROM scored GROUP BY run)
SELECT run, {r('(ma - mb) / (p + 1e-9)', 'd')} FROM s""")
def cohens_d_population(spark, sf):
    return P.cohens_d(t.scored(spark, sf), "prob_a", "prob_b", ["run"], ddof=0, eps=1e-9).select("run", "d")


ALIGNED = RESULTS + """, w AS (SELECT run, sigma, max(f1) FILTER (model = 'a') AS va, max(f1) FILTER (model = 'b') AS vb FROM results GROUP BY run, sigma),
e AS (SELECT run, 'b' AS baseline, (avg(va) - avg(vb)) / (sqrt((var_samp(va) + var_samp(vb)) / 2) + 1e-10) AS d FROM w GROUP BY run)"""


def aligned(spark, sf):
    both = P.side_by_side(results(spark, sf), "model", "a", "f1", ["run", "sigma"])
    return P.cohens_d(both, "value_a", "value_b", ["run", "baseline"], eps=1e-10, limits=P.EFFECT_LIMITS_COARSE, words=P.EFFECT_WORDS_COARSE)


@query("j07_d_across_levels", f"WITH {ALIGNED} SELECT run, baseline, {r('d', 'd', 5)} FROM e", 5)
def d_across_levels(spark, sf):
    return aligned(spark, sf).select("run", "baseline", "d")


@query("j07_d_summary", f"""WITH {ALIGNED}, s AS (SELECT baseline, avg(d) AS m, stddev_samp(d) AS sd FROM e GROUP BY baseline)
SELECT baseline, {r('m', 'd_mean', 5)}, {r('sd', 'd_std', 5)}, CASE WHEN abs(m) < 0.5 THEN 'small' WHEN abs(m) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM s""", 5)
def d_summary(spark, sf):
    return P.effect_summary(aligned(spark, sf), ["baseline"])


RANKS = f"""ranks AS (SELECT run, y, value, rank() OVER (PARTITION BY run ORDER BY value) + (count(*) OVER (PARTITION BY run, value) - 1) / 2.0 AS rk FROM scored),
ties AS (SELECT run, sum(c * c * c - c) AS tie FROM (SELECT run, value, CAST(count(*) AS DOUBLE) AS c FROM scored GROUP BY ALL) GROUP BY run),
u AS (SELECT run, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(rk) FILTER (y = 1) AS r1 FROM ranks GROUP BY run),
v AS (SELECT u.*, r1 - n1 * (n1 + 1) / 2 AS uu, n1 * n0 / 12.0 * ((n1 + n0 + 1) - tie / ((n1 + n0) * (n1 + n0 - 1))) AS var FROM u JOIN ties USING (run))"""


@query("j08_mann_whitney", f"WITH {SCORED}, {RANKS} SELECT run, n1, n0, {r('uu', 'u', 2)}, {r('(uu - n1 * n0 / 2 - 0.5) / sqrt(var)', 'z', 5)} FROM v", 5)
def mann_whitney(spark, sf):
    return P.mann_whitney(t.scored(spark, sf), "value", "y", ["run"], pvalues=False)


@query("j08_mann_whitney_p", f"""WITH {TRUTH}, {RANKS.replace('run', 'lang').replace('value', 'score').replace('FROM scored', 'FROM truth')},
w AS (SELECT lang, n1, n0, uu, (uu - n1 * n0 / 2 - 0.5) / sqrt(var) AS z FROM v)
SELECT lang, n1, n0, {r('uu', 'u')}, {r('z', 'z')}, {r(tails.normal_upper('z'), 'p_value')} FROM w""")
def mann_whitney_p(spark, sf):
    return P.mann_whitney(t.truth(spark, sf), "score", "y", ["lang"])


@query("j09_score_summary", f"WITH {SCORED} SELECT y, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('min(value)', 'low')}, {r('max(value)', 'high')} FROM scored GROUP BY y")
def score_summary(spark, sf):
    return P.score_summary(t.scored(spark, sf), ["y"], "value")


@query("j10_mcnemar_per_category", f"""WITH {TRUTH}, c AS (SELECT source, {CELLS} FROM truth GROUP BY source), {BINOMIAL.format(g='source')}
SELECT source, only_a, only_b, CASE WHEN only_a = only_b THEN 1.0::DOUBLE ELSE round(p_value + 1e-12, 6) + 0.0 END AS p_value FROM p""")
def mcnemar_per_category(spark, sf):
    cells = P.agreement(t.truth(spark, sf), ["lang", "source"])
    return P.mcnemar_exact(P.pooled(cells, ["source"])).select("source", "only_a", "only_b", "p_value")


MARGIN = "s AS (SELECT {g} avg(abs(prob_a - 0.5)) AS ma, avg(abs(prob_b - 0.5)) AS mb, var_samp(abs(prob_a - 0.5)) AS va, var_samp(abs(prob_b - 0.5)) AS vb FROM scored WHERE grp IN ('error', 'signup') {by})"


@query("j11_d_per_run_and_pooled", f"""WITH {SCORED}, {MARGIN.format(g='run,', by='GROUP BY run')}, {MARGIN.format(g='-1 AS run,', by='').replace('s AS', 'p AS', 1)},
a AS (SELECT * FROM s UNION ALL SELECT * FROM p)
SELECT CAST(run AS BIGINT) AS run, {r('ma', 'mean_a')}, {r('mb', 'mean_b')}, {r('(ma - mb) / sqrt((va + vb) / 2)', 'd')} FROM a""")
def d_per_run_and_pooled(spark, sf):
    rows = t.scored(spark, sf).filter(rare()).select("run", F.abs(F.col("prob_a") - 0.5).alias("a"), F.abs(F.col("prob_b") - 0.5).alias("b"))
    per = P.cohens_d(rows, "a", "b", ["run"]).select("run", "mean_a", "mean_b", "d")
    whole = P.cohens_d(rows, "a", "b").select(F.lit(-1).alias("run"), "mean_a", "mean_b", "d")
    return per.unionByName(whole)


