"""Inventory F1-F4, F9-F13, F22-F26: feature scores, PCA tables, class separation, correlation."""

from pyspark.sql import functions as F

from tarnfold.operators import neighbours, reduction, scaling, scoring
from tarnfold.plans import reduction as R
from workloads import tables as t
from workloads import tails
from workloads.encoding import PAIR_PCA
from workloads.registry import query
from workloads.summaries import SCORE_TABLE
from workloads.tables import FLOWS, FLOWS_LONG, VECTORS_LONG, r

NAMES = [f"v{i}" for i in range(t.DIM)]

# F per embedding component and class label
VECTOR_F = VECTORS_LONG + """,
stats AS (SELECT pos, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM cells GROUP BY ALL),
grand AS (SELECT pos, sum(n * m) / sum(n) AS g FROM stats GROUP BY pos),
fscore AS (SELECT pos, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score,
           count(*) - 1 AS d1, CAST(sum(n) - count(*) AS DOUBLE) AS d2,
           sum(n * (m - g) * (m - g)) / (sum(n * v) + 1e-8) AS fisher FROM stats JOIN grand USING (pos) GROUP BY pos)"""


@query("f01_anova_f", f"WITH {SCORE_TABLE} SELECT feature, {r('f_score', 'f_score')} FROM fscore")
def anova_f(spark, sf):
    return scoring.anova(t.flow_vectors(spark, sf), "features", "y", t.NUMERIC, pvalues=False).select("feature", "f_score")


@query("f01_anova_f_vectors", f"WITH {VECTOR_F} SELECT 'v' || pos AS feature, {r('f_score', 'f_score')} FROM fscore")
def anova_f_vectors(spark, sf):
    return scoring.anova(t.vectors(spark, sf), "v", "label", NAMES, pvalues=False).select("feature", "f_score")


VECTOR_P = f"{VECTOR_F}, pvalues AS (SELECT pos, f_score, {tails.f_upper('f_score', 'd1', 'd2')} AS p FROM fscore)"


@query("f01_anova_p_values", f"WITH {VECTOR_P} SELECT 'v' || pos AS feature, {r('f_score', 'f_score')}, {r('p', 'p_value')} FROM pvalues")
def anova_p_values(spark, sf):
    return scoring.anova(t.vectors(spark, sf), "v", "label", NAMES).select("feature", "f_score", "p_value")


@query("f02_top_k", f"WITH {VECTOR_F}, k AS (SELECT 'v' || pos AS feature, row_number() OVER (ORDER BY f_score DESC, pos) AS rank FROM fscore) SELECT feature, rank FROM k WHERE rank <= 20")
def top_k(spark, sf):
    scores = scoring.anova(t.vectors(spark, sf), "v", "label", NAMES, pvalues=False)
    return scoring.top_k(scores, 20).select("feature", "rank")


@query("f02_selected_columns", f"""WITH {VECTOR_F}, k AS (SELECT pos FROM fscore ORDER BY f_score DESC, pos LIMIT 5)
SELECT vec_id, {r('sum(x)', 'kept_sum')} FROM cells JOIN k USING (pos) GROUP BY vec_id""")
def selected_columns(spark, sf):
    v = t.vectors(spark, sf)
    keep = scoring.selected_positions(scoring.anova(v, "v", "label", NAMES, pvalues=False), 5)
    out = scoring.keep_positions(v, "v", keep, "kept")
    return out.select("vec_id", F.aggregate("kept", F.lit(0.0), lambda s, x: s + x).alias("kept_sum"))


@query("f03_mutual_information", f"WITH {SCORE_TABLE} SELECT feature, {r('mi', 'mutual_information', 8)} FROM mi", 8)
def mutual_information(spark, sf):
    return scoring.binned_mutual_information(t.flows(spark, sf), t.NUMERIC, "y").select("feature", "mutual_information")


# radius to the third neighbour of the class, rows within it by a window of that width
def sql_psi(n):
    z = f"({n} + 6.0)"
    inv = f"(1.0 / ({z} * {z}))"
    series = f"ln({z}) - 0.5 / {z} - {inv} * (1.0 / 12 - {inv} * (1.0 / 120 - {inv} * (1.0 / 252 - {inv} / 240.0)))"
    return f"({series}{''.join(f' - 1.0 / ({n} + {i}.0)' for i in range(6))})"


def _sql_windows(k):
    """Distances that reach k neighbours, b of them below."""
    sides = [([f"h{b}"] if b else []) + ([f"g{k - b}"] if b < k else []) for b in range(k + 1)]
    return ", ".join(s[0] if len(s) == 1 else f"CASE WHEN {s[0]} IS NOT NULL AND {s[1]} IS NOT NULL THEN greatest({s[0]}, {s[1]}) END" for s in sides)


_GAPS = ", ".join(f"x - lag(x, {j}) OVER o AS h{j}, lead(x, {j}) OVER o - x AS g{j}" for j in (1, 2, 3))
NEIGHBOURS = FLOWS_LONG + f""",
counts AS (SELECT pos, feature, y AS cls, x, count(*) AS c FROM long GROUP BY ALL),
sizes AS (SELECT pos, cls, sum(c) AS n_class FROM counts GROUP BY ALL HAVING sum(c) > 1),
points AS (SELECT counts.*, n_class FROM counts JOIN sizes USING (pos, cls)),
copies AS (SELECT *, unnest(generate_series(1, least(c, 3))) AS copy FROM points),
gaps AS (SELECT *, {_GAPS} FROM copies WINDOW o AS (PARTITION BY pos, cls ORDER BY x, copy)),
radii AS (SELECT pos, feature, cls, x, c, n_class, 0.999999 * CASE WHEN c > 3 THEN 0.0 ELSE coalesce(least({_sql_windows(3)}),
  greatest(0.0, h1, h2, h3, g1, g2, g3)) END AS radius FROM gaps WHERE copy = 1),
counted AS (SELECT *, sum(c) OVER (PARTITION BY pos ORDER BY x RANGE BETWEEN radius PRECEDING AND radius FOLLOWING) AS m FROM radii),
terms AS (SELECT feature, c, {sql_psi('CASE WHEN radius > 0 THEN least(3, n_class - 1) ELSE c END')} - {sql_psi('n_class')} - {sql_psi('m')} AS term FROM counted),
totals AS (SELECT feature, sum(c) AS n_rows, sum(c * term) / sum(c) AS s FROM terms GROUP BY feature)"""


@query("f03_neighbour_information", f"WITH {NEIGHBOURS} SELECT feature, CAST(n_rows AS BIGINT) AS n_rows, {r('greatest(0.0, s + ' + sql_psi('n_rows') + ')', 'mutual_information', 7)} FROM totals", 7)
def neighbour_information(spark, sf):
    return neighbours.neighbour_information(t.flows(spark, sf), t.NUMERIC, "y").select("feature", "n_rows", "mutual_information")


@query("f04_significance_counts", f"""WITH {VECTOR_P} SELECT count(*) FILTER (p < 0.05) AS n_significant, count(*) FILTER (p >= 0.05 OR p IS NULL) AS n_not_significant,
  count(*) FILTER (coalesce(f_score, 0) <= 1e-12) AS n_zero FROM pvalues""")
def significance_counts(spark, sf):
    return scoring.significance_counts(scoring.anova(t.vectors(spark, sf), "v", "label", NAMES))


@query("f09_pca_variance_pair", f"WITH {PAIR_PCA} SELECT {r('l1 / (l1 + l2)', 'ratio1', 5)}, {r('l2 / (l1 + l2)', 'ratio2', 5)} FROM eig", 5)
def pca_variance_pair(spark, sf):
    df = t.flow_vectors(spark, sf).withColumn("features", F.slice("features", 1, 2))
    df = scaling.fit_minmax(df, "features").apply(df, "features")
    pca = reduction.fit_pca(df, "features")
    return spark.createDataFrame([tuple(pca.ratio)], "ratio1 double, ratio2 double")


@query("f09_pca_share")
def pca_share(spark, sf):
    v = t.vectors(spark, sf)
    pca = reduction.fit_pca(v, "v", variance=0.95)
    out = pca.transform(v, "v")
    return out.groupBy("label").agg(F.avg(F.size("scores")).alias("axes"), F.avg(F.col("scores")[0]).alias("first_axis"))


@query("f10_explained_variance", f"""
WITH {PAIR_PCA}, l AS (SELECT 1 AS component, l1 / (l1 + l2) AS ratio FROM eig UNION ALL SELECT 2, l2 / (l1 + l2) FROM eig)
SELECT CAST(component AS BIGINT) AS component, {r('ratio', 'ratio', 5)}, {r('sum(ratio) OVER (ORDER BY component)', 'cumulative', 5)} FROM l""", 5)
def explained_variance(spark, sf):
    df = t.flow_vectors(spark, sf).withColumn("features", F.slice("features", 1, 2))
    df = scaling.fit_minmax(df, "features").apply(df, "features")
    return reduction.variance_table(spark, reduction.fit_pca(df, "features").ratio)


@query("f10_explained_variance_vectors")
def explained_variance_vectors(spark, sf):
    return reduction.variance_table(spark, reduction.fit_pca(t.vectors(spark, sf), "v").ratio)


@query("f11_fisher", f"WITH {VECTOR_F} SELECT 'v' || pos AS feature, {r('fisher', 'fisher')}, {r('avg(fisher) OVER ()', 'mean_fisher')} FROM fscore")
def fisher(spark, sf):
    f = scoring.fisher(t.vectors(spark, sf), "v", "label", NAMES).select("feature", "fisher")
    mean = f.agg(F.avg("fisher").alias("m")).first()["m"]
    return f.withColumn("mean_fisher", F.lit(mean))


@query("f12_davies_bouldin", f"""
WITH {VECTORS_LONG}, c AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY ALL),
d AS (SELECT vec_id, label, sqrt(sum((x - m) * (x - m))) AS dist FROM cells JOIN c USING (label, pos) GROUP BY ALL),
s AS (SELECT label, avg(dist) AS s FROM d GROUP BY label),
p AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) ** 2)) AS dc FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY ALL),
w AS (SELECT la, max((x.s + y.s) / dc) AS worst FROM p JOIN s x ON x.label = la JOIN s y ON y.label = lb GROUP BY la)
SELECT {r('avg(worst)', 'davies_bouldin')} FROM w""")
def davies_bouldin(spark, sf):
    return scoring.davies_bouldin(t.vectors(spark, sf), "v", "label")


@query("f13_silhouette", """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n FROM v a, v b GROUP BY ALL),
i AS (SELECT vec_id, max(CASE WHEN label = other THEN total / (n - 1) END) AS inside, min(CASE WHEN label <> other THEN total / n END) AS nearest FROM d GROUP BY vec_id)
SELECT round(avg((nearest - inside) / greatest(nearest, inside)), 6) + 0.0 AS silhouette, count(*) AS n FROM i""")
def silhouette(spark, sf):
    return scoring.silhouette(t.vectors(spark, sf), "v", "label")


PAIRS = [(i, j) for i in range(4) for j in range(4)]


def _corr_sql(fn: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t.NUMERIC[i]}' AS a, '{t.NUMERIC[j]}' AS b, {fn.format(a=t.NUMERIC[i], b=t.NUMERIC[j])} AS v" for i, j in PAIRS if i < j)


@query("f22_pearson", f"WITH {FLOWS}, c AS ({_corr_sql('(SELECT corr({a}, {b}) FROM flows)')}) SELECT a, b, {r('v', 'pearson')} FROM c")
def pearson(spark, sf):
    return scoring.pearson(t.flow_vectors(spark, sf), "features", t.NUMERIC).filter("i < j").select("a", "b", "pearson")


RANKS = FLOWS + ", ranks AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in t.NUMERIC) + " FROM flows)"


@query("f23_spearman", f"WITH {RANKS}, c AS ({_corr_sql('(SELECT corr({a}, {b}) FROM ranks)')}) SELECT a, b, {r('v', 'spearman')} FROM c")
def spearman(spark, sf):
    out = scoring.spearman(t.flow_vectors(spark, sf), "features", t.NUMERIC, pvalues=False)
    return out.filter("i < j").select("a", "b", "spearman")


@query("f23_spearman_p_values", f"""WITH {RANKS}, c AS ({_corr_sql('(SELECT corr({a}, {b}) FROM ranks)')}), n AS (SELECT CAST(count(*) - 2 AS DOUBLE) AS d FROM flows),
s AS (SELECT a, b, v, d, abs(v) * sqrt(d / (1.0 - v * v)) AS t FROM c, n) SELECT a, b, {r('v', 'spearman')}, {r(tails.t_two_sided('t', 'd'), 'p_value')} FROM s""")
def spearman_p_values(spark, sf):
    out = scoring.spearman(t.flow_vectors(spark, sf), "features", t.NUMERIC)
    return out.filter("i < j").select("a", "b", "spearman", "p_value")


@query("f24_strong_pairs", f"""
WITH {VECTORS_LONG}, c AS (SELECT a.pos AS i, b.pos AS j, corr(a.x, b.x) AS v FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.pos < b.pos GROUP BY ALL)
SELECT 'v' || i AS a, 'v' || j AS b, {r('v', 'pearson')} FROM c WHERE abs(v) > 0.1""")
def strong_pairs(spark, sf):
    m = scoring.pearson(t.vectors(spark, sf), "v", NAMES)
    return scoring.strong_pairs(m, "pearson", 0.1).select("a", "b", "pearson")


@query("f25_nonlinear_excess", f"""
WITH {RANKS}, p AS ({_corr_sql('(SELECT corr({a}, {b}) FROM flows)')}), s AS ({_corr_sql('(SELECT corr({a}, {b}) FROM ranks)')})
SELECT a, b, {r('p.v', 'pearson')}, {r('s.v', 'spearman')}, {r('abs(s.v) - abs(p.v)', 'excess')}, {r('abs(s.v) / (abs(p.v) + 1e-9)', 'ratio')} FROM p JOIN s USING (a, b)""")
def nonlinear_excess(spark, sf):
    df = t.flow_vectors(spark, sf)
    return scoring.nonlinear_excess(scoring.pearson(df, "features", t.NUMERIC),
                                    scoring.spearman(df, "features", t.NUMERIC, pvalues=False))


@query("f26_correlation_after_pca")
def correlation_after_pca(spark, sf):
    v = t.vectors(spark, sf)
    out = reduction.fit_pca(v, "v", 4).transform(v, "v")
    names = [f"pc{i}" for i in range(4)]
    worst = scoring.max_off_diagonal(scoring.pearson(out, "scores", names), "pearson")
    scaled = scaling.fit_minmax(out, "scores").apply(out, "scores")
    before = scoring.spearman(out, "scores", names, pvalues=False).select("i", "j", F.col("spearman").alias("before"))
    after = scoring.spearman(scaled, "scores", names, pvalues=False).select("i", "j", F.col("spearman").alias("after"))
    moved = before.join(after, ["i", "j"]).agg(F.max(F.abs(F.col("before") - F.col("after"))).alias("moved"))
    return worst.withColumn("k", F.lit(0)).join(moved.withColumn("k", F.lit(0)), "k") \
        .select((F.col("max_abs") < 1e-6).alias("uncorrelated"), (F.col("moved") < 1e-9).alias("rank_kept"))


@query("f27_category_anova", f"""
WITH {FLOWS_LONG}, stats AS (SELECT run, feature, pos, category, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY ALL),
grand AS (SELECT run, feature, sum(n * m) / sum(n) AS g FROM stats GROUP BY ALL)
SELECT run, feature, {r('(sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 'f_score', 5)}
FROM stats JOIN grand USING (run, feature) GROUP BY run, feature""", 5)
def category_anova(spark, sf):
    return scoring.anova(t.flow_vectors(spark, sf), "features", "category", t.NUMERIC, ["run"], pvalues=False).select("run", "feature", "f_score")




K_SET = (1, 2, 4, 8, 16, 32, 64)
K_SQL = f"""{t.VECTORS}, cells AS (SELECT vec_id, vec_id % 5 AS run, y, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM vectors),
st AS (SELECT run, pos, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM cells GROUP BY ALL),
g AS (SELECT run, pos, sum(n * m) / sum(n) AS g FROM st GROUP BY ALL),
fs AS (SELECT run, pos, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM st JOIN g USING (run, pos) GROUP BY ALL),
rk AS (SELECT run, pos, row_number() OVER (PARTITION BY run ORDER BY f DESC, pos) AS rk FROM fs),
ks AS (SELECT unnest({list(K_SET)}) AS k),
top AS (SELECT c.*, rk FROM cells c JOIN rk USING (run, pos)),
ys AS (SELECT run, pos, rk, sum((2 * y - 1) * x) AS s FROM top GROUP BY ALL),
yky AS (SELECT k, run, sum(s * s) AS yky FROM ys, ks WHERE rk <= k GROUP BY ALL),
mm AS (SELECT a.run, greatest(a.rk, b.rk) AS rk, sum(a.x * b.x) AS s FROM top a JOIN top b USING (vec_id) GROUP BY a.run, a.rk, b.rk),
k2 AS (SELECT k, run, sqrt(sum(s * s)) AS norm FROM mm, ks WHERE rk <= k GROUP BY ALL),
me AS (SELECT run, pos, avg(x) FILTER (y = 0) AS m0, avg(x) FILTER (y = 1) AS m1 FROM top GROUP BY ALL),
ds AS (SELECT k, t.run, vec_id, y, sum((x - m1) ** 2 - (x - m0) ** 2) AS d FROM top t JOIN me USING (run, pos), ks WHERE rk <= k GROUP BY ALL),
cf AS (SELECT k, run, count(*) AS n, count(*) FILTER (y = 0 AND d >= 0) AS tn, count(*) FILTER (y = 0 AND d < 0) AS fp, count(*) FILTER (y = 1 AND d >= 0) AS fn,
  count(*) FILTER (y = 1 AND d < 0) AS tp FROM ds GROUP BY ALL),
res AS (SELECT k, run, tn, fp, fn, tp, yky / (norm * n) AS alignment, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tn = 0 AND fn = 0 AS is_degenerate
  FROM cf JOIN yky USING (k, run) JOIN k2 USING (k, run))"""


def k_table(spark, sf):
    v = t.vectors(spark, sf).withColumn("run", F.col("vec_id") % 5)
    return R.k_degeneracy(v, "v", "y", "run", "vec_id", NAMES, K_SET)


@query("f08_k_degeneracy", f"WITH {K_SQL} SELECT k, run, tn, fp, fn, tp, {r('alignment', 'alignment')}, {r('f1', 'f1')}, is_degenerate FROM res")
def k_degeneracy(spark, sf):
    return k_table(spark, sf).select("k", "run", "tn", "fp", "fn", "tp", "alignment", "f1", "is_degenerate")


@query("f08_k_summary", f"""WITH {K_SQL} SELECT k, {r('avg(alignment)', 'alignment_mean')}, {r('stddev_samp(alignment)', 'alignment_std')}, {r('avg(f1)', 'f1_mean')},
  {r('stddev_samp(f1)', 'f1_std')}, count(*) FILTER (is_degenerate) AS n_degenerate FROM res GROUP BY k""")
def k_summary(spark, sf):
    return R.k_degeneracy_summary(k_table(spark, sf))
