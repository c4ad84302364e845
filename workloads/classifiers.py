"""Inventory H: classifiers on kernel maps, calibration, tuning, learning curve. Fits are iterative, so most have no SQL."""

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators import classifiers as C
from tarnfold.operators import duals as D
from tarnfold.operators import metrics, sampling, scaling, scoring
from tarnfold.operators import trainer as T
from tarnfold.plans import studies
from workloads import tables as t
from workloads.registry import query, table
from workloads.tables import r

#: kind, gamma, coef0
KERNELS = [("linear", 1.0, 0.0), ("poly", 0.25, 1.0), ("rbf", 0.25, 0.0)]


def labelled(spark, sf):
    """Embeddings with the class half as label: angles of the four best components."""
    v = t.vectors(spark, sf).withColumn("y", (F.col("label") >= 5).cast("int"))
    keep = scoring.selected_positions(scoring.anova(v, "v", "y", [f"v{i}" for i in range(t.DIM)], pvalues=False), 4)
    kept = scoring.keep_positions(v, "v", keep, "x")
    return scaling.fit_minmax(kept, "x", 0.0, math.pi).apply(kept, "x").select("vec_id", "label", "y", "v", "x")


def fitted(spark, sf, balanced=False, y=None):
    """The linear model of all four angles, fitted to its optimum, and its scores."""
    df = labelled(spark, sf)
    return T.fit_whole(df if y is None else df.withColumn("y", y), "x", "y", balanced=balanced, keep=["vec_id"])


@query("h01_linear_classifier")
def linear_classifier(spark, sf):
    """Status of every lineitem from its four scaled numbers."""
    _, scored = T.fit_whole(t.flow_vectors(spark, sf), "features", "y", scale=True, keep=["category"])
    return metrics.rates(metrics.confusion(scored, ["category"]))


def kernel_fits(spark, sf):
    """(kind, model) for the exact kernels on the four angles."""
    base = labelled(spark, sf)
    return [(kernel[0], D.fit_dual(base, "x", "y", kernel, keep=["vec_id"])) for kernel in KERNELS]


@query("h02_kernel_classifiers")
def kernel_classifiers(spark, sf):
    rows = [m.rows.select(F.lit(kind).alias("kernel"), "y", "pred") for kind, m in kernel_fits(spark, sf)]
    return metrics.macro_f1(reduce(DataFrame.unionByName, rows), ["kernel"])


@query("h09_kernel_width")
def kernel_width(spark, sf):
    """Distance of the margins in each kernel's space, from the multipliers; the gap bounds how far the objective is from its best."""
    rows = [m.rows.agg(F.lit(kind).alias("kernel"), F.count("*").alias("n")).select("*", F.lit(m.width).alias("width"), F.lit(m.objective).alias("objective"),
                                                                                   F.lit(m.gap / m.objective).alias("relative_gap")) for kind, m in kernel_fits(spark, sf)]
    return reduce(DataFrame.unionByName, rows)


@query("h10_kernel_support")
def kernel_support(spark, sf):
    """Rows with a multiplier, by class and at the bound."""
    return reduce(DataFrame.unionByName, [m.support().select(F.lit(kind).alias("kernel"), "*") for kind, m in kernel_fits(spark, sf)])


@query("h03_class_weights", f"""WITH w AS (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings), c AS (SELECT y, count(*) AS n FROM w GROUP BY y)
SELECT y, n, {r('sum(n) OVER () / (2 * n)', 'weight')} FROM c""")
def class_weights(spark, sf):
    rows = t.vectors(spark, sf).select((F.col("label") == 0).cast("int").alias("y"))
    weighted = rows.withColumn("weight", C.class_weights(rows, "y"))
    return weighted.groupBy("y").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


@query("h03_balanced_classifier")
def balanced_classifier(spark, sf):
    return metrics.confusion(fitted(spark, sf, True, (F.col("label") == 0).cast("int"))[1])


@query("h04_scores")
def scores(spark, sf):
    return fitted(spark, sf)[1].select("vec_id", "y", "score", "pred")


@query("h05_sigmoid_calibration")
def sigmoid_calibration(spark, sf):
    """Sigmoid fitted on train scores."""
    _, scored = fitted(spark, sf)
    out = C.apply_sigmoid(scored, C.fit_sigmoid(scored, "score", "y"), "score")
    return out.groupBy("y").agg(F.avg("prob").alias("mean_prob"), F.count("*").alias("n"))


@query("h05_sigmoid_out_of_fold")
def sigmoid_out_of_fold(spark, sf):
    """Sigmoid fitted on scores of five models that did not see the row, fitted together."""
    rows = T.study_rows(sampling.stratified_folds(labelled(spark, sf), 5, "label", ["vec_id"]), "x", "y", "fold")
    moments = T.part_moments(rows)
    designs = [T.Design({"fold": k}, frozenset(moments.parts) - {k}, *T.chosen(moments, range(4))) for k in moments.parts]
    oof = T.score_designs(rows, T.fit_designs(rows, moments, designs), lambda d: {d.name["fold"]})
    out = C.apply_sigmoid(oof, C.fit_sigmoid(oof, "score", "y"), "score")
    return out.groupBy("y").agg(F.avg("prob").alias("mean_prob"), F.count("*").alias("n"))


@query("h05_sigmoid_apply", f"SELECT event_id, {r('1.0 / (1.0 + exp(-(0.02 * (value - 50.0) - 0.1)))', 'prob')} FROM events")
def sigmoid_apply(spark, sf):
    class Given:
        coefficients, intercept = [0.02], -0.1

    ev = table(spark, sf, "events").select("event_id", (F.col("value") - 50.0).alias("score"))
    return C.apply_sigmoid(ev, Given, "score").select("event_id", "prob")


# (setting, fold, macro_f1) per part size and brand group, as a stand-in for a finished cross-validation
def finished_cv(spark, sf):
    p = table(spark, sf, "part")
    return p.groupBy(F.col("p_size").cast("double").alias("c"), F.substring("p_brand", 7, 1).alias("fold")).agg((F.avg("p_retailprice") / 10000.0).alias("macro_f1"))


FINISHED = """cv AS (SELECT CAST(p_size AS DOUBLE) AS c, substring(p_brand, 7, 1) AS fold, avg(p_retailprice) / 10000.0 AS f FROM part GROUP BY ALL),
tab AS (SELECT c, avg(f) AS m, stddev_samp(f) AS sd, stddev_samp(f) / sqrt(count(*)) AS se FROM cv GROUP BY c),
best AS (SELECT * FROM tab ORDER BY m DESC, c LIMIT 1)"""


@query("h06_one_standard_error", f"WITH {FINISHED} SELECT min(tab.c) AS chosen_c, {r('max(tab.m)', 'best_mean')} FROM tab, best WHERE tab.m >= best.m - best.se")
def one_standard_error(spark, sf):
    return C.one_standard_error(C.cv_table(finished_cv(spark, sf), ["c"], ddof=1))


@query("h07_best_setting", f"WITH {FINISHED} SELECT c AS chosen_c, {r('m', 'best_mean')} FROM best")
def best_setting(spark, sf):
    return C.best_setting(C.cv_table(finished_cv(spark, sf), ["c"], ddof=1))


@query("h07_tune_c")
def tune_c(spark, sf):
    """Scaler refitted per fold, five penalties and folds fitted together; binary F1."""
    df = sampling.stratified_folds(labelled(spark, sf), 5, "label", ["vec_id"])
    return studies.cv_means(studies.c_scores(T.study_rows(df, "v", "y", "fold")), ["c"], ddof=1, average="binary")


@query("h08_margin_summary", f"SELECT event_type, {r('avg(abs(value - 50))', 'margin_mean')}, {r('stddev_pop(abs(value - 50))', 'margin_std')} FROM events GROUP BY event_type")
def margin_summary(spark, sf):
    ev = table(spark, sf, "events").select("event_type", (F.col("value") - 50.0).alias("score"))
    return C.margin_summary(ev, ["event_type"])


@query("h09_margin_width")
def margin_width(spark, sf):
    model, scored = fitted(spark, sf)
    return scored.agg(F.count("*").alias("n")).withColumn("width", F.lit(model.width))


SUPPORT = "(2 * y - 1) * (value - 50) / 50 <= 1 + 1e-6"


@query("h10_support_rows", f"""WITH {t.SCORED} SELECT run, count(*) FILTER ({SUPPORT}) AS n_support, {r(f'count(*) FILTER ({SUPPORT}) / count(*)', 'support_share')},
  count(*) FILTER ({SUPPORT} AND y = 0) AS n_support_0, count(*) FILTER ({SUPPORT} AND y = 1) AS n_support_1 FROM scored GROUP BY run""")
def support_rows(spark, sf):
    s = t.scored(spark, sf).withColumn("score", (F.col("value") - 50) / 50)
    return C.support_rows(s, ["run"])


@query("h11_learning_curve")
def learning_curve(spark, sf):
    """Nested sizes up to the table's own, the scaler refitted on each sample, all sizes fitted together."""
    df = labelled(spark, sf)
    n = df.count()
    sizes = [s for s in (100, 200, 500, 1000) if s <= n]
    sized = sampling.size_ladder(df, sizes, "y", ["vec_id"]).select("y", "v", "size")
    return studies.learning_curve(sized, df, sizes, "v", "y")


@query("h12_train_test_gap")
def train_test_gap(spark, sf):
    return learning_curve(spark, sf).select("size", "gap")
