"""Max-margin classifiers on explicit kernel maps, sigmoid calibration, tuning and reports (inventory H, F5, F7).

A kernel classifier is the linear one on the kernel's feature map, so training is Spark ML's distributed optimizer and
scoring is a projection; no N x N matrix and no dual solver.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.scalars import ratio
from tarnfold.operators.metrics import macro_f1


@dataclass
class MarginModel:
    """Linear scorer w . phi + b."""

    model: object
    n: int
    c: float

    def score(self, df: DataFrame, phi: str, score: str = "score", pred: str = "pred") -> DataFrame:
        """Decision values and 0/1 predictions."""
        staged = df.withColumn("_svc_in", array_to_vector(F.col(phi).cast("array<double>")))
        out = self.model.transform(staged)
        return out.withColumn(score, vector_to_array("_svc_raw")[1]).withColumn(pred, F.col("_svc_pred").cast("int")) \
            .drop("_svc_in", "_svc_raw", "_svc_pred")

    def margin_width(self) -> float:
        """2 / |w|."""
        norm = float(self.model.coefficients.norm(2))
        return 2.0 / norm if norm > 0 else float("inf")


def class_weights(df: DataFrame, label: str) -> Column:
    """n / (2 n_class) as a column, from one two-row count."""
    counts = {r[label]: r["c"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).collect()}
    total = sum(counts.values())
    out = F.lit(1.0)
    for cls, c in counts.items():
        out = F.when(F.col(label) == cls, F.lit(total / (len(counts) * c))).otherwise(out)
    return out


def fit_margin(df: DataFrame, phi: str, label: str, c: float = 1.0, balanced: bool = False, max_iter: int = 100) -> MarginModel:
    """Hinge loss with penalty 1 / (C n) on the map ``phi``."""
    n = df.count()
    staged = df.select(array_to_vector(F.col(phi).cast("array<double>")).alias("_svc_in"), F.col(label).cast("double").alias("_svc_y"),
                       (class_weights(df, label) if balanced else F.lit(1.0)).alias("_svc_w"))
    svc = LinearSVC(featuresCol="_svc_in", labelCol="_svc_y", weightCol="_svc_w", rawPredictionCol="_svc_raw",
                    predictionCol="_svc_pred", regParam=1.0 / (c * n), standardization=False, maxIter=max_iter)
    return MarginModel(svc.fit(staged), n, c)


def fit_sigmoid(df: DataFrame, score: str, label: str):
    """Logistic map of scores to probabilities, fitted without penalty."""
    staged = df.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("_sig_in"), F.col(label).cast("double").alias("_sig_y"))
    return LogisticRegression(featuresCol="_sig_in", labelCol="_sig_y", regParam=0.0, maxIter=200, tol=1e-9).fit(staged)


def apply_sigmoid(df: DataFrame, model, score: str, prob: str = "prob") -> DataFrame:
    slope, shift = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn(prob, F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * F.col(score) + F.lit(shift)))))


def out_of_fold_scores(df: DataFrame, phi: str, label: str, fold: str, folds: int, c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """Scores of each row from the model that did not see its fold (for calibration with folds)."""
    def one(i):
        model = fit_margin(df.filter(F.col(fold) != i), phi, label, c, max_iter=max_iter)
        return model.score(df.filter(F.col(fold) == i), phi)

    parts = _parallel(one, range(folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _parallel(fn, items, width: int = 4):
    """Model fits are separate Spark jobs; a few are kept in flight so short ones share the cluster."""
    with ThreadPoolExecutor(max_workers=width) as pool:
        return list(pool.map(fn, items))


def margin_summary(scored: DataFrame, by=(), score: str = "score") -> DataFrame:
    return scored.groupBy(*by).agg(F.avg(F.abs(score)).alias("margin_mean"), F.stddev_pop(F.abs(score)).alias("margin_std"))


def support_rows(scored: DataFrame, by=(), score: str = "score", label: str = "y", slack: float = 1e-6) -> DataFrame:
    """Rows on or inside the margin (y f(x) <= 1): count, share, and count per class."""
    inside = (F.lit(2.0) * F.col(label) - 1.0) * F.col(score) <= 1.0 + slack
    return scored.groupBy(*by).agg(
        F.count_if(inside).alias("n_support"), ratio(F.count_if(inside), F.count(F.lit(1)), 0).alias("support_share"),
        F.count_if(inside & (F.col(label) == 0)).alias("n_support_0"), F.count_if(inside & (F.col(label) == 1)).alias("n_support_1"))


# --- cross-validation -------------------------------------------------------------------------------------------

def cross_validate(df: DataFrame, settings, prepare, label: str, fold: str, folds: int, max_iter: int = 50) -> DataFrame:
    """Macro-F1 of every (setting, fold).

    ``settings`` are dicts with ``name`` and ``c``; ``prepare(train, test, setting)`` fits on train only and returns both
    with a ``phi`` column. All scored folds end in one grouped aggregate.
    """
    def one(job):
        setting, i = job
        train, test = prepare(df.filter(F.col(fold) != i), df.filter(F.col(fold) == i), setting)
        model = fit_margin(train, "phi", label, setting.get("c", 1.0), max_iter=max_iter)
        return model.score(test, "phi").select(
            F.lit(str(setting["name"])).alias("setting"), F.lit(float(setting.get("c", 1.0))).alias("c"),
            F.lit(i).alias("fold"), F.col(label).cast("int").alias("y"), "pred")

    parts = _parallel(one, [(s, i) for s in settings for i in range(folds)])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return macro_f1(out, ["setting", "c", "fold"])


def cv_table(scores: DataFrame, by, value: str = "macro_f1", ddof: int = 0) -> DataFrame:
    """Mean, std and standard error over folds."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    s = scores.groupBy(*by).agg(F.avg(value).alias("f1_mean"), std(value).alias("f1_std"), F.count(value).alias("n_folds"))
    return s.withColumn("std_err", F.col("f1_std") / F.sqrt("n_folds"))


def one_standard_error(table: DataFrame, c: str = "c", by=()) -> DataFrame:
    """Smallest C whose mean is within one standard error of the best."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    best = F.max_by(F.struct("f1_mean", "std_err"), F.struct(F.col("f1_mean"), (-F.col(c)).alias("_c"))).over(whole)
    flagged = table.withColumn("_b", best).withColumn("_ok", F.col("f1_mean") >= F.col("_b.f1_mean") - F.col("_b.std_err"))
    return flagged.groupBy(*by).agg(F.min(F.when(F.col("_ok"), F.col(c))).alias("chosen_c"), F.max("f1_mean").alias("best_mean"))


def best_setting(table: DataFrame, c: str = "c", by=()) -> DataFrame:
    """C of the best mean; the smaller one wins ties."""
    return table.groupBy(*by).agg(F.max_by(c, F.struct(F.col("f1_mean"), (-F.col(c)).alias("_c"))).alias("chosen_c"),
                                  F.max("f1_mean").alias("best_mean"))


def learning_curve(sized: DataFrame, test: DataFrame, sizes, prepare, label: str, c: float = 1.0, done=(), size: str = "size",
                   max_iter: int = 50) -> DataFrame:
    """Train and test macro-F1, their gap and fit seconds for each training size; sizes in ``done`` are skipped."""
    scored, seconds = None, []
    for n in [s for s in sizes if s not in set(done)]:
        train_n, test_n = prepare(sized.filter(F.col(size) == n), test)
        start = time.perf_counter()
        model = fit_margin(train_n, "phi", label, c, max_iter=max_iter)
        seconds.append((n, time.perf_counter() - start))
        for split, part in (("train", train_n), ("test", test_n)):
            rows = model.score(part, "phi").select(F.lit(n).alias("size"), F.lit(split).alias("split"), F.col(label).alias("y"), "pred")
            scored = rows if scored is None else scored.unionByName(rows)
    spark = sized.sparkSession
    if scored is None:
        return spark.createDataFrame([], "size int, train_f1 double, test_f1 double, gap double, seconds double")
    wide = macro_f1(scored, ["size", "split"]).groupBy("size").pivot("split", ["train", "test"]).agg(F.first("macro_f1"))
    times = spark.createDataFrame(seconds, "size int, seconds double")
    return wide.join(times, "size").select("size", F.col("train").alias("train_f1"), F.col("test").alias("test_f1"),
                                           (F.col("train") - F.col("test")).alias("gap"), "seconds")
