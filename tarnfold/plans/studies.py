"""Studies over many fitted pipelines at once (inventory E8, F5, F7, H7, H11, H12, K2, K3, A9), on the grouped trainer.

Every function takes ``study_rows`` (or makes them) and fits all its models together, so the number of Spark jobs does not follow the number of folds,
runs, sizes or settings. Maps are refitted on exactly the rows a model learns from.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators import classifiers, metrics, scaling
from tarnfold.operators import trainer as T
from tarnfold.session import bounded


def _folds(moments: T.Moments):
    """(fold, the other folds)."""
    return [(k, frozenset(moments.parts) - {k}) for k in moments.parts]


def _held_out(design: T.Design) -> set:
    return {design.name["fold"]}


def k_scores(rows: DataFrame, ks, c: float = 1.0, most: int = 300) -> DataFrame:
    """(k, fold, tn, fp, fn, tp): the k best features by ANOVA of the training folds, tested on the fold left out."""
    moments = T.part_moments(rows)
    ks = [k for k in ks if k <= len(moments.base)]
    designs = []
    for fold, learns in _folds(moments):
        order = T.anova_order(moments, learns)
        designs += [T.Design({"k": int(k), "fold": int(fold)}, learns, *T.chosen(moments, order[:k]), c) for k in ks]
    return T.test_designs(rows, T.fit_designs(rows, moments, designs, most=most), _held_out)


def ablation_scores(rows: DataFrame, k: int, n: int, variance: float = 0.95, c: float = 1.0, most: int = 300) -> DataFrame:
    """(setting, fold, cells) of five pipelines: all features, PCA to a share of variance, the k best, PCA to n, the k best and PCA to n."""
    moments = T.part_moments(rows)
    every, designs = range(len(moments.base)), []
    for fold, learns in _folds(moments):
        best = T.anova_order(moments, learns)[:k]
        maps = {"1 all features": T.chosen(moments, every), "2 pca 95": T.principal_axes(moments, learns, every, variance=variance), "3 top k": T.chosen(moments, best),
                "4 pca n": T.principal_axes(moments, learns, every, n), "5 top k and pca n": T.principal_axes(moments, learns, best, min(n, len(best)))}
        designs += [T.Design({"setting": s, "fold": int(fold)}, learns, *m, c) for s, m in maps.items()]
    return T.test_designs(rows, T.fit_designs(rows, moments, designs, most=most), _held_out)


def c_scores(rows: DataFrame, cs=(0.01, 0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """(c, fold, cells): min-max refitted on the training folds, every penalty."""
    moments = T.part_moments(rows)
    designs = []
    for fold, learns in _folds(moments):
        held = T.scaled(moments, learns, range(len(moments.base)))  # one map for all penalties of a fold
        designs += [T.Design({"c": float(c), "fold": int(fold)}, learns, *held, float(c)) for c in cs]
    return T.test_designs(rows, T.fit_designs(rows, moments, designs), _held_out)


def cv_means(cells: DataFrame, by, ddof: int = 0, average: str = "macro") -> DataFrame:
    """Mean, std and standard error over folds of the F1 of confusion cells."""
    scores = metrics.macro_f1_of(cells) if average == "macro" else metrics.rates(cells).withColumn("macro_f1", F.col("f1"))
    return classifiers.cv_table(scores, by, ddof=ddof)


def angle_designs(rows: DataFrame, moments: T.Moments, names: dict, k: int, n: int, c: float = 1.0) -> list:
    """Designs select k -> PCA to n -> [0, pi] for every ``names`` entry {parts learnt from: name}, all refitted."""
    designs = []
    for learns, name in names.items():
        best = T.anova_order(moments, learns)[:k]
        designs.append(T.Design(name, learns, *T.principal_axes(moments, learns, best, min(n, len(best))), c))
    return T.to_angles(rows, designs)


def fitted_runs(rows: DataFrame, k: int, n: int, c: float = 1.0) -> list:
    """A fitted pipeline of every part: select, PCA, angles, classifier, all learnt from that part alone."""
    moments = T.part_moments(rows)
    designs = angle_designs(rows, moments, {frozenset([p]): {"train_run": int(p)} for p in moments.parts}, k, n, c)
    return T.fit_designs(rows, moments, designs)


def run_matrix(rows: DataFrame, fits: list) -> DataFrame:
    """(train_run, test_run, cells): every fitted run on every run's rows."""
    parts = [r["part"] for r in rows.select("part").distinct().collect()]
    return T.test_designs(rows, fits, lambda d: parts, by_part=True).withColumnRenamed("part", "test_run")


def noisy_scores(rows: DataFrame, fits: list, sigmas, key, seed: int = 9) -> DataFrame:
    """(train_run, sigma, y, score, pred, key): rows of a run's own part as angles with noise, scored by its model."""
    n = len(fits[0].w)
    phi = T.project_designs(rows, [f.design for f in fits], lambda d: set(d.learns), *key).withColumnRenamed("phi", "x")
    noisy = scaling.add_noise(phi, "x", n, sigmas, key, seed)
    limited = scaling.Scaler([0.0] * n, [math.pi] * n, 0.0, math.pi, True).apply(noisy, "x")
    models = T.model_table(rows.sparkSession, fits).select("model", *fits[0].design.name, "w", "b", "only")
    score = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.col("b"), lambda s, v: s + v)
    return limited.join(bounded(models), "model").withColumn("score", score).withColumn("pred", F.coalesce("only", (F.col("score") > 0).cast("int"))) \
        .select(*fits[0].design.name, "sigma", "y", "score", "pred", *key)


def learning_curve(sized: DataFrame, test: DataFrame, sizes, vector: str, label: str, size: str = "size", c: float = 1.0, path: str | None = None, model: str = "linear") -> DataFrame:
    """(size, train_f1, test_f1, gap, objective, duality_gap) for every training size, min-max refitted on each sample.

    With ``path``, a table of finished sizes (partitions model, size): those found there are not fitted again, new ones replace only their own partition, so a
    repeated or half-finished run leaves each size once.
    """
    spark = sized.sparkSession
    sizes = sorted({int(s) for s in sizes})
    done = finished(spark, path, model) if path else None
    left = [s for s in sizes if done is None or s not in {r["size"] for r in done.select("size").distinct().collect()}]
    fresh = None
    if left:
        rows = T.study_rows(sized.filter(F.col(size).isin(left)).select(vector, label, F.col(size).alias("_part"))
                            .unionByName(test.select(vector, label, F.lit(-1).alias("_part"))), vector, label, "_part")
        moments = T.part_moments(rows)
        designs = [T.Design({"size": s}, frozenset([s]), *T.scaled(moments, {s}, range(len(moments.base))), c) for s in left]
        fits = T.fit_designs(rows, moments, designs)
        f1 = metrics.macro_f1_of(T.test_designs(rows, fits, lambda d: {d.name["size"], -1}, by_part=True))
        wide = f1.groupBy("size").agg(F.max(F.when(F.col("part") != -1, F.col("macro_f1"))).alias("train_f1"), F.max(F.when(F.col("part") == -1, F.col("macro_f1"))).alias("test_f1"))
        proof = T.model_table(spark, fits).select("size", "objective", F.col("gap").alias("duality_gap"))
        fresh = wide.join(proof, "size").select("size", "train_f1", "test_f1", (F.col("train_f1") - F.col("test_f1")).alias("gap"), "objective", "duality_gap")
    if path is None:
        return fresh
    if fresh is not None:
        fresh.withColumn("model", F.lit(model)).write.option("partitionOverwriteMode", "dynamic").partitionBy("model", "size").mode("overwrite").parquet(path)
    return finished(spark, path, model).filter(F.col("size").isin(sizes))


CURVE = "train_f1 double, test_f1 double, gap double, objective double, duality_gap double, model string, size int"


def finished(spark, path: str, model: str) -> DataFrame:
    """Rows of a model in a table of finished sizes; none where there is no table yet."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], CURVE).select("size", "train_f1", "test_f1", "gap", "objective", "duality_gap")
    return spark.read.schema(CURVE).parquet(path).filter(F.col("model") == model).select("size", "train_f1", "test_f1", "gap", "objective", "duality_gap")
