"""Shift experiments over scored tables (inventory K): every run, model and setting goes through one grouped plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.operators import metrics, paired, reduction, sampling, scaling, summaries
from tarnfold.session import bounded, settle


def standard_vs_hard(scored: DataFrame, by, split: str = "split", average: str = "macro") -> DataFrame:
    """F1 on the standard and on the hard test, with the drop."""
    f1 = metrics.f1_score(scored, [*by, split], average=average)
    wide = summaries.to_wide(f1, by, split, ["standard", "hard"], "f1")
    wide = wide.select(*by, F.col("standard").alias("f1_standard"), F.col("hard").alias("f1_hard"))
    return summaries.paired_drop(wide, "f1_standard", "f1_hard")


def hard_test_mcnemar(scored: DataFrame, key, model: str, base: str, by=(), split: str = "split") -> DataFrame:
    """McNemar of a model against every other one on the hard rows."""
    hard = scored.filter(F.col(split) == "hard")
    a = hard.filter(F.col(model) == base).select(*by, *key, "y", F.col("pred").alias("pred_a"))
    b = hard.filter(F.col(model) != base).select(*by, *key, F.col(model).alias("baseline"), F.col("pred").alias("pred_b"))
    cells = paired.agreement(b.join(a, [*by, *key]), [*by, "baseline"])
    return paired.mcnemar_chi2(cells)


def run_matrix(train: DataFrame, test: DataFrame, vector: str, run: str, weights: DataFrame) -> DataFrame:
    """Every train run against every test run: each test row meets the parameter row of each train run.

    ``weights`` has one row per train run: low, high, w (array) and b. Rows are multiplied by the number of runs, which
    is what the experiment asks for; the parameter table is broadcast within its bound.
    """
    params = scaling.fit_minmax_by(train, vector, [run]).join(weights, run).withColumnRenamed(run, "train_run")
    params = settle(params.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("train_run"))))
    runs = params.count()
    offered = test.withColumnRenamed(run, "test_run").withColumn("_at", F.explode(F.sequence(F.lit(1), F.lit(runs)))) if runs \
        else test.withColumnRenamed(run, "test_run").withColumn("_at", F.lit(0))
    joined = offered.join(bounded(params), "_at").drop("_at")
    unit = F.zip_with(F.zip_with(F.col(vector), F.col("low"), lambda v, l: v - l), F.zip_with("high", "low", lambda h, l: h - l),
                      lambda v, s: F.when(s > 0, v / s).otherwise(v))
    score = F.aggregate(F.zip_with(unit, F.col("w"), lambda a, b: a * b), F.col("b"), lambda s, v: s + v)
    return joined.withColumn("score", score).withColumn("pred", (F.col("score") > 0).cast("int")).drop("low", "high", "w", "b")


def noise_sweep(scored: DataFrame, by, sigma: str = "sigma", average: str = "macro"):
    """F1 per noise level, and its slope over the levels."""
    f1 = metrics.f1_score(scored, [*by, sigma], average=average)
    return f1, summaries.slope(f1, by, sigma, "f1")


def prior_rebuild(df: DataFrame, n: int, label: str, category: str, normal: str, only: str, key, seed: int = 42) -> DataFrame:
    """Three test distributions: half and half, 70 % attack, and normal against one attack group."""
    half = n // 2
    seventy = round(0.7 * n)
    parts = [
        ("half", sampling.binary_counts_sample(df, half, n - half, label, key, seed)),
        ("seventy", sampling.binary_counts_sample(df, n - seventy, seventy, label, key, seed + 1)),
        ("only_" + only, sampling.sample_by_counts(df, {normal: half, only: n - half}, category, key, seed + 2)),
    ]
    out = None
    for name, part in parts:
        part = part.withColumn("distribution", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def prior_subsamples(df: DataFrame, shares, label: str, key, seed: int = 42) -> DataFrame:
    """The largest subsample of each attack share, stacked."""
    out = None
    for i, s in enumerate(shares):
        part = sampling.prior_subsample(df, s, label, key, seed + i).withColumn("share", F.lit(float(s)))
        out = part if out is None else out.unionByName(part)
    return out


def unchanged(a: DataFrame, b: DataFrame, on, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Result sets that must agree: rows compared, largest difference, verdict. Rows found on one side only fail."""
    left = a.select(*on, F.col(value).alias("_a"))
    right = b.select(*on, F.col(value).alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    j = left.join(right, list(on), "full_outer")
    lone = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    return j.agg(F.count(F.lit(1)).alias("rows"), F.max(gap).alias("max_delta"), lone.alias("unmatched")) \
        .withColumn("ok", (F.col("max_delta") < tolerance) & (F.col("unmatched") == 0))


def per_run_scores(train: DataFrame, test: DataFrame, vector: str, dim: int, run: str, n: int) -> DataFrame:
    """PCA refitted on every train run (one pass for all) and applied to the test rows of the same run."""
    params = reduction.fit_pca_by(train, vector, dim, [run], n)
    return reduction.apply_pca_by(test, params, vector, [run])
