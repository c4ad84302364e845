"""Paired tests, effect sizes and rank tests (inventory J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.scalars import band, ratio
from tarnfold.functions.tails import binomial_pvalue, chi2_pvalue, normal_pvalue
from tarnfold.operators.ranking import Splits, average_ranks

# Effect-size thresholds and words.
EFFECT_LIMITS = (0.2, 0.5, 0.8)
EFFECT_WORDS = ("negligible", "small", "medium", "large")
EFFECT_LIMITS_COARSE = (0.5, 0.8)
EFFECT_WORDS_COARSE = ("small", "medium", "large")


def pair_predictions(a: DataFrame, b: DataFrame, key, carry=()) -> DataFrame:
    """Two prediction tables side by side: y, pred_a, pred_b (and carried columns), joined on the row key."""
    left = a.select(*key, *carry, "y", F.col("pred").alias("pred_a"))
    return left.join(b.select(*key, F.col("pred").alias("pred_b")), list(key))


def agreement(df: DataFrame, by=(), y: str = "y", a: str = "pred_a", b: str = "pred_b", where: Column | None = None) -> DataFrame:
    """Rows both get right, only A, only B, and none."""
    ra, rb = F.col(a) == F.col(y), F.col(b) == F.col(y)
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*by).agg(
        F.count_if(ra & rb).alias("both_right"), F.count_if(ra & ~rb).alias("only_a"),
        F.count_if(~ra & rb).alias("only_b"), F.count_if(~ra & ~rb).alias("both_wrong"))


def only_a_right(df: DataFrame, y: str = "y", a: str = "pred_a", b: str = "pred_b") -> DataFrame:
    return df.filter((F.col(a) == F.col(y)) & (F.col(b) != F.col(y)))


def mcnemar_chi2(cells: DataFrame, pvalues: bool = True) -> DataFrame:
    """Continuity-corrected statistic (|A - B| - 1)^2 / (A + B) on the discordant cells; 0 and p = 1 when there are none."""
    d = F.col("only_a") + F.col("only_b")
    stat = ratio(F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, 2), d, 0.0)
    out = cells.withColumn("statistic", stat)
    return out.withColumn("p_value", F.when(d == 0, F.lit(1.0)).otherwise(chi2_pvalue(F.col("statistic")))) if pvalues else out


def mcnemar_exact(cells: DataFrame) -> DataFrame:
    """Two-sided binomial probability of the smaller discordant cell."""
    return cells.withColumn("p_value", binomial_pvalue(F.least("only_a", "only_b"), F.col("only_a") + F.col("only_b")))


def pooled(cells: DataFrame, by=()) -> DataFrame:
    """Cells summed over runs."""
    return cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("both_right", "only_a", "only_b", "both_wrong")])


def median_pvalue(tests: DataFrame, by=()) -> DataFrame:
    """Median of per-run p-values (result rows, one per run)."""
    return tests.groupBy(*by).agg(F.expr("percentile(p_value, 0.5)").alias("median_p"), F.count("p_value").alias("runs"))


def cohens_d(df: DataFrame, a: str, b: str, by=(), ddof: int = 1, eps: float = 0.0, nan_below: float | None = None,
             limits=EFFECT_LIMITS, words=EFFECT_WORDS) -> DataFrame:
    """(mean A - mean B) / (sqrt((var A + var B) / 2) + eps), with its word.

    ``nan_below`` makes the result null when the pooled deviation is smaller, or a side has fewer than two values.
    """
    var = F.var_samp if ddof == 1 else F.var_pop
    s = df.groupBy(*by).agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), var(a).alias("_va"), var(b).alias("_vb"),
                            F.count(a).alias("n_a"), F.count(b).alias("n_b"))
    pooled_sd = F.sqrt((F.col("_va") + F.col("_vb")) / 2.0)
    d = F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled_sd + F.lit(eps))
    if nan_below is not None:
        d = F.when((F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (pooled_sd >= nan_below), d)
    out = s.withColumn("d", d).withColumn("std_a", F.sqrt("_va")).withColumn("std_b", F.sqrt("_vb"))
    return out.withColumn("effect", band(F.col("d"), limits, words)).drop("_va", "_vb")


def side_by_side(df: DataFrame, model: str, a: str, value: str, keep) -> DataFrame:
    """Values of model ``a`` next to those of every other model, aligned on ``keep`` (run, level)."""
    left = df.filter(F.col(model) == a).select(*keep, F.col(value).alias("value_a"))
    right = df.filter(F.col(model) != a).select(*keep, F.col(model).alias("baseline"), F.col(value).alias("value_b"))
    return right.join(left, list(keep))


def effect_summary(effects: DataFrame, by) -> DataFrame:
    """Mean and std of d over runs, with the coarse word of the mean."""
    s = effects.groupBy(*by).agg(F.avg("d").alias("d_mean"), F.stddev_samp("d").alias("d_std"))
    return s.withColumn("effect", band(F.col("d_mean"), EFFECT_LIMITS_COARSE, EFFECT_WORDS_COARSE))


def mann_whitney(df: DataFrame, score: str, y: str, by=(), splits: Splits | None = None, pvalues: bool = True) -> DataFrame:
    """U of class 1 over class 0 and the one-sided p that class 1 scores higher (normal approximation with tie and
    continuity correction). Ranks are average ranks of the value table."""
    ranks = average_ranks(df, by, score, splits, {"c1": F.col(y).cast("long")})
    c = F.col("c").cast("double")
    s = ranks.groupBy(*by).agg(
        F.sum(F.col("c1") * F.col("avg_rank")).alias("_r1"), F.sum("c1").cast("double").alias("n1"), F.sum(c).alias("n"),
        F.sum(c * c * c - c).alias("_ties"))
    n1, n = F.col("n1"), F.col("n")
    n0 = n - n1
    u = F.col("_r1") - n1 * (n1 + 1) / 2.0
    var = n1 * n0 / 12.0 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1)))
    z = F.try_divide(u - n1 * n0 / 2.0 - 0.5, F.sqrt(var))
    out = s.select(*by, n1.cast("long").alias("n1"), n0.cast("long").alias("n0"), u.alias("u"), z.alias("z"))
    return out.withColumn("p_value", normal_pvalue(F.col("z"))) if pvalues else out


def score_summary(df: DataFrame, by, score: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
                               F.min(score).alias("low"), F.max(score).alias("high"))
