"""Distributions, multi-run summaries and comparisons of result tables (inventory C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.operators.ranking import exact_quantiles


def _whole(by) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def label_distribution(df: DataFrame, columns, by=()) -> DataFrame:
    """Count and percentage per level combination. The window runs over levels, not rows."""
    counts = df.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(_whole(by)))


def share_comparison(sample: DataFrame, source: DataFrame, column: str, rare=(), margin: float = 2.0) -> DataFrame:
    """Percentage of each level in a sample and in its source, with a flag for rare levels raised by over ``margin`` points."""
    s = label_distribution(sample, [column]).select(column, F.col("n").alias("n_sample"), F.col("percent").alias("pct_sample"))
    o = label_distribution(source, [column]).select(column, F.col("n").alias("n_source"), F.col("percent").alias("pct_source"))
    joined = s.join(o, column, "full_outer").na.fill(0, ["n_sample", "n_source"]).na.fill(0.0, ["pct_sample", "pct_source"])
    return joined.withColumn("oversampled", F.col(column).isin(list(rare)) & (F.col("pct_sample") > F.col("pct_source") + margin))


def run_summary(df: DataFrame, by, values, ddof: int = 1) -> DataFrame:
    """Mean and standard deviation of each value over runs."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"),
                               *[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), std(v).alias(f"{v}_std"))])


def paired_drop(df: DataFrame, before: str, after: str, guard: float = 1e-9) -> DataFrame:
    """Absolute drop and percentage of the starting value."""
    drop = F.col(before) - F.col(after)
    return df.withColumn("drop_abs", drop).withColumn("drop_pct", drop / F.greatest(F.col(before), F.lit(guard)) * 100.0)


def to_wide(df: DataFrame, by, column: str, levels, value: str) -> DataFrame:
    """Pivot over known levels, so no extra job looks for them."""
    return df.groupBy(*by).pivot(column, list(levels)).agg(F.first(value))


def spread(df: DataFrame, by, value: str) -> DataFrame:
    """Population standard deviation over settings."""
    return df.groupBy(*by).agg(F.stddev_pop(value).alias("spread"))


def slope(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """Least-squares slope of y on x."""
    return df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"))


def representative_runs(df: DataFrame, by, run: str, value: str) -> DataFrame:
    """Run nearest to the mean and run of the maximum; the smaller run number wins ties."""
    mean = df.withColumn("_m", F.avg(value).over(Window.partitionBy(*by)))
    gap = F.round(F.abs(F.col(value) - F.col("_m")), 12)
    return mean.groupBy(*by).agg(
        F.min_by(run, F.struct(gap.alias("g"), F.col(run))).alias("nearest_mean"),
        F.max_by(run, F.struct(F.col(value).alias("v"), (-F.col(run)).alias("r"))).alias("best"))


def quartiles(df: DataFrame, by, value: str) -> DataFrame:
    """25th, 50th and 75th percentile with linear interpolation, exact and distributed."""
    return exact_quantiles(df, by, value, [0.25, 0.5, 0.75], ["p25", "median", "p75"])


def marginal_gain(df: DataFrame, x: str, value: str, by=()) -> DataFrame:
    """Change of value per unit of x between consecutive settings."""
    w = _whole(by).orderBy(x)
    return df.withColumn("gain", (F.col(value) - F.lag(value).over(w)) / (F.col(x) - F.lag(x).over(w)))


def result_delta(a: DataFrame, b: DataFrame, on, values) -> DataFrame:
    """Values of two result tables side by side with a - b."""
    left = a.select(*on, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(*on, *[F.col(v).alias(f"{v}_b") for v in values])
    return left.join(right, list(on)).withColumns({f"{v}_delta": F.col(f"{v}_a") - F.col(f"{v}_b") for v in values})


def rebuild_confusion(df: DataFrame, precision: str, recall: str, n: str, n_pos: str) -> DataFrame:
    """Confusion cells from published precision and recall; a zero in either means no hit and no false alarm."""
    none = (F.col(precision) == 0) | (F.col(recall) == 0)
    tp = F.when(none, F.lit(0.0)).otherwise(F.col(recall) * F.col(n_pos))
    fp = F.when(none, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(tp, F.col(precision)), F.lit(0.0)) - tp)
    return df.withColumn("tn", F.bround(F.col(n) - F.col(n_pos) - fp).cast("long")).withColumn("fp", F.bround(fp).cast("long")) \
        .withColumn("fn", F.bround(F.col(n_pos) - tp).cast("long")).withColumn("tp", F.bround(tp).cast("long"))


def rank_shift(df: DataFrame, f_score: str, mi: str, order: str = "pos") -> DataFrame:
    """Rank by F (table order on ties), rank by mutual information (ties averaged, then truncated), and the difference.

    The input has one row per feature.
    """
    whole = Window.partitionBy(F.lit(0))
    by_f = F.row_number().over(whole.orderBy(F.col(f_score).desc_nulls_last(), order))
    first = F.rank().over(whole.orderBy(F.col(mi).desc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(mi))
    return df.withColumn("rank_f", by_f.cast("long")) \
        .withColumn("rank_mi", F.floor(first + (ties - 1) / 2.0).cast("long")) \
        .withColumn("rank_shift", F.col("rank_f") - F.col("rank_mi"))


def extremes(df: DataFrame, score: str, tie: str, top: int, bottom: int) -> DataFrame:
    """First and last rows of a score order, tagged."""
    head = df.orderBy(F.col(score).desc_nulls_last(), tie).limit(top).withColumn("end", F.lit("top"))
    tail = df.orderBy(F.col(score).asc_nulls_first(), F.col(tie).desc()).limit(bottom).withColumn("end", F.lit("bottom"))
    return head.unionByName(tail)


def cost_summary(df: DataFrame, by, seconds: str, value: str, guard: float = 1e-9) -> DataFrame:
    """Seconds and value per setting over measured rows, and seconds per point of value."""
    s = df.filter(F.col(seconds).isNotNull()).groupBy(*by).agg(
        F.avg(seconds).alias("seconds_mean"), F.stddev_samp(seconds).alias("seconds_std"),
        F.avg(value).alias("value_mean"), F.stddev_samp(value).alias("value_std"))
    return s.withColumn("seconds_per_point", F.col("seconds_mean") / (F.col("value_mean") + F.lit(guard)))


def winners(df: DataFrame, by, model: str, value: str, higher_is_better: Column | bool = True) -> DataFrame:
    """Best model per group (metric, setting); direction is a flag or a boolean column. Ties go to the smaller name."""
    up = higher_is_better if isinstance(higher_is_better, Column) else F.lit(higher_is_better)
    signed = F.when(up, -F.col(value)).otherwise(F.col(value))
    return df.groupBy(*by).agg(F.min_by(F.struct(model, value), F.struct(signed.alias("s"), F.col(model))).alias("_w")) \
        .select(*by, F.col(f"_w.{model}").alias("winner"), F.col(f"_w.{value}").alias("winning_value"))
