"""Choosing K and the number of components (inventory F6, F14-F21). All inputs are result tables, one row per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.hashing import draw_rank
from tarnfold.operators.ranking import exact_quantiles, hash_ranks, join_groups

# Search constants.
MIN_ALPHA = 0.05
MIN_BETA = 0.05
MAX_GAMMA = 0.5
PAIR_PENALTY = 5
LARGEST_N = 10


def elbow(table: DataFrame, k: str = "k", mean: str = "f1_mean", slack: float = 0.01, by=()) -> DataFrame:
    """Smallest K within ``slack`` of the best mean, and the K of the best mean (smallest on ties)."""
    best = F.max(mean).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return table.withColumn("_best", best).groupBy(*by).agg(
        F.min(F.when(F.col(mean) >= F.col("_best") - slack, F.col(k))).alias("k_final"),
        F.min(F.when(F.col(mean) == F.col("_best"), F.col(k))).alias("k_optimal"),
        F.max(mean).alias("best_mean"))


def gate_cost(n: Column, reps: int = 2, largest: int = LARGEST_N) -> Column:
    """(n r + 5 r n (n - 1) / 2) relative to its value at the largest n."""
    raw = n * reps + F.lit(PAIR_PENALTY * reps) * (n * (n - 1) / 2)
    top = largest * reps + PAIR_PENALTY * reps * largest * (largest - 1) / 2
    return (raw / F.lit(float(top))).cast("double")


def normalize_metrics(table: DataFrame, by=()) -> DataFrame:
    """Adds s_norm (min-max of s_n) and dbi_norm (1 - min-max of dbi); a zero range divides by 1."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))

    def unit(c):
        span = F.max(c).over(whole) - F.min(c).over(whole)
        return (F.col(c) - F.min(c).over(whole)) / F.when(span > 0, span).otherwise(F.lit(1.0))

    return table.withColumn("s_norm", unit("s_n")).withColumn("dbi_norm", F.lit(1.0) - unit("dbi"))


def variance_gate(table: DataFrame, threshold: float = 0.85, check: bool = True) -> DataFrame:
    """Candidates whose variance share reaches the threshold; none at all is an error."""
    kept = table.filter(F.col("v_n") >= threshold)
    if check and kept.isEmpty():
        raise ValueError(f"no candidate reaches a variance share of {threshold}")
    return kept


def simplex_grid(table: DataFrame, steps: int = 30) -> DataFrame:
    """Every candidate at every admissible weight point (alpha, beta, gamma) = (i, j, steps - i - j) / steps.

    ``point`` = i (steps + 1) + j orders the grid. The points are two sequences exploded next to each candidate.
    """
    unit = F.lit(float(steps))
    rows = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_i"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps) - F.col("_i"))).alias("_j"))
    rows = rows.withColumns({
        "point": F.col("_i") * (steps + 1) + F.col("_j"), "alpha": F.col("_i") / unit, "beta": F.col("_j") / unit,
        "gamma": (F.lit(steps) - F.col("_i") - F.col("_j")) / unit})
    return rows.filter((F.col("alpha") >= MIN_ALPHA) & (F.col("beta") >= MIN_BETA) & (F.col("gamma") <= MAX_GAMMA)).drop("_i", "_j")


def objective(alpha: Column, beta: Column, gamma: Column) -> Column:
    return alpha * F.col("v_n") + beta * F.col("s_norm") - gamma * F.col("q_n")


def weight_search(table: DataFrame, steps: int = 30) -> DataFrame:
    """Per grid point the n of the best objective (smallest n on ties) with its dbi and objective."""
    scored = simplex_grid(table, steps).withColumn("f", objective(F.col("alpha"), F.col("beta"), F.col("gamma")))
    best = F.max_by(F.struct("n", "dbi", "f"), F.struct("f", -F.col("n")))
    return scored.groupBy("point", "alpha", "beta", "gamma").agg(best.alias("b")) \
        .select("point", "alpha", "beta", "gamma", F.col("b.n").alias("best_n"), F.col("b.dbi").alias("dbi"), F.col("b.f").alias("f_score"))


def best_weights(log: DataFrame) -> DataFrame:
    """Weights whose chosen n has the lowest dbi; the first grid point wins ties."""
    return log.agg(F.min_by(F.struct("alpha", "beta", "gamma", "best_n", "dbi"), F.struct("dbi", "point")).alias("w")).select("w.*")


def choose(table: DataFrame, weights: DataFrame) -> DataFrame:
    """F(n) of every candidate under the chosen weights, with the winner flagged."""
    w = weights.first()
    scored = table.withColumn("f_n", objective(F.lit(w["alpha"]), F.lit(w["beta"]), F.lit(w["gamma"])))
    best = F.max_by("n", F.struct("f_n", -F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return scored.withColumn("chosen", F.col("n") == best)


def pareto_front(table: DataFrame) -> DataFrame:
    """Candidates no other one beats on v_n (up), s_norm (up) and q_n (down); equal points stay."""
    a, b = table.alias("a"), table.select("v_n", "s_norm", "q_n").alias("b")
    as_good = (F.col("b.v_n") >= F.col("a.v_n")) & (F.col("b.s_norm") >= F.col("a.s_norm")) & (F.col("b.q_n") <= F.col("a.q_n"))
    better = (F.col("b.v_n") > F.col("a.v_n")) | (F.col("b.s_norm") > F.col("a.s_norm")) | (F.col("b.q_n") < F.col("a.q_n"))
    return a.join(b, as_good & better, "left_anti")


def candidate_report(table: DataFrame, front: DataFrame) -> DataFrame:
    """One row per n with its status: chosen, pareto or rejected / candidate."""
    on_front = front.select(F.col("n").alias("_n")).withColumn("_front", F.lit(True))
    joined = table.join(on_front, F.col("n") == F.col("_n"), "left").drop("_n")
    status = F.when(F.col("chosen"), "chosen").when(F.col("_front"), "pareto") \
        .when(~F.col("passes"), "rejected").otherwise("candidate")
    return joined.withColumn("status", status).drop("_front")


def bootstrap_rows(df: DataFrame, key, replicates: int, draws: int, seed: int = 42) -> DataFrame:
    """Rows of ``replicates`` resamples with replacement: (replicate, multiplicity, row).

    Slots pick ranks by hash, equal slots merge first, and the ranks meet the rows in one equi-join; a resample is
    never gathered anywhere.
    """
    ranked = hash_ranks(df, [], key, seed, rank="_rn", size="_n")
    n = df.count()
    slots = df.sparkSession.range(replicates * draws).select(
        F.floor(F.col("id") / draws).cast("int").alias("replicate"),
        draw_rank(["id"], n, seed + 1).alias("_rn"))
    picks = slots.groupBy("replicate", "_rn").agg(F.count(F.lit(1)).alias("times"))
    return ranked.join(picks, "_rn").drop("_rn", "_n")


def interval(table: DataFrame, value: str, by=(), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean, population std and percentile interval of replicate values."""
    stats = table.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    bounds = exact_quantiles(table, by, value, [low, high], ["low", "high"])
    if by:
        return join_groups(stats, bounds, by)
    return stats.withColumn("_j", F.lit(0)).join(bounds.withColumn("_j", F.lit(0)), "_j").drop("_j")
