"""Feature scores, selection and correlation tables (inventory F1-F4, F11-F13, F22-F26)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.moments import per_feature, vector_summary
from tarnfold.functions.tails import f_pvalue, t_pvalue
from tarnfold.functions.vectors import euclidean
from tarnfold.operators.blocks import BLOCK, numbered_rows, over_block_pairs, square_distances
from tarnfold.operators.ranking import Splits, average_ranks, running_totals
from tarnfold.session import bounded, cut_lineage


def class_moments(df: DataFrame, vector: str, label: str, names, by=()) -> DataFrame:
    """Rows (by, label, feature, n, mean, var_pop): one aggregation for every group, class and feature."""
    table = vector_summary(df, vector, [*by, label])
    return per_feature(table, [*by, label, "n"], ["mean", "var_pop", "low", "high"], names)


def anova_from_moments(moments: DataFrame, label: str, by=(), pvalues: bool = True) -> DataFrame:
    """F = (between / (k - 1)) / (within / (N - k)) per feature. Null when nothing varies, infinite when only the classes do."""
    by = list(by)
    whole = Window.partitionBy(*by, "feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    dev = moments.withColumn("_d", F.col("mean") - grand)
    agg = dev.groupBy(*by, "feature", "pos").agg(
        F.count(label).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("_d") * F.col("_d")).alias("between"),
        F.sum(F.col("n") * F.col("var_pop")).alias("within"))
    f_stat = F.when(F.col("within") > 0, (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))) \
        .when(F.col("between") > 0, F.lit(float("inf")))
    out = agg.filter("k > 1").withColumn("f_score", f_stat)
    if pvalues:
        out = out.withColumn("p_value", f_pvalue(F.col("f_score"), F.col("k") - 1, F.col("n") - F.col("k")))
    return out.drop("between", "within")


def anova(df: DataFrame, vector: str, label: str, names, by=(), pvalues: bool = True) -> DataFrame:
    """F and p of every feature against the classes."""
    return anova_from_moments(class_moments(df, vector, label, names, by), label, by, pvalues)


def top_k(scores: DataFrame, k: int, score: str = "f_score", by=(), rank: str = "rank") -> DataFrame:
    """K best features per group; ties go to the earlier feature, undefined scores come last."""
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = scores.withColumn(rank, F.row_number().over(order.orderBy(F.col(score).desc_nulls_last(), "pos")).cast("long"))
    return ranked.filter(F.col(rank) <= k)


def selected_positions(scores: DataFrame, k: int, score: str = "f_score") -> list[int]:
    """Positions of the K best features in table order (at most one row per feature reaches the driver)."""
    return sorted(r["pos"] for r in top_k(scores, k, score).select("pos").collect())


def keep_positions(df: DataFrame, vector: str, positions, out: str | None = None) -> DataFrame:
    return df.withColumn(out or vector, F.array(*[F.col(vector)[int(i)].cast("double") for i in positions]))


def significance_counts(scores: DataFrame, alpha: float = 0.05, zero: float = 1e-12) -> DataFrame:
    return scores.agg(
        F.count_if(F.col("p_value") < alpha).alias("n_significant"),
        F.count_if((F.col("p_value") >= alpha) | F.col("p_value").isNull()).alias("n_not_significant"),
        F.count_if(F.coalesce(F.col("f_score"), F.lit(0.0)) <= zero).alias("n_zero"))


def binned_mutual_information(df: DataFrame, columns, label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each column with a class, over equal-frequency bins of the distinct values.

    A value's bin is fixed by the share of rows below it, so equal values share a bin. Cost: one value table per
    column, then bins x classes counts.
    """
    out = None
    borders = Splits.of_each(df, columns)
    for pos, c in enumerate(columns):
        table = df.groupBy(F.col(c).cast("double").alias("v"), label).agg(F.count(F.lit(1)).alias("c"))
        values = table.groupBy("v").agg(F.sum("c").alias("c"))
        below = running_totals(values, [], "v", ["c"], borders[pos])
        binned = below.select("v", F.least(
            F.floor((F.col("cum_c") - F.col("c")) * F.lit(bins) / F.col("total_c")), F.lit(bins - 1)).alias("bin"))
        joint = table.join(binned, "v").groupBy("bin", label).agg(F.sum("c").alias("c")) \
            .select(F.lit(c).alias("feature"), F.lit(pos).alias("pos"), "bin", F.col(label).cast("string").alias("cls"), "c")
        out = joint if out is None else out.unionByName(joint)
    total = F.sum("c").over(Window.partitionBy("feature"))
    p = out.withColumn("p", F.col("c") / total) \
        .withColumn("pb", F.sum("c").over(Window.partitionBy("feature", "bin")) / total) \
        .withColumn("pc", F.sum("c").over(Window.partitionBy("feature", "cls")) / total)
    return p.groupBy("feature", "pos").agg(
        F.sum(F.col("p") * F.log(F.col("p") / (F.col("pb") * F.col("pc")))).alias("mutual_information"))


# --- class separation -------------------------------------------------------------------------------------------

def fisher_from_moments(moments: DataFrame, label: str, by=(), eps: float = 1e-8) -> DataFrame:
    """sum n_k (mu_k - mu)^2 / (sum n_k var_k + eps) per component."""
    by = list(by)
    whole = Window.partitionBy(*by, "feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    dev = moments.withColumn("_d", F.col("mean") - grand)
    return dev.groupBy(*by, "feature", "pos").agg(
        (F.sum(F.col("n") * F.col("_d") * F.col("_d")) / (F.sum(F.col("n") * F.col("var_pop")) + F.lit(eps))).alias("fisher"))


def fisher(df: DataFrame, vector: str, label: str, names, by=()) -> DataFrame:
    return fisher_from_moments(class_moments(df, vector, label, names, by), label, by)


def davies_bouldin(df: DataFrame, vector: str, label: str, prefixes=None) -> DataFrame:
    """Mean over classes of the worst (s_i + s_j) / d_ij. Two passes over the rows; the class pairs are result-sized.

    ``prefixes`` asks for the index of the first n components for several n at once: rows (n, davies_bouldin).
    """
    sizes = prefixes or [None]
    centers = bounded(vector_summary(df, vector, [label]).select(F.col(label).alias("_cls"), F.col("mean").alias("_center")), 10_000)

    def head(c, n):
        return c if n is None else F.slice(c, 1, n)

    v = F.col(vector).cast("array<double>")
    spread = df.join(centers, F.col(label) == F.col("_cls")).groupBy("_cls").agg(
        *[F.avg(euclidean(head(v, n), head(F.col("_center"), n))).alias(f"_s{i}") for i, n in enumerate(sizes)],
        F.first("_center").alias("_center"))
    per = F.array(*[F.struct(F.lit(n).cast("int").alias("n"), F.col(f"_s{i}").alias("_s"), head(F.col("_center"), n).alias("_c"))
                    for i, n in enumerate(sizes)])
    long = spread.select("_cls", F.inline(per))
    # One array with all centers (classes, not rows) per n: each class compares itself with it.
    whole = Window.partitionBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = long.withColumn("_all", F.collect_list(F.struct("_cls", "_s", "_c")).over(whole))
    worst = F.array_max(F.transform(
        F.filter("_all", lambda o: o["_cls"] != F.col("_cls")),
        lambda o: F.try_divide(F.col("_s") + o["_s"], euclidean(F.col("_c"), o["_c"]))))
    out = every.groupBy("n").agg(F.avg(worst).alias("davies_bouldin"))
    return out if prefixes else out.drop("n")


def silhouette(df: DataFrame, vector: str, label: str, block: int = BLOCK) -> DataFrame:
    """Mean Euclidean silhouette of all rows, and their number.

    Each block of rows meets each block of points in a task; distance sums per (row, class) are added by key, so neither the
    driver nor a task holds the table. A row alone in its class has 0, as has every row of a single class; a null label is a
    class like any other. Rows without a vector are left out.
    """
    label_text = F.col(label).cast("string")
    rows = numbered_rows(df, vector, F.coalesce(F.concat(F.lit("="), label_text), F.lit("")).alias("_y"))

    def sums(left, right):
        sides = []
        for block in (left, right):
            names, owner, count = np.unique(block["_y"].astype(str), return_inverse=True, return_counts=True)
            order = np.argsort(owner, kind="stable")
            sides.append((block["_row"][order], block["_v"][order], names, owner[order], count))
        (_, a, a_names, a_owner, _), (_, b, b_names, b_owner, _) = sides
        totals = np.zeros((len(a), len(b_names))), np.zeros((len(b), len(a_names)))

        def starts(owner):
            return np.append(0, np.flatnonzero(owner[1:] != owner[:-1]) + 1)

        for at, to, squares, _ in square_distances(a, b):
            distance, rows_of, columns_of = np.sqrt(squares, out=squares), starts(a_owner[at]), starts(b_owner[to])
            totals[0][at, b_owner[to][0]:b_owner[to][-1] + 1] += np.add.reduceat(distance, columns_of, axis=1)
            totals[1][to, a_owner[at][0]:a_owner[at][-1] + 1] += np.add.reduceat(distance, rows_of, axis=0).T
        return [{"_row": np.repeat(row, len(names)), "_y": np.repeat(own_names[owner], len(names)), "other": np.tile(names, len(row)), "total": total.ravel(), "n": np.tile(count, len(row))}
                for (row, _, own_names, owner, _), (_, _, names, _, count), total in zip(sides, sides[::-1], totals)]

    met = over_block_pairs(rows, sums, "_row long, _y string, other string, total double, n long", block)
    per = met.groupBy("_row", "_y", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mine = F.col("_y") == F.col("other")
    row = per.groupBy("_row").agg(F.max(F.when(mine & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("inside"), F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("nearest"))
    top = F.greatest("inside", "nearest")
    whole = F.col("inside").isNotNull() & F.col("nearest").isNotNull() & (top > 0)
    return row.select(F.when(whole, (F.col("nearest") - F.col("inside")) / top).otherwise(F.lit(0.0)).alias("w")) \
        .agg(F.avg("w").alias("silhouette"), F.count("w").alias("n"))


# --- correlation ------------------------------------------------------------------------------------------------

def _matrix_rows(spark, matrix, names, value: str) -> DataFrame:
    rows = [(a, b, i, j, None if np.isnan(matrix[i, j]) else float(matrix[i, j]))
            for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, f"a string, b string, i int, j int, {value} double")


def pearson(df: DataFrame, vector: str, names) -> DataFrame:
    """All d x d coefficients as rows; constant columns give null off the diagonal."""
    return _matrix_rows(df.sparkSession, _corr(df, vector, "pearson"), names, "pearson")


def _corr(df: DataFrame, vector: str, method: str):
    vec = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return Correlation.corr(vec, "_v", method).first()[0].toArray()


def rank_vectors(df: DataFrame, vector: str, dim: int, out: str = "ranks") -> DataFrame:
    """Each component replaced by its average rank, whatever the number of components in one plan: rows are unpivoted to
    (row, component, value), one value table ranks all components, and the ranks meet their rows again by row number.

    Rows with a null in any component are left out and not ranked.
    """
    cells = F.col(vector).cast("array<double>")
    whole = df.filter(cells.isNotNull() & ~F.exists(cells, lambda v: v.isNull()))
    rows = cut_lineage(whole.select(F.monotonically_increasing_id().alias("_row"), F.slice(cells, 1, dim).alias("_v")))
    long = rows.select("_row", F.posexplode("_v").alias("_pos", "_value"))
    table = average_ranks(long, ["_pos"], "_value").select("_pos", "_value", "avg_rank")
    ranked = long.join(table, ["_pos", "_value"]).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", "avg_rank"))).alias("_z"))
    return ranked.select(F.transform("_z", lambda z: z["avg_rank"]).alias(out))


def spearman(df: DataFrame, vector: str, names, pvalues: bool = True) -> DataFrame:
    """Spearman coefficients (Pearson of average ranks) of the rows without nulls, with two-sided p from Student's t on the
    result rows."""
    ranks = cut_lineage(rank_vectors(df, vector, len(names)))
    out = _matrix_rows(df.sparkSession, _corr(ranks, "ranks", "pearson"), names, "spearman")
    if not pvalues:
        return out
    n = ranks.count()
    rho = F.col("spearman")
    t = F.abs(rho) * F.sqrt(F.try_divide(F.lit(float(n - 2)), F.lit(1.0) - rho * rho))
    p = F.when(F.abs(rho) >= 1.0 - 1e-15, F.lit(0.0)).when(rho.isNotNull(), t_pvalue(t, F.lit(n - 2)))
    return out.withColumn("p_value", p)


def strong_pairs(matrix: DataFrame, value: str, limit: float) -> DataFrame:
    """Unordered pairs with abs(value) above the limit, strongest first."""
    return matrix.filter((F.col("i") < F.col("j")) & (F.abs(value) > limit)).orderBy(F.abs(value).desc(), "i", "j")


def nonlinear_excess(pearson_rows: DataFrame, spearman_rows: DataFrame, guard: float = 1e-9) -> DataFrame:
    """abs(Spearman) - abs(Pearson) and their ratio, per unordered pair."""
    s = spearman_rows.select("i", "j", "spearman")
    joined = pearson_rows.join(s, ["i", "j"]).filter("i < j")
    return joined.select("a", "b", "pearson", "spearman",
                         (F.abs("spearman") - F.abs("pearson")).alias("excess"),
                         (F.abs("spearman") / (F.abs("pearson") + F.lit(guard))).alias("ratio"))


def max_off_diagonal(matrix: DataFrame, value: str) -> DataFrame:
    return matrix.filter("i <> j").agg(F.max(F.abs(value)).alias("max_abs"))
