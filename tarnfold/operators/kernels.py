"""Kernel statistics (inventory G).

Two forms. The map form covers kernels with an exact finite map (linear, polynomial): statistics of the N x N
matrix follow from sums over the N rows. The row form serves any kernel against a bounded set of reference rows
(at most MAX_REFERENCE, checked): each row carries its kernel values as one array; no pair table is built.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.hashing import draw_rank
from tarnfold.functions.moments import second_moments, vector_summary
from tarnfold.functions.vectors import dot, squared_distance
from tarnfold.operators.ranking import value_ranks
from tarnfold.session import bounded, settle

#: Most reference rows a kernel row may be computed against.
MAX_REFERENCE = 4096


def scale_gamma(df: DataFrame, vector: str) -> float:
    """1 / (d * population variance over all cells); 1 / d when the variance is 0."""
    row = vector_summary(df, vector).first()
    mean, var = np.asarray(row["mean"]), np.asarray(row["var_pop"])
    whole = float(var.mean() + ((mean - mean.mean()) ** 2).mean())
    return 1.0 / (len(mean) * whole) if whole > 0 else 1.0 / len(mean)


# --- values for given pairs -------------------------------------------------------------------------------------

def linear_value(a: Column, b: Column) -> Column:
    return dot(a, b)


def poly_value(a: Column, b: Column, gamma: float, coef0: float = 0.0) -> Column:
    base = F.lit(gamma) * dot(a, b) + F.lit(coef0)
    return base * base


def rbf_value(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(F.lit(-gamma) * squared_distance(a, b))


def label_value(a: Column, b: Column) -> Column:
    """Ideal kernel of 0/1 labels: +1 for equal ones, -1 otherwise."""
    return (F.lit(2) * a - F.lit(1)) * (F.lit(2) * b - F.lit(1))


# --- row form ---------------------------------------------------------------------------------------------------

def reference_rows(df: DataFrame, vector: str, order, label: str | None = None):
    """Reference vectors (and labels) as arrays, ordered by key. More than MAX_REFERENCE rows is an error."""
    cols = [F.col(vector).cast("array<double>").alias("v")] + ([F.col(label).alias("y")] if label else [])
    rows = df.select(*[F.col(c) for c in order], *cols).limit(MAX_REFERENCE + 1).toPandas()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"at most {MAX_REFERENCE} reference rows; sample them first")
    rows = rows.sort_values(list(order)).reset_index(drop=True)
    return np.stack(rows["v"].to_numpy()), (rows["y"].to_numpy().astype(float) if label else None)


def kernel_rows(df: DataFrame, vector: str, reference, kind: str, gamma: float = 1.0, coef0: float = 0.0,
                out: str = "k") -> DataFrame:
    """Adds the array of kernel values of each row against ``reference`` (a matrix from ``reference_rows``)."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(reference))

    @F.pandas_udf("array<double>")
    def against(v: pd.Series) -> pd.Series:
        ref = shared.value
        rows = np.stack(v.to_numpy()) if len(v) else np.zeros((0, ref.shape[1]))
        gram = rows @ ref.T
        if kind == "poly":
            gram = (gamma * gram + coef0) ** 2
        elif kind == "rbf":
            dist = (rows ** 2).sum(axis=1)[:, None] + (ref ** 2).sum(axis=1)[None, :] - 2.0 * gram
            gram = np.exp(-gamma * np.maximum(dist, 0.0))
        return pd.Series(list(gram))

    return df.withColumn(out, against(F.col(vector).cast("array<double>")))


def numbered(df: DataFrame, order, pos: str = "pos") -> DataFrame:
    """Position 0..m-1 by key, for a bounded reference set."""
    return df.withColumn(pos, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).cast("int"))


def _signed(labels) -> Column:
    return F.array(*[F.lit(2.0 * float(v) - 1.0) for v in labels])


def row_alignment(rows: DataFrame, labels, y: str, k: str = "k", by=()) -> DataFrame:
    """<K, yy'> / (|K| |yy'|); 0 when either norm is 0."""
    ky = dot(F.col(k), _signed(labels)) * (F.lit(2.0) * F.col(y) - F.lit(1.0))
    sums = rows.groupBy(*by).agg(F.sum(ky).alias("a"), F.sum(dot(F.col(k), F.col(k))).alias("b"), F.sum(F.size(k)).alias("m"))
    return sums.select(*by, F.coalesce(F.try_divide(F.col("a"), F.sqrt("b") * F.sqrt("m")), F.lit(0.0)).alias("alignment"))


def row_max_normalize(rows: DataFrame, k: str = "k") -> DataFrame:
    top = rows.agg(F.max(F.array_max(k))).first()[0]
    return rows.withColumn(k, F.transform(k, lambda v: v / F.lit(top)))


def row_center(rows: DataFrame, pos: str = "pos", k: str = "k", out: str = "centered") -> DataFrame:
    """HKH of a symmetric bounded matrix: take off both means, add the grand mean. Needs one number per reference row."""
    mean = F.aggregate(k, F.lit(0.0), lambda s, v: s + v) / F.size(k)
    means = [r[1] for r in rows.select(pos, mean.alias("m")).orderBy(pos).collect()]
    grand = float(np.mean(means))
    column = F.array(*[F.lit(float(m)) for m in means])
    return rows.withColumn(out, F.zip_with(k, column, lambda v, m: v - m - mean + F.lit(grand)))


def row_cka(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine of two centered kernels held in the same rows; 0 when one vanishes."""
    s = rows.agg(F.sum(dot(F.col(a), F.col(b))).alias("ab"), F.sum(dot(F.col(a), F.col(a))).alias("aa"),
                 F.sum(dot(F.col(b), F.col(b))).alias("bb"))
    return s.select(F.coalesce(F.try_divide(F.col("ab"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))), F.lit(0.0)).alias("cka"))


def row_effective_rank(rows: DataFrame, pos: str = "pos", k: str = "k", by=()) -> DataFrame:
    """trace^2 / |K|^2, which equals (sum s)^2 / sum s^2 for a positive semidefinite matrix."""
    return rows.groupBy(*by).agg(
        (F.pow(F.sum(F.col(k)[F.col(pos)]), 2) / F.sum(dot(F.col(k), F.col(k)))).alias("effective_rank"))


def row_block_ratio(rows: DataFrame, labels, y: str, k: str = "k", by=()) -> DataFrame:
    """Mean kernel value inside classes (diagonal included) and across them."""
    same = F.zip_with(k, F.array(*[F.lit(int(v)) for v in labels]), lambda v, l: F.when(l == F.col(y), v).otherwise(0.0))
    inside = F.aggregate(same, F.lit(0.0), lambda s, v: s + v)
    whole = F.aggregate(k, F.lit(0.0), lambda s, v: s + v)
    ones = [int(v) for v in labels]
    mates = F.when(F.col(y) == 1, F.lit(sum(ones))).otherwise(F.lit(len(ones) - sum(ones)))
    agg = rows.groupBy(*by).agg(F.sum(inside).alias("i"), F.sum(whole).alias("w"), F.sum(mates).alias("ni"), F.sum(F.size(k)).alias("nw"))
    within, across = F.col("i") / F.col("ni"), (F.col("w") - F.col("i")) / (F.col("nw") - F.col("ni"))
    return agg.select(*by, within.alias("within"), across.alias("across"), (within / (across + F.lit(1e-12))).alias("block_ratio"))


def row_concentration(rows: DataFrame, pos: str = "pos", k: str = "k", by=()) -> DataFrame:
    """Mean and population variance off the diagonal, and effective rank."""
    diag = F.col(k)[F.col(pos)]
    s = rows.groupBy(*by).agg(
        F.sum(F.aggregate(k, F.lit(0.0), lambda a, v: a + v) - diag).alias("s1"),
        F.sum(dot(F.col(k), F.col(k)) - diag * diag).alias("s2"), F.sum(F.size(k) - 1).alias("m"),
        F.sum(diag).alias("t"), F.sum(dot(F.col(k), F.col(k))).alias("q"))
    mean = F.col("s1") / F.col("m")
    return s.select(*by, mean.alias("mean_off"), (F.col("s2") / F.col("m") - mean * mean).alias("var_off"),
                    (F.col("t") * F.col("t") / F.col("q")).alias("effective_rank"))


def row_difference(rows: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Frobenius cosine, distance / n^2, mean absolute error and root mean square error of two matrices."""
    s = rows.groupBy(*by).agg(
        F.sum(dot(F.col(a), F.col(b))).alias("ab"), F.sum(dot(F.col(a), F.col(a))).alias("aa"),
        F.sum(dot(F.col(b), F.col(b))).alias("bb"), F.sum(squared_distance(F.col(a), F.col(b))).alias("d2"),
        F.sum(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, v: t + v)).alias("d1"),
        F.sum(F.size(a)).alias("m"))
    return s.select(*by, (F.col("ab") / (F.sqrt("aa") * F.sqrt("bb") + F.lit(1e-12))).alias("cosine"),
                    (F.sqrt("d2") / F.col("m")).alias("distance"), (F.col("d1") / F.col("m")).alias("mae"),
                    F.sqrt(F.col("d2") / F.col("m")).alias("rmse"))


def row_entry_variance(rows: DataFrame, key, k: str, exact: str, by=()) -> DataFrame:
    """Over repeats of the same row: mean per-entry population variance, and mean absolute error against ``exact``."""
    packed = rows.groupBy(*by, *key).agg(F.collect_list(k).alias("_all"), F.first(exact).alias("_exact"))
    m = F.size("_all")
    first = F.aggregate("_all", F.transform("_exact", lambda v: F.lit(0.0)), lambda s, a: F.zip_with(s, a, lambda x, y: x + y))
    second = F.aggregate("_all", F.transform("_exact", lambda v: F.lit(0.0)), lambda s, a: F.zip_with(s, a, lambda x, y: x + y * y))
    var = F.zip_with(first, second, lambda s1, s2: s2 / m - (s1 / m) * (s1 / m))
    err = F.aggregate("_all", F.lit(0.0), lambda s, a: s + F.aggregate(
        F.zip_with(a, F.col("_exact"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, v: t + v))
    return packed.groupBy(*by).agg(
        (F.sum(F.aggregate(var, F.lit(0.0), lambda s, v: s + v)) / F.sum(F.size("_exact"))).alias("entry_variance"),
        (F.sum(err) / F.sum(m * F.size("_exact"))).alias("mae"))


def diagonal_check(rows: DataFrame, pos: str = "pos", k: str = "k", floor: float = 0.99) -> DataFrame:
    low = F.min(F.col(k)[F.col(pos)])
    return rows.agg(low.alias("min_self"), (low >= floor).alias("ok"))


# --- map form ---------------------------------------------------------------------------------------------------

def map_statistics(df: DataFrame, phi: str, dim: int, y: str, by=()) -> DataFrame:
    """Alignment, label CKA, effective rank, block means, off-diagonal mean and variance of the full N x N kernel.

    With M = sum phi phi' and s = sum phi: |K| = |M|, trace K = trace M, sum K = |s|^2, and the class sums give the label
    terms. One pass sums a block per class, with K_ii as an extra component; the rest works on those blocks.
    """
    by = list(by)
    rows = df.select(*by, F.col(y).cast("int").alias("_y"), F.concat(F.col(phi), F.array(dot(F.col(phi), F.col(phi)))).alias("_z"))
    blocks = settle(second_moments(rows, "_z", dim + 1, [*by, "_y"]))
    one, own = F.lit(dim + 1), F.lit(dim)            # index of the constant and of K_ii
    moments = blocks.groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))
    double = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(2.0))
    inner = F.col("j") < own
    total = moments.groupBy(*by).agg(
        F.sum(F.when(inner, double * F.col("s") * F.col("s"))).alias("k2"),
        F.sum(F.when(inner & (F.col("i") == F.col("j")), F.col("s"))).alias("trace"),
        F.sum(F.when((F.col("i") < own) & (F.col("j") == one), F.col("s") * F.col("s"))).alias("ksum"),
        F.sum(F.when((F.col("i") == own) & (F.col("j") == own), F.col("s"))).alias("diag2"),
        F.sum(F.when((F.col("i") == one) & (F.col("j") == one), F.col("s"))).alias("n"))
    # |M - n mu mu'|^2 needs mu' M mu: each M entry meets the two sums it touches
    sums = moments.filter((F.col("j") == one) & (F.col("i") < own)).select(*by, F.col("i").alias("_at"), F.col("s").alias("_sum"))
    left = sums.select(*by, F.col("_at").alias("i"), F.col("_sum").alias("_si"))
    right = sums.select(*by, F.col("_at").alias("j"), F.col("_sum").alias("_sj"))
    cross = moments.filter(inner).join(left, [*by, "i"]).join(right, [*by, "j"]) \
        .groupBy(*by).agg(F.sum(double * F.col("s") * F.col("_si") * F.col("_sj")).alias("sms"))
    classes = blocks.filter(F.col("j") == one).groupBy(*by, "_y").agg(
        F.sum(F.when(F.col("i") < own, F.col("s") * F.col("s"))).alias("_cc"), F.sum(F.when(F.col("i") == one, F.col("s"))).alias("_n"))
    labels = classes.groupBy(*by).agg(
        F.sum("_cc").alias("within_sum"), F.sum(F.col("_n") * F.col("_n")).alias("within_n"),
        F.sum(F.when(F.col("_y") == 1, F.col("_cc")).otherwise(-F.col("_cc"))).alias("ygap"),   # y' K 1
        F.sum(F.when(F.col("_y") == 1, F.col("_n")).otherwise(-F.col("_n"))).alias("ysum"))
    out = _join_rows(_join_rows(total, cross, by), labels, by)
    n, ks, within = F.col("n"), F.col("ksum"), F.col("within_sum")
    across_sum = ks - within                        # both orders of the two classes
    signed = within - across_sum                    # y' K y
    centered2 = F.col("k2") - F.lit(2.0) / n * F.col("sms") + ks * ks / (n * n)
    ybar = F.col("ysum") / n
    label_mass = n - F.col("ysum") * F.col("ysum") / n
    off = n * (n - 1)
    mean_off = F.try_divide(ks - F.col("trace"), off)
    return out.select(
        *by, n.cast("long").alias("n"),
        F.coalesce(F.try_divide(signed, F.sqrt("k2") * n), F.lit(0.0)).alias("alignment"),
        F.coalesce(F.try_divide(signed - F.lit(2.0) * ybar * F.col("ygap") + ybar * ybar * ks,
                                F.sqrt(F.greatest(centered2, F.lit(0.0))) * label_mass), F.lit(0.0)).alias("label_cka"),
        F.try_divide(F.col("trace") * F.col("trace"), F.col("k2")).alias("effective_rank"),
        F.try_divide(within, F.col("within_n")).alias("within"),
        F.try_divide(across_sum, n * n - F.col("within_n")).alias("across"),
        mean_off.alias("mean_off"),
        (F.try_divide(F.col("k2") - F.col("diag2"), off) - mean_off * mean_off).alias("var_off"))


def _join_rows(a: DataFrame, b: DataFrame, by) -> DataFrame:
    """Join result-sized tables on their group, or on a constant when there is none."""
    if by:
        return a.join(b, list(by))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def map_center(df: DataFrame, phi: str, dim: int, out: str = "squares") -> DataFrame:
    """Adds each row's sum of squares in the doubly centered N x N kernel: c' C c with c the row's centered map and C the sum
    of c c' over all rows. The driver gets the D x D block and the mean."""
    mean = np.asarray(vector_summary(df, phi).first()["mean"])
    block = _block(second_moments(df, phi, dim, shift=mean), dim)
    shared = df.sparkSession.sparkContext.broadcast((mean, block))

    @F.pandas_udf("double")
    def squares(v: pd.Series) -> pd.Series:
        mean, block = shared.value
        c = np.stack(v.to_numpy()) - mean if len(v) else np.zeros((0, len(mean)))
        return pd.Series(np.einsum("ij,ij->i", c @ block, c))

    return df.withColumn(out, squares(F.col(phi).cast("array<double>")))


def map_max_normalize(df: DataFrame, phi: str, dim: int, out: str = "total") -> DataFrame:
    """Adds each row's sum in the N x N kernel divided by its largest entry, which for a positive semidefinite kernel stands on
    the diagonal; ``top`` is the row's own entry after division."""
    own = dot(F.col(phi), F.col(phi))
    top = df.agg(F.max(own)).first()[0]
    summary = vector_summary(df, phi).first()
    sums = F.array(*[F.lit(float(m * summary["n"])) for m in summary["mean"]])
    return df.withColumn(out, dot(F.col(phi), sums) / F.lit(top)).withColumn("top", own / F.lit(top))


def map_diagonal(df: DataFrame, phi: str, floor: float) -> DataFrame:
    """Least diagonal entry, and whether it is ``floor`` or more."""
    low = F.min(dot(F.col(phi), F.col(phi)))
    return df.agg(low.alias("min_self"), (low >= floor).alias("ok"))


def _block(moments: DataFrame, dim: int) -> np.ndarray:
    """Products of components as a symmetric D x D matrix: D (D + 1) / 2 rows on the driver."""
    block = np.zeros((dim, dim))
    for r in moments.filter((F.col("i") < dim) & (F.col("j") < dim)).collect():
        block[r["i"], r["j"]] = block[r["j"], r["i"]] = r["s"]
    return block


def map_cka(df: DataFrame, phi_a: str, dim_a: int, phi_b: str, dim_b: int) -> DataFrame:
    """CKA of two mapped kernels: |C_ab|^2 / (|C_aa| |C_bb|) with centered cross moments of the joined maps."""
    both = df.select(F.concat(F.col(phi_a), F.col(phi_b)).alias("_z"))
    dim = dim_a + dim_b
    mean = list(vector_summary(both, "_z").first()["mean"])
    c = second_moments(both, "_z", dim, shift=mean).filter((F.col("i") < dim) & (F.col("j") < dim))
    double = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(2.0))
    sq = F.col("s") * F.col("s")
    s = c.agg(F.sum(F.when((F.col("i") < dim_a) & (F.col("j") >= dim_a), sq)).alias("ab"),
              F.sum(F.when(F.col("j") < dim_a, double * sq)).alias("aa"), F.sum(F.when(F.col("i") >= dim_a, double * sq)).alias("bb"))
    return s.select(F.coalesce(F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0)).alias("cka"))


def spectrum(df: DataFrame, phi: str, dim: int) -> DataFrame:
    """Nonzero eigenvalues of the N x N kernel, from the D x D moment matrix, with cumulative shares."""
    values = np.clip(np.linalg.eigvalsh(_block(second_moments(df, phi, dim), dim))[::-1], 0.0, None)
    share = np.cumsum(values) / (values.sum() or 1.0)
    return df.sparkSession.createDataFrame(
        [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(values, share))],
        "component int, eigenvalue double, cumulative double")


def components_for(table: DataFrame, shares=(0.90, 0.99)) -> DataFrame:
    """Fewest components that reach each share."""
    return table.agg(*[F.min(F.when(F.col("cumulative") >= s - 1e-12, F.col("component"))).alias(f"n_{round(s * 100)}") for s in shares])


def map_bootstrap(rows: DataFrame, phi: str, dim: int, y: str, times: str = "times", replicate: str = "replicate") -> DataFrame:
    """Alignment and effective rank of every resample (rows with multiplicities), straight from weighted moments."""
    signed = rows.withColumn("_sy", (F.lit(2.0) * F.col(y) - 1.0) * F.col(times)) \
        .withColumn("_vec", F.col(phi))
    moments = second_moments(signed, "_vec", dim, [replicate], weight=times).filter((F.col("i") < dim) & (F.col("j") < dim))
    double = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(2.0))
    norms = moments.groupBy(replicate).agg(
        F.sum(double * F.col("s") * F.col("s")).alias("k2"), F.sum(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("trace"))
    scaled = signed.select(replicate, times, F.transform(phi, lambda v: v * F.col("_sy")).alias("_p"))
    sums = vector_summary(scaled, "_p", [replicate])
    total = scaled.groupBy(replicate).agg(F.sum(times).alias("m"))
    joined = norms.join(sums.select(replicate, F.transform("mean", lambda v: v * F.col("n")).alias("_s")), replicate).join(total, replicate)
    return joined.select(replicate, F.try_divide(dot(F.col("_s"), F.col("_s")), F.sqrt("k2") * F.col("m")).alias("alignment"),
                         F.try_divide(F.col("trace") * F.col("trace"), F.col("k2")).alias("effective_rank"))


# --- random pairs -----------------------------------------------------------------------------------------------

def random_row_pairs(df: DataFrame, key: str, vector: str, seed: int = 42) -> DataFrame:
    """Each row next to a row drawn for it by hash: (key, a, b). The partner is the row whose rank by key is drawn by hash;
    ranks come from range buckets, so the join is an equi-join of two columns spread over all tasks."""
    n = df.count()
    ranked = value_ranks(df.withColumn("_o", F.col(key).cast("double")), [], "_o", [key], rank="_rank").select(key, vector, "_rank")
    asked = ranked.select(key, F.col(vector).alias("a"), draw_rank([key], n, seed).alias("_rank"))
    return asked.join(ranked.select("_rank", F.col(vector).alias("b")), "_rank").select(key, "a", "b")


def unit_histogram(df: DataFrame, value: str, bins: int = 50, by=()) -> DataFrame:
    """Counts of [0, 1] values in equal bins, empty bins included; the last bin is closed on the right."""
    by = list(by)
    slot = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).between(0, 1)).groupBy(*by, slot.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    empty = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return empty.join(bounded(counts), [*by, "bin"], "left").select(*by, "bin", F.coalesce("c", F.lit(0)).alias("c"))


def divergence_from_beta(hist: DataFrame, dim: int, bins: int = 50, by=()) -> DataFrame:
    """KL divergence of a histogram from Beta(1, 2**dim - 1) taken at bin midpoints and renormalized."""
    b = 2 ** dim - 1
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    mid = (F.col("bin") + 0.5) / bins
    density = F.lit(float(b)) * F.pow(F.lit(1.0) - mid, b - 1)
    both = hist.withColumn("_d", density).withColumn("_p", F.try_divide(F.col("c").cast("double"), F.sum("c").over(whole))) \
        .withColumn("_q", F.col("_d") / F.sum("_d").over(whole))
    eps = 1e-12
    term = F.when(F.col("_p") > eps, F.col("_p") * F.log((F.col("_p") + eps) / (F.col("_q") + eps))).otherwise(0.0)
    return both.groupBy(*by).agg(F.sum(term).alias("kl"), F.sum("c").cast("long").alias("n"))


def falling(table: DataFrame, order: str, value: str, by=()) -> DataFrame:
    """Consecutive values with a flag that each is below the one before."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    return table.withColumn("previous", F.lag(value).over(w)) \
        .withColumn("falls", F.when(F.col("previous").isNotNull(), F.col(value) < F.col("previous")))
