"""PCA and the explained-variance table (inventory F9, F10), also fitted per group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.moments import second_moments, vector_summary
from tarnfold.session import bounded


@dataclass
class CenteredPca:
    """Principal axes with the mean they were fitted around; each axis points so that its largest loading is positive."""

    model: object
    mean: list
    signs: list
    ratio: list

    @property
    def loadings(self) -> np.ndarray:
        return self.model.pc.toArray().T * np.asarray(self.signs)[:, None]

    def transform(self, df: DataFrame, vector: str, out: str = "scores", n: int | None = None) -> DataFrame:
        """Scores (x - mean) . axis. The library model projects without centering, so the projected mean is taken off."""
        n = n or len(self.ratio)
        raw = self.model.pc.toArray().T
        offset = raw @ np.asarray(self.mean)
        staged = df.withColumn("_pca_in", array_to_vector(F.col(vector).cast("array<double>")))
        projected = self.model.transform(staged).withColumn("_pca_out", vector_to_array("_pca_out"))
        cells = [(F.col("_pca_out")[i] - F.lit(float(offset[i]))) * F.lit(float(self.signs[i])) for i in range(n)]
        return projected.withColumn(out, F.array(*cells)).drop("_pca_in", "_pca_out")


def fit_pca(df: DataFrame, vector: str, n: int | None = None, variance: float | None = None) -> CenteredPca:
    """``n`` axes, or the fewest whose variance share reaches ``variance``. The covariance is a distributed aggregate;
    only the d x d eigenproblem runs on the driver."""
    mean = list(vector_summary(df, vector).first()["mean"])
    staged = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_pca_in"))
    model = PCA(k=len(mean), inputCol="_pca_in", outputCol="_pca_out").fit(staged)
    ratio = [float(v) for v in model.explainedVariance.toArray()]
    if variance is not None:
        # one part in 1e12 of slack, so that rounding in the last digit never adds an axis
        n = next((i + 1 for i, c in enumerate(np.cumsum(ratio)) if c >= variance - 1e-12), len(ratio))
    n = n or len(ratio)
    axes = model.pc.toArray().T
    signs = [1.0 if a[np.argmax(np.abs(a))] >= 0 else -1.0 for a in axes]
    return CenteredPca(model, mean, signs, ratio[:n])


def variance_table(spark, ratio) -> DataFrame:
    """One row per component: share and cumulative share."""
    cum = np.cumsum(ratio)
    return spark.createDataFrame([(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratio, cum))],
                                 "component int, ratio double, cumulative double")


def fit_pca_by(df: DataFrame, vector: str, dim: int, by, n: int) -> DataFrame:
    """PCA of every group from one pass of grouped second moments: rows (by, mean, axes, ratio).

    The driver solves one d x d eigenproblem per group; groups x d x d numbers reach it, bounded by the run table.
    """
    shift = list(vector_summary(df, vector).first()["mean"])
    moments = second_moments(df, vector, dim, by, shift).collect()
    blocks: dict = {}
    for r in moments:
        key = tuple(r[b] for b in by)
        block = blocks.setdefault(key, np.zeros((dim + 1, dim + 1)))
        block[r["i"], r["j"]] = block[r["j"], r["i"]] = r["s"]
    rows = []
    for key, block in sorted(blocks.items()):
        count = block[dim, dim]
        mu = block[:dim, dim] / count
        cov = block[:dim, :dim] / count - np.outer(mu, mu)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][:n]
        axes = vectors[:, order].T
        axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] >= 0, 1.0, -1.0)[:, None]
        total = float(np.clip(values, 0, None).sum()) or 1.0
        rows.append((*key, [float(v) for v in mu + np.asarray(shift)], [[float(v) for v in a] for a in axes],
                     [float(v) / total for v in values[order]]))
    fields = ", ".join(f"`{b}` {t}" for b, t in df.select(*by).dtypes)
    return df.sparkSession.createDataFrame(rows, f"{fields}, mean array<double>, axes array<array<double>>, ratio array<double>")


def apply_pca_by(df: DataFrame, params: DataFrame, vector: str, by, out: str = "scores") -> DataFrame:
    joined = df.join(bounded(params.select(*by, F.col("mean").alias("_mu"), F.col("axes").alias("_axes"))), list(by))
    centered = F.zip_with(F.col(vector).cast("array<double>"), F.col("_mu"), lambda a, b: a - b)
    score = F.transform("_axes", lambda axis: F.aggregate(
        F.zip_with(F.col("_centered"), axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return joined.withColumn("_centered", centered).withColumn(out, score).drop("_mu", "_axes", "_centered")
