"""Exact finite feature maps: kernel(x, z) = map(x) . map(z), so kernel statistics need sums over rows, not over pairs.

Polynomial and Fourier maps are Arrow-batched functions from a block of vectors to a block of mapped vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that are mapped at a time: a mapped row may hold thousands of numbers.
STEP = 256


def _block_column(df: DataFrame, vector: str, out: str, block) -> DataFrame:
    """Adds ``out`` = ``block`` applied to the matrix of every ``STEP`` rows; no more mapped rows than these are held at once."""
    kept = [c for c in df.columns if c != out]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(vector).cast("array<double>").alias("_vector"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                v = part.column(batch.num_columns - 1)
                if v.null_count or len(pc.list_value_length(v).unique()) > 1:
                    raise ValueError("vectors must be of one length and not null")
                cells = block(v.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*kept, out])

    return source.mapInArrow(run, schema)


def poly2_block(x: np.ndarray, gamma: float, coef0: float = 0.0) -> np.ndarray:
    """Map of (gamma x.z + coef0)**2: squares, scaled products, and linear and constant terms when coef0 > 0."""
    i, j = np.triu_indices(x.shape[1])
    cells = gamma * x[:, i] * x[:, j] * np.where(i == j, 1.0, math.sqrt(2.0))
    if coef0:
        cells = np.hstack([cells, math.sqrt(2.0 * gamma * coef0) * x, np.full((len(x), 1), float(coef0))])
    return cells


def poly2_size(dim: int, coef0: float = 0.0) -> int:
    return dim * (dim + 1) // 2 + (dim + 1 if coef0 else 0)


def fourier_block(x: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Random Fourier features of a shift-invariant kernel with the given frequencies."""
    angle = x @ freq.T
    return np.hstack([np.cos(angle), np.sin(angle)]) / math.sqrt(len(freq))


def add_map(df: DataFrame, kind: str, vector: str, dim: int, out: str = "phi", gamma: float | None = None,
            coef0: float = 0.0, size: int = 256, seed: int = 42) -> tuple[DataFrame, int]:
    """The map named ``kind`` (linear, poly, rbf) and its length. ``coef0`` is added to a linear kernel and before the square of
    a polynomial one.

    ``rbf`` is approximate: its error falls as 1 / sqrt(size).
    """
    gamma = 1.0 / dim if gamma is None else gamma
    if kind == "linear":
        cells = F.col(vector).cast("array<double>")
        return (df.withColumn(out, F.concat(cells, F.array(F.lit(math.sqrt(coef0))))), dim + 1) if coef0 else (df.withColumn(out, cells), dim)
    if kind == "poly":
        return _block_column(df, vector, out, lambda x: poly2_block(x, gamma, coef0)), poly2_size(dim, coef0)
    if kind == "rbf":
        freq = np.random.default_rng(seed).normal(0.0, math.sqrt(2.0 * gamma), (size // 2, dim))
        return _block_column(df, vector, out, lambda x: fourier_block(x, freq)), 2 * (size // 2)
    raise ValueError(f"unknown kernel {kind!r}")
