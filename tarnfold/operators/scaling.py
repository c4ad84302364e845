"""Scalers fitted on train and applied anywhere, and noise injection (inventory E3-E5, E7-E9).

A fitted scaler is two short arrays on the driver; applying it is a projection. Fits per run, fold or size are rows of a
parameter table made by one grouped aggregation and joined on the group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.hashing import gaussian
from tarnfold.functions.moments import vector_summary
from tarnfold.functions.scalars import clip, rescale
from tarnfold.session import bounded

ANGLE_MAX = math.pi
#: Components written out one by one in a projection; longer vectors go through array functions, as generated code has a size limit.
UNROLLED = 16


@dataclass
class Scaler:
    """value -> (value - shift) / scale * width + base, limited to [base, base + width] when ``clipped``."""

    shift: list = field(default_factory=list)
    scale: list = field(default_factory=list)
    base: float = 0.0
    width: float = 1.0
    clipped: bool = False

    def apply(self, df: DataFrame, vector: str, out: str | None = None, clipped: bool | None = None) -> DataFrame:
        limit = self.clipped if clipped is None else clipped
        if len(self.shift) > UNROLLED:
            moved = F.zip_with(F.col(vector).cast("array<double>"), F.lit([float(a) for a in self.shift]), lambda v, a: v - a)
            cell = F.zip_with(moved, F.lit([float(s) for s in self.scale]), lambda v, s: v / s * F.lit(self.width) + F.lit(self.base))
            return df.withColumn(out or vector, F.transform(cell, lambda v: clip(v, self.base, self.base + self.width)) if limit else cell)
        cells = []
        for i, (a, s) in enumerate(zip(self.shift, self.scale)):
            cell = (F.col(vector)[i].cast("double") - F.lit(a)) / F.lit(s) * F.lit(self.width) + F.lit(self.base)
            cells.append(clip(cell, self.base, self.base + self.width) if limit else cell)
        return df.withColumn(out or vector, F.array(*cells))


def fit_minmax(df: DataFrame, vector: str, base: float = 0.0, top: float = 1.0, clipped: bool = True) -> Scaler:
    """Range scaler; constant columns map to ``base`` (their scale is 1)."""
    row = vector_summary(df, vector).first()
    scale = [(h - l) if h > l else 1.0 for l, h in zip(row["low"], row["high"])]
    return Scaler(list(row["low"]), scale, base, top - base, clipped)


def fit_standard(df: DataFrame, vector: str) -> Scaler:
    """Mean 0, population standard deviation 1; constant columns keep scale 1."""
    row = vector_summary(df, vector).first()
    return Scaler(list(row["mean"]), [math.sqrt(v) if v > 0 else 1.0 for v in row["var_pop"]])


def minmax_columns(train: DataFrame, data: DataFrame, columns, base: float = 0.0, top: float = 1.0,
                   clipped: bool = True) -> DataFrame:
    """Min-max of wide columns with ranges from ``train``: one aggregate row, then a projection."""
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))]
    row = train.agg(*aggs).first()
    out = {}
    for c in columns:
        cell = rescale(F.col(c).cast("double"), row[f"lo_{c}"], row[f"hi_{c}"], base, top)
        out[c] = clip(cell, base, top) if clipped else cell
    return data.withColumns(out)


def standard_columns(train: DataFrame, data: DataFrame, columns) -> DataFrame:
    row = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return data.withColumns({
        c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] if row[f"s_{c}"] else 1.0) for c in columns})


def fit_minmax_by(df: DataFrame, vector: str, by) -> DataFrame:
    """Ranges of every group in one aggregation: rows (by, low, high)."""
    return vector_summary(df, vector, by).select(*by, "low", "high")


def apply_minmax_by(df: DataFrame, params: DataFrame, vector: str, by, base: float = 0.0, top: float = 1.0,
                    clipped: bool = True) -> DataFrame:
    """Scale each row with the ranges of its group; the parameter table is broadcast only within its bound."""
    joined = df.join(bounded(params), list(by))
    cells = F.zip_with(F.zip_with(F.col(vector), F.col("low"), lambda v, l: v - l), F.zip_with("high", "low", lambda h, l: h - l),
                       lambda v, w: F.lit(base) + F.when(w > 0, v / w).otherwise(v) * F.lit(top - base))
    if clipped:
        cells = F.transform(cells, lambda v: clip(v, base, top))
    return joined.withColumn(vector, cells).drop("low", "high")


def add_noise(df: DataFrame, vector: str, dim: int, sigmas, key, seed: int = 0, extra=(), out: str | None = None) -> DataFrame:
    """Every row at every noise level: v_i + N(0, sigma), drawn from the hash of (extra, key, level number, i)."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(s)).alias("sigma")) for i, s in enumerate(sigmas)])
    spread = df.withColumn("_l", F.explode(levels))
    def noisy(v, i):
        return v + F.col("_l.sigma") * gaussian([*extra, *key, F.col("_l.level"), i], seed)

    cells = F.transform(F.slice(vector, 1, dim), noisy) if dim > UNROLLED else F.array(*[noisy(F.col(vector)[i], F.lit(i)) for i in range(dim)])
    return spread.withColumn(out or vector, cells).withColumn("sigma", F.col("_l.sigma")).drop("_l")


