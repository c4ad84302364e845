"""First and second moments of vector columns, per group, in one pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector_summary(df: DataFrame, vector: str, by=()) -> DataFrame:
    """Per group: n and the arrays mean, var_pop, low, high. Partial aggregates merge before the shuffle."""
    by = list(by)
    metrics = Summarizer.metrics("count", "mean", "variance", "min", "max")
    source = df.select(*by, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    stats = source.groupBy(*by).agg(metrics.summary(F.col("_v")).alias("_s"))
    n = F.col("_s.count")
    shrink = F.when(n > 0, (n - 1) / n).otherwise(F.lit(0.0))
    return stats.select(
        *by, n.alias("n"), vector_to_array("_s.mean").alias("mean"),
        F.transform(vector_to_array("_s.variance"), lambda v: v * shrink).alias("var_pop"),
        vector_to_array("_s.min").alias("low"), vector_to_array("_s.max").alias("high"))


def per_feature(table: DataFrame, by, arrays, names) -> DataFrame:
    """One row per (by, feature) from parallel array columns."""
    zipped = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), *[F.col(a) for a in arrays])
    return table.select(*by, F.posexplode(zipped).alias("pos", "_z")).select(*by, "pos", "_z.*")


def second_moments(df: DataFrame, vector: str, dim: int, by=(), shift=None, weight: str | None = None) -> DataFrame:
    """Sums of products: rows (by, i <= j, s) with s = sum of w (v_i - shift_i)(v_j - shift_j); index ``dim`` is the constant 1.

    Each task reduces its rows to one (dim + 1) x (dim + 1) block per group with a matrix product, so the shuffle
    carries blocks, not rows.
    """
    by = list(by)
    center = np.zeros(dim) if shift is None else np.asarray(shift, dtype=float)
    upper_i, upper_j = np.triu_indices(dim + 1)
    source = df.select(*by, F.col(vector).cast("array<double>").alias("_v"),
                       (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    fields = [f for f in source.schema.fields if f.name in by]
    schema = T.StructType([*fields, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                           T.StructField("s", T.DoubleType())])

    def blocks(batches):
        acc: dict = {}
        types = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = [batch.schema.field(n).type for n in by]
            rows = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim) - center
            rows = np.hstack([rows, np.ones((batch.num_rows, 1))])
            weights = batch.column("_w").to_numpy(zero_copy_only=False)
            places = {(): slice(None)}
            if by:
                frame = pd.DataFrame({n: batch.column(n).to_pandas() for n in by})
                places = {k if isinstance(k, tuple) else (k,): at for k, at in frame.groupby(by, sort=False).indices.items()}
            for k, at in places.items():
                part = rows[at]
                block = part.T @ (part * weights[at][:, None])
                acc[k] = acc[k] + block if k in acc else block
        for k, block in acc.items():
            values = block[upper_i, upper_j]
            cols = [pa.array([v] * len(values), type=kind) for v, kind in zip(k, types)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(upper_i.astype("int32")), pa.array(upper_j.astype("int32")), pa.array(values)],
                names=[*by, "i", "j", "s"])

    return source.mapInArrow(blocks, schema).groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))
