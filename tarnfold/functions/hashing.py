"""Seeded integer hash made of plain arithmetic.

Every random choice in the package (samples, folds, shuffles, noise, bootstrap draws) comes from this hash of the
row key, so results depend neither on partitioning nor on task retries, and the same expression can be written in
any SQL dialect. All products stay below 2**62.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647  # 2**31 - 1
MULTIPLIER = 48271
HIGH_MULTIPLIER = 69621
#: Added to the values of the second hash of a wide draw.
SECOND = 1


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _fold(values, seed) -> Column:
    """Low and high part of each value enter apart, so that values PRIME apart differ; below 2**31 the high part is zero."""
    acc = F.pmod(as_col(seed).cast("long"), F.lit(PRIME))
    for value in values:
        value = as_col(value).cast("long")
        both = F.pmod(value, F.lit(PRIME)) + F.pmod(F.shiftright(value, 31), F.lit(PRIME)) * F.lit(HIGH_MULTIPLIER)
        acc = (acc * F.lit(MULTIPLIER) + both + F.lit(12345)) % F.lit(PRIME)
    return acc


def seeded_hash(values, seed=0) -> Column:
    """Integer in [0, PRIME): a multiplicative fold of ``seed`` and ``values``, then x -> x**5 (a permutation mod PRIME)."""
    acc = _fold(values, seed)
    square = (acc * acc) % F.lit(PRIME)
    fourth = (square * square) % F.lit(PRIME)
    return (fourth * acc) % F.lit(PRIME)


def draw_rank(values, n, seed=0) -> Column:
    """Rank 1..n drawn by hash. Two hashes make a number below 2**62, so every rank can be drawn however large n is."""
    wide = seeded_hash(values, seed) * F.lit(PRIME) + seeded_hash([*values, F.lit(SECOND)], seed)
    return (F.lit(1) + F.pmod(wide, F.greatest(as_col(n).cast("long"), F.lit(1)))).cast("long")


def hashable(df: DataFrame, values) -> list:
    """``values`` with columns that are not whole numbers replaced by a 64-bit hash of them; nulls stay null."""
    kinds = dict(df.dtypes)
    whole = ("tinyint", "smallint", "int", "bigint", "boolean")
    return [v if not isinstance(v, str) or kinds.get(v, "bigint") in whole else F.when(F.col(v).isNotNull(), F.xxhash64(F.col(v))) for v in values]


def with_hash(df: DataFrame, values, seed=0, name: str = "_h") -> DataFrame:
    """``seeded_hash`` as a column, in three projections so that each step is computed once per row.

    The result is never null, so the optimizer infers no null filters that would repeat the arithmetic below a join.
    """
    values = [F.coalesce(as_col(v).cast("long"), F.lit(-1)) for v in hashable(df, values)]
    folded = df.withColumn("_fold", F.coalesce(_fold(values, seed), F.lit(0))) \
        .withColumn("_square", (F.col("_fold") * F.col("_fold")) % F.lit(PRIME))
    fourth = (F.col("_square") * F.col("_square")) % F.lit(PRIME)
    return folded.withColumn(name, F.coalesce((fourth * F.col("_fold")) % F.lit(PRIME), F.lit(0))).drop("_fold", "_square")


def uniform(values, seed=0) -> Column:
    """Uniform double strictly inside (0, 1)."""
    return (seeded_hash(values, seed) + F.lit(0.5)) / F.lit(float(PRIME))


def gaussian(values, seed=0) -> Column:
    """Standard normal by the Box-Muller transform of two hashes that differ by a stream number."""
    values = list(values)
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(values + [F.lit(1)], seed)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(values + [F.lit(2)], seed))


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """Monotone bucket number of a hash value, 0 .. buckets - 1."""
    return F.coalesce(F.floor(hashed * F.lit(buckets) / F.lit(float(PRIME))).cast("int"), F.lit(0))
