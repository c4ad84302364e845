"""Exact global and per-group order statistics without one task ever holding one group.

A plain ``row_number() over (partition by g order by x)`` sorts all of ``g`` in one task. Here the order is cut into
range buckets first: rows are ranked inside (group, bucket), and bucket offsets come from a pre-aggregated table of
groups x buckets rows. Value ties wider than one bucket are cut again by the hash of the row key.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.hashing import hash_bucket, with_hash
from tarnfold.session import bounded, parts_of, settle

#: Hash ranges per stratum in rank and cut searches, at least.
HASH_BUCKETS = 4096


def hash_ranges(df: DataFrame) -> int:
    """Hash ranges for ``df``: they follow the session's shuffle width, so that one range fits a task. No result depends on it."""
    return max(HASH_BUCKETS, 16 * parts_of(df.sparkSession))


def join_groups(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi-join on group columns in which null is a group like any other."""
    on = list(on)
    named = right.withColumnsRenamed({c: f"_g_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in on])
    return left.join(named, same, how).drop(*[f"_g_{c}" for c in on])


class Splits:
    """Range-bucket borders of one numeric column; values wide enough to fill a bucket get one of their own."""

    def __init__(self, points):
        self.heavy = sorted({p for p in points if points.count(p) > 1})
        borders = set(points) | {math.nextafter(p, math.inf) for p in self.heavy}
        self.points = sorted(p for p in borders if math.isfinite(p))

    @classmethod
    def of(cls, df: DataFrame, column: str, parts: int | None = None) -> "Splits":
        """Borders at approximate quantiles: one pass, ``parts - 1`` doubles on the driver."""
        return cls.of_each(df, [column], parts)[0]

    @classmethod
    def of_each(cls, df: DataFrame, columns, parts: int | None = None) -> "list[Splits]":
        """Borders of several columns from the same pass."""
        parts = parts or parts_of(df.sparkSession)
        probs = [i / parts for i in range(1, parts)]
        names = [f"_q{i}" for i in range(len(columns))]
        source = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
        return [cls(points) for points in source.approxQuantile(names, probs, 1.0 / (4 * parts))]

    def add_to(self, df: DataFrame, column: str, name: str = "_range") -> DataFrame:
        if not self.points:
            return df.withColumn(name, F.lit(0.0))
        borders = [-math.inf, *self.points, math.inf]
        source = df.withColumn("_split_value", F.col(column).cast("double"))
        return Bucketizer(splits=borders, inputCol="_split_value", outputCol=name, handleInvalid="keep") \
            .transform(source).drop("_split_value")

    def is_heavy(self, column: Column) -> Column:
        return column.isin([float(h) for h in self.heavy]) if self.heavy else F.lit(False)


def running_totals(table: DataFrame, by, order: str, sums, splits: Splits, descending: bool = False,
                   total: bool = True) -> DataFrame:
    """Inclusive running sums of ``sums`` along ``order`` inside ``by``; adds cum_<c> and, if asked, total_<c>.

    ``table`` must already be aggregated to one row per (by, order).
    """
    by, sums = list(by), list(sums)
    cut = splits.add_to(table, order)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inner = Window.partitionBy(*by, "_range").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    sized = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sized.select(
        *by, "_range",
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"total_{c}") for c in sums if total],
    )
    kept = table.columns
    return (
        cut.select(*kept, "_range", *[F.sum(c).over(inner).alias(f"_i_{c}") for c in sums])
        .transform(join_groups, offsets, [*by, "_range"])
        .select(
            *kept,
            *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums],
            *[f"total_{c}" for c in sums if total],
        )
    )


def _offsets(hist: DataFrame, by, buckets) -> DataFrame:
    """Rows before each bucket and rows of the whole group, from a (by, buckets) -> _c table that is run once."""
    hist = settle(hist)
    before = Window.partitionBy(*by).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    return bounded(hist.select(
        *by, *buckets, "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(*by)).alias("_size")))


def _hash_cut(df: DataFrame, by, key, seed, buckets: int | None):
    buckets = buckets or hash_ranges(df)
    hashed = with_hash(df, key, seed).withColumn("_b", hash_bucket(F.col("_h"), buckets))
    return hashed, _offsets(hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c")), by, ["_b"])


def _value_cut(df: DataFrame, by, value: str, key, seed, splits: Splits, tie_buckets: int):
    hashed = splits.add_to(with_hash(df, key, seed), value)
    heavy = splits.is_heavy(F.col(value).cast("double"))
    hashed = hashed.withColumn("_b", F.when(heavy, hash_bucket(F.col("_h"), tie_buckets)).otherwise(F.lit(0)))
    hist = hashed.groupBy(*by, "_range", "_b").agg(F.count(F.lit(1)).alias("_c"))
    return hashed, _offsets(hist, by, ["_range", "_b"])


def hash_ranks(df: DataFrame, by, key, seed=0, buckets: int | None = None, rank: str = "rn",
               size: str | None = None) -> DataFrame:
    """Rank 1..n of every row inside ``by`` in the seeded shuffle order (hash, then key)."""
    by, key = list(by), list(key)
    hashed, offsets = _hash_cut(df, by, key, seed, buckets)
    inner = Window.partitionBy(*by, "_b").orderBy("_h", *key)
    ranked = join_groups(hashed, offsets, [*by, "_b"]).withColumn(rank, (F.row_number().over(inner) + F.col("_off")).cast("long"))
    if size:
        ranked = ranked.withColumn(size, F.col("_size").cast("long"))
    return ranked.select(*df.columns, rank, *([size] if size else []))


def value_ranks(df: DataFrame, by, value: str, key, seed=0, splits: Splits | None = None, rank: str = "rn",
                size: str = "n_rows", tie_buckets: int = 64) -> DataFrame:
    """Rank 1..n inside ``by`` along ``value``; equal values follow the seeded hash of the key, then the key."""
    by, key = list(by), list(key)
    hashed, offsets = _value_cut(df, by, value, key, seed, splits or Splits.of(df, value), tie_buckets)
    inner = Window.partitionBy(*by, "_range", "_b").orderBy(value, "_h", *key)
    return join_groups(hashed, offsets, [*by, "_range", "_b"]).select(
        *df.columns, (F.row_number().over(inner) + F.col("_off")).cast("long").alias(rank), F.col("_size").cast("long").alias(size))


def _slots(joined: DataFrame, columns, inner: Window, slots: int, out: str) -> DataFrame:
    """Equal-count slot of each row: max(n // slots, 1) rows per slot, the last one takes the rest.

    A bucket that lies inside one slot settles its rows as they are; only rows of buckets across a slot border are
    shuffled and ranked, at most (slots - 1) buckets per group.
    """
    width = F.greatest(F.floor(F.col("_size") / F.lit(slots)), F.lit(1))

    def slot(rank):
        return F.least(F.floor((rank - 1) / width), F.lit(slots - 1)).cast("int")

    first, last = slot(F.col("_off") + 1), slot(F.col("_off") + F.col("_c"))
    sure = joined.filter(first == last).select(*columns, first.alias(out))
    torn = joined.filter(first != last).withColumn("_rn", F.row_number().over(inner) + F.col("_off"))
    return sure.unionByName(torn.select(*columns, slot(F.col("_rn")).alias(out)))


def hash_slots(df: DataFrame, by, key, slots: int, seed=0, buckets: int | None = None, out: str = "slot") -> DataFrame:
    """Cut the seeded shuffle order of each group into equal slots 0..slots-1."""
    by, key = list(by), list(key)
    hashed, offsets = _hash_cut(df, by, key, seed, buckets)
    return _slots(join_groups(hashed, offsets, [*by, "_b"]), df.columns, Window.partitionBy(*by, "_b").orderBy("_h", *key), slots, out)


def value_slots(df: DataFrame, by, value: str, key, slots: int, seed=0, splits: Splits | None = None, out: str = "slot",
                tie_buckets: int = 64) -> DataFrame:
    """Cut each group into equal slots along ``value``; equal values follow the seeded hash of the key, then the key."""
    by, key = list(by), list(key)
    hashed, offsets = _value_cut(df, by, value, key, seed, splits or Splits.of(df, value), tie_buckets)
    inner = Window.partitionBy(*by, "_range", "_b").orderBy(value, "_h", *key)
    return _slots(join_groups(hashed, offsets, [*by, "_range", "_b"]), df.columns, inner, slots, out)


def exact_quantiles(df: DataFrame, by, value: str, probs, names=None, splits: Splits | None = None) -> DataFrame:
    """Linear-interpolation quantiles per group: one value table, bucketed running counts, conditional minima.

    Unlike ``percentile`` no task keeps all distinct values of a group in memory.
    """
    by = list(by)
    names = names or [f"p{round(p * 100):02d}" for p in probs]
    values = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")) \
        .agg(F.count(F.lit(1)).alias("c"))
    splits = splits or Splits.of(df, value)
    cum = running_totals(values, by, "_v", ["c"], splits)
    aggs = []
    for p, name in zip(probs, names):
        pos = F.lit(float(p)) * (F.col("total_c") - 1)
        aggs += [
            F.min(F.when(F.col("cum_c") > F.floor(pos), F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("cum_c") > F.ceil(pos), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_f_{name}"),
        ]
    out = [
        (F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in names
    ]
    return cum.groupBy(*by).agg(*aggs).select(*by, *out)


def average_ranks(df: DataFrame, by, value: str, splits: Splits | None = None, extra_sums=()) -> DataFrame:
    """One row per (by, value): count ``c``, average rank ``avg_rank`` and ``total_c``; ``extra_sums`` maps name -> column."""
    by = list(by)
    extra = dict(extra_sums)
    table = df.groupBy(*by, F.col(value).cast("double").alias(value)).agg(
        F.count(F.lit(1)).alias("c"), *[F.sum(c).alias(n) for n, c in extra.items()])
    splits = splits or Splits.of(df, value)
    cum = running_totals(table, by, value, ["c"], splits)
    return cum.withColumn("avg_rank", F.col("cum_c") - (F.col("c") - 1) / F.lit(2.0))
