"""Labels, lookups, set differences and clipping (inventory B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.scalars import clip
from tarnfold.session import bounded

# Label columns that never count as features, and the default group.
LABEL_COLUMNS = ["label", "label_binary", "label_multiclass", "attack_category"]
NOT_FEATURES = LABEL_COLUMNS + ["difficulty_level"]
UNKNOWN = "Unknown"


def binary_label(column: str, normal: str = "normal") -> Column:
    """1 for every value other than the normal one."""
    return (F.col(column) != F.lit(normal)).cast("int")


def lookup(df: DataFrame, on: str, table: DataFrame, key: str, value: str, out: str, default: str = UNKNOWN) -> DataFrame:
    """Map a column through a two-column table; keys that are missing or null get ``default``. A key that stands in the table
    more than once takes its least value, so no row is multiplied."""
    small = bounded(table.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias("_value")))
    joined = df.join(small, F.col(on) == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_value"), F.lit(default))).drop("_key", "_value")


def category_of(df: DataFrame, column: str, mapping: dict, out: str = "attack_category") -> DataFrame:
    """``lookup`` through a Python dict."""
    table = df.sparkSession.createDataFrame(sorted(mapping.items()), "k string, v string")
    return lookup(df, column, table, "k", "v", out)


def text_category(column: str, default: str = UNKNOWN) -> Column:
    """Category as text: nulls become the default before the cast, blanks are trimmed."""
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit(default))


def label_flows(df: DataFrame, mapping: dict, label: str = "label") -> DataFrame:
    """The three label columns of a raw flow table."""
    df = df.withColumn("label_binary", binary_label(label)).withColumn("label_multiclass", F.col(label))
    return category_of(df, label, mapping)


def feature_columns(df: DataFrame, labels=NOT_FEATURES) -> list[str]:
    """All columns but the label columns, in table order."""
    return [c for c in df.columns if c not in set(labels)]


def in_groups(column: str, groups) -> Column:
    return F.col(column).isin(list(groups))


def group_mask(df: DataFrame, column: str, groups, out: str = "is_rare") -> DataFrame:
    return df.withColumn(out, F.coalesce(in_groups(column, groups), F.lit(False)))


def level_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Every level with where it occurs: in_both, only_in_left or only_in_right."""
    a = left.select(F.col(column).alias("level"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(F.col(column).alias("level"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    seen = a.unionByName(b).groupBy("level").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    where = F.when((F.col("l") == 1) & (F.col("r") == 1), "in_both") \
        .when(F.col("l") == 1, "only_in_left").otherwise("only_in_right")
    return seen.select("level", where.alias("side"))


def concat_rows(*tables: DataFrame, tag: str | None = None) -> DataFrame:
    """Union by column name; ``tag`` names a column that numbers the inputs."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn(tag, F.lit(i)) if tag else t
        out = t if out is None else out.unionByName(t)
    return out


def concat_columns(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """Columns side by side, matched by the row key."""
    return left.join(right, list(key), "inner")


def clip_columns(df: DataFrame, columns, low: float, high: float) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), low, high) for c in columns})


def clip_report(df: DataFrame, columns, low: float, high: float) -> DataFrame:
    """Cells below and above the range and their share of all cells, per column; one pass."""
    aggs = []
    for c in columns:
        aggs += [F.count_if(F.col(c) < low).alias(f"b_{c}"), F.count_if(F.col(c) > high).alias(f"a_{c}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    per = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"b_{c}").alias("below"), F.col(f"a_{c}").alias("above")) for c in columns
    ])
    long = row.select("n", F.inline(per))
    return long.withColumn("share", F.try_divide(F.col("below") + F.col("above"), F.col("n").cast("double")))


def unmapped_levels(df: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """Distinct values without an entry in the map, with their counts."""
    levels = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(table.select(F.col(key).alias(column)).distinct(), column, "left_anti")
