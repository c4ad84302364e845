"""Data-quality checks as (check, ok, detail) rows (inventory L). Each suite is one aggregate over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(AssertionError):
    pass


def require(report: DataFrame) -> DataFrame:
    """The report itself, or an error that lists the failed checks."""
    failed = [r["check"] for r in report.filter("NOT ok").select("check").collect()]
    if failed:
        raise CheckFailed(f"failed checks: {failed}")
    return report


def _rows(row: DataFrame, checks) -> DataFrame:
    """One aggregate row to one row per check; a check is (name, ok column, detail column)."""
    cells = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"),
                               F.coalesce(d.cast("double"), F.lit(None).cast("double")).alias("detail")) for n, ok, d in checks])
    return row.select(F.inline(cells))


def _column_stats(columns):
    low = F.min(F.least(*[F.col(c).cast("double") for c in columns])) if len(columns) > 1 else F.min(F.col(columns[0]).cast("double"))
    high = F.max(F.greatest(*[F.col(c).cast("double") for c in columns])) if len(columns) > 1 else F.max(F.col(columns[0]).cast("double"))
    holes = sum((F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in columns[1:]),
                F.count_if(F.col(columns[0]).isNull() | F.isnan(F.col(columns[0]).cast("double"))))
    return low, high, holes


def sanity_suite(train: DataFrame, test: DataFrame, features, test_features, label: str, multiclass: str, category: str,
                 normal: str = "normal", categories_expected: int | None = None) -> DataFrame:
    """Range [0, 1], no nulls, labels {0, 1}, categories set, same columns, labels consistent, number of categories."""
    low, high, holes = _column_stats(features)
    row = train.agg(
        low.alias("low"), high.alias("high"), holes.alias("holes"), F.min(label).alias("l0"), F.max(label).alias("l1"),
        F.count_if(~F.col(label).isin(0, 1) | F.col(label).isNull()).alias("odd"),
        F.count_if(F.col(category).isNull()).alias("no_cat"),
        F.count_if((F.col(multiclass) == normal) & (F.col(label) == 1)).alias("clash"), F.count_distinct(category).alias("cats"))
    checks = [
        ("feature_range", (F.abs("low") < 1e-9) & (F.abs(F.col("high") - 1.0) < 1e-9), F.col("high")),
        ("no_nulls_in_features", F.col("holes") == 0, F.col("holes")),
        ("label_binary_valid", (F.col("odd") == 0) & (F.col("l0") == 0) & (F.col("l1") == 1), F.col("odd")),
        ("no_nulls_in_category", F.col("no_cat") == 0, F.col("no_cat")),
        ("columns_match", F.lit(list(features) == list(test_features)), F.lit(len(test_features))),
        ("label_consistency", F.col("clash") == 0, F.col("clash")),
    ]
    if categories_expected is not None:
        checks.append(("category_count", F.col("cats") == categories_expected, F.col("cats")))
    return _rows(row, checks)


def sample_sizes(df: DataFrame, by, declared: dict) -> DataFrame:
    """Rows per sample against the declared sizes."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    want = df.sparkSession.createDataFrame(list(declared.items()), f"{by} {dict(df.dtypes)[by]}, expected bigint")
    joined = want.join(counts, by, "left")
    return joined.select(by, "expected", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("ok"))


def selection_checks(df: DataFrame, features, scores: DataFrame, k: int, alpha: float = 0.05) -> DataFrame:
    """Selected columns: count, nulls, range, significance."""
    low, high, holes = _column_stats(features)
    worst = scores.filter(F.col("feature").isin(list(features))).agg(
        F.max(F.coalesce("p_value", F.lit(1.0))).alias("worst_p"), F.count(F.lit(1)).alias("known"))
    row = df.agg(low.alias("low"), high.alias("high"), holes.alias("holes"))
    row = row.withColumn("_j", F.lit(1)).join(worst.withColumn("_j", F.lit(1)), "_j")
    return _rows(row, [
        ("width", F.lit(len(features) == k), F.lit(len(features))),
        ("no_nulls", F.col("holes") == 0, F.col("holes")),
        ("range", (F.col("low") >= -1e-9) & (F.col("high") <= 1.0 + 1e-9), F.col("high")),
        ("all_significant", F.col("worst_p") < alpha, F.col("worst_p")),
        ("columns_known", F.col("known") == len(features), F.col("known")),
    ])


def angle_checks(df: DataFrame, vector: str, dim: int, top: float) -> DataFrame:
    """Angle vectors: width, range [0, top], nulls."""
    row = df.agg(
        F.count_if(F.size(vector) != dim).alias("odd"), F.min(F.array_min(vector)).alias("low"), F.max(F.array_max(vector)).alias("high"),
        F.count_if(F.exists(vector, lambda v: v.isNull() | F.isnan(v))).alias("holes"), F.count(F.lit(1)).alias("n"))
    return _rows(row, [
        ("width", F.col("odd") == 0, F.col("odd")),
        ("range", (F.col("low") >= -1e-9) & (F.col("high") <= top + 1e-9), F.col("high")),
        ("no_nulls", F.col("holes") == 0, F.col("holes")),
        ("not_empty", F.col("n") > 0, F.col("n")),
    ])


def leaked_labels(spark, features, labels) -> DataFrame:
    """Label columns found among the features; empty when clean."""
    found = sorted(set(features) & set(labels))
    return spark.createDataFrame([(c,) for c in found], "column string")


def label_agreement(df: DataFrame, category: str, label: str, normal: str = "Normal") -> DataFrame:
    """Both directions of: normal category if and only if label 0."""
    row = df.agg(F.count_if((F.col(category) == normal) & (F.col(label) != 0)).alias("a"),
                 F.count_if((F.col(category) != normal) & (F.col(label) == 0)).alias("b"))
    return _rows(row, [("normal_is_zero", F.col("a") == 0, F.col("a")), ("zero_is_normal", F.col("b") == 0, F.col("b"))])


def missing_rare(source: DataFrame, sample: DataFrame, category: str, rare) -> DataFrame:
    """Rare categories of the source that a sample lost."""
    want = source.filter(F.col(category).isin(list(rare))).select(category).distinct()
    have = sample.filter(F.col(category).isin(list(rare))).select(category).distinct()
    return want.join(have, category, "left_anti")
