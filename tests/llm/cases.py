"""Small tables with every awkward case: nulls, empty and long texts, repeated rows, ties, columns of clashing names."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["id", "fp", "row", "words", "h", "s", "n", "part", "block", "class", "key", "piece", "group", "score", "y", "text_", "low", "component", "_row", "v", "node"]

BASE = "the quick brown fox jumps over the lazy dog and runs far away from the big old house on the green hill near the river"
ROWS = [(1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("lazy", "idle")), (4, None), (5, ""), (6, "   \n\t "), (None, BASE), (None, None), (7, "one"), (7, "two words"),
        (8, "word " * 5000), (9, "x" * 20000), (10, "ÀÉ naïve 中文 　   end"), (11, "1 " * 6000), (12, "a@b.c 4111-1111-1111-1111 " * 200)]


def docs(spark, rows=None, extra=True):
    df = spark.createDataFrame([(i, t, "en", "src", len(t) if t else None) for i, t in (ROWS if rows is None else rows)], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if extra else df


def read(spark, name, folder=SF):
    return spark.read.parquet(f"{folder}/{name}.parquet")
