"""Query registry, result tidying and scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(spark, sf_dir)``; its doubles are rounded to ``digits`` so that both engines print the same value."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded doubles (no negative zero) and 64-bit integers."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for written results: under spark.checkpoint.dir, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
        base = tempfile.mkdtemp(prefix="tarnfold-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
