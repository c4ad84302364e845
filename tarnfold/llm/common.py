"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.session import cut_lineage

#: Words are maximal runs without these; ``bytes.split()`` cuts at the same six.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: it is computed once, whatever is lost later."""
    return cut_lineage(df)


def small(kept: DataFrame, most: int = 500_000) -> DataFrame:
    """``kept`` (a kept table of a few numbers a row) marked for broadcast if a count of its rows says so, else left to a shuffle join."""
    return F.broadcast(kept) if kept.count() <= most else kept


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def once(key: str, make: Callable):
    """A value made once for each Python worker process (a loaded vocabulary, a cache), whichever tasks run there."""
    held = sys.modules.setdefault("_tarnfold_held", types.ModuleType("_tarnfold_held")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def lower_az(text):
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id):
    """crc32 of the id written as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), component = smallest node reachable.

    Alternating large-star and small-star rounds: every neighbour list shrinks to its minimum by a partial aggregate and
    a join, so a node with a third of all edges is never gathered. Each round is kept in the shared folder. Loops, null
    ends and repeated edges are ignored; no edges give an empty result.
    """
    def seen(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v"))).distinct())
    last = seen(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = keep(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u != v").distinct())
        now = seen(e)
        if now == last:
            break
        last = now
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
