"""Hash, tails and scalar formulas against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tarnfold.functions import tails
from tarnfold.functions.hashing import HIGH_MULTIPLIER, MULTIPLIER, PRIME, SECOND, draw_rank, gaussian, seeded_hash, uniform, with_hash
from tarnfold.functions.scalars import band, clip, rescale


def plain_hash(values, seed):
    acc = seed % PRIME
    for v in values:
        acc = (acc * MULTIPLIER + v % PRIME + (v >> 31) % PRIME * HIGH_MULTIPLIER + 12345) % PRIME
    return pow(acc, 5, PRIME)


def test_hash_is_the_stated_arithmetic(spark):
    df = spark.range(200).select("id", (F.col("id") * 7919 - 300).alias("other"))
    rows = with_hash(df, ["id", "other"], 42).select("id", "other", "_h", seeded_hash(["id", "other"], 42).alias("h2")).collect()
    for r in rows:
        assert r["_h"] == r["h2"] == plain_hash([r["id"], r["other"]], 42)


def test_keys_a_prime_apart_differ_and_text_keys_work(spark):
    df = spark.createDataFrame([(5, "u5"), (5 + PRIME, "u751"), (5 + 2 * PRIME, None), (-7, ""), (2 ** 62, "x")], "id bigint, name string")
    rows = with_hash(with_hash(df, ["id"], 1, "a"), ["name"], 1, "b").collect()
    assert len({r["a"] for r in rows}) == len({r["b"] for r in rows}) == 5


def test_every_rank_of_a_huge_table_can_be_drawn(spark):
    n = 5 * 10 ** 12
    rows = spark.range(2000).select("id", draw_rank(["id"], n, 9).alias("r"), draw_rank(["id"], 3, 9).alias("s")).collect()
    for r in rows:
        assert r["r"] == 1 + (plain_hash([r["id"]], 9) * PRIME + plain_hash([r["id"], SECOND], 9)) % n
    assert sum(r["r"] > 2 ** 31 for r in rows) > 1990 and max(r["r"] for r in rows) > 0.99 * n and {r["s"] for r in rows} == {1, 2, 3}


def test_hash_permutes_small_ids_and_is_even(spark):
    df = spark.range(100_000).select(uniform(["id"], 7).alias("u"), gaussian(["id"], 7).alias("g"), seeded_hash(["id"], 7).alias("h"))
    r = df.agg(F.count_distinct("h").alias("d"), F.avg("u").alias("m"), F.avg("g").alias("gm"), F.stddev_pop("g").alias("gs"),
               F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert r["d"] == 100_000
    assert abs(r["m"] - 0.5) < 0.01 and abs(r["gm"]) < 0.02 and abs(r["gs"] - 1) < 0.02
    assert 0 < r["lo"] < r["hi"] < 1
    cells = df.groupBy(F.floor(F.col("u") * 20)).count().collect()
    assert len(cells) == 20 and all(abs(c["count"] - 5000) < 400 for c in cells)


@pytest.mark.parametrize("fn, args, want", [
    (tails.chi2_pvalue, (3.841458820694124,), 0.05),
    (tails.t_pvalue, (2.2281388519649385, 10.0), 0.05),
    (tails.f_pvalue, (4.102821015430206, 2.0, 10.0), 0.05),
    (tails.normal_pvalue, (1.6448536269514722,), 0.05),
    (tails.binomial_pvalue, (1.0, 10.0), 22 / 1024),
    (tails.binomial_pvalue, (5.0, 10.0), 1.0),
    (tails.binomial_pvalue, (0.0, 0.0), 1.0),
])
def test_tails(spark, fn, args, want):
    got = spark.range(1).select(fn(*[F.lit(a) for a in args]).alias("p")).first()["p"]
    assert got == pytest.approx(want, abs=1e-9)


def test_scalars(spark):
    df = spark.createDataFrame([(-1.0,), (0.25,), (9.0,), (None,)], "v double")
    rows = df.select(clip(F.col("v"), 0.0, 1.0).alias("c"), rescale(F.col("v"), 5.0, 5.0).alias("flat"),
                     band(F.col("v"), (0.2, 0.5, 0.8), ("negligible", "small", "medium", "large")).alias("w")).collect()
    assert [r["c"] for r in rows] == [0.0, 0.25, 1.0, None]
    assert [r["w"] for r in rows] == ["large", "small", "large", "undefined"]
    assert rescale(F.lit(5.0), 5.0, 5.0, 0.0, math.pi) is not None
