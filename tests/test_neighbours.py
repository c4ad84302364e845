"""Neighbour estimate of mutual information against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.functions.scalars import digamma
from tarnfold.operators.neighbours import INSIDE, neighbour_information


def psi(n):
    return sum(1.0 / i for i in range(1, n)) - 0.57721566490153286


def brute(rows, k):
    """All distances of all pairs."""
    sizes = {c: sum(q == c for _, q in rows) for _, c in rows}
    rows = [(x, c) for x, c in rows if sizes[c] > 1]
    total = 0.0
    for i, (x, c) in enumerate(rows):
        near = sorted(abs(x - a) for j, (a, q) in enumerate(rows) if q == c and j != i)
        of = min(k, len(near))
        radius = near[of - 1] * INSIDE
        m = sum(x - radius <= a <= x + radius for a, _ in rows)
        own = of if radius > 0 else sum(a == x for a, q in rows if q == c)
        total += psi(own) - psi(sizes[c]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    cls = rng.integers(0, 3, 400)
    wide = rng.normal(cls * 1.5, 1.0)
    steps = np.round(rng.normal(cls, 2.0))
    zeros = np.where(rng.random(400) < 0.7, 0.0, rng.random(400))
    out = [(f"c{c}", float(a), float(b), float(z)) for c, a, b, z in zip(cls, wide, steps, zeros)]
    out += [("two", 9.0, 1.0, 0.0), ("two", -9.0, 1.0, 0.5), ("one", 3.0, 3.0, 3.0), ("three", 0.1, 5.0, 0.0), ("three", 0.2, 5.0, 0.0), ("three", 0.4, 5.0, -0.0)]
    return out


@pytest.mark.parametrize("k,parts", [(3, 1), (3, 9), (1, 40), (5, 150)])
def test_equals_all_pairs(spark, rows, k, parts):
    """Many ranges, so that neighbours lie several ranges away; ties, a class of two rows and one of a single row."""
    df = spark.createDataFrame(rows, "cls string, wide double, steps double, zeros double").repartition(5)
    got = {r.feature: r for r in neighbour_information(df, ["wide", "steps", "zeros"], "cls", k, parts).collect()}
    for at, name in enumerate(["wide", "steps", "zeros"], 1):
        assert got[name].mutual_information == pytest.approx(brute([(r[at], r[0]) for r in rows], k), abs=1e-9)
        assert got[name].n_rows == len(rows) - 1
    assert got["wide"].mutual_information > 0.2


def test_nulls_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "cls string, wide double, steps double, zeros double")
    extra = spark.createDataFrame([(None, 1.0, 1.0, 1.0), ("c0", None, math.nan, math.inf)], df.schema)
    plain, more = ({r.feature: r.mutual_information for r in neighbour_information(d, ["wide", "zeros"], "cls").collect()} for d in (df, df.union(extra)))
    assert plain == pytest.approx(more)
    assert neighbour_information(df.limit(0), ["wide"], "cls").count() == 0
    one = neighbour_information(df.withColumn("cls", F.lit("a")), ["steps"], "cls").first()
    assert one.mutual_information == pytest.approx(brute([(r[2], "a") for r in rows], 3), abs=1e-9) and one.n_rows == len(rows)


def test_digamma(spark):
    got = spark.range(1, 200).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-10) for r in got)
