"""Resamples as large as the table: totals, independence of the partitioning, and statistics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import resampling as R


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), int(rng.integers(0, 2)), float(rng.normal()) if i % 7 else None) for i in range(700)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int, q double").repartition(6), rows


def test_totals_are_exact_and_draws_stay(table):
    df, rows = table
    drawn = R.Drawn(df, ["id"], 30, block_rows=64)
    assert drawn.blocks == 11
    times = {(r.replicate, r.id): r.times for r in drawn.multiplicities("id").collect()}
    matrix = np.array([[times.get((k, i), 0) for i in range(700)] for k in range(30)])
    assert (matrix.sum(axis=1) == 700).all() and matrix.max() > 2
    again = {(r.replicate, r.id): r.times for r in R.Drawn(df.coalesce(2).orderBy(F.desc("id")), ["id"], 30, block_rows=64).multiplicities("id").collect()}
    assert again == times
    assert abs(matrix.var() - 1) < 0.1 and abs((matrix == 0).mean() - np.exp(-1)) < 0.02  # multiplicities are about Poisson
    other = {(r.replicate, r.id): r.times for r in R.Drawn(df, ["id"], 30, seed=1, block_rows=64).multiplicities("id").collect()}
    assert other != times


def test_intervals_equal_those_of_the_listed_draws(table):
    df, rows = table
    drawn = R.Drawn(df, ["id"], 40, block_rows=100)
    matrix = np.zeros((40, 700))
    for r in drawn.multiplicities("id").collect():
        matrix[r.replicate, r.id] = r.times
    x, s = np.array([r[1] for r in rows]), 2.0 * np.array([r[2] for r in rows]) - 1
    q = np.array([np.nan if r[3] is None else r[3] for r in rows])
    want = {"alignment": [], "cka": [], "effective_rank": [], "q": []}
    for w in matrix.astype(int):
        z, t = np.repeat(x, w, axis=0), np.repeat(s, w)
        k, label = z @ z.T, np.outer(t, t)
        h = np.eye(700) - 1 / 700
        kc, lc = h @ k @ h, h @ label @ h
        want["alignment"].append((k * label).sum() / (np.linalg.norm(k) * np.linalg.norm(label)))
        want["cka"].append((kc * lc).sum() / (np.linalg.norm(kc) * np.linalg.norm(lc)))
        want["effective_rank"].append(np.trace(k) ** 2 / (k * k).sum())
        want["q"].append(np.nanmean(np.repeat(q, w)))
    got = {r.statistic: r for r in [*R.linear_kernel_intervals(drawn, "v", "y", 3).collect(), *R.mean_intervals(drawn, ["q"]).collect()]}
    for name, values in want.items():
        r = got[name]
        assert (r["mean"], r["std"], r["low"], r["high"]) == pytest.approx((np.mean(values), np.std(values), *np.quantile(values, [0.025, 0.975])), rel=1e-9)


def test_width_of_the_interval_follows_the_table(table):
    df, rows = table
    q = np.array([r[3] for r in rows if r[3] is not None])
    r = R.mean_intervals(R.Drawn(df, ["id"], 400), ["q"]).first()
    assert r["std"] == pytest.approx(q.std() / len(q) ** 0.5, rel=0.15)


def test_of_nothing(spark):
    drawn = R.Drawn(spark.createDataFrame([], "id long, q double"), ["id"])
    assert R.mean_intervals(drawn, ["q"]).first()["mean"] is None and drawn.multiplicities("id").count() == 0


def test_columns_are_made_of_few_rows_at_a_time(spark, tmp_path):
    """Columns of a row may be thousands, so a task holds those of at most ROWS rows; the sums are those of the listed draws."""
    from tarnfold.operators import resampling as R

    df = spark.createDataFrame([(i, float(i)) for i in range(1000)], "id long, x double")
    drawn = R.Drawn(df, ["id"], replicates=3)

    def columns(table):
        with open(f"{tmp_path}/sizes", "a") as f:
            f.write(f"{table.num_rows} ")
        return np.stack([table.column("x").to_numpy(), np.ones(table.num_rows)], axis=1)

    got = drawn.sums(columns, "x")
    assert max(map(int, (tmp_path / "sizes").read_text().split())) <= 256
    want = {r.replicate: (r.x, r.n) for r in drawn.multiplicities("x").groupBy("replicate").agg(F.sum(F.col("times") * F.col("x")).alias("x"), F.sum("times").alias("n")).collect()}
    assert np.allclose(got, [want[k] for k in range(3)]) and (got[:, 1] == 1000).all()
