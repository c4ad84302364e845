"""Map statistics and row statistics against the N x N matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.functions import feature_maps as M
from tarnfold.operators import blocks as B
from tarnfold.operators import kernels as G


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, math.pi, (40, 4))
    y = (rng.uniform(size=40) < 0.4).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(40)], "id int, y int, x array<double>").repartition(5)
    return df, x, y


def matrix_statistics(k, y):
    n, s = len(y), 2 * y - 1
    h = np.eye(n) - 1 / n
    kc, yc = h @ k @ h, h @ np.outer(s, s) @ h
    same = np.equal.outer(y, y)
    off = k[~np.eye(n, dtype=bool)]
    return {"alignment": s @ k @ s / (np.linalg.norm(k) * n), "label_cka": (kc * yc).sum() / (np.linalg.norm(kc) * np.linalg.norm(yc)),
            "effective_rank": np.trace(k) ** 2 / (k ** 2).sum(), "within": k[same].mean(), "across": k[~same].mean(),
            "mean_off": off.mean(), "var_off": off.var()}


@pytest.mark.parametrize("kind, kw", [("linear", {}), ("poly", {"coef0": 1.0}), ("linear", {"coef0": 0.5})])
def test_map_statistics_equal_the_matrix(spark, points, kind, kw):
    df, x, y = points
    mapped, dim = M.add_map(df, kind, "x", 4, **kw)
    got = G.map_statistics(mapped, "phi", dim, "y").first().asDict()
    if kind == "linear":
        k = x @ x.T + kw.get("coef0", 0.0)
    else:
        k = (x @ x.T / 4 + 1.0) ** 2
    for name, want in matrix_statistics(k, y).items():
        assert got[name] == pytest.approx(want, rel=1e-7, abs=1e-9), name
    values = [r["eigenvalue"] for r in G.spectrum(mapped, "phi", dim).collect()]
    assert np.allclose(values[:4], np.linalg.eigvalsh(k)[::-1][:4])


def test_row_statistics_equal_the_matrix(spark, points):
    df, x, y = points
    ref, labels = G.reference_rows(df, "x", ["id"], "y")
    assert np.allclose(ref, x) and (labels == y).all()
    rows = G.kernel_rows(G.numbered(df, ["id"]), "x", ref, "rbf", 0.3)
    k = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    want = matrix_statistics(k, y)
    assert G.row_alignment(rows, labels, "y").first()["alignment"] == pytest.approx(want["alignment"])
    assert G.row_effective_rank(rows).first()["effective_rank"] == pytest.approx(want["effective_rank"])
    b = G.row_block_ratio(rows, labels, "y").first()
    assert (b["within"], b["across"]) == (pytest.approx(want["within"]), pytest.approx(want["across"]))
    c = G.row_concentration(rows).first()
    assert (c["mean_off"], c["var_off"]) == (pytest.approx(want["mean_off"]), pytest.approx(want["var_off"]))
    assert G.diagonal_check(rows).first()["ok"]


def test_reference_bound_and_gamma(spark, points, monkeypatch):
    df, x, _ = points
    assert G.scale_gamma(df, "x") == pytest.approx(1 / (4 * x.var()))
    monkeypatch.setattr(G, "MAX_REFERENCE", 10)
    with pytest.raises(ValueError):
        G.reference_rows(df, "x", ["id"])


def test_fourier_map_is_close(points):
    _, x, _ = points
    freq = np.random.default_rng(1).normal(0, math.sqrt(0.6), (4000, 4))
    phi = M.fourier_block(x, freq)
    assert np.abs(phi @ phi.T - np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))).max() < 0.08


def test_bootstrap_weights_equal_repeated_rows(spark, points):
    df, x, y = points
    times = {i: (i * 7) % 3 for i in range(40)}
    rows = df.withColumn("times", (F.col("id") * 7) % 3).filter("times > 0").withColumn("replicate", F.lit(0))
    got = G.map_bootstrap(rows, "x", 4, "y").first()
    idx = [i for i in range(40) for _ in range(times[i])]
    want = matrix_statistics(x[idx] @ x[idx].T, y[idx])
    assert got["alignment"] == pytest.approx(want["alignment"]) and got["effective_rank"] == pytest.approx(want["effective_rank"])


def test_histogram_and_divergence(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.019, 0.5, 1.0)], "f double")
    hist = G.unit_histogram(df, "f", 50)
    counts = {r["bin"]: r["c"] for r in hist.collect()}
    assert len(counts) == 50 and counts[0] == 2 and counts[25] == 1 and counts[49] == 1
    mid = (np.arange(50) + .5) / 50
    q = 15 * (1 - mid) ** 14
    q /= q.sum()
    p = np.array([counts[i] for i in range(50)]) / 4
    want = sum(a * math.log((a + 1e-12) / (b + 1e-12)) for a, b in zip(p, q) if a > 1e-12)
    assert G.divergence_from_beta(hist, 4).first()["kl"] == pytest.approx(want)


def test_map_rows_equal_the_matrix(spark, points):
    df, x, _ = points
    k = x @ x.T
    h = np.eye(40) - 1 / 40
    squares = {r["id"]: r["squares"] for r in G.map_center(df, "x", 4).collect()}
    assert np.allclose([squares[i] for i in range(40)], ((h @ k @ h) ** 2).sum(axis=1))
    rows = {r["id"]: r for r in G.map_max_normalize(df, "x", 4).collect()}
    assert np.allclose([rows[i]["total"] for i in range(40)], k.sum(axis=1) / k.max()) and np.allclose([rows[i]["top"] for i in range(40)], np.diag(k) / k.max())
    low = G.map_diagonal(df, "x", 0.0).first()
    assert low["min_self"] == pytest.approx(np.diag(k).min()) and low["ok"]


def test_random_pairs_are_rows_of_the_table(spark, points):
    df, x, _ = points
    rows = G.random_row_pairs(df, "id", "x").collect()
    assert len(rows) == 40 and all(np.allclose(r["a"], x[r["id"]]) and any(np.allclose(r["b"], z) for z in x) for r in rows)


@pytest.mark.parametrize("block", [16, 2048])
def test_sums_over_all_rows_equal_the_matrix(spark, block):
    rng = np.random.default_rng(12)
    n = 90
    x, y = rng.normal(size=(n, 5)) * 0.4, (rng.random(n) < 0.2).astype(int)
    x[7] = x[3]
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "vec_id long, y int, v array<double>")
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    a, b = np.exp(-2.0 * d2), (x @ x.T / 5 + 0.5) ** 2
    sums = B.kernel_sums(df, "v", "y", [("rbf", 2.0, 0.0), ("poly", 0.2, 0.5)], ["vec_id"], block).cache()
    rows = sums.orderBy("vec_id").collect()
    for m, k in enumerate((a, b)):
        for c, want in (("total", k.sum(1)), ("squares", (k * k).sum(1)), ("top", k.max(1)), ("self", np.diag(k))):
            assert [r[f"{c}{m}"] for r in rows] == pytest.approx(want.tolist(), rel=1e-9)
        s, off, same = 2 * y - 1, ~np.eye(n, dtype=bool), y[:, None] == y[None]
        got = B.whole_statistics(sums, m).first()
        want = {"n": n, "alignment": s @ k @ s / (np.sqrt((k * k).sum()) * n), "effective_rank": np.trace(k) ** 2 / (k * k).sum(), "within": k[same].mean(),
                "across": k[~same].mean(), "mean_off": k[off].mean(), "var_off": k[off].var(), "min_self": np.diag(k).min()}
        assert got.asDict() == pytest.approx(want, rel=1e-7)
    h = np.eye(n) - 1.0 / n
    ca, cb = h @ a @ h, h @ b @ h
    assert B.whole_cka(sums).first().cka == pytest.approx((ca * cb).sum() / np.sqrt((ca * ca).sum() * (cb * cb).sum()), rel=1e-8)
    want = ((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()), np.sqrt(((a - b) ** 2).sum()) / n ** 2, np.abs(a - b).mean(), np.sqrt(((a - b) ** 2).mean()))
    assert tuple(B.whole_difference(sums).first()) == pytest.approx(want, rel=1e-8)
    got = B.centered_sums(df, "v", "y", ("rbf", 2.0, 0.0), "vec_id", block).orderBy("vec_id").collect()
    assert [r.squares for r in got] == pytest.approx((ca * ca).sum(1).tolist(), rel=1e-8) and [r.top for r in got] == pytest.approx(ca.max(1).tolist(), rel=1e-8)


def test_rows_meet_in_a_bounded_number_of_blocks(spark):
    """A row is sent to at most PIECES groups however many rows there are, each unordered pair of blocks is computed once, and every row meets all rows."""
    df = spark.createDataFrame([(i, [float(i)]) for i in range(300)], "vec_id long, v array<double>")

    def run(left, right):
        return [{"_row": a["_row"], "n": np.full(len(a["_row"]), len(b["_row"])), "calls": np.ones(len(a["_row"]), int)} for a, b in ((left, right), (right, left))]

    met = B.over_block_pairs(B.numbered_rows(df, "v"), run, "_row long, n long, calls long", block=4)
    per = met.groupBy("_row").agg(F.sum("n").alias("n"), F.sum("calls").alias("calls")).collect()
    assert len(per) == 300 and {r.n for r in per} == {300} and max(r.calls for r in per) <= B.PIECES


@pytest.mark.parametrize("block", [16, 2048])
def test_sums_of_odd_rows_equal_the_matrix(spark, block):
    """Rows of one class only in some blocks, a class mix that cuts tiles, a component that is not a number and wanted sums only."""
    x = np.random.default_rng(5).normal(size=(40, 3))
    x[9, 1] = np.nan
    y = (np.arange(40) >= 37).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(40)], "vec_id long, y int, v array<double>")
    k = x @ x.T
    rows = B.kernel_sums(df, "v", "y", [("linear", 1.0, 0.0)], ["vec_id"], block, ("same", "top")).orderBy("vec_id").collect()
    assert "total0" not in rows[0].asDict()
    assert np.allclose([r.same0 for r in rows], [k[i, y == y[i]].sum() for i in range(40)], equal_nan=True) and not np.isnan(rows[39].same0)
    assert np.allclose([r.top0 for r in rows], k.max(axis=1), equal_nan=True)


def test_maps_are_made_of_few_rows_at_a_time(spark, monkeypatch, tmp_path):
    """However many rows a batch has, at most STEP are mapped at once; other columns stay beside their rows."""
    monkeypatch.setattr(M, "STEP", 7)
    df = spark.createDataFrame([(i, [float(i), 1.0], f"r{i}") for i in range(50)], "id long, v array<double>, name string").coalesce(1)

    def block(x):
        with open(f"{tmp_path}/sizes", "a") as f:
            f.write(f"{len(x)} ")
        return np.hstack([x, 2 * x])

    got = {r.id: r for r in M._block_column(df, "v", "phi", block).collect()}
    assert len(got) == 50 and all(r.phi == [i, 1.0, 2.0 * i, 2.0] and r.v == [i, 1.0] and r.name == f"r{i}" for i, r in got.items())
    assert max(map(int, (tmp_path / "sizes").read_text().split())) <= 7
    assert M._block_column(df, "v", "v", lambda x: x + 1).filter("id = 3").first().v == [4.0, 2.0]
