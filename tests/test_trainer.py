"""Grouped trainer and exact dual classifiers: optimality, maps per part, job counts, resume."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import duals as D
from tarnfold.operators import metrics
from tarnfold.operators import trainer as T
from tarnfold.plans import studies


def cloud(n=240, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, dim)) * [1, 2, 1, 1, 3, 1] + np.outer(y, [1.5, 0, -1, 0, 0, 0.5]) + 4
    return x, y, np.arange(n) % 4


@pytest.fixture(scope="module")
def study(spark):
    x, y, part = cloud()
    rows = [(i, v.tolist(), int(c), int(p)) for i, (v, c, p) in enumerate(zip(x, y, part))]
    rows += [(900, None, 1, 0), (901, [9.0] * 6, None, 1), (902, [9.0] * 6, 1, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int, part int").repartition(5)
    return df, x, y, part


def brute_best(x, y, c, costs=(1.0, 1.0)):
    """Least hinge objective, by solving the dual over all rows."""
    s = 2.0 * y - 1
    cost = c * np.asarray(costs)[y]
    gram = x @ x.T
    alpha = D.solve_working(gram, s, np.zeros(len(x)), np.zeros(len(x)), cost, 1e-7)
    return alpha.sum() - 0.5 * (alpha * s) @ gram @ (alpha * s)


def hinge_objective(fit, x, y, costs=(1.0, 1.0)):
    u = 1 - (2.0 * y - 1) * (x @ fit.w + fit.b)
    return 0.5 * fit.w @ fit.w + (fit.design.c * np.asarray(costs)[y] * np.maximum(u, 0)).sum()


def test_moments_of_parts(study):
    df, x, y, part = study
    m = T.part_moments(T.study_rows(df, "v", "y", "part"))
    assert m.parts == [0, 1, 2, 3]
    own = np.isin(part, [1, 3])
    n, sums, cross, low, high = m.of({1, 3})
    z = x[own] - m.base
    assert n.tolist() == [np.sum(y[own] == 0), np.sum(y[own] == 1)]
    assert np.allclose(sums.sum(axis=0), z.sum(axis=0)) and np.allclose(cross.sum(axis=0), z.T @ z)
    assert np.allclose(low, x[own].min(axis=0)) and np.allclose(high, x[own].max(axis=0))


def test_maps_follow_their_parts_only(study):
    df, x, y, part = study
    rows = T.study_rows(df, "v", "y", "part")
    m = T.part_moments(rows)
    own = np.isin(part, [0, 2])
    a, b = x[own][y[own] == 0], x[own][y[own] == 1]
    f = sum(len(g) * (g.mean(axis=0) - x[own].mean(axis=0)) ** 2 for g in (a, b)) / sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in (a, b))
    order = T.anova_order(m, {0, 2})
    assert order.tolist() == np.argsort(-f).tolist()
    axes, shift = T.principal_axes(m, {0, 2}, order[:4], 2)
    inputs = (x[own][:, order[:4]] - x[own][:, order[:4]].mean(axis=0))
    values, vectors = np.linalg.eigh(inputs.T @ inputs)
    assert np.allclose(np.abs((x[own] - m.base) @ axes + shift + m.base @ axes), np.abs(inputs @ vectors[:, ::-1][:, :2]))
    scaled, off = T.scaled(m, {0, 2}, range(6))
    z = x[own] @ scaled + off
    assert np.allclose(z.min(axis=0), 0) and np.allclose(z.max(axis=0), 1)


@pytest.mark.parametrize("c,balanced", [(0.01, False), (1.0, True)])
def test_fits_are_optimal(study, c, balanced):
    df, x, y, part = study
    rows = T.study_rows(df, "v", "y", "part")
    m = T.part_moments(rows)
    designs = []
    for fold in range(4):
        learns = frozenset(range(4)) - {fold}
        designs += [T.Design({"fold": fold, "k": k}, learns, *T.chosen(m, T.anova_order(m, learns)[:k]), c, balanced) for k in (2, 6)]
        designs.append(T.Design({"fold": fold, "k": -1}, learns, *T.principal_axes(m, learns, range(6), 3), c, balanced))
    for fit in T.fit_designs(rows, m, designs):
        own = np.isin(part, list(fit.design.learns))
        inputs, labels = x[own] @ fit.design.axes + fit.design.shift, y[own]
        costs = [len(labels) / (2 * np.sum(labels == k)) for k in (0, 1)] if balanced else (1.0, 1.0)
        value, best = hinge_objective(fit, inputs, labels, costs), brute_best(inputs, labels, c, costs)
        assert value == pytest.approx(fit.objective, rel=1e-9)
        assert best - 1e-6 * best <= value <= best * (1 + 2e-3)
        assert value - best <= fit.gap + 1e-6 * best  # the gap is a proof


def test_cells_count_the_parts_tested(study):
    df, x, y, part = study
    rows = T.study_rows(df, "v", "y", "part", "id")
    m = T.part_moments(rows)
    fits = T.fit_designs(rows, m, [T.Design({"run": p}, frozenset([p]), *T.scaled(m, {p}, range(6))) for p in range(4)])
    cells = {(r.run, r.part): (r.tn, r.fp, r.fn, r.tp) for r in T.test_designs(rows, fits, lambda d: {0, 1, 2, 3}, by_part=True).collect()}
    scored = {(r.run, r.id): (r.score, r.pred) for r in T.score_designs(rows, fits, lambda d: {0, 1, 2, 3}, "id").collect()}
    assert len(cells) == 16 and len(scored) == 4 * 240
    for f in fits:
        score = (x @ f.design.axes + f.design.shift) @ f.w + f.b
        assert np.allclose(score, [scored[f.design.name["run"], i][0] for i in range(240)])
        for p in range(4):
            own, pred = part == p, score > 0
            assert cells[f.design.name["run"], p] == tuple(int(np.sum(own & (y == a) & (pred == b))) for a, b in ((0, False), (0, True), (1, False), (1, True)))
    macro = metrics.macro_f1_of(T.test_designs(rows, fits, lambda d: {0, 1}))
    direct = metrics.macro_f1(T.score_designs(rows, fits, lambda d: {0, 1}), ["run"])
    assert {r.run: round(r.macro_f1, 9) for r in macro.collect()} == {r.run: round(r.macro_f1, 9) for r in direct.collect()}


def test_parts_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1, 0), ([2.0, 2.0], 1, 0), ([0.0, 1.0], 0, 1), ([5.0, 1.0], 1, 1)], "v array<double>, y int, part int")
    rows = T.study_rows(df, "v", "y", "part")
    m = T.part_moments(rows)
    fits = T.fit_designs(rows, m, [T.Design({"p": p}, frozenset([p]), *T.scaled(m, {p}, [0, 1])) for p in (0, 1, 2)])
    assert [f.only for f in fits] == [1, None, 0]
    assert {r.p: r.pred for r in T.score_designs(rows.filter("part = 0"), fits, lambda d: {0}).collect()}[2] == 0


def test_rounds_do_not_follow_the_number_of_models(study):
    df, *_ = study
    rows = T.study_rows(df, "v", "y", "part")
    m = T.part_moments(rows)

    def rounds(cs):
        return max(f.rounds for f in T.fit_designs(rows, m, [T.Design({"c": c}, frozenset(range(4)), *T.scaled(m, range(4), range(6)), c) for c in cs]))

    assert rounds([1.0] * 20) == rounds([1.0]) < 60


def test_rounds_read_packed_blocks(study, monkeypatch):
    """Rounds get blocks of raw numbers, not a list for every row, and other columns do not travel; blocks hold every row once."""
    df, x, y, part = study
    rows = T.study_rows(df, "v", "y", "part", "id")
    seen, old = [], T._round
    monkeypatch.setattr(T, "_round", lambda blocks, trials: seen.append((blocks.columns, blocks.count())) or old(blocks, trials))
    monkeypatch.setattr(T, "PACKED_ROWS", 7)
    fits = T.fit_designs(rows, T.part_moments(rows), [T.Design({"c": 1.0}, frozenset(range(4)), np.eye(6), np.zeros(6))])
    assert fits[0].objective == pytest.approx(hinge_objective(fits[0], x, y), rel=1e-9)
    assert {c for columns, _ in seen for c in columns} == {"part", "y", "x"} and max(n for _, n in seen) < 60
    found = [z for batch in T.packed(rows).toArrow().to_batches() for z in T._blocks([batch])]
    assert sorted(np.concatenate([z[2] for z in found]).tolist()) == sorted(x.tolist()) and sum(len(z[0]) for z in found) == 240


def test_smoothed_hinge():
    u = np.array([-1.0, 0.0, 0.02, 0.05, 0.3])
    want = np.array([0, 0, 0.02 ** 2 / 0.1, 0.025, 0.275])
    assert np.allclose(T.smooth(u, 0.05), want) and T.smooth_sum(u.copy(), np.arange(5.0), 0.05) == pytest.approx(np.arange(5) @ want)


def test_models_are_saved_and_loaded(study, tmp_path, spark):
    df, *_ = study
    rows = T.study_rows(df, "v", "y", "part", "id")
    fits = studies.fitted_runs(rows, 4, 2)
    T.model_table(spark, fits).write.parquet(f"{tmp_path}/models")
    again = T.fits_of(spark.read.parquet(f"{tmp_path}/models"), ["train_run"])
    first, second = ({(r.train_run, r.id): r.score for r in T.score_designs(rows, f, lambda d: {0, 1, 2, 3}, "id").collect()} for f in (fits, again))
    assert first == second and len(first) == 960


def test_learning_curve_goes_on_where_it_stopped(study, tmp_path, spark, monkeypatch):
    df, *_ = study
    known = df.filter("y is not null and v is not null")
    sized = known.withColumn("size", F.explode(F.array(F.lit(40), F.lit(80), F.lit(160)))).filter("id < size")
    path = f"{tmp_path}/curve"
    def told(df):
        return {r["size"]: {c: round(v, 7) for c, v in r.asDict().items()} for r in df.collect()}

    whole = told(studies.learning_curve(sized, known, [40, 80, 160], "v", "y"))
    assert told(studies.learning_curve(sized, known, [40, 80], "v", "y", path=path)) == {s: whole[s] for s in (40, 80)}
    fitted, old = [], T.fit_designs
    monkeypatch.setattr(T, "fit_designs", lambda rows, m, designs, **kw: fitted.extend(d.name["size"] for d in designs) or old(rows, m, designs, **kw))
    assert told(studies.learning_curve(sized, known, [40, 80, 160], "v", "y", path=path)) == whole and fitted == [160]
    assert studies.learning_curve(sized, known, [40, 80, 160], "v", "y", path=path).count() == 3 and fitted == [160]
    assert all(math.isclose(r["gap"], r["train_f1"] - r["test_f1"], abs_tol=1e-6) and r["duality_gap"] <= 5e-3 * r["objective"] for r in whole.values())


@pytest.mark.parametrize("kernel", [("linear", 1.0, 0.0), ("poly", 0.2, 1.0), ("rbf", 0.1, 0.0)])
@pytest.mark.parametrize("working,balanced", [(1024, False), (96, True)])
def test_dual_is_optimal(spark, kernel, working, balanced):
    x, y, _ = cloud(150, seed=3)
    x = np.concatenate([x, x[:10]])  # repeated rows, some with the other label
    y = np.concatenate([y, 1 - y[:5], y[5:10]])
    test = np.random.default_rng(1).normal(size=(20, 6)) + 4
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))] + [(1000 + i, v.tolist(), None) for i, v in enumerate(test)] + [(2000, None, 1)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(4)
    model = D.fit_dual(df, "x", "y", kernel, 1.0, balanced, ["id"], working)
    s, costs = 2.0 * y - 1, np.array([len(y) / (2 * np.sum(y == k)) for k in (0, 1)])[y] if balanced else np.ones(len(y))

    def gram(a, b):
        return a @ b.T if kernel[0] == "linear" else (kernel[1] * a @ b.T + kernel[2]) ** 2 if kernel[0] == "poly" else np.exp(-kernel[1] * ((a[:, None] - b[None]) ** 2).sum(axis=2))

    k = gram(x, x)
    alpha = D.solve_working(k, s, np.zeros(len(x)), np.zeros(len(x)), costs, 1e-7)
    best = alpha.sum() - 0.5 * (alpha * s) @ k @ (alpha * s)
    assert model.objective == pytest.approx(best, rel=1e-4) and model.gap <= 1e-3 * best
    got = {r.id: r for r in model.rows.collect()}
    assert len(got) == len(x) + 20 and got[1000].y is None and got[1000].alpha == 0
    mine = np.array([got[i].alpha for i in range(len(x))])
    assert abs((mine * s).sum()) < 1e-6 and mine.min() >= 0 and (mine <= costs + 1e-9).all()
    assert np.allclose([got[i].score for i in range(len(x))], k @ (mine * s) + model.offset, atol=1e-8)
    assert np.allclose([got[1000 + i].score for i in range(20)], gram(test, x) @ (mine * s) + model.offset, atol=1e-8)
    assert model.width == pytest.approx(2 / ((mine * s) @ k @ (mine * s)) ** 0.5, rel=1e-8)
    r = model.support().first()
    assert (r.n_support, r.n_support_0, r.n_support_1) == (np.sum(mine > 0), np.sum((mine > 0) & (y == 0)), np.sum((mine > 0) & (y == 1)))


def test_dual_of_one_class(spark):
    model = D.fit_dual(spark.createDataFrame([([1.0], 0), ([2.0], 0)], "x array<double>, y int"), "x", "y", ("rbf", 1.0, 0.0))
    assert [r.pred for r in model.rows.collect()] == [0, 0] and model.rounds == 0 and model.support().first().n_support == 0
    assert D.fit_dual(spark.createDataFrame([], "x array<double>, y int"), "x", "y", ("rbf", 1.0, 0.0)).rows.count() == 0


def test_dual_starts_near_its_optimum(spark, monkeypatch):
    """Rows beyond a working set do not take a round for every few of them."""
    x, y, _ = cloud(200, seed=8)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y int").coalesce(2)
    model = D.fit_dual(df, "x", "y", ("linear", 1.0, 0.0), 0.1, keep=["id"], working=24)
    assert model.rounds <= 3 and model.gap <= 2e-3 * model.objective
    monkeypatch.setattr(D, "_started", lambda state, *given: state)
    assert D.fit_dual(df, "x", "y", ("linear", 1.0, 0.0), 0.1, keep=["id"], working=24, most=4).rounds == 4


@pytest.mark.parametrize("kernel", [("linear", 1.0, 0.0), ("poly", 0.2, 1.0), ("rbf", 0.1, 0.0)])
def test_start_of_a_dual_ends_at_a_working_set(spark, monkeypatch, kernel):
    """The start's smoothing narrows until a working set can hold the rows within it, not to the tolerance; exact rounds bring the same optimum."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(int)
    fits, old = [], D.fit_designs
    monkeypatch.setattr(D, "fit_designs", lambda *given, **named: fits.extend(old(*given, **named)) or fits)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y int").coalesce(2)
    model = D.fit_dual(df, "x", "y", kernel, keep=["id"], working=128)
    assert fits[0].rounds <= 30 and model.rounds <= 12
    k, s = D.kernel_matrix(x, x, kernel), 2.0 * y - 1
    alpha = D.solve_working(k, s, np.zeros(600), np.zeros(600), np.ones(600), 1e-6)
    best = alpha.sum() - 0.5 * (alpha * s) @ k @ (alpha * s)
    assert model.objective == pytest.approx(best, rel=1e-4) and model.gap <= 1e-4 * best
    assert model.width == pytest.approx(2 / ((alpha * s) @ k @ (alpha * s)) ** 0.5, rel=1e-3)


def test_few_numbers_are_added_without_a_shuffle(spark, monkeypatch):
    """A round of a small model is one pass; its sums are those of the two steps."""
    x, y, _ = cloud(200, seed=4)
    rows = T.study_rows(spark.createDataFrame([(0, int(c), v.tolist()) for v, c in zip(x, y)], "p int, y int, v array<double>").repartition(5), "v", "y", "p")
    blocks = T.packed(rows)
    design = T.Design({"p": 0}, frozenset([0]), np.eye(6), np.zeros(6))
    trials = [(k, design, np.full(7, 0.1 * k), np.ones(7), 0.5, np.ones(2), 0.3) for k in (0, 1)]
    grouped, old = [], type(blocks).groupBy
    monkeypatch.setattr(type(blocks), "groupBy", lambda df, *by: grouped.append(by) or old(df, *by))
    here = T._round(blocks, trials)
    assert not grouped
    monkeypatch.setattr(T, "AT_ONCE", 0)
    there = T._round(blocks, trials)
    assert grouped and here.keys() == there.keys() == {0, 1}
    for k in here:
        assert all(np.allclose(a, b, rtol=1e-12, atol=1e-12) for a, b in zip(here[k], there[k]))
        s = 2.0 * y - 1
        u = 1 - s * (x @ (trials[k][2] + 0.5)[:6] + trials[k][2][6] + 0.5)
        assert here[k][4] == np.sum((u > 0) & (u < 0.3)) and here[k][2] == pytest.approx(np.maximum(u, 0).sum())


def test_support_of_many_copies(spark, monkeypatch):
    """Copies with either label beyond a working set stay within the corner at every width; support rows are those of the optimum."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 3)), np.tile([0.2, -0.1, 0.4], (150, 1))])
    y = np.concatenate([(x[:300, 0] + 0.7 * rng.normal(size=300) > 0).astype(int), np.arange(150) % 2])
    fits, old = [], D.fit_designs
    monkeypatch.setattr(D, "fit_designs", lambda *given, **named: fits.extend(old(*given, **named)) or fits)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y int").coalesce(2)
    kernel = ("rbf", 0.25, 0.0)
    model = D.fit_dual(df, "x", "y", kernel, keep=["id"], working=96)
    assert fits[0].rounds + model.rounds <= 40 and model.gap <= 2e-4 * model.objective
    k, s = D.kernel_matrix(x, x, kernel), 2.0 * y - 1
    alpha = D.solve_working(k, s, np.zeros(450), np.zeros(450), np.ones(450), 1e-6)
    mine = {r.id: r.alpha for r in model.rows.collect()}
    score = {r.id: r.score for r in model.rows.collect()}
    assert model.objective == pytest.approx(alpha.sum() - 0.5 * (alpha * s) @ k @ (alpha * s), rel=1e-4)
    out = [i for i in range(450) if s[i] * score[i] > 1.01]
    within = [i for i in range(450) if s[i] * score[i] < 0.99]
    assert len(out) > 50 and all(mine[i] == 0 for i in out) and all(mine[i] == 1 for i in within)
    r = model.support().first()
    assert len(within) <= r.n_bound <= r.n_support <= 450 - len(out) and r.n_support == r.n_support_0 + r.n_support_1
