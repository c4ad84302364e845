"""Encoders, scalers, PCA, scores, pipelines, classifiers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import checks, classifiers, encoding, labels, metrics, reduction, sampling, scaling, scoring
from tarnfold.plans import reduction as plan
from tarnfold.plans import shift


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(8)
    y = np.arange(300) % 2
    x = rng.normal(size=(300, 6)) * np.array([1, 2, 1, 1, 3, 0.0]) + 5
    x[:, 1] += 4 * y
    x[:, 2] -= 2 * y
    df = spark.createDataFrame([(i, int(y[i]), i % 3, [float(v) for v in x[i]]) for i in range(300)], "id int, y int, run int, features array<double>")
    return df.repartition(4), x, y


@pytest.mark.parametrize("block", [64, 2048])
def test_silhouette_of_all_rows_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    y = np.append(np.arange(250) % 3, [7, 9])
    x = rng.normal(size=(252, 5)) + y[:, None] * 0.4
    x[3] = x[0]
    want = np.zeros(252)
    for i in range(252):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        if (y == y[i]).sum() > 1:
            inside = far[y == y[i]].sum() / ((y == y[i]).sum() - 1)
            nearest = min(far[y == c].mean() for c in set(y) - {y[i]})
            want[i] = (nearest - inside) / max(nearest, inside)
    df = spark.createDataFrame([(None if y[i] == 9 else str(y[i]), x[i].tolist()) for i in range(252)], "y string, v array<double>")
    got = scoring.silhouette(df, "v", "y", block=block).first()
    assert got.n == 252 and got.silhouette == pytest.approx(want.mean(), abs=1e-12)
    assert tuple(scoring.silhouette(df.limit(0), "v", "y").first()) == (None, 0)


def test_silhouette_above_the_old_bound(spark):
    df = spark.range(5200).select((F.col("id") % 2).cast("string").alias("y"), F.array((F.col("id") % 2) * 10.0, (F.col("id") % 7) / 7.0).alias("v"))
    got = scoring.silhouette(df, "v", "y").first()
    assert got.n == 5200 and 0.9 < got.silhouette < 1


def test_frozen_one_hot(spark):
    train = spark.createDataFrame([("tcp", 1.0), ("udp", 2.0), ("only_train", 3.0)], "proto string, n double")
    test = spark.createDataFrame([("tcp", 5.0), ("only_test", 6.0), (None, 7.0)], "proto string, n double")
    onehot = encoding.FrozenOneHot.fit(train, ["n"], ["proto"])
    assert onehot.names == ["n", "proto_only_train", "proto_tcp", "proto_udp"]
    assert [r["features"] for r in onehot.transform(test).orderBy("n").collect()] == [[5, 0, 1, 0], [6, 0, 0, 0], [7, 0, 0, 0]]
    with pytest.raises(ValueError):
        encoding.FrozenOneHot.fit(train, [], ["proto"], max_levels=2)


def test_scalers_on_a_constant_column(blobs):
    df, x, _ = blobs
    rows = scaling.fit_minmax(df, "features", 0.0, math.pi).apply(df, "features").orderBy("id").collect()
    got = np.array([r["features"] for r in rows])
    assert (got[:, 5] == 0).all() and got[:, :5].max() == pytest.approx(math.pi) and got.min() == 0
    std = np.array([r["features"] for r in scaling.fit_standard(df, "features").apply(df, "features").orderBy("id").collect()])
    assert np.allclose(std[:, :5], ((x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1))[:, :5]) and (std[:, 5] == 0).all()


def test_clip_flag(spark, blobs):
    df, _, _ = blobs
    s = scaling.Scaler([0.0], [1.0], 0.0, 1.0, True)
    one = spark.createDataFrame([([3.0],)], "features array<double>")
    assert s.apply(one, "features").first()["features"] == [1.0]
    assert s.apply(one, "features", clipped=False).first()["features"] == [3.0]


def test_pca_is_centered_and_signed(blobs):
    df, x, _ = blobs
    pca = reduction.fit_pca(df, "features", 3)
    got = np.array([r["scores"] for r in pca.transform(df, "features").orderBy("id").collect()])
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    vt = vt * np.sign(vt[np.arange(6), np.abs(vt).argmax(1)])[:, None]
    assert np.allclose(got, (x - x.mean(0)) @ vt[:3].T)
    assert np.allclose(pca.ratio, (s ** 2 / (s ** 2).sum())[:3])
    assert len(reduction.fit_pca(df, "features", variance=0.999).ratio) == 5
    by = reduction.fit_pca_by(df, "features", 6, ["run"], 2)
    part = x[np.arange(300) % 3 == 1]
    row = by.filter("run = 1").first()
    assert np.allclose(row["mean"], part.mean(0))
    want = np.array([r["scores"] for r in reduction.fit_pca(df.filter("run = 1"), "features", 2).transform(df.filter("run = 1"), "features").orderBy("id").collect()])
    got = np.array([r["scores"] for r in shift.per_run_scores(df, df, "features", 6, "run", 2).filter("run = 1").orderBy("id").collect()])
    assert np.allclose(got, want)


def test_anova_with_constant_feature(blobs):
    df, x, y = blobs
    rows = {r["pos"]: r for r in scoring.anova(df, "features", "y", [f"f{i}" for i in range(6)]).collect()}
    for i in range(5):
        a, b = x[y == 0, i], x[y == 1, i]
        between = len(a) * (a.mean() - x[:, i].mean()) ** 2 + len(b) * (b.mean() - x[:, i].mean()) ** 2
        within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
        assert rows[i]["f_score"] == pytest.approx(between / (within / 298))
    assert rows[5]["f_score"] is None and rows[5]["p_value"] is None
    assert scoring.selected_positions(scoring.anova(df, "features", "y", list("abcdef")), 2) == [1, 2]


def test_correlations(blobs):
    df, x, _ = blobs
    names = [f"f{i}" for i in range(3)]
    cut = df.withColumn("features", F.slice("features", 1, 3))
    p = {(r["i"], r["j"]): r["pearson"] for r in scoring.pearson(cut, "features", names).collect()}
    assert p[(0, 1)] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1])
    ranks = x[:, :3].argsort(0).argsort(0)
    s = {(r["i"], r["j"]): r for r in scoring.spearman(cut, "features", names).collect()}
    assert s[(1, 2)]["spearman"] == pytest.approx(np.corrcoef(ranks[:, 1], ranks[:, 2])[0, 1]) and 0 <= s[(1, 2)]["p_value"] <= 1


def test_pipeline_classifier_and_stream(spark, blobs, tmp_path):
    from tarnfold.streaming.scoring import score_stream
    df, _, _ = blobs
    fitted = plan.fit_reduction(df, [f"f{i}" for i in range(6)], "y", 3, 2)
    assert 1 in fitted.positions
    angles = fitted.to_angles(df)
    assert checks.require(checks.angle_checks(angles, "angles", 2, math.pi)).count() == 4
    model = classifiers.fit_margin(angles, "angles", "y")
    scored = model.score(angles, "angles")
    assert metrics.macro_f1(scored).first()["macro_f1"] > 0.75
    assert model.margin_width() > 0
    prob = classifiers.apply_sigmoid(scored, classifiers.fit_sigmoid(scored, "score", "y"), "score")
    ece = metrics.calibration_error(metrics.reliability(prob, [], "prob", ["id"], 5)).first()["ece"]
    assert 0 <= ece < 0.2
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = score_stream(spark.readStream.schema(df.schema).parquet(path), fitted, model)
    q = stream.select("id", "pred").writeStream.format("memory").queryName("scored_stream").start()
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: r["pred"] for r in spark.table("scored_stream").collect()}
    assert got == {r["id"]: r["pred"] for r in scored.select("id", "pred").collect()}


def test_cross_validation_tables(spark, blobs):
    df, _, _ = blobs
    folds = sampling.stratified_folds(df, 2, "y", ["id"])
    table = plan.k_search(folds, [f"f{i}" for i in range(6)], "y", [1, 3], "fold", 2, max_iter=10)
    rows = {r["k"]: r["f1_mean"] for r in table.collect()}
    assert set(rows) == {1, 3} and all(v > 0.7 for v in rows.values())
    cv = spark.createDataFrame([(0.1, .88, .01), (1.0, .90, .03), (10.0, .90, .01)], "c double, f1_mean double, std_err double")
    assert classifiers.one_standard_error(cv).first()["chosen_c"] == 0.1
    assert classifiers.best_setting(cv).first()["chosen_c"] == 1.0


def test_checks_report_failures(spark):
    df = spark.createDataFrame([(0.0, 0, "normal", "Normal"), (1.2, 1, "normal", "DoS")], "f double, y int, m string, c string")
    report = checks.sanity_suite(df, df, ["f"], ["f"], "y", "m", "c", categories_expected=5)
    failed = {r["check"] for r in report.filter("NOT ok").collect()}
    assert failed == {"feature_range", "label_consistency", "category_count"}
    with pytest.raises(checks.CheckFailed):
        checks.require(report)


def test_flow_labels(spark):
    from tarnfold.sources.readers import FLOW_GROUPS
    df = spark.createDataFrame([("normal",), ("smurf",), ("never_seen",), (None,)], "label string")
    got = {r["label"]: (r["label_binary"], r["attack_category"]) for r in labels.label_flows(df, FLOW_GROUPS).collect()}
    assert got["normal"] == (0, "Normal") and got["smurf"] == (1, "DoS") and got["never_seen"] == (1, "Unknown") and got[None][1] == "Unknown"
    texts = spark.createDataFrame([(None,), (" DoS ",)], "c string").select(labels.text_category("c").alias("c"))
    assert [r["c"] for r in texts.collect()] == ["Unknown", "DoS"]
