"""Micro tables: ties, few rows, remainders, one class, no discordant pairs."""

import math

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import metrics as M
from tarnfold.operators import paired as P
from tarnfold.operators import search, summaries
from tarnfold.plans import shift


@pytest.fixture(scope="module")
def ties(spark):
    return spark.createDataFrame([(1, .1, 0), (2, .5, 1), (3, .5, 0), (4, .5, 1), (5, .9, 1)], "id int, p double, y int")


def test_curves_with_ties(ties):
    assert M.roc_auc(ties, [], "p").first()["auc"] == pytest.approx((1 + 1 + 2 * (1 + .5)) / 6)
    # .9: P 1, recall 1/3; .5: P 3/4, recall 1; .1: nothing new
    assert M.average_precision(ties, [], "p").first()["ap"] == pytest.approx(1 / 3 + 2 / 3 * 3 / 4)
    pts = {r["score"]: (r["fpr"], r["tpr"]) for r in M.roc_points(ties, [], "p").collect()}
    assert pts[.9] == (0.0, pytest.approx(1 / 3)) and pts[.5] == (.5, 1.0) and pts[.1] == (1.0, 1.0)
    op = M.operating_points(ties, [], "p", [0.05]).first()
    assert op["fpr"] == 0.0 and op["tpr"] == pytest.approx(1 / 3)


def test_corners_of_a_curve(spark):
    """Runs of equal steps longer than a range, repeated scores, two groups and a null one, against a plain loop."""
    rows = [(g, round(1 - i / 200, 3), int((i // run) % 2 == 0)) for g, run in (("a", 7), ("b", 40), (None, 1)) for i in range(200)]
    rows += [("a", 0.5, 1), ("a", 0.495, 0), ("a", 0.495, 0)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    got = {(r.g, r.score): (r.fpr, r.tpr) for r in M.corner_points(df, ["g"], "p").collect()}
    want = {}
    for g in ("a", "b", None):
        own = [(p, y) for q, p, y in rows if q == g]
        scores = sorted({p for p, _ in own}, reverse=True)
        steps = [(sum(y for q, y in own if q == p), sum(1 - y for q, y in own if q == p)) for p in scores]
        total = [sum(x) for x in zip(*steps)]
        for i, p in enumerate(scores):
            if i in (0, len(scores) - 1) or steps[i] != steps[i + 1]:
                done = [sum(x) for x in zip(*steps[:i + 1])]
                want[g, p] = (done[1] / total[1], done[0] / total[0])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    every = M.operating_points(df, ["g"], "p", [0.03]).filter("g = 'b'").first()
    corner = M.operating_points(df, ["g"], "p", [0.03], corners=True).filter("g = 'b'").first()
    assert every.fpr > 0 and corner.fpr == 0.0 and corner.tpr == pytest.approx(40 / 120)


def test_mann_whitney_with_ties(ties):
    r = P.mann_whitney(ties, "p", "y").first()
    assert r["u"] == pytest.approx(5.0)  # U / (n1 n0) is the AUC
    var = 3 * 2 / 12 * (6 - (27 - 3) / (5 * 4))
    z = (5 - 3 - .5) / math.sqrt(var)
    assert r["z"] == pytest.approx(z) and r["p_value"] == pytest.approx(.5 * math.erfc(z / math.sqrt(2)))


def test_reliability_bins(spark):
    few = spark.createDataFrame([(i, i / 10, i % 2) for i in range(3)], "id int, p double, y int")
    assert [r["size"] for r in M.reliability(few, [], "p", ["id"], 10).orderBy("bin").collect()] == [1, 1, 1]
    rest = spark.createDataFrame([(i, i / 23, i % 2) for i in range(23)], "id int, p double, y int")
    bins = M.reliability(rest, [], "p", ["id"], 5).orderBy("bin").collect()
    assert [r["size"] for r in bins] == [4, 4, 4, 4, 7]
    want = sum(len(b) / 23 * abs(sum(i % 2 for i in b) / len(b) - sum(i / 23 for i in b) / len(b))
               for b in (range(0, 4), range(4, 8), range(8, 12), range(12, 16), range(16, 23)))
    assert M.calibration_error(M.reliability(rest, [], "p", ["id"], 5)).first()["ece"] == pytest.approx(want)


def test_one_class(spark):
    one = spark.createDataFrame([(i, i / 4, 1, 1) for i in range(4)], "id int, p double, y int, pred int")
    assert M.roc_auc(one, [], "p").first()["auc"] is None
    assert M.average_precision(one, [], "p").first()["ap"] == pytest.approx(1.0)
    assert M.macro_f1(one).first()["macro_f1"] == 1.0
    none = one.withColumn("y", F.lit(0))
    assert M.average_precision(none, [], "p").first()["ap"] is None
    r = M.rates(M.confusion(none)).first()
    assert (r["precision"], r["recall"], r["f1"], r["fpr"], r["fnr"]) == (0, 0, 0, 1, 0)


def test_no_discordant_pairs(spark):
    same = spark.createDataFrame([(1, 1, 1), (0, 1, 1)], "y int, pred_a int, pred_b int")
    cells = P.agreement(same)
    r = P.mcnemar_chi2(cells).first()
    assert (r["statistic"], r["p_value"]) == (0.0, 1.0)
    assert P.mcnemar_exact(cells).first()["p_value"] == 1.0


def test_cohens_d_variants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)], "a double, b double")
    pooled = math.sqrt((1.0 + 13.0) / 2)
    assert P.cohens_d(df, "a", "b").first()["d"] == pytest.approx(-3 / pooled)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "a double, b double")
    assert P.cohens_d(flat, "a", "b", nan_below=1e-12).first()["effect"] == "undefined"
    assert P.cohens_d(flat, "a", "b", ddof=0, eps=1e-9).first()["d"] == 0.0


def test_pareto_keeps_equal_points(spark):
    df = spark.createDataFrame([(1, .9, .5, .2), (2, .9, .5, .2), (3, .8, .4, .3), (4, .7, .9, .1)], "n int, v_n double, s_norm double, q_n double")
    assert sorted(r["n"] for r in search.pareto_front(df).collect()) == [1, 2, 4]


def test_elbow_gate_and_slope(spark):
    cv = spark.createDataFrame([(4, .80), (8, .895), (16, .90), (32, .90)], "k int, f1_mean double")
    r = search.elbow(cv).first()
    assert (r["k_final"], r["k_optimal"]) == (8, 16)
    assert spark.range(1).select(search.gate_cost(F.lit(10), 2)).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        search.variance_gate(spark.createDataFrame([(1, .2)], "n int, v_n double"), .85)
    two = spark.createDataFrame([(0.0, 1.0), (1.0, .4)], "s double, f double")
    assert summaries.slope(two, [], "s", "f").first()["slope"] == pytest.approx(-.6)


def test_confusion_rebuild_and_invariance(spark):
    df = spark.createDataFrame([(.75, .6, 20, 10), (0.0, 0.0, 20, 10)], "p double, r double, n int, pos int")
    rows = summaries.rebuild_confusion(df, "p", "r", "n", "pos").select("tn", "fp", "fn", "tp").collect()
    assert [tuple(r) for r in rows] == [(8, 2, 4, 6), (10, 0, 10, 0)]
    a = spark.createDataFrame([(1, .5), (2, .6)], "k int, v double")
    assert shift.unchanged(a, a, ["k"], "v").first()["ok"]
    assert not shift.unchanged(a, a.filter("k = 1"), ["k"], "v").first()["ok"]
