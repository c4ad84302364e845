"""Exact sizes, short pools, folds, runs, and independence from partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import ranking
from tarnfold.operators import sampling as S

SECOND = ["Normal", "Generic", "Exploits", "Fuzzers", "DoS", "Reconnaissance", "Analysis", "Backdoor", "Shellcode", "Worms"]
CASES = [
    ({"Normal": 330, "Exploits": 330, "DoS": 340}, 100, [], 0),
    ({"A": 100, "B": 200, "C": 300, "D": 400}, 100, [], 0),
    (dict(zip(SECOND, [500, 400, 300, 250, 150, 120, 30, 20, 12, 3])), 100, SECOND[-4:], 5),
    ({f"g{i}": 100 + 10 * i for i in range(8)}, 20, [], 0),
    ({c: 250 for c in "ABCD"}, 100, [], 0),
    ({"Normal": 600, "DoS": 300, "R": 60, "U": 4}, 100, ["R", "U"], 10),
]


def make(spark, counts):
    rows, i = [], 0
    for cat, n in counts.items():
        for _ in range(n):
            rows.append((i, cat))
            i += 1
    return spark.createDataFrame(rows, "id bigint, category string")


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("mode", ["pooled", "floor", "lrm_balanced"])
def test_sample_has_exactly_n_rows(spark, case, mode):
    counts, n, rare, m = CASES[case]
    got = S.stratified_sample(make(spark, counts), n, "category", ["id"], rare, m, mode, 42)
    per = {r["category"]: r["count"] for r in got.groupBy("category").count().collect()}
    assert sum(per.values()) == n
    if mode != "pooled":
        assert all(per[c] >= m for c in rare)


@pytest.mark.parametrize("seed", range(100, 105))
def test_other_seeds(spark, seed):
    counts, n, rare, m = CASES[-1]
    assert S.stratified_sample(make(spark, counts), n, "category", ["id"], rare, m, "lrm_balanced", seed).count() == n


STRATA = {"c0": 3, "c1": 40, "big": 1000, "mid": 400, "tiny": 1}


@pytest.mark.parametrize("mode, want", [
    # rare c0 and c1 share 2 x 10: one each, 18 left by count 3 : 40, so 1.256 and 16.744; others 80: one each, 77 left by 1000 : 400 : 1
    ("pooled", {"c0": 2, "c1": 18, "big": 56, "mid": 23, "tiny": 1}),
    # ten for each rare one, of which c0 has three and repeats them
    ("per_category", {"c0": 10, "c1": 10, "big": 56, "mid": 23, "tiny": 1}),
    # floors of 80 x share: 57.1, 22.8 and at least one: all spent
    ("floor", {"c0": 10, "c1": 10, "big": 57, "mid": 22, "tiny": 1}),
    ("lrm_balanced", {"c0": 10, "c1": 10, "big": 57, "mid": 22, "tiny": 1}),
])
def test_quotas_by_hand(spark, mode, want):
    table = spark.createDataFrame(sorted(STRATA.items()), "category string, n bigint").coalesce(1)
    got = {r["category"]: r["quota"] for r in S.plan_quotas(table, 100, "category", ["c0", "c1"], 10, mode).collect()}
    assert got == want


@pytest.mark.parametrize("mode", ["pooled", "per_category", "floor", "lrm_balanced"])
def test_quotas_of_many_groups_sum_to_their_size(spark, mode):
    rng = random.Random(5)
    rows = [(g, c if c != "c2" else None, rng.choice([1, 2, 3, 10, 57, 400, 1000]), 5 + 30 * (g % 5), g % 7) for g in range(25) for c in ("c0", "c1", "c2", "c3", "c4")[:2 + g % 4]]
    table = spark.createDataFrame(rows, "g int, category string, n bigint, want bigint, least_rare bigint").coalesce(1)
    got = S.plan_quotas(table, F.col("want"), "category", ["c0", "c1"], F.col("least_rare"), mode, ["g"]).collect()
    sums = {}
    for r in got:
        sums[r["g"]] = sums.get(r["g"], 0) + r["quota"]
    assert len(got) == len(rows) and sums == {g: 5 + 30 * (g % 5) for g in range(25)}


def test_surplus_of_many_tiny_strata_is_taken_back(spark):
    """Floors of one for 60 strata make 60 + 30; 40 rows are wanted, so the big stratum gives its surplus back."""
    table = spark.createDataFrame([("big", 3000)] + [(f"t{i:02d}", 1) for i in range(30)], "category string, n bigint").coalesce(1)
    got = {r["category"]: r["quota"] for r in S.plan_quotas(table, 40, "category", mode="lrm_balanced").collect()}
    assert sum(got.values()) == 40 and got["big"] == 10 and all(got[f"t{i:02d}"] == 1 for i in range(30))


def with_null(spark):
    """1000 rows, 100 of them without a category, with text keys."""
    rows = [(f"u{i}", None if i % 10 == 0 else "ABC"[i % 3], float(i % 37), i % 2) for i in range(1000)]
    return spark.createDataFrame(rows, "key string, category string, score double, y int")


def test_a_null_stratum_is_a_stratum(spark):
    df = with_null(spark)
    assert S.stratified_sample(df, 500, "category", ["key"], ["A"], 5).count() == 500
    split = S.stratified_split(df, 500, "category", ["key"])
    assert split.count() == 500 and split.filter("category IS NULL").count() == 50
    folds = S.stratified_folds(df, 5, "category", ["key"]).groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("category").isNull()).alias("m")).collect()
    assert [(r["n"], r["m"]) for r in folds] == [(200, 20)] * 5
    subset = S.cv_subset(df, 300, "category", ["key"], ["B"])
    assert subset.count() == 300 or subset.filter("category = 'B'").count() == 300
    assert S.cv_subset(df, 600, "category", ["key"], ["B"]).filter("category IS NULL").count() > 0
    again = S.draw(df, S.stratum_counts(df, "category").withColumn("quota", F.lit(150).cast("long")), "category", ["key"], 3)
    assert again.filter("category IS NULL").count() == 150 and again.count() == 600


def test_a_null_group_has_quantiles_curves_and_bins(spark):
    from tarnfold.operators import metrics, summaries
    df = with_null(spark)
    none = [r[0] for r in df.filter("category IS NULL").select("score").collect()]
    got = {r["category"]: r for r in ranking.exact_quantiles(df, ["category"], "score", [0.0, 0.5, 1.0]).collect()}
    assert len(got) == 4 and got[None]["p00"] == min(none) and got[None]["p100"] == max(none)
    auc = {r["category"]: r["auc"] for r in metrics.roc_auc(df, ["category"], "score").collect()}
    assert set(auc) == {None, "A", "B", "C"}
    bins = metrics.reliability(df, ["category"], "score", ["key"])
    assert bins.agg(F.sum("size")).first()[0] == 1000 and summaries is not None


def test_short_pool_repeats_rows(spark):
    got = S.stratified_sample(make(spark, {"A": 50, "rare": 2}), 20, "category", ["id"], ["rare"], 5)
    rare = got.filter("category = 'rare'")
    assert rare.count() == 5 and rare.select("id").distinct().count() <= 2 and rare.select("draw").distinct().count() == 5


def test_one_hot_stratum_and_shuffled_input(spark):
    df = make(spark, {"hot": 6000, "A": 200, "B": 100})
    a = S.stratified_sample(df, 500, "category", ["id"])
    b = S.stratified_sample(df.repartition(17), 500, "category", ["id"])
    assert a.select("id").exceptAll(b.select("id")).isEmpty() and a.count() == b.count() == 500
    assert a.select("id").distinct().count() == 500


def test_runs_are_disjoint_and_complete(spark):
    df = make(spark, {"A": 700, "B": 303})
    sliced = S.disjoint_slices(df, 5, ["id"])
    sizes = {r["run"]: r["count"] for r in sliced.groupBy("run").count().collect()}
    assert sizes == {0: 200, 1: 200, 2: 200, 3: 200, 4: 203}
    assert sliced.select("id").distinct().count() == 1003
    runs = S.disjoint_runs(df, 5, 50, "category", ["id"])
    assert S.run_overlaps(runs, ["id"]).isEmpty()
    assert {r["count"] for r in runs.groupBy("run").count().collect()} == {50}


def test_folds_differ_by_at_most_one(spark):
    df = make(spark, {"A": 103, "B": 57, "C": 4})
    folds = S.stratified_folds(df, 5, "category", ["id"])
    per = folds.groupBy("fold").count().collect()
    assert {r["fold"] for r in per} == {0, 1, 2, 3}  # smallest class has 4 rows
    assert max(r["count"] for r in per) - min(r["count"] for r in per) <= 1
    for c in "ABC":
        n = [r["count"] for r in folds.filter(F.col("category") == c).groupBy("fold").count().collect()]
        assert max(n) - min(n) <= 1


def test_missing_class_is_an_error(spark):
    with pytest.raises(ValueError):
        S.sample_by_counts(make(spark, {"A": 5}), {"A": 1, "Z": 1}, "category", ["id"])


def test_prior_and_balanced_subsets(spark):
    df = make(spark, {"0": 90, "1": 30}).withColumn("y", F.col("category").cast("int"))
    got = {r["y"]: r["count"] for r in S.prior_subsample(df, 0.5, "y", ["id"]).groupBy("y").count().collect()}
    assert got == {0: 30, 1: 30}
    got = {r["y"]: r["count"] for r in S.balanced_subset(df, 100, "y", ["id"]).groupBy("y").count().collect()}
    assert got == {0: 70, 1: 30}


def test_ranks_with_a_value_holding_most_rows(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") / 7.0).otherwise(F.lit(100.0)).alias("v"))
    rows = ranking.value_ranks(df, [], "v", ["id"]).orderBy("rn").collect()
    assert [r["rn"] for r in rows] == list(range(1, 5001))
    values = [r["v"] for r in rows]
    assert values == sorted(values)
    slots = ranking.value_slots(df, [], "v", ["id"], 7).groupBy("slot").count().collect()
    assert {r["slot"]: r["count"] for r in slots} == {**{i: 714 for i in range(6)}, 6: 716}
    q = ranking.exact_quantiles(df, [], "v", [0.0, 0.1, 0.5, 1.0], ["a", "b", "c", "d"]).first()
    assert q["a"] == values[0] and q["d"] == values[-1] and q["c"] == 100.0
    at = 0.1 * 4999
    assert q["b"] == pytest.approx(values[int(at)] + (at - int(at)) * (values[int(at) + 1] - values[int(at)]))
