"""The reduction study end to end: encode, scale, select, PCA, angles (inventory E6-E8, F5, F7, F8, F17-F21)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators import kernels, metrics, reduction, scaling, scoring, search, trainer
from tarnfold.functions.moments import per_feature, vector_summary
from tarnfold.functions.vectors import squared_distance
from tarnfold.operators.encoding import FrozenOneHot
from tarnfold.operators.scaling import ANGLE_MAX
from tarnfold.plans import studies
from tarnfold.session import bounded


@dataclass
class FittedReduction:
    """select -> PCA -> [0, pi], everything fitted on train."""

    positions: list
    pca: reduction.CenteredPca
    angles: scaling.Scaler
    names: list = field(default_factory=list)

    def to_scores(self, df: DataFrame, vector: str = "features", out: str = "scores") -> DataFrame:
        """Up to PCA only: the input of noise injection and of the standardized branch."""
        kept = scoring.keep_positions(df, vector, self.positions, "_kept")
        return self.pca.transform(kept, "_kept", out).drop("_kept")

    def to_angles(self, df: DataFrame, vector: str = "features", out: str = "angles", clipped: bool = True) -> DataFrame:
        return self.angles.apply(self.to_scores(df, vector, out), out, out, clipped)


def fit_reduction(train: DataFrame, names, label: str, k: int, n: int, vector: str = "features") -> FittedReduction:
    scores = scoring.anova(train, vector, label, names, pvalues=False)
    positions = scoring.selected_positions(scores, min(k, len(names)))
    kept = scoring.keep_positions(train, vector, positions, "_kept")
    pca = reduction.fit_pca(kept, "_kept", n)
    angles = scaling.fit_minmax(pca.transform(kept, "_kept", "_scores"), "_scores", 0.0, ANGLE_MAX)
    return FittedReduction(positions, pca, angles, [names[i] for i in positions])


def encode(train: DataFrame, test: DataFrame, numeric, categorical):
    """One-hot and min-max fitted on train; test is clipped to the train range."""
    onehot = FrozenOneHot.fit(train, numeric, categorical)
    a, b = onehot.transform(train), onehot.transform(test)
    scaler = scaling.fit_minmax(a, "features")
    return scaler.apply(a, "features", clipped=False), scaler.apply(b, "features"), onehot, scaler


def k_search(cv_rows: DataFrame, names, label: str, ks, fold: str, folds: int, vector: str = "features", max_iter: int = 300) -> DataFrame:
    """Mean and std of macro-F1 over folds for every K; features are ranked on the training folds only. All K and folds are fitted together."""
    rows = trainer.study_rows(cv_rows.filter(F.col(fold) < folds), vector, label, fold)
    return studies.cv_means(studies.k_scores(rows, [k for k in ks if k <= len(names)], most=max_iter), ["k"])


def ablation(cv_rows: DataFrame, names, label: str, k: int, n: int, fold: str, folds: int, vector: str = "features", max_iter: int = 300) -> DataFrame:
    """Five pipelines: all features, PCA to 95 %, top K, PCA to n, top K then PCA to n. All pipelines and folds are fitted together."""
    rows = trainer.study_rows(cv_rows.filter(F.col(fold) < folds), vector, label, fold)
    return studies.cv_means(studies.ablation_scores(rows, min(k, len(names)), n, most=max_iter), ["setting"])


def component_metrics(train: DataFrame, vector: str, label: str, n_values, reps: int = 2) -> DataFrame:
    """V, S, DBI and Q for every n. One PCA serves all n, because its first n axes are the n-axis solution: Fisher scores
    and Davies-Bouldin distances of every n come from one pass each."""
    spark = train.sparkSession
    dim = len(vector_summary(train, vector).first()["mean"])
    n_values = [n for n in n_values if n <= dim]
    top = max(n_values)
    pca = reduction.fit_pca(train, vector, top)
    scored = pca.transform(train, vector, "scores").select(label, "scores")
    names = [f"pc{i}" for i in range(top)]
    table = vector_summary(scored, "scores", [label])
    moments = per_feature(table, [label, "n"], ["mean", "var_pop"], names)
    fisher = {r["pos"]: r["fisher"] for r in scoring.fisher_from_moments(moments, label).collect()}  # one row per component
    dbi = {r["n"]: r["davies_bouldin"] for r in scoring.davies_bouldin(scored, "scores", label, n_values).collect()}
    rows = [(n, float(sum(pca.ratio[:n])), sum(fisher[i] for i in range(n)) / n, dbi[n]) for n in n_values]
    out = spark.createDataFrame(rows, "n int, v_n double, s_n double, dbi double")
    return out.withColumn("q_n", search.gate_cost(F.col("n"), reps))


def pareto_choice(metrics: DataFrame, threshold: float = 0.85, steps: int = 30) -> DataFrame:
    """Gate, normalize, search the weights, score, front, status: the table the choice of n is read from."""
    norm = search.normalize_metrics(metrics).withColumn("passes", F.col("v_n") >= threshold)
    candidates = search.variance_gate(norm, threshold)
    weights = search.best_weights(search.weight_search(candidates, steps))
    scored = search.choose(candidates, weights)
    front = search.pareto_front(scored)
    rejected = norm.filter(~F.col("passes")).withColumn("f_n", F.lit(None).cast("double")).withColumn("chosen", F.lit(False))
    return search.candidate_report(scored.unionByName(rejected), front)


def objective_intervals(train: DataFrame, vector: str, label: str, key, candidates: DataFrame, weights: dict, s_min: float,
                        s_span: float, replicates: int = 200, draws: int = 5000, seed: int = 42) -> DataFrame:
    """Bootstrap mean, std and interval of F(n): resampled class moments of all components in one grouped aggregate."""
    top = candidates.agg(F.max("n")).first()[0]
    pca = reduction.fit_pca(train, vector, top)
    scored = pca.transform(train, vector, "scores").select(*key, label, "scores")
    drawn = search.bootstrap_rows(scored, key, replicates, draws, seed).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    table = vector_summary(drawn, "scores", ["replicate", label])
    moments = per_feature(table, ["replicate", label, "n"], ["mean", "var_pop"], [f"pc{i}" for i in range(top)])
    fisher = scoring.fisher_from_moments(moments, label, ["replicate"])
    cand = [(r["n"], r["v_n"], r["q_n"]) for r in candidates.select("n", "v_n", "q_n").collect()]
    cells = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(v).alias("v_n"), F.lit(q).alias("q_n")) for n, v, q in cand])
    per = fisher.select("replicate", "pos", "fisher", F.inline(cells)).filter("pos < n") \
        .groupBy("replicate", "n", "v_n", "q_n").agg(F.avg("fisher").alias("s"))
    f = F.lit(weights["alpha"]) * F.col("v_n") + F.lit(weights["beta"]) * (F.col("s") - F.lit(s_min)) / F.lit(s_span) \
        - F.lit(weights["gamma"]) * F.col("q_n")
    return search.interval(per.select("replicate", "n", f.alias("f")), "f", ["n"])


def k_degeneracy(df: DataFrame, vector: str, y: str, run: str, key: str, names, ks) -> DataFrame:
    """Small feature sets per run: (k, run) -> alignment of the linear kernel, confusion cells and degeneracy of the nearest-mean
    classifier. Each run ranks its own features; a row meets every k once, with the components beyond k set to zero, so all
    sets and runs go through one plan."""
    ks = sorted({int(k) for k in ks if k <= len(names)})
    scores = scoring.anova(df, vector, y, names, [run], pvalues=False)
    order = scoring.top_k(scores, ks[-1], by=[run]).groupBy(run).agg(F.sort_array(F.collect_list(F.struct("rank", "pos"))).alias("_o"))
    order = order.select(run, F.transform("_o", lambda z: z["pos"]).alias("_order"))
    rows = df.select(run, key, F.col(y).alias("y"), F.col(vector).cast("array<double>").alias("_v")).join(bounded(order), run)
    picked = rows.withColumn("_x", F.expr("transform(_order, p -> _v[p])")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    picked = picked.select("k", run, key, "y", F.expr("transform(_x, (v, i) -> if(i < k, v, 0.0D))").alias("x"))
    alignment = kernels.map_statistics(picked, "x", ks[-1], "y", ["k", run]).select("k", run, "alignment")
    means = vector_summary(picked, "x", ["k", run, "y"]).groupBy("k", run).agg(
        F.max(F.when(F.col("y") == 0, F.col("mean"))).alias("_m0"), F.max(F.when(F.col("y") == 1, F.col("mean"))).alias("_m1"))
    nearest = picked.join(bounded(means), ["k", run])
    pred = F.coalesce((squared_distance(F.col("x"), F.col("_m1")) < squared_distance(F.col("x"), F.col("_m0"))).cast("int"), F.when(F.col("_m0").isNull(), 1).otherwise(0))
    cells = metrics.confusion(nearest.withColumn("pred", pred), ["k", run])
    return metrics.degeneracy(cells).join(alignment, ["k", run])


def k_degeneracy_summary(table: DataFrame) -> DataFrame:
    """Mean and standard deviation over runs for every k, and how many runs are degenerate."""
    return table.groupBy("k").agg(F.avg("alignment").alias("alignment_mean"), F.stddev_samp("alignment").alias("alignment_std"), F.avg("f1").alias("f1_mean"),
                                  F.stddev_samp("f1").alias("f1_std"), F.count_if("is_degenerate").alias("n_degenerate"))
