"""Classification metrics, ranking curves and calibration (inventory I), for any number of groups in one plan.

Scored rows: (key, y, pred, score or prob, group columns). ``by`` lists the grouping columns (model, run, setting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.scalars import ratio
from tarnfold.operators.ranking import Splits, join_groups, running_totals, value_slots


def confusion(df: DataFrame, by=(), y: str = "y", pred: str = "pred") -> DataFrame:
    def cell(t, p):
        return F.count_if((F.col(y) == t) & (F.col(pred) == p))

    return df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def confusion_shares(cells: DataFrame) -> DataFrame:
    """Row-normalized confusion: shares of the true class."""
    neg, pos = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    return cells.select("*", ratio(F.col("tn"), neg, 0).alias("tn_share"), ratio(F.col("fp"), neg, 0).alias("fp_share"),
                        ratio(F.col("fn"), pos, 0).alias("fn_share"), ratio(F.col("tp"), pos, 0).alias("tp_share"))


def rates(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, binary F1, FPR and FNR; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.select(
        "*", ratio(tp + tn, tn + fp + fn + tp, 0).alias("accuracy"), ratio(tp, tp + fp, 0).alias("precision"),
        ratio(tp, tp + fn, 0).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, 0).alias("f1"),
        ratio(fp, fp + tn, 0).alias("fpr"), ratio(fn, fn + tp, 0).alias("fnr"))


def macro_f1(df: DataFrame, by=(), y: str = "y", pred: str = "pred") -> DataFrame:
    """Mean of per-class F1 over the classes present in truth or prediction; any number of classes."""
    cells = df.groupBy(*by, y, pred).agg(F.count(F.lit(1)).alias("_c"))
    truth = cells.select(*by, F.col(y).alias("_cls"), F.col("_c").alias("_nt"), F.lit(0).cast("long").alias("_np"),
                         F.when(F.col(y) == F.col(pred), F.col("_c")).otherwise(F.lit(0)).alias("_hit"))
    guess = cells.select(*by, F.col(pred).alias("_cls"), F.lit(0).cast("long").alias("_nt"), F.col("_c").alias("_np"),
                         F.lit(0).cast("long").alias("_hit"))
    per = truth.unionByName(guess).groupBy(*by, "_cls").agg(F.sum("_nt").alias("t"), F.sum("_np").alias("p"), F.sum("_hit").alias("h"))
    return per.groupBy(*by).agg(F.avg(ratio(2 * F.col("h"), F.col("t") + F.col("p"), 0)).alias("macro_f1"))


def macro_f1_of(cells: DataFrame) -> DataFrame:
    """Macro-F1 of binary confusion cells: the mean over the classes present in truth or prediction."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    both = [ratio(2 * hit, 2 * hit + fp + fn, 0) for hit in (tn, tp)]
    present = [(hit + fp + fn > 0).cast("int") for hit in (tn, tp)]
    return cells.withColumn("macro_f1", (both[0] * present[0] + both[1] * present[1]) / (present[0] + present[1]))


def f1_score(df: DataFrame, by=(), y: str = "y", pred: str = "pred", average: str = "macro") -> DataFrame:
    if average == "macro":
        return macro_f1(df, by, y, pred).withColumnRenamed("macro_f1", "f1")
    return rates(confusion(df, by, y, pred)).select(*by, "f1")


# --- ranking curves ---------------------------------------------------------------------------------------------

def score_table(df: DataFrame, by, score: str, y: str = "y") -> DataFrame:
    """One row per (by, distinct score) with positives and negatives: what every curve is computed from."""
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(F.lit(1).cast("long") - F.col(y)).alias("neg"))


def curve_counts(df: DataFrame, by, score: str, y: str = "y", splits: Splits | None = None) -> DataFrame:
    """Cumulative positives and negatives from the highest score down."""
    splits = splits or Splits.of(df, score)
    return running_totals(score_table(df, by, score, y), by, "score", ["pos", "neg"], splits, descending=True)


def roc_points(df: DataFrame, by, score: str, y: str = "y", splits: Splits | None = None) -> DataFrame:
    cum = curve_counts(df, by, score, y, splits)
    return cum.select(*by, "score", ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
                      ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"))


def roc_auc(df: DataFrame, by, score: str, y: str = "y", splits: Splits | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half: sum of neg * (cum_pos - pos / 2) / (P N). Null with one class."""
    cum = curve_counts(df, by, score, y, splits)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return cum.groupBy(*by).agg(ratio(area, F.max("total_pos").cast("double") * F.max("total_neg").cast("double")).alias("auc"))


def corner_points(df: DataFrame, by, score: str, y: str = "y", splits: Splits | None = None) -> DataFrame:
    """The ROC points that curve libraries keep by default: the first, the last, and each point whose step differs from the next one's.

    A point goes if the next lower score adds just as many positives and as many negatives. The next score of a range's last row is the
    head of the following range that holds rows: heads are a table of groups x ranges rows, so no task sees a whole curve.
    """
    by, splits = list(by), splits or Splits.of(df, score)
    cut = splits.add_to(curve_counts(df, by, score, y, splits), "score")
    inner = Window.partitionBy(*by, "_range").orderBy(F.desc("score"))
    heads = cut.groupBy(*by, "_range").agg(F.max_by(F.struct("pos", "neg"), "score").alias("_own"))
    along = Window.partitionBy(*by).orderBy(F.desc("_range"))
    heads = heads.select(*by, "_range", F.lead("_own").over(along).alias("_head"))
    ahead = join_groups(cut.withColumn("_next", F.lead(F.struct("pos", "neg")).over(inner)), heads, [*by, "_range"])
    ahead = ahead.withColumn("_next", F.coalesce("_next", "_head"))
    first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
    return ahead.filter(first | F.col("_next").isNull() | (F.col("_next") != F.struct("pos", "neg"))).select(
        *by, "score", ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"), ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"))


def operating_points(df: DataFrame, by, score: str, limits=(0.01, 0.05), y: str = "y", splits: Splits | None = None,
                     corners: bool = False) -> DataFrame:
    """Per FPR limit, the last ROC point within it; (0, 0) when even the first point is beyond.

    All points are considered, or with ``corners`` those that curve libraries keep, which may give an earlier point.
    """
    points = (corner_points if corners else roc_points)(df, by, score, y, splits)
    cells = F.array(*[F.lit(float(v)) for v in limits])
    spread = points.withColumn("limit", F.explode(cells))
    best = F.max_by(F.when(F.col("fpr") <= F.col("limit"), F.struct("fpr", "tpr", "score")),
                    F.when(F.col("fpr") <= F.col("limit"), F.struct("fpr", "tpr")))
    return spread.groupBy(*by, "limit").agg(best.alias("b")).select(
        *by, "limit", F.coalesce("b.fpr", F.lit(0.0)).alias("fpr"), F.coalesce("b.tpr", F.lit(0.0)).alias("tpr"),
        F.col("b.score").alias("threshold"))


def pr_points(df: DataFrame, by, score: str, y: str = "y", splits: Splits | None = None) -> DataFrame:
    cum = curve_counts(df, by, score, y, splits)
    return cum.select(*by, "score", ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                      ratio(F.col("cum_pos"), F.col("total_pos")).alias("recall"))


def average_precision(df: DataFrame, by, score: str, y: str = "y", splits: Splits | None = None) -> DataFrame:
    """Sum of recall steps times precision over distinct scores. Null without positives."""
    cum = curve_counts(df, by, score, y, splits)
    step = F.col("pos") * ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return cum.groupBy(*by).agg(ratio(F.sum(step), F.max("total_pos")).alias("ap"))


def positive_rate(df: DataFrame, by=(), y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("baseline"))


def group_average_precision(df: DataFrame, by, groups, group: str, prob: str, normal: str) -> DataFrame:
    """One-vs-rest AP of each group; the normal group is scored by 1 - p.

    Rows are tabulated per (group, probability) first, so the one-vs-rest expansion works on the value table.
    """
    table = df.groupBy(*by, F.col(group).alias("_g"), F.col(prob).cast("double").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    spread = table.withColumn("target", F.explode(F.array(*[F.lit(g) for g in groups])))
    score = F.when(F.col("target") == F.lit(normal), F.lit(1.0) - F.col("_p")).otherwise(F.col("_p"))
    hit = F.coalesce((F.col("_g") == F.col("target")).cast("long"), F.lit(0)) * F.col("_c")
    scored = spread.withColumn("score", score).withColumn("_hit", hit)
    values = scored.groupBy(*by, "target", "score").agg(F.sum("_hit").alias("pos"), F.sum(F.col("_c") - F.col("_hit")).alias("neg"))
    base = Splits.of(df, prob)
    splits = Splits(sorted(base.points + [1.0 - p for p in base.points]))
    cum = running_totals(values, [*by, "target"], "score", ["pos", "neg"], splits, descending=True)
    step = F.col("pos") * ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return cum.groupBy(*by, "target").agg(ratio(F.sum(step), F.max("total_pos")).alias("ap"))


def group_accuracy(df: DataFrame, by, group: str, groups=None, y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy per group; asked-for groups without rows give null."""
    acc = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))
    if groups is None:
        return acc
    wanted = acc.select(*by).distinct() if by else df.sparkSession.range(1).select()
    wanted = wanted.select(*by, F.explode(F.array(*[F.lit(g) for g in groups])).alias(group))
    return join_groups(wanted, acc, [*by, group], "left").select(*by, group, F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


# --- calibration ------------------------------------------------------------------------------------------------

def reliability(df: DataFrame, by, prob: str, key, bins: int = 10, y: str = "y", seed: int = 0) -> DataFrame:
    """Equal-count bins by probability: max(n // bins, 1) rows each, the last one takes the rest.

    Equal probabilities follow the seeded hash of the key. Only rows of range buckets across a bin border are ranked.
    """
    rows = df.select(*by, *key, y, F.col(prob).cast("double").alias("_p"))
    binned = value_slots(rows, by, "_p", key, bins, seed, out="bin")
    return binned.groupBy(*by, "bin").agg(
        F.avg("_p").alias("confidence"), F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("size")) \
        .withColumn("over_confident", F.col("rate") < F.col("confidence"))


def calibration_error(bins: DataFrame, by=()) -> DataFrame:
    """Expected and maximum calibration error of reliability bins."""
    gap = F.abs(F.col("rate") - F.col("confidence"))
    return bins.groupBy(*by).agg((F.sum(F.col("size") * gap) / F.sum("size")).alias("ece"), F.max(gap).alias("mce"))


# --- degeneracy -------------------------------------------------------------------------------------------------

def degeneracy(cells: DataFrame) -> DataFrame:
    """Flag of models that call everything an attack (no TN, no FN), and the distance of F1 to 2p / (1 + p)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    share = ratio(tp + fn, F.greatest(tn + fp + fn + tp, F.lit(1)))
    return cells.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn, 0)) \
        .withColumn("f1_all_attack", 2.0 * share / (1.0 + share)) \
        .withColumn("is_degenerate", (tn == 0) & (fn == 0)) \
        .withColumn("degeneracy_distance", F.abs(F.col("f1") - F.col("f1_all_attack")))


def escape_report(runs: DataFrame, setting, need: int = 3) -> DataFrame:
    """Per setting: runs that are not degenerate, means, and whether it escapes; the best escaping one is flagged."""
    setting = list(setting)
    per = runs.groupBy(*setting).agg(
        F.count_if(~F.col("is_degenerate")).alias("n_sound"), F.avg("f1").alias("f1_mean"),
        F.stddev_samp("f1").alias("f1_std"), F.avg("degeneracy_distance").alias("distance_mean"))
    per = per.withColumn("escapes", F.col("n_sound") >= need)
    rank = F.when(F.col("escapes"), F.struct("f1_mean", "distance_mean"))
    best = F.max(rank).over(Window.partitionBy(F.lit(0)))
    return per.withColumn("best", F.coalesce(F.col("escapes") & (F.struct("f1_mean", "distance_mean") == best), F.lit(False)))
