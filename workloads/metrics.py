"""Inventory I: classification metrics, curves, calibration, degeneracy."""

from pyspark.sql import functions as F

from tarnfold.operators import metrics as M
from workloads import tables as t
from workloads.registry import query
from workloads.tables import SCORED, SCORED_GROUPS, SCORED_LONG, SCORED_RARE, TRUTH, r, sql_hash

CELLS = """cells AS (SELECT run, model, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM models GROUP BY ALL)"""
BASE = f"WITH {SCORED_LONG}, {CELLS}"
BY = ["run", "model"]


def cells(spark, sf):
    return M.confusion(t.scored_long(spark, sf), BY)


@query("i01_confusion", f"""{BASE} SELECT *, {r('coalesce(tn / nullif(tn + fp, 0), 0)', 'tn_share')}, {r('coalesce(fp / nullif(tn + fp, 0), 0)', 'fp_share')},
  {r('coalesce(fn / nullif(fn + tp, 0), 0)', 'fn_share')}, {r('coalesce(tp / nullif(fn + tp, 0), 0)', 'tp_share')} FROM cells""")
def confusion(spark, sf):
    return M.confusion_shares(cells(spark, sf))


@query("i02_binary_rates", f"""{BASE} SELECT run, model, {r('(tp + tn) / (tn + fp + fn + tp)', 'accuracy')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')},
  {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')} FROM cells""")
def binary_rates(spark, sf):
    return M.rates(cells(spark, sf)).select(*BY, "accuracy", "precision", "recall", "f1")


@query("i02_binary_rates_labels", f"""WITH {TRUTH}, cells AS (SELECT lang, count(*) FILTER (y = 0 AND pred_a = 0) AS tn, count(*) FILTER (y = 0 AND pred_a = 1) AS fp,
  count(*) FILTER (y = 1 AND pred_a = 0) AS fn, count(*) FILTER (y = 1 AND pred_a = 1) AS tp FROM truth GROUP BY lang)
SELECT lang, tn, fp, fn, tp, {r('(tp + tn) / (tn + fp + fn + tp)', 'accuracy')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')},
  {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')},
  {r('coalesce(fp / nullif(fp + tn, 0), 0)', 'fpr')}, {r('coalesce(fn / nullif(fn + tp, 0), 0)', 'fnr')} FROM cells""")
def binary_rates_labels(spark, sf):
    return M.rates(M.confusion(t.truth(spark, sf), ["lang"], "y", "pred_a"))


@query("i03_macro_f1", f"""{BASE}, f AS (SELECT run, model, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0 FROM cells)
SELECT run, model, {r('(f0 + f1) / 2', 'macro_f1')} FROM f""")
def macro_f1(spark, sf):
    return M.macro_f1(t.scored_long(spark, sf), BY)


@query("i03_macro_f1_multiclass", f"""WITH {SCORED}, g AS (SELECT run, grp AS y, CASE WHEN prob_a >= 0.5 THEN 'view' WHEN prob_b >= 0.5 THEN 'click' ELSE 'error' END AS pred FROM scored),
c AS (SELECT run, k, count(*) FILTER (y = k AND pred = k) AS h, count(*) FILTER (y = k) AS n, count(*) FILTER (pred = k) AS p
      FROM g, (SELECT DISTINCT event_type AS k FROM events) GROUP BY ALL)
SELECT run, {r('avg(2 * h / (n + p))', 'macro_f1')} FROM c WHERE n + p > 0 GROUP BY run""")
def macro_f1_multiclass(spark, sf):
    guess = F.when(F.col("prob_a") >= 0.5, "view").when(F.col("prob_b") >= 0.5, "click").otherwise("error")
    rows = t.scored(spark, sf).select("run", F.col("grp").alias("y"), guess.alias("pred"))
    return M.macro_f1(rows, ["run"])


@query("i04_error_rates", f"{BASE} SELECT run, model, {r('coalesce(fp / nullif(fp + tn, 0), 0)', 'fpr')}, {r('coalesce(fn / nullif(fn + tp, 0), 0)', 'fnr')} FROM cells")
def error_rates(spark, sf):
    return M.rates(cells(spark, sf)).select(*BY, "fpr", "fnr")


CURVE = """pts AS (SELECT model, prob AS score, sum(y) AS pos, sum(1 - y) AS neg FROM models GROUP BY model, prob),
curve AS (SELECT model, score, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS tp, sum(neg) OVER (PARTITION BY model) AS tn
  FROM pts WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@query("i05_roc_points", f"WITH {SCORED_LONG}, {CURVE} SELECT model, {r('score', 'score')}, {r('cn / tn', 'fpr')}, {r('cp / tp', 'tpr')} FROM curve")
def roc_points(spark, sf):
    return M.roc_points(t.scored_long(spark, sf), ["model"], "prob")


@query("i05_roc_auc", f"WITH {SCORED_LONG}, {CURVE} SELECT model, {r('sum(neg * (cp - pos / 2)) / (max(tp) * max(tn))', 'auc')} FROM curve GROUP BY model")
def roc_auc(spark, sf):
    return M.roc_auc(t.scored_long(spark, sf), ["model"], "prob")


@query("i06_operating_points", f"""WITH {SCORED_LONG}, {CURVE}, l AS (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE]) AS lim),
z AS (SELECT model, lim, cn / tn AS fpr, cp / tp AS tpr, score, row_number() OVER (PARTITION BY model, lim ORDER BY cn DESC, cp DESC) AS k FROM curve, l WHERE cn / tn <= lim)
SELECT m.model, {r('l.lim', '"limit"')}, {r('coalesce(fpr, 0)', 'fpr')}, {r('coalesce(tpr, 0)', 'tpr')}, {r('score', 'threshold')}
FROM (SELECT DISTINCT model FROM models) m CROSS JOIN l LEFT JOIN z ON z.model = m.model AND z.lim = l.lim AND z.k = 1""")
def operating_points(spark, sf):
    return M.operating_points(t.scored_long(spark, sf), ["model"], "prob")


@query("i06_operating_corners", f"""WITH {SCORED_LONG}, {CURVE}, l AS (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE]) AS lim),
steps AS (SELECT *, row_number() OVER w AS i, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg FROM curve WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
corners AS (SELECT * FROM steps WHERE i = 1 OR next_pos IS NULL OR next_pos != pos OR next_neg != neg),
z AS (SELECT model, lim, cn / tn AS fpr, cp / tp AS tpr, score, row_number() OVER (PARTITION BY model, lim ORDER BY cn DESC, cp DESC) AS k FROM corners, l WHERE cn / tn <= lim)
SELECT m.model, {r('l.lim', '"limit"')}, {r('coalesce(fpr, 0)', 'fpr')}, {r('coalesce(tpr, 0)', 'tpr')}, {r('score', 'threshold')}
FROM (SELECT DISTINCT model FROM models) m CROSS JOIN l LEFT JOIN z ON z.model = m.model AND z.lim = l.lim AND z.k = 1""")
def operating_corners(spark, sf):
    return M.operating_points(t.scored_long(spark, sf), ["model"], "prob", corners=True)


@query("i07_pr_points", f"WITH {SCORED_LONG}, {CURVE} SELECT model, {r('score', 'score')}, {r('cp / (cp + cn)', 'precision')}, {r('cp / tp', 'recall')} FROM curve")
def pr_points(spark, sf):
    return M.pr_points(t.scored_long(spark, sf), ["model"], "prob")


AP = "sum(pos * cp / (cp + cn)) / max(tp)"


@query("i07_average_precision", f"WITH {SCORED_LONG}, {CURVE} SELECT model, {r(AP, 'ap')} FROM curve GROUP BY model")
def average_precision(spark, sf):
    return M.average_precision(t.scored_long(spark, sf), ["model"], "prob")


@query("i08_pr_baseline", f"WITH {SCORED} SELECT run, {r('avg(y)', 'baseline')} FROM scored GROUP BY run")
def pr_baseline(spark, sf):
    return M.positive_rate(t.scored(spark, sf), ["run"])


def curve_sql(source: str, by: str, target: str, score: str = "score") -> str:
    return f"""pts AS (SELECT {by}, {score} AS score, sum({target}) AS pos, sum(1 - {target}) AS neg FROM {source} GROUP BY {by}, {score}),
curve AS (SELECT *, sum(pos) OVER w AS cp, sum(pos + neg) OVER w AS ca, sum(pos) OVER (PARTITION BY {by}) AS tp FROM pts WINDOW w AS (PARTITION BY {by} ORDER BY score DESC))"""


@query("i09_group_average_precision", f"""WITH {SCORED_LONG}, g AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'absent']) AS target),
ovr AS (SELECT model, target, CASE WHEN grp = target THEN 1 ELSE 0 END AS hit, CASE WHEN target = 'view' THEN 1.0 - prob ELSE prob END AS score FROM models, g),
{curve_sql('ovr', 'model, target', 'hit')}
SELECT model, target, {r('sum(pos * cp / ca) / nullif(max(tp), 0)', 'ap')} FROM curve GROUP BY model, target""")
def group_average_precision(spark, sf):
    return M.group_average_precision(t.scored_long(spark, sf), ["model"], SCORED_GROUPS + ["absent"], "grp", "prob", "view")


@query("i10_rare_average_precision", f"""WITH {SCORED_LONG}, m AS (SELECT run, model, prob AS score, CASE WHEN grp IN ('error', 'signup') THEN 1 ELSE 0 END AS hit FROM models),
{curve_sql('m', 'run, model', 'hit')} SELECT run, model, {r('sum(pos * cp / ca) / max(tp)', 'ap')} FROM curve GROUP BY run, model""")
def rare_average_precision(spark, sf):
    rows = t.scored_long(spark, sf).withColumn("hit", F.col("grp").isin(SCORED_RARE).cast("int"))
    return M.average_precision(rows, BY, "prob", "hit")


@query("i11_group_accuracy", f"""WITH {SCORED_LONG}, g AS (SELECT unnest(['error', 'signup', 'absent']) AS grp), a AS (SELECT model, grp, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS acc FROM models GROUP BY ALL)
SELECT m.model, g.grp, coalesce(n, 0) AS n, {r('acc', 'accuracy')} FROM (SELECT DISTINCT model FROM models) m CROSS JOIN g LEFT JOIN a ON a.model = m.model AND a.grp = g.grp""")
def group_accuracy(spark, sf):
    return M.group_accuracy(t.scored_long(spark, sf), ["model"], "grp", SCORED_RARE + ["absent"])


def bins_sql(source: str, by: str, bins: int) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY prob, {sql_hash(['event_id'], 0)}, event_id) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
bins AS (SELECT {by}, least((rn - 1) // greatest(n // {bins}, 1), {bins - 1}) AS bin, avg(prob) AS confidence, avg(y) AS rate, count(*) AS size FROM ranked GROUP BY ALL)"""


@query("i12_reliability_bins", f"WITH {SCORED_LONG}, {bins_sql('models', 'run, model', 10)} SELECT run, model, CAST(bin AS BIGINT) AS bin, {r('confidence', 'confidence')}, {r('rate', 'rate')}, size FROM bins")
def reliability_bins(spark, sf):
    return M.reliability(t.scored_long(spark, sf), BY, "prob", ["event_id"]).drop("over_confident")


ECE = f"{r('sum(size * abs(rate - confidence)) / sum(size)', 'ece')}, {r('max(abs(rate - confidence))', 'mce')}"


@query("i13_calibration_error", f"WITH {SCORED_LONG}, {bins_sql('models', 'run, model', 10)} SELECT run, model, {ECE} FROM bins GROUP BY run, model")
def calibration_error(spark, sf):
    return M.calibration_error(M.reliability(t.scored_long(spark, sf), BY, "prob", ["event_id"]), BY)


@query("i13_rare_calibration_error", f"WITH {SCORED_LONG}, rare AS (SELECT * FROM models WHERE grp IN ('error', 'signup')), {bins_sql('rare', 'run, model', 5)} SELECT run, model, {ECE} FROM bins GROUP BY run, model")
def rare_calibration_error(spark, sf):
    rows = t.scored_long(spark, sf).filter(F.col("grp").isin(SCORED_RARE))
    return M.calibration_error(M.reliability(rows, BY, "prob", ["event_id"], 5), BY)


@query("i14_over_confidence", f"WITH {SCORED_LONG}, {bins_sql('models', 'model', 10)} SELECT model, CAST(bin AS BIGINT) AS bin, rate < confidence AS over_confident FROM bins")
def over_confidence(spark, sf):
    return M.reliability(t.scored_long(spark, sf), ["model"], "prob", ["event_id"]).select("model", "bin", "over_confident")


@query("i15_pooled_reliability", f"WITH {SCORED_LONG}, {bins_sql('models', 'model', 10)} SELECT model, CAST(bin AS BIGINT) AS bin, {r('confidence', 'confidence')}, {r('rate', 'rate')}, size FROM bins")
def pooled_reliability(spark, sf):
    return M.reliability(t.scored_long(spark, sf), ["model"], "prob", ["event_id"]).drop("over_confident")


DEGENERATE = """deg AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, 2 * p / (1 + p) AS f1_all_attack, tn = 0 AND fn = 0 AS is_degenerate,
  abs(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) - 2 * p / (1 + p)) AS degeneracy_distance FROM (SELECT *, (tp + fn) / greatest(tn + fp + fn + tp, 1) AS p FROM cells))"""


@query("i16_degeneracy", f"{BASE}, {DEGENERATE} SELECT run, model, {r('f1', 'f1')}, {r('f1_all_attack', 'f1_all_attack')}, is_degenerate, {r('degeneracy_distance', 'degeneracy_distance')} FROM deg")
def degeneracy(spark, sf):
    return M.degeneracy(cells(spark, sf)).select(*BY, "f1", "f1_all_attack", "is_degenerate", "degeneracy_distance")


@query("i17_escape_rule", f"""{BASE}, {DEGENERATE}, s AS (SELECT model, count(*) FILTER (NOT is_degenerate) AS n_sound, avg(f1) AS f, stddev_samp(f1) AS sd, avg(degeneracy_distance) AS d FROM deg GROUP BY model),
e AS (SELECT *, n_sound >= 3 AS escapes FROM s), b AS (SELECT model FROM e WHERE escapes ORDER BY f DESC, d DESC LIMIT 1)
SELECT e.model, n_sound, {r('f', 'f1_mean')}, {r('sd', 'f1_std')}, {r('d', 'distance_mean')}, escapes, b.model IS NOT NULL AS best FROM e LEFT JOIN b ON b.model = e.model""")
def escape_rule(spark, sf):
    return M.escape_report(M.degeneracy(cells(spark, sf)), ["model"])


@query("i18_pooled_pr_curves", f"""WITH {SCORED_LONG}, both2 AS (SELECT model, 'attack' AS target, prob AS score, y AS hit FROM models UNION ALL
  SELECT model, 'rare', prob, CASE WHEN grp IN ('error', 'signup') THEN 1 ELSE 0 END FROM models), {curve_sql('both2', 'model, target', 'hit')}
SELECT model, target, {r('score', 'score')}, {r('cp / ca', 'precision')}, {r('cp / tp', 'recall')} FROM curve""")
def pooled_pr_curves(spark, sf):
    pair = F.array(F.struct(F.lit("attack").alias("target"), F.col("y").alias("hit")),
                   F.struct(F.lit("rare").alias("target"), F.col("grp").isin(SCORED_RARE).cast("int").alias("hit")))
    rows = t.scored_long(spark, sf).select("model", "prob", F.inline(pair))
    return M.pr_points(rows, ["model", "target"], "prob", "hit")
