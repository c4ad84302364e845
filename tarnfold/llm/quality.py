"""Quality classifier: a sparse rule ensemble (operator 2).

Statistics of each text are Spark columns. Spark ML grows shallow trees on them; every path from a root to a node is a rule,
a conjunction of bounds on statistics. A lasso logistic regression weighs the rules, most get weight zero, and those that
stay are compiled back into one Spark column expression, so scoring runs without Python.

Learning reads all labelled rows of the training folds, no sample. An id labelled more than once counts as the majority of its
labels (a tie: 1). Null labels are skipped. Without labelled rows every score is 0.5; with one class only, that class.
Null and empty texts have statistics zero and are scored like any other. Each row keeps its own row; extra columns of
``docs`` or ``labels`` are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import WORD_BREAK, fold_of, keep, table

FEATURES = ["words", "word_length", "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "distinct", "echoes", "line_length", "line_repeats"]


def statistics(docs: DataFrame, text_col: str = "text", keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """``keep_cols`` of each row, and its statistics as columns named like ``FEATURES``: shares of characters, words or lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keep_cols, text.alias("_text")) \
        .withColumns({"_w": F.filter(F.split("_text", WORD_BREAK), lambda w: w != ""), "_l": F.filter(F.split("_text", "\n"), lambda x: x != ""), "_n": F.length("_text")})
    n, w, lines = F.greatest(F.col("_n"), F.lit(1)), F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.size("_l"), F.lit(1))

    def many(pattern):
        return F.size(F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))) / n

    def sign(c):
        return (F.col("_n") - F.length(F.replace("_text", F.lit(c), F.lit("")))) / n

    echo = F.zip_with("_w", F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    values = {
        "words": F.log1p(F.size("_w")), "word_length": F.col("_n") / w, "upper": many("[A-ZÀ-ÖØ-Þ]"), "digits": many("[0-9]"), "symbols": many("[#$%&*=<>{}~^_]"),
        "bars": sign("|"), "bangs": sign("!"), "stops": sign("."), "commas": sign(","), "distinct": F.size(F.array_distinct("_w")) / F.sqrt(w),
        "echoes": F.size(F.filter(echo, lambda x: x)) / w, "line_length": F.log1p(F.col("_n") / lines), "line_repeats": 1 - F.size(F.array_distinct("_l")) / lines}
    return rows.select(*keep_cols, *[values[k].cast("double").alias(k) for k in FEATURES])


def _bound(feature: str, op: str, value: float) -> Column:
    return F.col(feature) <= F.lit(value) if op == "<=" else F.col(feature) > F.lit(value)


def tree_rules(model) -> list[tuple]:
    """Distinct rules of a forest: tuples of (feature, op, value), the tightest bound of each kind, in a fixed order."""
    rules = {}
    for tree in model.trees:
        path = []
        for line in tree.toDebugString.splitlines():
            found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
            if found:
                depth = len(found[1])
                path = [x for x in path if x[0] < depth] + [(depth, FEATURES[int(found[2])], found[3], float(found[4]))]
                tight = {}
                for _, f, op, v in path:
                    tight[f, op] = v if (f, op) not in tight else (min if op == "<=" else max)(tight[f, op], v)
                rules[tuple(sorted((f, op, v) for (f, op), v in tight.items()))] = True
    return sorted(rules)


def _fires(rule: tuple) -> Column:
    out = F.lit(True)
    for f, op, v in rule:
        out = out & _bound(f, op, v)
    return out.cast("double")


class RuleEnsemble:
    """Weighted rules; ``score`` is a column over the statistics."""

    def __init__(self, bias: float, weights: dict[tuple, float]):
        self.bias, self.weights = bias, weights

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.weights.items():
            total = total + F.lit(weight) * _fires(rule)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(rows: DataFrame, label: str, trees: int = 20, depth: int = 3, penalty: float = 2e-3, seed: int = 7) -> RuleEnsemble:
    """Fit on rows of statistics with a 0/1 label."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if len(counts) < 2:
        return RuleEnsemble(0.0 if not counts else 20.0 if 1 in counts else -20.0, {})
    staged = rows.select(array_to_vector(F.array(*FEATURES)).alias("x"), F.col(label).cast("double").alias("y"), *FEATURES)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=3, subsamplingRate=0.7,
                                    featureSubsetStrategy="0.5", seed=seed).fit(staged)
    rules = tree_rules(forest)
    if not rules:
        share = counts.get(1, 0) / sum(counts.values())
        return RuleEnsemble(_logit(share), {})
    fired = keep(staged.select(array_to_vector(F.array(*[_fires(r) for r in rules])).alias("x"), "y"))
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(fired)
    return RuleEnsemble(float(lasso.intercept), {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-6})


def _logit(share: float) -> float:
    from math import log
    return log(share / (1 - share))


def train_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **settings) -> RuleEnsemble:
    """Learn from the labelled rows whose fold (crc32 of the id, modulo 5) is not 0. ``stats``: statistics with the id; texts are
    never shuffled to meet their labels."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")) \
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    train = stats.filter(fold_of(id_col) != 0).join(known, F.col(id_col) == F.col("_id"))
    return fit_rules(keep(train.select("_y", *FEATURES)), "_y", **settings)


def score_quality(stats: DataFrame, model: RuleEnsemble, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score) for every row of statistics."""
    return stats.select(id_col, (fold_of(id_col) == 0).alias("held_out"), model.score().alias("score"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more."""
    model = train_quality(statistics(docs.filter(fold_of(id_col) != 0), text_col, (id_col,)), labels, id_col)
    # docs stay in one column, so that none of theirs can clash with the statistics
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_t"))
    return statistics(packed, "_t", ("_row",)).filter(model.score() >= least).select("_row.*")


def op2_rule_ensemble(spark, sf_dir):
    stats = keep(statistics(table(spark, sf_dir, "documents"), keep_cols=("doc_id",)))
    scored = score_quality(stats, train_quality(stats, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES, ORACLES = {"op2_rule_ensemble": op2_rule_ensemble}, {}
