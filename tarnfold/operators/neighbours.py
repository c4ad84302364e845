"""Mutual information of a numeric column with a class from nearest-neighbour distances (inventory F3).

For a row of class c the radius is the distance to its k-th neighbour of the same class; m counts rows of any class within it.
The estimate is psi(N) + mean psi(k) - mean psi(N_c) - mean psi(m), at least 0. All columns share one plan, however many there are:

* Rows become (column, value, class, count) by a partial aggregate, so that repeated values cost nothing further.
* Values are cut into ranges. A range needs the k nearest values beyond its borders; each range hands out its k outermost ones (halo rows).
* The radius is a minimum over k + 1 windows of neighbours, the count a difference of two running sums along the ranges.

Rows whose value or class is null or whose value is not finite take no part, nor does a class of one row. A class of fewer than k + 1
rows uses all its others. Where more than k rows of a class are equal the radius is 0: then k and m count equal values (the tie rule of
mixed discrete and continuous data), so no noise has to be added. A distance within a millionth of the radius counts as the radius,
which lies outside. A column without any such row has no result row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.scalars import digamma
from tarnfold.session import cut_lineage, parts_of

#: Part of a radius that counts as inside.
INSIDE = 1.0 - 1e-6


def _value_counts(df: DataFrame, columns, label: str) -> DataFrame:
    """(pos, cls, x, c, n_class): rows of each value and class, of classes of two rows or more."""
    cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("pos", "x")
    counts = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("cls"), cells) \
        .filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))) \
        .groupBy("pos", "cls", (F.col("x") + 0.0).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    counts = cut_lineage(counts)
    sizes = counts.groupBy("pos", "cls").agg(F.sum("c").alias("n_class")).filter("n_class > 1")
    return counts.join(sizes, ["pos", "cls"])


def _ranges(values: DataFrame, parts: int):
    """A function (pos, x) -> number of the value range; borders are ``parts - 1`` doubles a column."""
    probs = [i / parts for i in range(1, parts)]
    rows = values.groupBy("pos").agg(F.percentile_approx("x", probs, 20 * parts).alias("at")).collect() if parts > 1 else []
    borders = {r["pos"]: np.unique(np.array(r["at"], float)) for r in rows}

    @F.pandas_udf("int")
    def number(pos: pd.Series, x: pd.Series) -> pd.Series:
        out, which, at = np.zeros(len(x), np.int32), pos.to_numpy(), x.to_numpy()
        for p in np.unique(which):
            own = which == p
            out[own] = np.searchsorted(borders.get(p, np.zeros(0)), at[own], side="right")
        return pd.Series(out)

    return number


def neighbour_radii(values: DataFrame, number, k: int) -> DataFrame:
    """``values`` with ``radius``, the distance to the k-th neighbour of the class."""
    part, keys = Window.partitionBy("pos", "cls", "range"), ["pos", "cls", "range"]
    rows = values.withColumn("range", number("pos", "x")) \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("c"), F.lit(k)).cast("int"))))
    rows = cut_lineage(rows.withColumns({"up": F.row_number().over(part.orderBy("x", "copy")),
                                         "down": F.row_number().over(part.orderBy(F.desc("x"), F.desc("copy")))}))
    edges = rows.filter((F.col("up") <= k) | (F.col("down") <= k)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("up") <= k, F.col("x")))).alias("low"),
        F.sort_array(F.collect_list(F.when(F.col("down") <= k, F.col("x")))).alias("high"))
    along, none = Window.partitionBy("pos", "cls").orderBy("range"), F.array().cast("array<double>")
    before = F.concat(*[F.coalesce(F.lag("high", j).over(along), none) for j in range(k, 0, -1)])
    after = F.concat(*[F.coalesce(F.lead("low", j).over(along), none) for j in range(1, k + 1)])
    halo = edges.select(*keys, before.alias("before"), after.alias("after")).select(
        *keys, F.explode(F.concat(F.expr(f"slice(before, greatest(1, size(before) - {k - 1}), {k})"), F.slice("after", 1, k))).alias("x"))
    both = rows.select(*keys, "x", "copy", "c", "n_class").unionByName(halo, allowMissingColumns=True)
    order = part.orderBy("x", F.col("copy").isNull(), "copy")
    gap = {-j: F.col("x") - F.lag("x", j).over(order) for j in range(1, k + 1)} | {j: F.lead("x", j).over(order) - F.col("x") for j in range(1, k + 1)}
    near = both.withColumns({f"g{j}" if j > 0 else f"h{-j}": g for j, g in gap.items()}).filter("copy = 1")

    def window(below):
        sides = ([F.col(f"h{below}")] if below else []) + ([F.col(f"g{k - below}")] if below < k else [])
        return sides[0] if len(sides) == 1 else F.when(sides[0].isNotNull() & sides[1].isNotNull(), F.greatest(*sides))

    windows = [window(b) for b in range(k + 1)]
    every = [F.coalesce(F.col(f"{s}{j}"), F.lit(0.0)) for j in range(1, k + 1) for s in "gh"]
    radius = F.when(F.col("c") > k, F.lit(0.0)).otherwise(F.coalesce(F.least(*windows), F.greatest(*every)))
    return near.select("pos", "cls", "x", "c", "n_class", radius.alias("radius"))


def counts_within(values: DataFrame, asked: DataFrame, number) -> DataFrame:
    """``asked`` (pos, cls, x, radius) with ``m``, the rows of ``values`` from ``x - radius`` to ``x + radius``."""
    points = values.select("pos", F.lit(None).cast(asked.schema["cls"].dataType).alias("cls"), F.lit(None).cast("double").alias("x"),
                           F.col("x").alias("at"), F.lit(1).alias("kind"), "c")
    ends = asked.select("pos", "cls", "x", F.inline(F.array(
        F.struct((F.col("x") - F.col("radius")).alias("at"), F.lit(0).alias("kind")),
        F.struct((F.col("x") + F.col("radius")).alias("at"), F.lit(2).alias("kind"))))).withColumn("c", F.lit(0).cast("long"))
    events = cut_lineage(points.unionByName(ends).withColumn("range", number("pos", "at")))
    sizes = events.groupBy("pos", "range").agg(F.sum("c").alias("n"))
    before = Window.partitionBy("pos").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("pos", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    inner = Window.partitionBy("pos", "range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("cum", F.sum("c").over(inner)).filter("kind != 1").join(offsets, ["pos", "range"])
    signed = (F.col("cum") + F.col("below")) * (F.col("kind") - 1)
    return found.groupBy("pos", "cls", "x").agg(F.sum(signed).alias("m"))


def neighbour_information(df: DataFrame, columns, label: str, k: int = 3, parts: int | None = None) -> DataFrame:
    """(feature, pos, n_rows, mutual_information in nats) of each of ``columns`` with the class ``label``."""
    columns = list(columns)
    values = cut_lineage(_value_counts(df, columns, label))
    number = _ranges(values, parts or parts_of(df.sparkSession))
    radii = cut_lineage(neighbour_radii(values, number, k).withColumn("radius", F.col("radius") * INSIDE))
    light = counts_within(values, radii.filter("radius > 0").select("pos", "cls", "x", "radius"), number)
    equal = F.sum("c").over(Window.partitionBy("pos", "x"))
    rows = radii.withColumn("equal", equal).join(light, ["pos", "cls", "x"], "left")
    inside = F.when(F.col("radius") > 0, F.least(F.lit(k), F.col("n_class") - 1)).otherwise(F.col("c"))
    m = F.when(F.col("radius") > 0, F.col("m")).otherwise(F.col("equal"))
    term = digamma(inside) - digamma(F.col("n_class")) - digamma(m)
    names = F.array(*[F.lit(c) for c in columns])
    return rows.groupBy("pos").agg(F.sum("c").alias("n_rows"), F.sum(F.col("c") * term).alias("s")).select(
        names[F.col("pos")].alias("feature"), "pos", "n_rows",
        F.greatest(F.lit(0.0), digamma(F.col("n_rows")) + F.col("s") / F.col("n_rows")).alias("mutual_information"))
