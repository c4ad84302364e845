"""Inventory L: data-quality suites."""

import math

from pyspark.sql import functions as F

from tarnfold.operators import checks as C
from tarnfold.operators import sampling, scaling, scoring
from workloads import tables as t
from workloads.registry import query
from workloads.sampling import LADDER, counts, drawn, pooled
from workloads.tables import FLOWS, KEY, NUMERIC, RARE, r


SCALED = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in NUMERIC)


@query("l01_sanity_suite", f"""WITH {FLOWS}, scaled AS (SELECT category, y, {SCALED} FROM flows),
s AS (SELECT min(least({', '.join(NUMERIC)})) AS low, max(greatest({', '.join(NUMERIC)})) AS high, count(*) FILTER (l_quantity IS NULL OR l_extendedprice IS NULL OR l_discount IS NULL OR l_tax IS NULL) AS holes,
  count(*) FILTER (y NOT IN (0, 1)) AS odd, min(y) AS y0, max(y) AS y1, count(*) FILTER (category IS NULL) AS no_cat, count(*) FILTER (category = 'A' AND y = 1) AS clash, count(DISTINCT category) AS cats FROM scaled)
SELECT 'feature_range' AS "check", abs(low) < 1e-9 AND abs(high - 1) < 1e-9 AS ok, {r('high', 'detail')} FROM s UNION ALL SELECT 'no_nulls_in_features', holes = 0, CAST(holes AS DOUBLE) FROM s
UNION ALL SELECT 'label_binary_valid', odd = 0 AND y0 = 0 AND y1 = 1, CAST(odd AS DOUBLE) FROM s UNION ALL SELECT 'no_nulls_in_category', no_cat = 0, CAST(no_cat AS DOUBLE) FROM s
UNION ALL SELECT 'columns_match', true, 4.0 FROM s UNION ALL SELECT 'label_consistency', clash = 0, CAST(clash AS DOUBLE) FROM s UNION ALL SELECT 'category_count', cats = 5, CAST(cats AS DOUBLE) FROM s""")
def sanity_suite(spark, sf):
    df = t.flows(spark, sf)
    scaled = scaling.minmax_columns(df, df, NUMERIC)
    return C.sanity_suite(scaled, scaled, NUMERIC, NUMERIC, "y", "category", "category", "A", 5)


@query("l02_sample_sizes", f"WITH {LADDER}, {counts('offered', group='size')}, {pooled('size', 'greatest(5, size // 20)', 'size')}, {drawn('offered', 'quotas', 42, group='size')} "
       "SELECT size, size AS expected, count(*) AS n, count(*) = size AS ok FROM sample GROUP BY size")
def sample_sizes(spark, sf):
    sizes = [100, 200, 500, 1000]
    ladder = sampling.size_ladder(t.flows(spark, sf), sizes, "category", KEY, RARE)
    return C.sample_sizes(ladder, "size", {s: s for s in sizes})


@query("l03_selection_checks")
def selection_checks(spark, sf):
    df = t.flows(spark, sf)
    scaled = scaling.minmax_columns(df, df, NUMERIC)
    scores = scoring.anova(t.flow_vectors(spark, sf), "features", "category", NUMERIC)
    return C.selection_checks(scaled, NUMERIC[:2], scores, 2)


@query("l04_angle_checks", f"""WITH {t.ALL_ANGLES}, s AS (SELECT min(x) AS low, max(x) AS high, count(DISTINCT vec_id) AS n, count(*) FILTER (x IS NULL) AS holes, (SELECT count(*) FILTER (len(v) <> 64) FROM vectors) AS odd FROM angles)
SELECT 'width' AS "check", odd = 0 AS ok, CAST(odd AS DOUBLE) AS detail FROM s UNION ALL SELECT 'range', low >= -1e-9 AND high <= {math.pi!r} + 1e-9, {r('high', 'detail')} FROM s
UNION ALL SELECT 'no_nulls', holes = 0, CAST(holes AS DOUBLE) FROM s UNION ALL SELECT 'not_empty', n > 0, CAST(n AS DOUBLE) FROM s""")
def angle_checks(spark, sf):
    return C.angle_checks(t.all_angles(spark, sf), "x", t.DIM, math.pi)


@query("l05_leaked_labels", f"WITH {FLOWS} SELECT 'y' AS \"column\", count(y) AS filled FROM flows")
def leaked_labels(spark, sf):
    """Label columns among the features, with their filled rows."""
    df = t.flows(spark, sf)
    found = C.leaked_labels(spark, df.columns, ["y", "label_binary"])
    filled = df.agg(F.count("y").alias("y")).select(F.lit("y").alias("column"), F.col("y").alias("filled"))
    return found.join(filled, "column")


@query("l06_label_agreement", f"""WITH {FLOWS} SELECT 'normal_is_zero' AS "check", count(*) = 0 AS ok, CAST(count(*) AS DOUBLE) AS detail FROM flows WHERE category = 'A' AND y <> 0
UNION ALL SELECT 'zero_is_normal', count(*) = 0, CAST(count(*) AS DOUBLE) FROM flows WHERE category <> 'A' AND y = 0""")
def label_agreement(spark, sf):
    return C.label_agreement(t.flows(spark, sf), "category", "y", "A")


@query("l06_missing_rare", f"""WITH {FLOWS} SELECT DISTINCT category FROM flows WHERE category IN ('bulk', 'heavy') AND category NOT IN (SELECT category FROM flows WHERE l_quantity < 50)""")
def missing_rare(spark, sf):
    df = t.flows(spark, sf)
    return C.missing_rare(df, df.filter(F.col("l_quantity") < 50), "category", RARE)


