"""Inventory D: exact samples, splits, runs and folds. The portable hash lets SQL name the very rows that must be drawn."""

from pyspark.sql import functions as F

from tarnfold.operators import sampling as S
from workloads import tables as t
from workloads.registry import query, table
from workloads.tables import FLOWS, KEY, RARE, sql_hash, sql_rank

K = ", ".join(KEY)


def lrm(name: str, source: str, total: str, one: bool = True, weight: str = "n", stratum: str = "category", group: str = "") -> str:
    """Largest-remainder quotas as SQL: every column of ``source`` plus quota."""
    part = f"PARTITION BY {group}" if group else ""
    each = f"CASE WHEN tot >= k AND {weight} > 0 THEN 1 ELSE 0 END" if one else "0"
    return f"""{name}_a AS (SELECT *, {total} AS tot, sum(CASE WHEN {weight} > 0 THEN 1 ELSE 0 END) OVER ({part}) AS k,
  sum({weight}) OVER ({part}) AS sw FROM {source}),
{name}_b AS (SELECT *, {each} AS e FROM {name}_a),
{name}_c AS (SELECT *, tot - sum(e) OVER ({part}) AS rest FROM {name}_b),
{name}_d AS (SELECT *, coalesce(CAST({weight} * rest AS DOUBLE) / nullif(CAST(sw AS DOUBLE), 0), 0) AS raw FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN {weight} > 0 THEN raw - floor(raw) ELSE -1 END AS fr, rest - sum(floor(raw)) OVER ({part}) AS short FROM {name}_d),
{name} AS (SELECT {group + ', ' if group else ''}{stratum}, n, CAST(e + floor(raw) + CASE WHEN {weight} > 0 AND row_number() OVER ({part} ORDER BY fr DESC, {stratum}) <= short
  THEN 1 ELSE 0 END AS BIGINT) AS quota FROM {name}_e)"""


def drawn(source: str, quotas: str, seed: int, name: str = "sample", stratum: str = "category", key: str = K, group: str = "",
          keys=None) -> str:
    """The drawn rows as SQL: plain ranks up to the quota, or slots over a short pool."""
    by = f"{group}, {stratum}" if group else stratum
    groups = [group] if group else []
    keys = keys or KEY
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {sql_hash(groups + keys, seed)}, {key}) AS rn FROM {source}),
{name}_q AS (SELECT *, row_number() OVER ({'PARTITION BY ' + group if group else ''} ORDER BY {stratum}) AS ord FROM {quotas} WHERE quota > 0),
{name}_s AS (SELECT {by}, slot, {sql_rank(groups + ['ord', 'slot'], 'n', seed)} AS rn
  FROM (SELECT *, unnest(range(1, quota + 1)) AS slot FROM {name}_q WHERE quota > n)),
{name} AS (SELECT r.*, 1 AS draw FROM {name}_r r JOIN {name}_q q USING ({by}) WHERE q.quota <= q.n AND r.rn <= q.quota
  UNION ALL SELECT r.*, s.slot FROM {name}_r r JOIN {name}_s s USING ({by}, rn))"""


def counts(source: str = "flows", stratum: str = "category", group: str = "") -> str:
    by = f"{group}, {stratum}" if group else stratum
    return f"counts AS (SELECT {by}, count(*) AS n FROM {source} GROUP BY ALL)"


IS_RARE = "category IN ('bulk', 'heavy')"


def pooled(n, m, group: str = "") -> str:
    """Quotas of the pooled mode as SQL."""
    part = f"PARTITION BY {group}" if group else ""
    cols = f"{group + ', ' if group else ''}category, n"
    return (f"flagged AS (SELECT *, least({n}, {m} * sum(CASE WHEN {IS_RARE} THEN 1 ELSE 0 END) OVER ({part})) AS budget FROM counts),\n"
            f"rare_in AS (SELECT * FROM flagged WHERE {IS_RARE}), other_in AS (SELECT * FROM flagged WHERE NOT {IS_RARE}),\n"
            + lrm("rare_q", "rare_in", "budget", group=group) + ",\n" + lrm("other_q", "other_in", f"{n} - budget", group=group) + ",\n"
            + f"quotas AS (SELECT {cols}, quota FROM rare_q UNION ALL SELECT {cols}, quota FROM other_q)")


POOLED_SAMPLE = ",\n".join([FLOWS, counts(), pooled(1000, 50), drawn("flows", "quotas", 42)])


@query("d01_largest_remainder", f"WITH {FLOWS}, {counts()}, {lrm('q', 'counts', '1001')} SELECT category, n, quota FROM q")
def largest_remainder(spark, sf):
    return S.allocate(S.stratum_counts(t.flows(spark, sf), "category"), 1001, "category")


@query("d02_rare_aware_sample", f"WITH {POOLED_SAMPLE} SELECT {K}, category, draw FROM sample")
def rare_aware_sample(spark, sf):
    return S.stratified_sample(t.flows(spark, sf), 1000, "category", KEY, RARE, 50, "pooled", 42).select(*KEY, "category", "draw")


# per-category floor quotas: m for each rare group, floor of the share for the others, what is missing by spare rows
FLOOR_QUOTAS = f"""flagged AS (SELECT *, {IS_RARE} AS rare FROM counts),
based AS (SELECT category, n, CASE WHEN rare THEN 30 ELSE
  least(greatest(floor(n * 940 / CAST(sum(n) OVER (PARTITION BY rare) AS DOUBLE)), 1), n) END AS base FROM flagged),
spared AS (SELECT category, n, CAST(base AS BIGINT) AS base, greatest(n - base, 0) AS spare, 1000 - sum(base) OVER () AS miss FROM based)"""


@query("d03_floor_sample", f"""WITH {FLOWS}, {counts()}, {FLOOR_QUOTAS}, {lrm('extra', 'spared', 'miss', False, 'spare')},
quotas AS (SELECT category, s.n, base + quota AS quota FROM spared s JOIN extra USING (category)), {drawn('flows', 'quotas', 42)}
SELECT {K}, category, draw FROM sample""")
def floor_sample(spark, sf):
    return S.stratified_sample(t.flows(spark, sf), 1000, "category", KEY, RARE, 30, "floor", 42).select(*KEY, "category", "draw")


@query("d04_balanced_remainder_sample", f"""WITH {FLOWS}, {counts()}, other_in AS (SELECT * FROM counts WHERE NOT {IS_RARE}),
{lrm('other_q', 'other_in', '941', False)},
quotas AS (SELECT category, n, quota FROM other_q UNION ALL SELECT category, n, 30 FROM counts WHERE {IS_RARE}), {drawn('flows', 'quotas', 42)}
SELECT {K}, category, draw FROM sample""")
def balanced_remainder_sample(spark, sf):
    return S.stratified_sample(t.flows(spark, sf), 1001, "category", KEY, RARE, 30, "lrm_balanced", 42).select(*KEY, "category", "draw")




@query("d05_draw_with_replacement", f"""WITH p AS (SELECT p_partkey, p_type AS category FROM part), {counts('p')},
quotas AS (SELECT category, n, 500 AS quota FROM counts), {drawn('p', 'quotas', 7, key='p_partkey', keys=['p_partkey'])}
SELECT p_partkey, category, draw FROM sample""")
def draw_with_replacement(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"))
    quotas = S.stratum_counts(p, "category").withColumn("quota", F.lit(500).cast("long"))
    return S.draw(p, quotas, "category", ["p_partkey"], 7)


def cv_sql(n: int, cap: str) -> str:
    return f"""{FLOWS}, pool AS (SELECT *, CASE WHEN {IS_RARE} THEN '' ELSE category END AS stratum FROM flows),
{counts('pool', 'stratum')}, taken AS (SELECT *, coalesce(max(CASE WHEN stratum = '' THEN least(n, {cap}) END) OVER (), 0) AS rare_take FROM counts),
other_in AS (SELECT * FROM taken WHERE stratum <> ''), {lrm('other_q', 'other_in', f'{n} - rare_take', False, stratum='stratum')},
quotas AS (SELECT stratum, n, least(quota, n) AS quota FROM other_q UNION ALL SELECT stratum, n, rare_take FROM taken WHERE stratum = ''),
{drawn('pool', 'quotas', 42, stratum='stratum')}"""


@query("d06_cv_subset", f"WITH {cv_sql(5000, '5000')} SELECT {K}, category FROM sample")
def cv_subset(spark, sf):
    return S.cv_subset(t.flows(spark, sf), 5000, "category", KEY, RARE).select(*KEY, "category")


@query("d07_cv_subset_capped", f"WITH {cv_sql(3000, '1200')} SELECT {K}, category FROM sample")
def cv_subset_capped(spark, sf):
    return S.cv_subset(t.flows(spark, sf), 3000, "category", KEY, RARE, 0.4).select(*KEY, "category")


def class_sql(case: str, stratum: str = "y", seed: int = 42, source: str = "flows") -> str:
    return f"{FLOWS}, {counts(source, stratum)}, quotas AS (SELECT *, {case} AS quota FROM counts), {drawn(source, 'quotas', seed, stratum=stratum)}"


@query("d08_balanced_binary", f"WITH {class_sql('500')} SELECT {K}, y, draw FROM sample")
def balanced_binary(spark, sf):
    return S.balanced_sample(t.flows(spark, sf), 1000, "y", KEY).select(*KEY, "y", "draw")


@query("d09_exact_binary_counts", f"WITH {class_sql('CASE WHEN y = 1 THEN 700 ELSE 300 END')} SELECT {K}, y, draw FROM sample")
def exact_binary_counts(spark, sf):
    return S.binary_counts_sample(t.flows(spark, sf), 300, 700, "y", KEY).select(*KEY, "y", "draw")


@query("d10_exact_category_counts", f"WITH {class_sql('CASE category WHEN $$A$$ THEN 150 WHEN $$bulk$$ THEN 80 ELSE 0 END', 'category')} SELECT {K}, category, draw FROM sample")
def exact_category_counts(spark, sf):
    return S.sample_by_counts(t.flows(spark, sf), {"A": 150, "bulk": 80}, "category", KEY).select(*KEY, "category", "draw")


@query("d11_prior_subsample", f"""WITH {FLOWS}, {counts('flows', 'y')},
size AS (SELECT *, floor(least(max(CASE WHEN y = 0 THEN n END) OVER () / (1.0::DOUBLE - 0.9::DOUBLE), max(CASE WHEN y = 1 THEN n END) OVER () / 0.9::DOUBLE)) AS total FROM counts),
quotas AS (SELECT y, n, CAST(least(CASE WHEN y = 0 THEN round_even(total * (1.0::DOUBLE - 0.9::DOUBLE), 0) ELSE total - round_even(total * (1.0::DOUBLE - 0.9::DOUBLE), 0) END, n) AS BIGINT) AS quota FROM size),
{drawn('flows', 'quotas', 42, stratum='y')}
SELECT y, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM sample GROUP BY y""")
def prior_subsample(spark, sf):
    out = S.prior_subsample(t.flows(spark, sf), 0.9, "y", KEY)
    return out.groupBy("y").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"))


@query("d12_stratified_split", f"WITH {FLOWS}, {counts('flows', 'y')}, {lrm('quotas', 'counts', '301', False, stratum='y')}, {drawn('flows', 'quotas', 42, stratum='y')} SELECT {K}, y FROM sample")
def stratified_split(spark, sf):
    return S.stratified_split(t.flows(spark, sf), 301, "y", KEY).select(*KEY, "y")


SLICED = f"""{FLOWS}, shuffled AS (SELECT * EXCLUDE (run), row_number() OVER (ORDER BY {sql_hash(KEY, 0)}, {K}) AS pos, count(*) OVER () AS total FROM flows),
sliced AS (SELECT *, least((pos - 1) // (total // 5), 4) AS run FROM shuffled)"""


@query("d13_disjoint_runs", f"WITH {SLICED}, {counts('sliced', group='run')}, {pooled(100, 5, 'run')}, {drawn('sliced', 'quotas', 0, group='run')} SELECT run, {K}, category, draw FROM sample")
def disjoint_runs(spark, sf):
    df = t.flows(spark, sf).drop("run")
    return S.disjoint_runs(df, 5, 100, "category", KEY, RARE, 5).select("run", *KEY, "category", "draw")


SEEDED = f"{FLOWS}, offered AS (SELECT * EXCLUDE (run), unnest(range(0, 5)) AS run FROM flows)"


@query("d14_seeded_runs", f"WITH {SEEDED}, {counts('offered', group='run')}, {pooled(200, 10, 'run')}, {drawn('offered', 'quotas', 3, group='run')} SELECT run, {K}, category, draw FROM sample")
def seeded_runs(spark, sf):
    df = t.flows(spark, sf).drop("run")
    return S.seeded_runs(df, 5, 200, "category", KEY, RARE, 10, seed=3).select("run", *KEY, "category", "draw")


@query("d15_run_overlaps", f"WITH {SEEDED}, {counts('offered', group='run')}, {pooled(2000, 100, 'run')}, {drawn('offered', 'quotas', 3, group='run')} "
       f"SELECT {K}, count(DISTINCT run) AS n_runs FROM sample GROUP BY {K} HAVING count(DISTINCT run) > 1")
def run_overlaps(spark, sf):
    df = t.flows(spark, sf).drop("run")
    return S.run_overlaps(S.seeded_runs(df, 5, 2000, "category", KEY, RARE, 100, seed=3), KEY)


@query("d16_stratified_folds", f"""WITH {FLOWS}, {counts()}, plan AS (SELECT category, least(5, min(n) OVER ()) AS k, coalesce(sum(n) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM counts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {sql_hash(KEY, 42)}, {K}) AS rn FROM flows)
SELECT CAST((rn - 1 + shift) % k AS BIGINT) AS fold, category, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM ranked JOIN plan USING (category) GROUP BY ALL""")
def stratified_folds(spark, sf):
    folds = S.stratified_folds(t.flows(spark, sf), 5, "category", KEY)
    return folds.groupBy("fold", "category").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"))


LADDER = f"{FLOWS}, offered AS (SELECT *, unnest([100, 200, 500, 1000]) AS size FROM flows)"


@query("d17_size_ladder", f"WITH {LADDER}, {counts('offered', group='size')}, {pooled('size', 'greatest(5, size // 20)', 'size')}, {drawn('offered', 'quotas', 42, group='size')} SELECT size, {K}, category, draw FROM sample")
def size_ladder(spark, sf):
    return S.size_ladder(t.flows(spark, sf), [100, 200, 500, 1000], "category", KEY, RARE).select("size", *KEY, "category", "draw")


@query("d18_balanced_subset", f"WITH {class_sql('least(n, 100)')} SELECT {K}, y FROM sample")
def balanced_subset(spark, sf):
    return S.balanced_subset(t.flows(spark, sf), 200, "y", KEY).select(*KEY, "y")


