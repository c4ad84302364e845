"""Inventory G: kernel statistics. SQL forms every pair; the engine never does."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnfold.functions import feature_maps as M
from tarnfold.functions.hashing import gaussian
from tarnfold.operators import blocks as B
from tarnfold.operators import kernels as G
from tarnfold.operators import sampling, scaling, search
from tarnfold.operators.ranking import value_ranks
from tarnfold.operators.resampling import Drawn, linear_kernel_intervals
from tarnfold.session import cut_lineage, settle
from workloads import tables as t
from workloads.registry import query
from workloads.tables import ANGLES, VECTORS, r, sql_gaussian, sql_hash, sql_rank

M_REF = 64

# SQL: balanced reference rows, the same draw as sampling.balanced_subset(…, 64, "y", ["vec_id"])
REF = f"""ref AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {sql_hash(['vec_id'], 42)}, vec_id) AS rn FROM {{src}}) WHERE rn <= {M_REF // 2}))"""


def reference(df):
    return settle(sampling.balanced_subset(df, M_REF, "y", ["vec_id"]), G.MAX_REFERENCE)


def reference_matrix(spark, sf):
    v = t.vectors(spark, sf)
    ref = reference(v)
    return v, ref, G.reference_rows(ref, "v", ["vec_id"], "y")


def exploded(rows, k="k"):
    """Kernel rows summed up per row: sum, sum of squares, largest value; keeps results row-sized."""
    return rows.select(
        "vec_id", F.aggregate(k, F.lit(0.0), lambda s, x: s + x).alias("total"),
        F.aggregate(k, F.lit(0.0), lambda s, x: s + x * x).alias("squares"), F.array_max(k).alias("top"))


def per_row(expr: str, ctes: str) -> str:
    return f"""WITH {ctes}, k AS (SELECT a.vec_id, {expr} AS k FROM vectors a, ref b)
SELECT vec_id, {r('sum(k)', 'total')}, {r('sum(k * k)', 'squares')}, {r('max(k)', 'top')} FROM k GROUP BY vec_id"""


VREF = VECTORS + ", " + REF.format(src="vectors")
CELLS = VECTORS + ", c AS (SELECT unnest(v) AS x FROM vectors), gamma AS (SELECT 1.0 / (64 * var_pop(x)) AS g FROM c)"


@query("g01_linear_rows", per_row("list_dot_product(a.v, b.v)", VREF))
def linear_rows(spark, sf):
    v, _, (ref, _) = reference_matrix(spark, sf)
    return exploded(G.kernel_rows(v, "v", ref, "linear"))


@query("g02_poly_rows", per_row("(list_dot_product(a.v, b.v) / 64 + 1.0) ** 2", VREF))
def poly_rows(spark, sf):
    v, _, (ref, _) = reference_matrix(spark, sf)
    return exploded(G.kernel_rows(v, "v", ref, "poly", 1.0 / 64, 1.0))


@query("g03_rbf_rows", per_row("exp(-2.0 * list_distance(a.v, b.v) ** 2)", VREF))
def rbf_rows(spark, sf):
    v, _, (ref, _) = reference_matrix(spark, sf)
    return exploded(G.kernel_rows(v, "v", ref, "rbf", 2.0))


@query("g03_rbf_fourier_map")
def rbf_fourier_map(spark, sf):
    """Whole-table RBF statistics through the approximate map."""
    a, dim = M.add_map(t.angles(spark, sf), "rbf", "x", 4, gamma=0.25, size=128)
    return G.map_statistics(a.select("y", "phi"), "phi", dim, "y")


@query("g04_gamma_scale", f"WITH {CELLS} SELECT {r('g', 'gamma')} FROM gamma")
def gamma_scale(spark, sf):
    return spark.createDataFrame([(G.scale_gamma(t.vectors(spark, sf), "v"),)], "gamma double")


NEXT = """nxt AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS pos FROM vectors)"""


def with_next(spark, sf):
    """Each row's vector next to that of the next row by key: an equi-join on the position."""
    s = t.vectors(spark, sf).withColumn("o", F.col("vec_id").cast("double"))
    ranked = value_ranks(s, [], "o", ["vec_id"]).select("vec_id", "v", "rn")
    return ranked.join(ranked.select((F.col("rn") - 1).alias("rn"), F.col("v").alias("other")), "rn")


@query("g05_poly_neighbor", f"WITH {VECTORS}, {NEXT} SELECT a.vec_id, {r('(list_dot_product(a.v, b.v) / 64 + 1.0) ** 2', 'k')} FROM nxt a JOIN nxt b ON b.pos = a.pos + 1")
def poly_neighbor(spark, sf):
    return with_next(spark, sf).select("vec_id", G.poly_value(F.col("v"), F.col("other"), 1.0 / 64, 1.0).alias("k"))


@query("g06_rbf_neighbor", f"WITH {VECTORS}, {NEXT} SELECT a.vec_id, {r('exp(-2.0 * list_distance(a.v, b.v) ** 2)', 'k')} FROM nxt a JOIN nxt b ON b.pos = a.pos + 1")
def rbf_neighbor(spark, sf):
    return with_next(spark, sf).select("vec_id", G.rbf_value(F.col("v"), F.col("other"), 2.0).alias("k"))


@query("g05_poly_map_rows", f"""WITH {VECTORS} SELECT vec_id, {r('v[1] * v[1] / 64', 'first')}, {r('(list_dot_product(v, v) / 64 + 1.0) ** 2', 'norm')} FROM vectors""")
def poly_map_rows(spark, sf):
    """The explicit map of the squared kernel, 2145 terms a row: its squared length is the kernel's own value."""
    a, _ = M.add_map(t.vectors(spark, sf), "poly", "v", 64, coef0=1.0)
    return a.select("vec_id", F.col("phi")[0].alias("first"), F.aggregate("phi", F.lit(0.0), lambda s, v: s + v * v).alias("norm"))


PAIR_SUM = """pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, a.y AS yi, b.y AS yj, {k} AS k FROM {src} a, {src} b)"""


@query("g07_label_kernel", f"""WITH {VECTORS}, {REF.format(src='vectors')}
SELECT a.vec_id, CAST(sum((2 * a.y - 1) * (2 * b.y - 1)) AS BIGINT) AS total FROM vectors a, ref b GROUP BY a.vec_id""")
def label_kernel(spark, sf):
    v, _, (_, labels) = reference_matrix(spark, sf)
    ones = F.array(*[F.lit(int(x)) for x in labels])
    return v.select("vec_id", F.aggregate(F.transform(ones, lambda b: G.label_value(F.col("y"), b)), F.lit(0), lambda s, x: s + x).alias("total"))


def linear_ref_rows(spark, sf, kind="rbf", gamma=2.0, coef0=0.0):
    """Square kernel of the reference rows as array rows with positions."""
    _, ref, (matrix, labels) = reference_matrix(spark, sf)
    rows = G.kernel_rows(G.numbered(ref, ["vec_id"]), "v", matrix, kind, gamma, coef0)
    return rows, labels


REF_RBF = VREF + ", " + PAIR_SUM.format(k="exp(-2.0 * list_distance(a.v, b.v) ** 2)", src="ref")
REF_POLY = VREF + ", " + PAIR_SUM.format(k="(list_dot_product(a.v, b.v) / 64) ** 2", src="ref")


@query("g08_max_normalize", f"WITH {REF_POLY}, m AS (SELECT max(k) AS top FROM pairs) SELECT i AS vec_id, {r('sum(k / top)', 'total')}, {r('max(k / top)', 'top')} FROM pairs, m GROUP BY i")
def max_normalize(spark, sf):
    rows, _ = linear_ref_rows(spark, sf, "poly", 1.0 / 64)
    return exploded(G.row_max_normalize(rows)).select("vec_id", "total", "top")


KTA = "sum(k * (2 * yi - 1) * (2 * yj - 1)) / (sqrt(sum(k * k)) * sqrt(count(*)))"


@query("g09_alignment_rbf", f"WITH {REF_RBF} SELECT {r(KTA, 'alignment')} FROM pairs")
def alignment_rbf(spark, sf):
    rows, labels = linear_ref_rows(spark, sf)
    return G.row_alignment(rows, labels, "y")


@query("g10_double_centering", f"""WITH {REF_RBF}, c AS (SELECT i, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k FROM pairs)
SELECT i AS vec_id, {r('sum(k * k)', 'squares')}, {r('max(k)', 'top')} FROM c GROUP BY i""")
def double_centering(spark, sf):
    rows, _ = linear_ref_rows(spark, sf)
    return exploded(G.row_center(rows), "centered").select("vec_id", "squares", "top")


@query("g11_cka_rows", f"""WITH {VREF}, pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, exp(-2.0 * list_distance(a.v, b.v) ** 2) AS k1, (list_dot_product(a.v, b.v) / 64) ** 2 AS k2 FROM ref a, ref b),
c AS (SELECT k1 - avg(k1) OVER (PARTITION BY i) - avg(k1) OVER (PARTITION BY j) + avg(k1) OVER () AS k1, k2 - avg(k2) OVER (PARTITION BY i) - avg(k2) OVER (PARTITION BY j) + avg(k2) OVER () AS k2 FROM pairs)
SELECT {r('sum(k1 * k2) / (sqrt(sum(k1 * k1)) * sqrt(sum(k2 * k2)))', 'cka')} FROM c""")
def cka_rows(spark, sf):
    rows, _ = linear_ref_rows(spark, sf)
    _, _, (matrix, _) = reference_matrix(spark, sf)
    rows = G.kernel_rows(rows, "v", matrix, "poly", 1.0 / 64, out="k2")
    rows = G.row_center(G.row_center(rows, out="c1"), k="k2", out="c2")
    return G.row_cka(rows, "c1", "c2")


def whole_stats(k: str) -> str:
    return f"""{PAIR_SUM.format(k=k, src='state')},
t AS (SELECT (SELECT count(*) FROM state) AS n, {KTA} AS alignment, sum(CASE WHEN i = j THEN k END) ** 2 / sum(k * k) AS effective_rank,
  avg(k) FILTER (yi = yj) AS within, avg(k) FILTER (yi <> yj) AS across, avg(k) FILTER (i <> j) AS mean_off, var_pop(k) FILTER (i <> j) AS var_off FROM pairs),
c AS (SELECT k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k,
  ((2 * yi - 1) - (SELECT avg(2 * y - 1) FROM state)) * ((2 * yj - 1) - (SELECT avg(2 * y - 1) FROM state)) AS l FROM pairs),
cka AS (SELECT sum(k * l) / (sqrt(sum(k * k)) * sqrt(sum(l * l))) AS label_cka FROM c)
SELECT n, {', '.join(r(c, c) for c in ['alignment', 'label_cka', 'effective_rank', 'within', 'across', 'mean_off', 'var_off'])} FROM t, cka"""


LINEAR = "list_dot_product(a.v, b.v)"
WHOLE = f"{VECTORS}, state AS (SELECT * FROM vectors), "


@query("g09_map_statistics_linear", f"WITH {WHOLE}" + whole_stats(LINEAR))
def map_statistics_linear(spark, sf):
    """Every row and all 64 components."""
    return G.map_statistics(t.vectors(spark, sf).select("y", "v"), "v", 64, "y")


LINEAR_PAIRS = WHOLE + PAIR_SUM.format(k=LINEAR, src="state")


@query("g08_max_normalize_linear", f"WITH {LINEAR_PAIRS}, m AS (SELECT max(k) AS top FROM pairs) SELECT i AS vec_id, {r('sum(k / top)', 'total')}, {r('max(CASE WHEN i = j THEN k / top END)', 'top')} FROM pairs, m GROUP BY i")
def max_normalize_linear(spark, sf):
    return G.map_max_normalize(t.vectors(spark, sf), "v", 64).select("vec_id", "total", "top")


@query("g10_double_centering_linear", f"""WITH {LINEAR_PAIRS}, c AS (SELECT i, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k FROM pairs)
SELECT i AS vec_id, {r('sum(k * k)', 'squares')} FROM c GROUP BY i""")
def double_centering_linear(spark, sf):
    return G.map_center(t.vectors(spark, sf), "v", 64).select("vec_id", "squares")


@query("g12_effective_rank_linear", f"WITH {LINEAR_PAIRS} SELECT {r('sum(CASE WHEN i = j THEN k END) ** 2 / sum(k * k)', 'effective_rank')} FROM pairs")
def effective_rank_linear(spark, sf):
    return map_statistics_linear(spark, sf).select("effective_rank")


@query("g14_block_ratio_linear", f"""WITH {LINEAR_PAIRS}, b AS (SELECT avg(k) FILTER (yi = yj) AS w, avg(k) FILTER (yi <> yj) AS a FROM pairs)
SELECT {r('w', 'within')}, {r('a', 'across')}, {r('w / (a + 1e-12)', 'block_ratio')} FROM b""")
def block_ratio_linear(spark, sf):
    s = map_statistics_linear(spark, sf)
    return s.select("within", "across", (F.col("within") / (F.col("across") + F.lit(1e-12))).alias("block_ratio"))


@query("g22_diagonal_check_linear", f"WITH {LINEAR_PAIRS} SELECT {r('min(k)', 'min_self')}, min(k) >= 0.99 AS ok FROM pairs WHERE i = j")
def diagonal_check_linear(spark, sf):
    return G.map_diagonal(t.vectors(spark, sf), "v", 0.99)


@query("g09_map_statistics_poly", f"WITH {ANGLES}, state AS (SELECT * FROM angles), " + whole_stats("((a.x0 * b.x0 + a.x1 * b.x1 + a.x2 * b.x2 + a.x3 * b.x3) / 4 + 1.0) ** 2"))
def map_statistics_poly(spark, sf):
    a, dim = M.add_map(t.angles(spark, sf), "poly", "x", 4, coef0=1.0)
    return G.map_statistics(a.select("y", "phi"), "phi", dim, "y")


@query("g11_cka_maps", f"""WITH {VECTORS}, lo AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(range(0, 64)) AS pos, unnest(v) AS x FROM vectors) GROUP BY pos),
u AS (SELECT vec_id, list((x - lo) / (hi - lo) ORDER BY pos) AS w FROM (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM vectors) JOIN lo USING (pos) GROUP BY vec_id),
s2 AS (SELECT * FROM vectors JOIN u USING (vec_id)),
pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) AS k1, list_dot_product(a.w, b.w) AS k2 FROM s2 a, s2 b),
c AS (SELECT k1 - avg(k1) OVER (PARTITION BY i) - avg(k1) OVER (PARTITION BY j) + avg(k1) OVER () AS k1, k2 - avg(k2) OVER (PARTITION BY i) - avg(k2) OVER (PARTITION BY j) + avg(k2) OVER () AS k2 FROM pairs)
SELECT {r('sum(k1 * k2) / (sqrt(sum(k1 * k1)) * sqrt(sum(k2 * k2)))', 'cka')} FROM c""")
def cka_maps(spark, sf):
    """Linear kernels of the raw and of the min-max scaled vectors."""
    v = t.vectors(spark, sf)
    return G.map_cka(scaling.fit_minmax(v, "v").apply(v.withColumn("w", F.col("v")), "w"), "v", 64, "w", 64)


@query("g12_effective_rank", f"WITH {REF_RBF} SELECT {r('sum(CASE WHEN i = j THEN k END) ** 2 / sum(k * k)', 'effective_rank')} FROM pairs")
def effective_rank(spark, sf):
    rows, _ = linear_ref_rows(spark, sf)
    return G.row_effective_rank(rows)


@query("g13_spectrum")
def spectrum(spark, sf):
    return G.spectrum(t.vectors(spark, sf).select("v"), "v", 64)


@query("g13_components_for_share")
def components_for_share(spark, sf):
    return G.components_for(spectrum(spark, sf))


@query("g14_block_ratio", f"""WITH {REF_RBF}, b AS (SELECT avg(k) FILTER (yi = yj) AS w, avg(k) FILTER (yi <> yj) AS a FROM pairs)
SELECT {r('w', 'within')}, {r('a', 'across')}, {r('w / (a + 1e-12)', 'block_ratio')} FROM b""")
def block_ratio(spark, sf):
    rows, labels = linear_ref_rows(spark, sf)
    return G.row_block_ratio(rows, labels, "y")


BOOT = f"""{ANGLES}, numbered AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(['vec_id'], 42)}, vec_id) AS rn FROM angles),
slots AS (SELECT id // 300 AS replicate, {sql_rank(['id'], '(SELECT count(*) FROM angles)', 43)} AS rn FROM (SELECT unnest(range(0, 6000)) AS id)),
drawn AS (SELECT replicate, y, x0, x1, x2, x3 FROM slots JOIN numbered USING (rn)),
pairs AS (SELECT a.replicate, ((a.x0 * b.x0 + a.x1 * b.x1 + a.x2 * b.x2 + a.x3 * b.x3) / 4) ** 2 AS k, a.y AS yi, b.y AS yj FROM drawn a JOIN drawn b ON a.replicate = b.replicate),
tr AS (SELECT replicate, sum(((x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3) / 4) ** 2) AS trace FROM drawn GROUP BY replicate)"""


def boot_kernel(spark, sf):
    a, dim = M.add_map(t.angles(spark, sf), "poly", "x", 4)
    rows = search.bootstrap_rows(a.select("vec_id", "y", "phi"), ["vec_id"], 20, 300)
    return G.map_bootstrap(rows, "phi", dim, "y")


@query("g15_kernel_bootstrap", f"""WITH {BOOT} SELECT replicate, {r(KTA, 'alignment')}, {r('max(trace) ** 2 / sum(k * k)', 'effective_rank')} FROM pairs JOIN tr USING (replicate) GROUP BY replicate""")
def kernel_bootstrap(spark, sf):
    return boot_kernel(spark, sf)


@query("g15_kernel_interval", f"""WITH {BOOT}, s AS (SELECT replicate, {KTA} AS v FROM pairs GROUP BY replicate)
SELECT {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('quantile_cont(v, 0.025)', 'low')}, {r('quantile_cont(v, 0.975)', 'high')} FROM s""")
def kernel_interval(spark, sf):
    return search.interval(boot_kernel(spark, sf), "alignment")


@query("g15_table_intervals")
def table_kernel_intervals(spark, sf):
    """Two hundred resamples as large as the table, all 64 components: alignment, CKA with the labels, effective rank."""
    return linear_kernel_intervals(Drawn(t.vectors(spark, sf).select("vec_id", "y", "v"), ["vec_id"]), "v", "y", t.DIM)


ADDED = (0.0, 0.25, 0.5, 1.0, 2.0)


def _conc_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS setting, avg(k) FILTER (i <> j) AS mean_off, var_pop(k) FILTER (i <> j) AS var_off, sum(CASE WHEN i = j THEN k END) ** 2 / sum(k * k) AS effective_rank "
        f"FROM (SELECT i, j, k + {c} AS k FROM pairs)" for i, c in enumerate(ADDED))
    return f"WITH {LINEAR_PAIRS}, u AS ({rows})"


@query("g16_concentration", f"{_conc_sql()} SELECT setting, {r('mean_off', 'mean_off')}, {r('var_off', 'var_off')}, {r('effective_rank', 'effective_rank')} FROM u")
def concentration(spark, sf):
    """Linear kernels plus a constant, five settings, over all rows."""
    return concentration_table(spark, sf)


def concentration_table(spark, sf):
    v = t.vectors(spark, sf)
    grown = v.select(F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(c ** 0.5).alias("add")) for i, c in enumerate(ADDED)])).alias("z"), "y", "v")
    grown = grown.select("z.setting", "y", F.concat("v", F.array("z.add")).alias("phi"))
    return G.map_statistics(grown, "phi", 65, "y", ["setting"]).select("setting", "mean_off", "var_off", "effective_rank")


@query("g16_concentration_rows", f"WITH {REF_RBF} SELECT {r('avg(k) FILTER (i <> j)', 'mean_off')}, {r('var_pop(k) FILTER (i <> j)', 'var_off')}, "
       f"{r('sum(CASE WHEN i = j THEN k END) ** 2 / sum(k * k)', 'effective_rank')} FROM pairs")
def concentration_rows(spark, sf):
    return G.row_concentration(linear_ref_rows(spark, sf)[0])


def two_kernels(spark, sf):
    rows, _ = linear_ref_rows(spark, sf)
    _, _, (matrix, _) = reference_matrix(spark, sf)
    return G.kernel_rows(rows, "v", matrix, "rbf", 1.5, out="k2")


@query("g17_kernel_difference", f"""WITH {VREF}, p AS (SELECT exp(-2.0 * list_distance(a.v, b.v) ** 2) AS a, exp(-1.5 * list_distance(a.v, b.v) ** 2) AS b FROM ref a, ref b)
SELECT {r('sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-12)', 'cosine')}, {r('sqrt(sum((a - b) ** 2)) / count(*)', 'distance')},
  {r('avg(abs(a - b))', 'mae')}, {r('sqrt(avg((a - b) ** 2))', 'rmse')} FROM p""")
def kernel_difference(spark, sf):
    return G.row_difference(two_kernels(spark, sf), "k", "k2")


def noisy_kernels(spark, sf):
    """Repeats of the reference kernel with seeded noise of two sizes; the exact kernel rides along."""
    rows, _ = linear_ref_rows(spark, sf)
    spread = rows.withColumn("setting", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    noise = F.transform("k", lambda v, p: v + F.lit(0.01) * F.col("setting") * gaussian(["vec_id", p, "setting", "seed"], 5))
    return spread.withColumn("k_noisy", noise)


NOISY = VREF + f""", pairs AS (SELECT a.vec_id AS i, b.pos AS j, exp(-2.0 * list_distance(a.v, b.v) ** 2) AS k FROM ref a, ref b),
noisy AS (SELECT i, j, k, setting, seed, k + 0.01::DOUBLE * setting * {sql_gaussian(['i', 'j', 'setting', 'seed'], 5)} AS kn FROM pairs,
  (SELECT unnest([1, 2]) AS setting), (SELECT unnest([0, 1, 2]) AS seed))"""


@query("g18_entry_variance", f"""WITH {NOISY}, e AS (SELECT setting, i, j, var_pop(kn) AS v FROM noisy GROUP BY ALL), m AS (SELECT setting, avg(abs(kn - k)) AS mae FROM noisy GROUP BY setting)
SELECT setting, {r('avg(v)', 'entry_variance', 7)}, {r('any_value(mae)', 'mae', 7)} FROM e JOIN m USING (setting) GROUP BY setting""", 7)
def entry_variance(spark, sf):
    return G.row_entry_variance(noisy_kernels(spark, sf), ["vec_id"], "k_noisy", "k", ["setting"])


@query("g19_sample_noise_summary", f"""WITH {NOISY}, d AS (SELECT setting, seed, sqrt(avg((kn - k) ** 2)) AS rmse FROM noisy GROUP BY ALL),
s AS (SELECT setting, avg(rmse) AS m, stddev_samp(rmse) AS sd FROM d GROUP BY setting)
SELECT setting, {r('m', 'rmse_mean')}, {r('sd', 'rmse_std')}, m = min(m) OVER () AS smallest_gap, m = max(m) OVER () AS largest_gap FROM s""")
def sample_noise_summary(spark, sf):
    per = G.row_difference(noisy_kernels(spark, sf), "k", "k_noisy", ["setting", "seed"])
    s = per.groupBy("setting").agg(F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"))
    whole = Window.partitionBy(F.lit(0))
    return s.withColumn("smallest_gap", F.col("rmse_mean") == F.min("rmse_mean").over(whole)) \
        .withColumn("largest_gap", F.col("rmse_mean") == F.max("rmse_mean").over(whole))


# each row and a row drawn for it by hash
RANDOM = f"""{VECTORS}, ranked AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) AS rank FROM vectors),
fid AS (SELECT a.vec_id, exp(-0.5 * list_distance(a.v, b.v) ** 2) AS f FROM ranked a JOIN ranked b ON b.rank = {sql_rank(['a.vec_id'], '(SELECT count(*) FROM vectors)', 42)})"""


def random_values(spark, sf):
    pairs = G.random_row_pairs(t.vectors(spark, sf), "vec_id", "v", 42)
    return pairs.select("vec_id", G.rbf_value(F.col("a"), F.col("b"), 0.5).alias("f"))


@query("g20_random_pair_values", f"WITH {RANDOM} SELECT vec_id, {r('f', 'f')} FROM fid")
def random_pair_values(spark, sf):
    """Kernel values of random pairs of table rows."""
    return random_values(spark, sf)


HIST = """h AS (SELECT b.bin, coalesce(c, 0) AS c FROM (SELECT unnest(range(0, 50)) AS bin) b
  LEFT JOIN (SELECT least(CAST(floor(f * 50) AS BIGINT), 49) AS bin, count(*) AS c FROM fid GROUP BY 1) x USING (bin))"""


@query("g21_histogram", f"WITH {RANDOM}, {HIST} SELECT bin, c FROM h")
def histogram(spark, sf):
    return G.unit_histogram(random_values(spark, sf), "f")


@query("g21_divergence", f"""WITH {RANDOM}, {HIST}, d AS (SELECT c * 1.0 / sum(c) OVER () AS p, 15.0 * (1.0 - (bin + 0.5) / 50) ** 14 AS dens FROM h),
q AS (SELECT p, dens / sum(dens) OVER () AS q FROM d)
SELECT {r('sum(CASE WHEN p > 1e-12 THEN p * ln((p + 1e-12) / (q + 1e-12)) ELSE 0 END)', 'kl')}, (SELECT CAST(sum(c) AS BIGINT) FROM h) AS n FROM q""")
def divergence(spark, sf):
    return G.divergence_from_beta(G.unit_histogram(random_values(spark, sf), "f"), 4)


@query("g22_diagonal_check", f"WITH {REF_RBF} SELECT {r('min(k)', 'min_self')}, min(k) >= 0.99 AS ok FROM pairs WHERE i = j")
def diagonal_check(spark, sf):
    return G.diagonal_check(linear_ref_rows(spark, sf)[0])


@query("g23_monotonicity", f"{_conc_sql()} SELECT setting, {r('effective_rank', 'effective_rank')}, {r('lag(effective_rank) OVER (ORDER BY setting)', 'previous')}, effective_rank < lag(effective_rank) OVER (ORDER BY setting) AS falls FROM u")
def monotonicity(spark, sf):
    return G.falling(concentration_table(spark, sf).select("setting", "effective_rank"), "setting", "effective_rank")


ALIGN = "sum(k * (2 * yi - 1) * (2 * yj - 1)) / (sqrt(sum(k * k)) * sqrt(count(*)))"


@query("g24_scaled_alignment", f"""WITH {LINEAR_PAIRS}, four AS (SELECT yi, yj, 4.0 * k AS k FROM pairs)
SELECT (SELECT {r(ALIGN, 'v').removesuffix(' AS v')} FROM pairs) AS alignment, (SELECT {r(ALIGN, 'v').removesuffix(' AS v')} FROM four) AS alignment_scaled""")
def scaled_alignment(spark, sf):
    """Scaling all kernel values leaves the alignment where it was."""
    v = t.vectors(spark, sf)
    both = v.select("y", F.explode(F.array(F.struct(F.lit("alignment").alias("which"), F.col("v").alias("x")),
                                           F.struct(F.lit("alignment_scaled").alias("which"), F.transform("v", lambda c: c * 2.0).alias("x")))).alias("z"))
    stats = G.map_statistics(both.select("z.which", "y", "z.x"), "x", t.DIM, "y", ["which"])
    return stats.groupBy().pivot("which", ["alignment", "alignment_scaled"]).agg(F.first("alignment"))


# Every row against every row in blocks, with the table's own class mix: the statistics that the queries above read from reference
# rows. SQL forms all pairs of the table.
ALL_PAIRS = VECTORS + ", pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, a.y AS yi, b.y AS yj, {k} AS k FROM vectors a, vectors b)"
RBF_SQL, SQUARED_SQL = "exp(-2.0 * list_distance(a.v, b.v) ** 2)", "(list_dot_product(a.v, b.v) / 64) ** 2"
ALL_RBF = ALL_PAIRS.format(k=RBF_SQL)


def all_per_row(k: str) -> str:
    return f"WITH {ALL_PAIRS.format(k=k)} SELECT i AS vec_id, {r('sum(k)', 'total')}, {r('sum(k * k)', 'squares')}, {r('max(k)', 'top')} FROM pairs GROUP BY i"


RBF, SLOWER, SQUARED = ("rbf", 2.0, 0.0), ("rbf", 1.5, 0.0), ("poly", 1.0 / 64, 0.0)


def all_sums(spark, sf, *kernels, wanted):
    return B.kernel_sums(t.vectors(spark, sf), "v", "y", kernels, ["vec_id"], wanted=wanted)


def all_statistics(spark, sf):
    return B.whole_statistics(all_sums(spark, sf, RBF, wanted=("total", "squares", "signed", "same")))


def all_rows(spark, sf, kernel):
    return all_sums(spark, sf, kernel, wanted=("total", "squares", "top")).select("vec_id", F.col("total0").alias("total"), F.col("squares0").alias("squares"), F.col("top0").alias("top"))


@query("g01_linear_rows_all", all_per_row("list_dot_product(a.v, b.v)"))
def linear_rows_all(spark, sf):
    return all_rows(spark, sf, ("linear", 1.0, 0.0))


@query("g02_poly_rows_all", all_per_row("(list_dot_product(a.v, b.v) / 64 + 1.0) ** 2"))
def poly_rows_all(spark, sf):
    return all_rows(spark, sf, ("poly", 1.0 / 64, 1.0))


@query("g03_rbf_rows_all", all_per_row(RBF_SQL))
def rbf_rows_all(spark, sf):
    return all_rows(spark, sf, RBF)


@query("g07_label_kernel_all", f"WITH {VECTORS} SELECT a.vec_id, CAST(sum((2 * a.y - 1) * (2 * b.y - 1)) AS BIGINT) AS total FROM vectors a, vectors b GROUP BY a.vec_id")
def label_kernel_all(spark, sf):
    """The label kernel has rank one: a row's total is its own sign times the sum of all signs."""
    v = t.vectors(spark, sf).select("vec_id", (2 * F.col("y") - 1).alias("s"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("s").alias("signs")))).select("vec_id", (F.col("s") * F.col("signs")).alias("total"))


@query("g08_max_normalize_all", f"WITH {ALL_PAIRS.format(k=SQUARED_SQL)}, m AS (SELECT max(k) AS top FROM pairs) SELECT i AS vec_id, {r('sum(k / m.top)', 'total')}, {r('max(k / m.top)', 'top')} FROM pairs, m GROUP BY i")
def max_normalize_all(spark, sf):
    sums = cut_lineage(all_sums(spark, sf, SQUARED, wanted=("total", "top")))
    top = sums.agg(F.max("top0").alias("most"))
    return sums.crossJoin(F.broadcast(top)).select("vec_id", (F.col("total0") / F.col("most")).alias("total"), (F.col("top0") / F.col("most")).alias("top"))


@query("g09_alignment_rbf_all", f"WITH {ALL_RBF} SELECT {r(KTA, 'alignment')} FROM pairs")
def alignment_rbf_all(spark, sf):
    return all_statistics(spark, sf).select("alignment")


@query("g10_double_centering_all", f"""WITH {ALL_RBF}, c AS (SELECT i, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k FROM pairs)
SELECT i AS vec_id, {r('sum(k * k)', 'squares')}, {r('max(k)', 'top')} FROM c GROUP BY i""")
def double_centering_all(spark, sf):
    return B.centered_sums(t.vectors(spark, sf), "v", "y", RBF, "vec_id")


@query("g11_cka_rows_all", f"""WITH {VECTORS}, pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, {RBF_SQL} AS k1, {SQUARED_SQL} AS k2 FROM vectors a, vectors b),
c AS (SELECT k1 - avg(k1) OVER (PARTITION BY i) - avg(k1) OVER (PARTITION BY j) + avg(k1) OVER () AS k1, k2 - avg(k2) OVER (PARTITION BY i) - avg(k2) OVER (PARTITION BY j) + avg(k2) OVER () AS k2 FROM pairs)
SELECT {r('sum(k1 * k2) / (sqrt(sum(k1 * k1)) * sqrt(sum(k2 * k2)))', 'cka')} FROM c""")
def cka_rows_all(spark, sf):
    return B.whole_cka(all_sums(spark, sf, RBF, SQUARED, wanted=("total", "squares", "cross")))


@query("g12_effective_rank_all", f"WITH {ALL_RBF} SELECT {r('sum(CASE WHEN i = j THEN k END) ** 2 / sum(k * k)', 'effective_rank')} FROM pairs")
def effective_rank_all(spark, sf):
    return all_statistics(spark, sf).select("effective_rank")


@query("g14_block_ratio_all", f"""WITH {ALL_RBF}, b AS (SELECT avg(k) FILTER (yi = yj) AS w, avg(k) FILTER (yi <> yj) AS a FROM pairs)
SELECT {r('w', 'within')}, {r('a', 'across')}, {r('w / (a + 1e-12)', 'block_ratio')} FROM b""")
def block_ratio_all(spark, sf):
    return all_statistics(spark, sf).select("within", "across", (F.col("within") / (F.col("across") + F.lit(1e-12))).alias("block_ratio"))


@query("g16_concentration_rows_all", f"""WITH {ALL_RBF} SELECT {r('avg(k) FILTER (i <> j)', 'mean_off')}, {r('var_pop(k) FILTER (i <> j)', 'var_off')},
  {r('sum(CASE WHEN i = j THEN k END) ** 2 / sum(k * k)', 'effective_rank')} FROM pairs""")
def concentration_rows_all(spark, sf):
    return all_statistics(spark, sf).select("mean_off", "var_off", "effective_rank")


@query("g17_kernel_difference_all", f"""WITH {VECTORS}, p AS (SELECT {RBF_SQL} AS a, exp(-1.5 * list_distance(a.v, b.v) ** 2) AS b FROM vectors a, vectors b)
SELECT {r('sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-12)', 'cosine')}, {r('sqrt(sum((a - b) ** 2)) / count(*)', 'distance')},
  {r('avg(abs(a - b))', 'mae')}, {r('sqrt(avg((a - b) ** 2))', 'rmse')} FROM p""")
def kernel_difference_all(spark, sf):
    return B.whole_difference(all_sums(spark, sf, RBF, SLOWER, wanted=("squares", "cross", "gap", "gap_squares")))


@query("g22_diagonal_check_all", f"WITH {ALL_RBF} SELECT {r('min(k)', 'min_self')}, min(k) >= 0.99 AS ok FROM pairs WHERE i = j")
def diagonal_check_all(spark, sf):
    return all_statistics(spark, sf).select("min_self", (F.col("min_self") >= 0.99).alias("ok"))
