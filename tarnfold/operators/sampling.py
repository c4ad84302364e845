"""Exact-size stratified sampling, splits, runs and folds (inventory D).

Every sampler is: count per stratum -> integer quota per stratum -> rows with the lowest seeded hash in each stratum.
The counts come as a (stratum, hash range) histogram, so one pass yields both the quota inputs and the hash range in
which each stratum's cut falls. Rows below the cut range are kept as they are; only the rows of the cut range are
ranked. No stratum is ever sorted as a whole. A null stratum or group is one like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.hashing import draw_rank, hash_bucket, with_hash
from tarnfold.operators.ranking import hash_ranges, hash_ranks, hash_slots, join_groups
from tarnfold.session import bounded, settle

#: Slots that one row of a draw with replacement unfolds into.
SLOT_RUN = 10_000


def _whole(group) -> Window:
    return Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))


def stratum_counts(df: DataFrame, stratum: str, group=()) -> DataFrame:
    """Rows per (group, stratum), run once."""
    return settle(df.groupBy(*group, stratum).agg(F.count(F.lit(1)).alias("n")))


# --- quotas -----------------------------------------------------------------------------------------------------

def allocate(counts: DataFrame, total, stratum: str, group=(), ensure_min_one: bool = True, weight: str = "n",
             out: str = "quota") -> DataFrame:
    """Largest-remainder quotas that sum exactly to ``total`` in every group.

    With ``ensure_min_one`` each stratum gets one first, provided the total covers all of them; the rest is
    proportional to ``weight``. Remainder ties go to the smaller stratum name.
    """
    group = list(group)
    total = total if isinstance(total, Column) else F.lit(int(total))
    whole = _whole(group)
    by_fraction = whole.orderBy(F.col("_frac").desc(), F.col(stratum))
    live = counts.withColumn("_live", (F.col(weight) > 0).cast("int")).withColumn("_total", F.greatest(total.cast("long"), F.lit(0)))
    live = live.withColumn("_k", F.sum("_live").over(whole)).withColumn("_w", F.sum(weight).over(whole))
    each = F.when((F.col("_total") >= F.col("_k")) & F.lit(ensure_min_one), F.col("_live")).otherwise(F.lit(0))
    live = live.withColumn("_each", each).withColumn("_rest", F.col("_total") - F.sum("_each").over(whole))
    raw = F.coalesce(F.try_divide(F.col(weight).cast("double") * F.col("_rest").cast("double"), F.col("_w").cast("double")), F.lit(0.0))
    live = live.withColumn("_raw", raw).withColumn("_floor", F.floor("_raw"))
    live = live.withColumn("_frac", F.when(F.col("_live") == 1, F.col("_raw") - F.col("_floor")).otherwise(F.lit(-1.0)))
    live = live.withColumn("_short", F.col("_rest") - F.sum("_floor").over(whole))
    bump = ((F.row_number().over(by_fraction) <= F.col("_short")) & (F.col("_live") == 1)).cast("long")
    return live.select(*counts.columns, (F.col("_each") + F.col("_floor") + bump).cast("long").alias(out))


def _proportional_floor(counts, total, stratum, group):
    """max(1, floor(total * share)), capped at the pool."""
    share = F.try_divide(F.col("n").cast("double") * total.cast("double"), F.sum("n").over(_whole(group)).cast("double"))
    return counts.withColumn("quota", F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0))), F.lit(1)), F.col("n")))


def _proportional_balanced(counts, total, stratum, group):
    """Floors of at least one, then balanced: deficits round-robin to the largest remainders, surplus round-robin from the
    smallest ones, never below one. Each (round, stratum) step is a row, so the first ``need`` rows are the steps taken."""
    whole = _whole(group)
    exact = F.coalesce(F.try_divide(F.col("n").cast("double") * total.cast("double"), F.sum("n").over(whole).cast("double")), F.lit(0.0))
    base = counts.withColumn("_exact", exact).withColumn("_base", F.greatest(F.floor("_exact"), F.lit(1)).cast("long"))
    base = base.withColumn("_rem", F.col("_exact") - F.floor("_exact"))
    base = base.withColumn("_gap", (total - F.sum("_base").over(whole)).cast("long"))
    limit = F.when(F.col("_gap") > 0, F.col("_gap")).otherwise(F.least(F.col("_base") - 1, -F.col("_gap")))
    steps = base.withColumn("_round", F.explode_outer(
        F.when(limit > 0, F.sequence(F.lit(1).cast("long"), limit)).otherwise(F.lit(None).cast("array<bigint>"))))
    order = whole.orderBy(F.col("_round").asc_nulls_last(),
                          F.when(F.col("_gap") > 0, -F.col("_rem")).otherwise(F.col("_rem")), F.col(stratum))
    taken = (F.row_number().over(order) <= F.abs(F.col("_gap"))) & F.col("_round").isNotNull()
    steps = steps.withColumn("_step", F.when(taken, F.signum("_gap").cast("long")).otherwise(F.lit(0)))
    return steps.groupBy(*group, stratum).agg(F.max("n").alias("n"), F.max("_base").alias("_b"), F.sum("_step").alias("_s")) \
        .select(*group, stratum, "n", F.least(F.col("_b") + F.col("_s"), F.col("n")).alias("quota"))


def _top_up(quotas: DataFrame, n_samples: Column, stratum: str, group) -> DataFrame:
    """Spread what is still missing over unselected rows, in proportion to them; then repeat rows if none are left."""
    whole = _whole(group)
    spare = quotas.withColumn("_spare", F.greatest(F.col("n") - F.col("quota"), F.lit(0))) \
        .withColumn("_miss", F.greatest(n_samples - F.sum("quota").over(whole), F.lit(0)))
    spare = spare.withColumn("_fill", F.least("_miss", F.sum("_spare").over(whole)))
    spare = allocate(spare, F.col("_fill"), stratum, group, ensure_min_one=False, weight="_spare", out="_extra")
    spare = allocate(spare, F.col("_miss") - F.col("_fill"), stratum, group, ensure_min_one=False, out="_again")
    return spare.select(*group, stratum, "n", (F.col("quota") + F.col("_extra") + F.col("_again")).alias("quota"))


def plan_quotas(counts: DataFrame, n_samples, stratum: str, rare=(), min_rare=0, mode: str = "pooled", group=()) -> DataFrame:
    """Quota per stratum for a rare-aware sample of exactly ``n_samples`` rows.

    ``mode``: ``pooled`` gives the rare groups ``min_rare`` times their number, one each and the rest by count;
    ``per_category`` gives each ``min_rare``; ``floor`` and ``lrm_balanced`` are per_category with those roundings of
    the other groups, topped up to the exact size. ``n_samples`` and ``min_rare`` may be columns of ``counts``.
    """
    if mode not in ("pooled", "per_category", "floor", "lrm_balanced"):
        raise ValueError(f"unknown mode {mode!r}")
    group = list(group)
    n_col = n_samples if isinstance(n_samples, Column) else F.lit(int(n_samples))
    m_col = min_rare if isinstance(min_rare, Column) else F.lit(int(min_rare))
    whole = _whole(group)
    base = counts.withColumn("_n", n_col.cast("long")).withColumn("_m", m_col.cast("long")) \
        .withColumn("_rare", F.coalesce(F.col(stratum).isin(list(rare)), F.lit(False)) if rare else F.lit(False))
    base = base.withColumn("_k", F.sum(F.col("_rare").cast("long")).over(whole)) \
        .withColumn("_others", F.sum((~F.col("_rare")).cast("long")).over(whole))
    base = base.withColumn("_budget", F.when(F.col("_k") > 0, F.least("_n", F.col("_m") * F.col("_k"))).otherwise(F.lit(0)))
    rare_part, other_part = base.filter("_rare"), base.filter("NOT _rare")
    keep = [*group, stratum, "n", "_n", "quota"]
    if mode == "pooled":
        rare_q = allocate(rare_part, F.col("_budget"), stratum, group)
        other_q = allocate(other_part, F.col("_n") - F.col("_budget"), stratum, group)
    else:
        rare_q = allocate(rare_part.withColumn("_one", F.lit(1)), F.col("_budget"), stratum, group,
                          ensure_min_one=False, weight="_one")
        rest = F.col("_n") - F.col("_budget")
        if mode == "per_category":
            other_q = allocate(other_part, rest, stratum, group)
        else:
            rounding = _proportional_floor if mode == "floor" else _proportional_balanced
            live = other_part.filter(rest > 0)
            sizes = counts.select(*group, n_col.cast("long").alias("_n")).distinct() if group else None
            other_q = rounding(live, rest if mode == "floor" else F.max(rest).over(whole), stratum, group)
            if "_n" not in other_q.columns:
                other_q = join_groups(other_q, sizes, group) if group else other_q.withColumn("_n", n_col.cast("long"))
            idle = other_part.filter(rest <= 0).withColumn("quota", F.lit(0).cast("long"))
            other_q = other_q.select(*keep).unionByName(idle.select(*keep))
    quotas = rare_q.select(*keep).unionByName(other_q.select(*keep))
    total = F.sum("quota").over(whole)
    # Only a floor sample whose ones outweigh the budget can exceed the size: trim from the largest strata.
    over = quotas.withColumn("_over", F.greatest(total - F.col("_n"), F.lit(0)))
    over = over.withColumn("_before", F.coalesce(F.sum("quota").over(
        whole.orderBy(F.col("quota").desc(), F.col(stratum)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    trimmed = over.withColumn(
        "quota", F.col("quota") - F.least(F.col("quota"), F.greatest(F.col("_over") - F.col("_before"), F.lit(0))))
    return _top_up(trimmed, F.col("_n"), stratum, group)


# --- drawing ----------------------------------------------------------------------------------------------------

class Lot:
    """Rows of a table with their seeded hash and the (group, stratum, hash range) histogram, which is run once."""

    def __init__(self, df: DataFrame, stratum: str, key, seed=0, group=(), buckets: int | None = None):
        self.df, self.stratum, self.key, self.seed, self.group = df, stratum, list(key), seed, list(group)
        self.by = [*group, stratum]
        self.hashed = with_hash(df, [*group, *key], seed).withColumn("_b", hash_bucket(F.col("_h"), buckets or hash_ranges(df)))
        self.hist = settle(self.hashed.groupBy(*self.by, "_b").agg(F.count(F.lit(1)).alias("_c")))

    def counts(self) -> DataFrame:
        return settle(self.hist.groupBy(*self.by).agg(F.sum("_c").alias("n")))

    def take(self, quotas: DataFrame) -> DataFrame:
        """The rows of a quota table; adds ``draw`` (1 for plain draws, the slot number for draws with replacement).

        A stratum whose quota exceeds its rows is drawn with replacement: slot s takes the row whose rank is drawn by the hash of s.
        Groups (runs, sizes) enter the hash, so they shuffle independently.
        """
        by, key = self.by, self.key
        along = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        wanted = quotas.filter("quota > 0").withColumn(
            "_ord", F.row_number().over(_whole(self.group).orderBy(self.stratum)).cast("long"))
        wanted = settle(wanted.select(*by, F.col("n").alias("_n"), F.col("quota").alias("_quota"), "_ord"))
        lanes = join_groups(self.hist.withColumn("_before", F.coalesce(F.sum("_c").over(along), F.lit(0))), wanted, by) \
            .withColumn("_again", F.col("_quota") > F.col("_n")).filter((F.col("_before") < F.col("_quota")) | F.col("_again"))
        near = join_groups(self.hashed, bounded(lanes), [*by, "_b"])
        # Hash ranges below the cut are kept as they are; only the range of the cut, and strata drawn with replacement, are ranked.
        whole_range = (F.col("_before") + F.col("_c") <= F.col("_quota")) & ~F.col("_again")
        sure = near.filter(whole_range).select(*self.df.columns, F.lit(1).cast("long").alias("draw"))
        torn = near.filter(~whole_range).withColumn(
            "_rn", (F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *key)) + F.col("_before")).cast("long"))
        once = torn.filter(~F.col("_again") & (F.col("_rn") <= F.col("_quota"))).select(*self.df.columns, F.lit(1).cast("long").alias("draw"))
        again = wanted.filter(F.col("_quota") > F.col("_n"))
        if again.isEmpty():
            return sure.unionByName(once)
        runs = again.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_quota") - 1) / SLOT_RUN).cast("long"))))
        first = F.col("_run") * SLOT_RUN + 1
        slots = runs.withColumn("_slot", F.explode(F.sequence(first, F.least(first + (SLOT_RUN - 1), F.col("_quota")).cast("long"))))
        slots = slots.select(*by, draw_rank([*self.group, "_ord", "_slot"], F.col("_n"), self.seed).alias("_rn"), "_slot")
        drawn = join_groups(torn.filter("_again"), slots, [*by, "_rn"])
        return sure.unionByName(once).unionByName(drawn.select(*self.df.columns, F.col("_slot").cast("long").alias("draw")))


def draw(df: DataFrame, quotas: DataFrame, stratum: str, key, seed=0, group=(), buckets: int | None = None) -> DataFrame:
    """Draw a given quota table (group, stratum, n, quota)."""
    return Lot(df, stratum, key, seed, group, buckets).take(quotas)


def stratified_sample(df: DataFrame, n_samples: int, stratum: str, key, rare=(), min_rare: int = 0, mode: str = "pooled",
                      seed: int = 42, group=()) -> DataFrame:
    """Rare-aware sample of exactly ``n_samples`` rows (per group, if groups are given)."""
    lot = Lot(df, stratum, key, seed, group)
    return lot.take(plan_quotas(lot.counts(), n_samples, stratum, rare, min_rare, mode, group))


def cv_subset(df: DataFrame, n_samples: int, stratum: str, key, rare=(), rare_max_frac: float | None = None,
              seed: int = 42) -> DataFrame:
    """All rare rows (up to ``rare_max_frac`` of the size), the rest proportional, nothing drawn twice."""
    pool = df.withColumn("_pool", F.when(F.col(stratum).isin(list(rare)), F.lit("")).otherwise(F.col(stratum)))
    lot = Lot(pool, "_pool", key, seed)
    return lot.take(cv_quotas(lot.counts(), n_samples, rare_max_frac)).drop("_pool", "draw")


def cv_quotas(counts: DataFrame, n_samples: int, rare_max_frac: float | None = None, stratum: str = "_pool") -> DataFrame:
    """Quotas of ``cv_subset``; the rare rows form the stratum with the empty name."""
    cap = n_samples if rare_max_frac is None else min(n_samples, int(n_samples * rare_max_frac))
    whole = _whole(())
    base = counts.withColumn("_rare_take", F.coalesce(
        F.max(F.when(F.col(stratum) == "", F.least(F.col("n"), F.lit(cap)))).over(whole), F.lit(0)))
    rare = base.filter(F.col(stratum) == "").select(stratum, "n", F.col("_rare_take").alias("quota"))
    other = allocate(base.filter(~F.col(stratum).eqNullSafe("")), F.lit(n_samples) - F.col("_rare_take"), stratum, ensure_min_one=False)
    return rare.unionByName(other.select(stratum, "n", F.least("quota", "n").alias("quota")))


def sample_by_counts(df: DataFrame, wanted: dict, stratum: str, key, seed: int = 42, check: bool = True) -> DataFrame:
    """Exactly ``wanted[level]`` rows of each level, with replacement if short; a missing level is an error."""
    lot = Lot(df.filter(F.col(stratum).isin(list(wanted))), stratum, key, seed)
    counts = lot.counts()
    if check:
        found = {r[0] for r in counts.select(stratum).collect()}  # at most len(wanted) rows
        missing = [k for k in wanted if k not in found]
        if missing:
            raise ValueError(f"no rows for {missing}")
    quota = F.lit(0)
    for level, n in wanted.items():
        quota = F.when(F.col(stratum) == F.lit(level), F.lit(int(n))).otherwise(quota)
    return lot.take(counts.withColumn("quota", quota.cast("long")))


def balanced_sample(df: DataFrame, n_samples: int, label: str, key, seed: int = 42) -> DataFrame:
    """Half of the size from each binary class, with replacement if a class is short."""
    half = n_samples // 2
    return sample_by_counts(df, {0: half, 1: n_samples - half}, label, key, seed)


def binary_counts_sample(df: DataFrame, n_normal: int, n_attack: int, label: str, key, seed: int = 42) -> DataFrame:
    return sample_by_counts(df, {0: n_normal, 1: n_attack}, label, key, seed)


def balanced_subset(df: DataFrame, size: int, label: str, key, seed: int = 42) -> DataFrame:
    """At most size/2 rows per class; room a short class leaves goes to the other one. Nothing drawn twice."""
    lot = Lot(df, label, key, seed)
    counts = lot.counts()
    whole = _whole(())
    first = counts.withColumn("quota", F.least(F.col("n"), F.lit(size // 2).cast("long")))
    room = F.greatest(F.lit(size) - F.sum("quota").over(whole), F.lit(0))
    spare = first.withColumn("_spare", F.col("n") - F.col("quota")).withColumn("_room", room)
    fill = F.least("_room", F.sum("_spare").over(whole))
    quotas = allocate(spare, fill, label, ensure_min_one=False, weight="_spare", out="_extra")
    return lot.take(quotas.select(label, "n", (F.col("quota") + F.col("_extra")).alias("quota"))).drop("draw")


def prior_quotas(counts: DataFrame, label: str, share_attack: float) -> DataFrame:
    """Largest sizes with the wanted share of class 1 and no repeats: n = floor(min(n0/(1-r), n1/r)), class 0 rounded half-even."""
    whole = _whole(())
    n0 = F.max(F.when(F.col(label) == 0, F.col("n"))).over(whole)
    n1 = F.max(F.when(F.col(label) == 1, F.col("n"))).over(whole)
    r1, r0 = float(share_attack), 1.0 - float(share_attack)
    limits = [n / F.lit(r) for n, r in ((n0, r0), (n1, r1)) if r > 0]
    size = F.floor(F.least(*limits) if len(limits) == 2 else limits[0])
    with_size = counts.withColumn("_size", size).withColumn("_zero", F.bround(F.col("_size") * F.lit(r0)).cast("long"))
    quota = F.when(F.col(label) == 0, F.col("_zero")).otherwise(F.col("_size") - F.col("_zero"))
    return with_size.select(label, "n", F.least(quota, F.col("n")).alias("quota"))


def prior_subsample(df: DataFrame, share_attack: float, label: str, key, seed: int = 42) -> DataFrame:
    lot = Lot(df, label, key, seed)
    return lot.take(prior_quotas(lot.counts(), label, share_attack)).drop("draw")


def stratified_split(df: DataFrame, size: int, label: str, key, seed: int = 42) -> DataFrame:
    """A stratified subset of fixed size, proportional by largest remainder."""
    lot = Lot(df, label, key, seed)
    return lot.take(allocate(lot.counts(), size, label, ensure_min_one=False)).drop("draw")


# --- runs and folds ---------------------------------------------------------------------------------------------

def disjoint_slices(df: DataFrame, n_runs: int, key, seed: int = 0, out: str = "run") -> DataFrame:
    """Shuffle and cut into ``n_runs`` equal slices 0..n-1; the last one takes the rest. Rows are not moved for it, except
    those of the few hash ranges a slice border falls into."""
    return hash_slots(df, [], key, n_runs, seed, out=out)


def disjoint_runs(df: DataFrame, n_runs: int, run_size: int, stratum: str, key, rare=(), min_rare: int = 0,
                  mode: str = "pooled", seed: int = 0) -> DataFrame:
    """One rare-aware sample inside each disjoint slice."""
    sliced = disjoint_slices(df, n_runs, key, seed)
    return stratified_sample(sliced, run_size, stratum, key, rare, min_rare, mode, seed, group=["run"])


def seeded_runs(df: DataFrame, n_runs: int, run_size: int, stratum: str, key, rare=(), min_rare: int = 0,
                mode: str = "pooled", seed: int = 0) -> DataFrame:
    """Independent samples; every row is offered to every run and the run number enters the hash."""
    offered = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
    return stratified_sample(offered, run_size, stratum, key, rare, min_rare, mode, seed, group=["run"])


def size_ladder(df: DataFrame, sizes, stratum: str, key, rare=(), mode: str = "pooled", seed: int = 42) -> DataFrame:
    """Samples of several sizes at once; each rare minimum is max(5, size // 20)."""
    offered = df.withColumn("size", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    lot = Lot(offered, stratum, key, seed, ["size"])
    floor = F.greatest(F.lit(5), F.floor(F.col("size") / 20))
    return lot.take(plan_quotas(lot.counts(), F.col("size"), stratum, rare, floor, mode, ["size"]))


def run_overlaps(df: DataFrame, key, run: str = "run") -> DataFrame:
    """Keys that occur in more than one run; empty when the runs are disjoint."""
    return df.groupBy(*key).agg(F.count_distinct(run).alias("n_runs")).filter("n_runs > 1")


def stratified_folds(df: DataFrame, k: int, stratum: str, key, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold 0..k'-1 with k' = min(k, smallest class); classes continue where the previous one stopped, so fold sizes differ
    by at most one overall and within each class."""
    ranked = hash_ranks(df, [stratum], key, seed, rank="_rank")
    counts = stratum_counts(df, stratum)
    whole = _whole(())
    before = whole.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.select(
        stratum, F.least(F.lit(k), F.min("n").over(whole)).alias("_k"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    return join_groups(ranked, bounded(plan), [stratum]) \
        .withColumn(out, F.pmod(F.col("_rank") - 1 + F.col("_shift"), F.col("_k")).cast("int")) \
        .select(*df.columns, out)
