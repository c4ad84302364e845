"""Max-margin classifiers on exact kernels (inventory H2, H9, H10): block coordinate ascent on the dual, multipliers as a table.

Every row keeps its multiplier and its kernel sum f = sum of multiplier * sign * kernel over all rows. A round takes the ``working`` rows that violate the optimality conditions
most (half of them above, half below), solves the dual over these exactly with all other multipliers fixed, and adds what changed to every row's f:
rows against at most ``working`` broadcast rows, in strips. There is no Gram matrix and a round is one pass. Rounds end when no
pair of rows violates the conditions by more than ``tol``. Tables larger than a working set start from the multipliers of a fit on a finite map of the kernel, which ends
as soon as the rows it leaves open fit a working set; the rounds, the offset and the gap use the kernel itself.

Rows without a label have no multiplier but are scored all the same: test rows ride along. Rows with a null vector are left out. With rows of
one class only, all multipliers are zero and that class is predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.blocks import kernel_strips, over_block_pairs
from tarnfold.operators.trainer import WIDTHS, Design, Moments, fit_designs
from tarnfold.session import cut_lineage

#: Rows of a working set; its kernel matrix is all that is held at once.
WORKING = 1024
#: Rows that landmarks of the start are picked from, most landmarks, and the share of the largest kernel value they may leave unexplained there.
SAMPLE, LANDMARKS, LEAST = 4096, 512, 1e-9


def kernel_matrix(left: np.ndarray, right: np.ndarray, kernel) -> np.ndarray:
    """Values of a kernel (kind, gamma, coef0)."""
    out = np.zeros((len(left), len(right)))
    for at, to, (k,) in kernel_strips(left, right, [kernel]):
        out[at, to] = k
    return out


def solve_working(gram: np.ndarray, y: np.ndarray, alpha: np.ndarray, f: np.ndarray, cost: np.ndarray, tol: float, most: int = 500_000) -> np.ndarray:
    """Multipliers of a working set at the optimum of the dual with all others fixed: pairs of rows, one by violation, the other by the gain it promises."""
    alpha, g = alpha.copy(), y - f
    diagonal = np.diagonal(gram)
    for _ in range(most):
        up = np.where(y > 0, alpha < cost, alpha > 0)
        low = np.where(y > 0, alpha > 0, alpha < cost)
        above = np.where(up, g, -np.inf)
        i = int(above.argmax())
        fall = above[i] - g
        if not low.any() or fall[low].max() <= tol:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * gram[i], 1e-12)
        j = int(np.where(low & (fall > 0), fall * fall / curve, -np.inf).argmax())
        step = min(fall[j] / curve[j], cost[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost[j] - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        for k in (i, j):
            alpha[k] = 0.0 if alpha[k] < 1e-14 * cost[k] else cost[k] if alpha[k] > cost[k] * (1 - 1e-14) else alpha[k]
        g = g - step * (gram[i] - gram[j])
    return alpha


@dataclass
class DualModel:
    """``rows``: kept columns, y (0, 1 or null), alpha, cost, score, pred."""

    rows: DataFrame
    offset: float
    squared_norm: float
    objective: float  # of the primal
    gap: float  # primal minus dual objective
    rounds: int
    kernel: tuple

    @property
    def width(self) -> float:
        """Distance between the margins in the kernel's own space."""
        return 2.0 / self.squared_norm ** 0.5 if self.squared_norm > 0 else float("inf")

    def support(self) -> DataFrame:
        """Rows with a multiplier: number, share of the labelled rows, number by class, number at the bound."""
        has = F.col("alpha") > 0
        labelled = self.rows.filter("y is not null")
        return labelled.agg(F.count_if(has).alias("n_support"), F.avg(has.cast("double")).alias("support_share"), F.count_if(has & (F.col("y") == 0)).alias("n_support_0"),
                            F.count_if(has & (F.col("y") == 1)).alias("n_support_1"), F.count_if(F.col("alpha") >= F.col("cost")).alias("n_bound"))


def fit_dual(df: DataFrame, vector: str, label: str, kernel: tuple, c: float = 1.0, balanced: bool = False, keep=(), working: int = WORKING, tol: float = 1e-3, most: int = 1000) -> DualModel:
    """``kernel`` is (kind, gamma, coef0), kind "linear", "poly" (squared) or "rbf"."""
    given = df.select(F.col(label).cast("int").alias("y"), F.col(vector).cast("array<double>").alias("x"), *keep).filter("x is not null")
    counts = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect() if r["y"] is not None}
    total = sum(counts.values())
    costs = {y: c * total / (len(counts) * n) if balanced else float(c) for y, n in counts.items()}
    cost = F.when(F.col("y") == 1, F.lit(costs.get(1, 0.0))).when(F.col("y") == 0, F.lit(costs.get(0, 0.0))).otherwise(F.lit(0.0))
    state = cut_lineage(given.select(F.monotonically_increasing_id().alias("row"), (2.0 * F.col("y") - 1.0).alias("s"), "x", F.lit(0.0).alias("alpha"), F.lit(0.0).alias("f"), cost.alias("cost"), *keep))
    rounds = 0
    if len(counts) == 2 and total > working:
        state = _started(state, kernel, counts, costs, total, tol, working)
    while len(counts) == 2 and rounds < most:
        chosen = _working_set(state, working, tol)
        if chosen is None:
            break
        ids, x, y, alpha, f, bound = chosen
        after = solve_working(kernel_matrix(x, x, kernel), y, alpha, f, bound, tol / 2)
        moved = np.flatnonzero(after != alpha)
        if not len(moved):
            break
        state = cut_lineage(_move(state, ids[moved], x[moved], after[moved], (after - alpha)[moved] * y[moved], kernel))
        rounds += 1
    return _finish(state, costs, kernel, rounds, counts)


def landmarks(x: np.ndarray, kernel, most: int = LANDMARKS, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(rows, inverse root of their kernel matrix) by pivoted Cholesky: the row worst explained by the ones before it comes next, until none is further than
    ``least`` of the largest value from its explanation."""
    left = np.array([kernel_matrix(v[None], v[None], kernel)[0, 0] for v in x])
    floor, columns, at = least * left.max(initial=0.0), np.zeros((min(most, len(x)), len(x))), []
    while len(at) < len(columns) and (left > floor).any():
        i, k = int(left.argmax()), len(at)
        columns[k] = (kernel_matrix(x, x[i:i + 1], kernel)[:, 0] - columns[:k, i] @ columns[:k]) / left[i] ** 0.5
        left -= columns[k] * columns[k]
        left[i] = 0.0
        at.append(i)
    return x[at], np.linalg.inv(columns[:len(at), at].T).T if at else np.zeros((0, 0))


def _started(state: DataFrame, kernel, counts: dict, costs: dict, total: int, tol: float, working: int) -> DataFrame:
    """``state`` with multipliers near the optimum. The kernel is replaced by a finite map on landmarks, picked from at most ``SAMPLE`` rows; on that map the
    grouped trainer fits the smoothed hinge over all labelled rows, and its multipliers are those of the rows. The smoothing narrows until at most ``working`` rows lie within
    its corner, or to half of ``tol``: rows beyond it have their multipliers at a bound already, so that an exact round settles the others at once where further rounds of
    the fit would move them one by one. Kernel sums are then taken with the kernel itself, over all pairs in blocks; the exact rounds that follow also mend what the map leaves out."""
    sample = state.filter("s is not null").orderBy(F.xxhash64("row")).limit(SAMPLE).select("x").toArrow().column("x").combine_chunks()
    points, root = landmarks(sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1), kernel)
    size = len(points)
    if not size:
        return state

    def mapped(x):
        return kernel_matrix(x, points, kernel) @ root

    rows = state.filter("s is not null").select(F.lit(0).alias("part"), ((F.col("s") + 1) / 2).cast("int").alias("y"), "x")
    none = np.zeros(size), np.zeros((size, size)), np.full(size, np.inf), np.full(size, -np.inf)
    moments = Moments(np.zeros(size), {(0, y): (n, *none) for y, n in counts.items()})
    design = Design({"model_name": "start"}, frozenset([0]), np.eye(size), np.zeros(size), float(costs[0]))
    if costs[0] != costs[1]:
        design.c, design.balanced = costs[0] * 2 * counts[0] / total, True
    widths = [w for w in WIDTHS if w > tol / 2]
    while (widths or WIDTHS)[-1] > tol / 2:
        widths.append(max(tol / 2, (widths or WIDTHS)[-1] / 2))
    fit = fit_designs(rows, moments, [design], 1e-7, widths=widths, mapped=mapped, few=working)[0]

    def multipliers(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                s, cost = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("s", "cost"))
                alpha = np.nan_to_num(cost * np.clip((1.0 - s * (mapped(x) @ fit.w + fit.b)) / fit.corner, 0.0, 1.0))
                yield b.set_column(b.schema.names.index("alpha"), "alpha", pa.array(alpha))

    state = cut_lineage(state.mapInArrow(multipliers, state.schema))
    # the sum of multiplier times sign is to be zero: free multipliers give way in proportion to their room
    room = F.when((F.col("alpha") > 0) & (F.col("alpha") < F.col("cost")), F.when(F.col("s") * F.lit(1.0) > 0, F.col("alpha")).otherwise(F.col("cost") - F.col("alpha"))).otherwise(F.lit(0.0))
    other = F.when(room > 0, F.col("cost") - room).otherwise(F.lit(0.0))
    over, down, up = state.filter("s is not null").agg(F.sum(F.col("alpha") * F.col("s")), F.sum(room), F.sum(other)).first()
    free = down if over > 0 else up
    if abs(over) > 0.5 * free:
        return state.withColumns({"alpha": F.lit(0.0), "f": F.lit(0.0)})
    if over:
        state = state.withColumn("alpha", F.when(room > 0, F.col("alpha") - F.col("s") * F.lit(over / free) * (room if over > 0 else other)).otherwise(F.col("alpha")))

    def sums(left, right):
        found = [{"_row": a["_row"], "f": np.zeros(len(a["_v"]))} for a in (left, right)]
        for at, to, (k,) in kernel_strips(left["_v"], right["_v"], [kernel]):
            found[0]["f"][at] += k @ right["given"][to]
            found[1]["f"][to] += left["given"][at] @ k
        return found

    state = cut_lineage(state)
    given = state.select(F.col("row").alias("_row"), F.col("x").alias("_v"), F.coalesce(F.col("alpha") * F.col("s"), F.lit(0.0)).alias("given"))
    f = over_block_pairs(given, sums, "_row long, f double").groupBy("_row").agg(F.sum("f").alias("f"))
    return cut_lineage(state.drop("f").join(f.withColumnRenamed("_row", "row"), "row").select(*state.columns))


def _working_set(state: DataFrame, working: int, tol: float):
    g = (F.col("s") - F.col("f")).alias("g")
    up = F.when(F.col("s") > 0, F.col("alpha") < F.col("cost")).otherwise(F.col("alpha") > 0)
    low = F.when(F.col("s") > 0, F.col("alpha") > 0).otherwise(F.col("alpha") < F.col("cost"))
    rows = state.filter("s is not null").select("row", "x", "s", "alpha", "f", "cost", g, up.alias("up"), low.alias("low"))
    a = rows.filter("up").orderBy(F.desc("g"), "row").limit(working // 2).toArrow()
    b = rows.filter("low").orderBy("g", "row").limit(working // 2).toArrow()
    if not a.num_rows or not b.num_rows or a.column("g")[0].as_py() - b.column("g")[0].as_py() <= tol:
        return None
    both = pa.concat_tables([a, b])
    ids, first = np.unique(both.column("row").to_numpy(), return_index=True)
    both = both.take(pa.array(first))
    x = both.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(both.num_rows, -1)
    return ids, x, *(both.column(c).to_numpy().astype(float) for c in ("s", "alpha", "f", "cost"))


def _move(state: DataFrame, ids, x, alpha, change, kernel) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            f = b.column("f").to_numpy().copy()
            for at, to, (k,) in kernel_strips(own, x, [kernel]):
                f[at] += k @ change[to]
            mine = b.column("alpha").to_numpy().copy()
            place = np.searchsorted(ids, b.column("row").to_numpy()).clip(max=len(ids) - 1)
            hit = ids[place] == b.column("row").to_numpy()
            mine[hit] = alpha[place[hit]]
            columns = {c: b.column(c) for c in b.schema.names} | {"alpha": pa.array(mine), "f": pa.array(f)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return state.mapInArrow(run, state.schema)


def _finish(state: DataFrame, costs: dict, kernel: tuple, rounds: int, counts: dict) -> DualModel:
    g = F.col("s") - F.col("f")
    free = (F.col("alpha") > 0) & (F.col("alpha") < F.col("cost"))
    up = F.when(F.col("s") > 0, F.col("alpha") < F.col("cost")).otherwise(F.col("alpha") > 0)
    low = F.when(F.col("s") > 0, F.col("alpha") > 0).otherwise(F.col("alpha") < F.col("cost"))
    known = state.filter("s is not null")
    r = known.agg(F.avg(F.when(free, g)).alias("free"), F.max(F.when(up, g)).alias("high"), F.min(F.when(low, g)).alias("low"), F.sum("alpha").alias("a"),
                  F.sum(F.col("alpha") * F.col("s") * F.col("f")).alias("norm")).first()
    if len(counts) == 2:
        offset = r["free"] if r["free"] is not None else (r["high"] + r["low"]) / 2
    else:
        offset = 1.0 if 1 in counts else -1.0
    norm, a = max(0.0, r["norm"] or 0.0), r["a"] or 0.0
    loss = known.agg(F.sum(F.col("cost") * F.greatest(F.lit(0.0), 1.0 - F.col("s") * (F.col("f") + F.lit(offset))))).first()[0] or 0.0
    score = F.col("f") + F.lit(offset)
    names = [c for c in state.columns if c not in ("row", "s", "x", "alpha", "f", "cost")]
    rows = state.select(*names, ((F.col("s") + 1) / 2).cast("int").alias("y"), "alpha", "cost", score.alias("score"), (score > 0).cast("int").alias("pred"))
    primal = norm / 2 + loss
    return DualModel(rows, float(offset), norm, primal, primal - (a - norm / 2), rounds, kernel)
