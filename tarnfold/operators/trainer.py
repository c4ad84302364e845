"""Many pipelines and max-margin classifiers in one plan (inventory E8, F5, F7, H7, H11, K2, K3).

A study fits the same kind of model for every run, fold, size and setting. Here rows are dealt to parts once (a fold, a run, a step of a size
ladder), and a model is a ``Design``: the parts it learns from, its penalty, and an affine map from features to model inputs.

* ``part_moments`` reads the table once and returns sums, products and ranges of every (part, class). Min-max, ANOVA selection and PCA of
  any set of parts follow from them by addition, so refitting them for each fold and setting reads nothing again.
* ``fit_designs`` moves all models together: a round is one pass over the kept rows, packed in blocks of raw numbers, in which every task adds up value, gradient and
  curvature of each model still moving, and one aggregate by model. Rounds are those of the slowest model; their number does not depend on
  how many models there are. Steps are Newton steps with halving.
* ``test_designs`` scores rows of the parts a model is tested on and returns its confusion cells, counted in the tasks.

What reaches the driver are numbers of models, inputs and parts (models x inputs ** 2), never rows; ``LARGEST`` bounds it.

The loss is the hinge, smoothed within ``width`` of its corner; the width shrinks in steps to ``WIDTHS[-1]``. Multipliers read off the smoothed loss are
feasible for the dual, so every fit carries a duality gap: a proof of how far its hinge objective can be from the best one. Rows with a null vector,
label or part take no part. A model without rows, or with rows of one class only, has no weights and predicts that class (0 without rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.moments import vector_summary
from tarnfold.session import cut_lineage

WIDTHS = (2.0, 0.3, 0.05, 0.01)
#: Shorter steps whose values are measured together with the whole step.
LINE = (0.8, 0.6, 0.45, 0.3, 0.2, 0.1, 0.05, 0.02, 0.005, 0.001)
#: Numbers of one round, or of the moments, that may reach the driver.
LARGEST = 1 << 27
#: Task results are added up in this many groups first; those of at most so many numbers are fetched as they are.
SALTS, AT_ONCE = 32, 1 << 22


def study_rows(df: DataFrame, vector: str, label: str, part: str, *keep: str) -> DataFrame:
    """(part, y, x, keep columns), written once."""
    rows = df.select(F.col(part).cast("int").alias("part"), F.col(label).cast("int").alias("y"), F.col(vector).cast("array<double>").alias("x"), *keep)
    return cut_lineage(rows.filter("part is not null and y is not null and x is not null"))


def _inputs(batch: pa.RecordBatch):
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return batch.column("part").to_numpy(), batch.column("y").to_numpy(), flat.reshape(batch.num_rows, -1)


#: Rows and bytes of a packed block, and rows that a round works on at a time.
PACKED_ROWS, PACKED_BYTES, CHUNK = 16_384, 1 << 20, 4_096


def packed(rows: DataFrame, mapped: Callable | None = None) -> DataFrame:
    """(part, y, x) of ``study_rows`` as blocks of raw numbers, written once: rounds read memory instead of converting lists row by row. ``mapped`` is applied to
    the matrix of inputs on the way. Tables of fewer partitions than the cluster has cores are dealt again, by blocks."""
    def block(held):
        part, y, x = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (part.astype("<i4"), y.astype("<i1"), np.ascontiguousarray(x, "<f8"))], ["part", "y", "x"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part, y, x = _inputs(batch)
            step = max(1, min(PACKED_ROWS, PACKED_BYTES // (8 * max(1, x.shape[1]))))
            for k in range(0, len(y), step):
                piece = x[k:k + step] if mapped is None else mapped(x[k:k + step])
                held.append((part[k:k + step], y[k:k + step], piece))
                n += piece.size + 1
                if 8 * n >= PACKED_BYTES:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    blocks = rows.select("part", "y", "x").mapInArrow(run, "part binary, y binary, x binary")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(blocks.repartition(cores) if rows.rdd.getNumPartitions() < cores else blocks)


def _blocks(batches):
    """(part, y, x) of the chunks of ``packed`` rows."""
    for batch in batches:
        for row in range(batch.num_rows):
            part, y, x = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in (("part", "<i4"), ("y", "<i1"), ("x", "<f8")))
            x = x.reshape(len(y), -1)
            for k in range(0, len(y), CHUNK):
                yield part[k:k + CHUNK], y[k:k + CHUNK], x[k:k + CHUNK]


def _added(df: DataFrame, numbers: int | None = None) -> list:
    """(key, sums, tops) of rows (key, sums, tops): arrays added and maximized by key, in two steps so that no group has a row for each task. Where all rows together are known
    to hold few ``numbers``, they are added here, task by task, without a shuffle."""
    if numbers is not None and numbers <= AT_ONCE:
        out, found = df.select("key", "sums", "tops").toArrow(), {}
        for k, *own in zip(*(out.column(c) for c in ("key", "sums", "tops"))):
            s, t = (np.asarray(a.values, float) for a in own)
            old = found.get(k.as_py())
            found[k.as_py()] = (s, t) if old is None else (old[0] + s, np.maximum(old[1], t))
        return [(k, s, t) for k, (s, t) in found.items()]
    schema = "key long, salt int, sums array<double>, tops array<double>"

    def add(t: pa.Table) -> pa.Table:
        sums, tops = (np.asarray(t.column(c).combine_chunks().flatten()).reshape(t.num_rows, -1) for c in ("sums", "tops"))
        top = tops.max(axis=0) if tops.shape[1] else np.zeros(0)
        return pa.table({"key": t.column("key").slice(0, 1), "salt": pa.array([0], pa.int32()), "sums": pa.array([sums.sum(axis=0)], pa.list_(pa.float64())),
                         "tops": pa.array([top], pa.list_(pa.float64()))})

    dealt = df.select("key", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "sums", "tops")
    out = dealt.groupBy("key", "salt").applyInArrow(add, schema).groupBy("key").applyInArrow(add, schema).toArrow()
    return [(k, np.array(s, float), np.array(t, float)) for k, s, t in zip(*(out.column(c).to_pylist() for c in ("key", "sums", "tops")))]


def _sums_batch(found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s for s, _ in found.values()], pa.list_(pa.float64())),
                                       pa.array([t for _, t in found.values()], pa.list_(pa.float64()))], ["key", "sums", "tops"])


ADDING = "key long, sums array<double>, tops array<double>"


@dataclass
class Moments:
    """Of each (part, class): n, sums and products of x - base, and ranges of x."""

    base: np.ndarray
    cells: dict

    def of(self, parts: Iterable[int]):
        """n, sums and products by class of a set of parts, and ranges."""
        dim, chosen = len(self.base), set(parts)
        n, sums, cross = np.zeros(2), np.zeros((2, dim)), np.zeros((2, dim, dim))
        low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
        for (part, y), (count, s, c, lo, hi) in self.cells.items():
            if part in chosen:
                n[y] += count
                sums[y] += s
                cross[y] += c
                low, high = np.minimum(low, lo), np.maximum(high, hi)
        return n, sums, cross, low, high

    @property
    def parts(self) -> list:
        return sorted({p for p, _ in self.cells})


def part_moments(rows: DataFrame) -> Moments:
    """Moments of every part of ``study_rows``, in one pass after that of the mean."""
    mean = vector_summary(rows, "x").first()
    base = np.array(mean["mean"] if mean is not None and mean["mean"] is not None else [], float)
    dim = len(base)

    def run(batches):
        found = {}
        for b in batches:
            if not b.num_rows:
                continue
            part, y, x = _inputs(b)
            keys = part.astype(np.int64) * 2 + y
            for key in np.unique(keys):
                own = x[keys == key]
                z = own - base
                s = np.concatenate([[len(own)], z.sum(axis=0), (z.T @ z).ravel()])
                t = np.concatenate([own.max(axis=0), -own.min(axis=0)])
                old = found.get(int(key))
                found[int(key)] = (s, t) if old is None else (old[0] + s, np.maximum(old[1], t))
        if found:
            yield _sums_batch(found)

    cells = {}
    for key, s, t in _added(rows.select("part", "y", "x").mapInArrow(run, ADDING)):
        cells[(key // 2, key % 2)] = (s[0], s[1:dim + 1], s[dim + 1:].reshape(dim, dim), -t[dim:], t[:dim])
    return Moments(base, cells)


# --- maps fitted from moments -----------------------------------------------------------------------------------

def anova_order(moments: Moments, parts) -> np.ndarray:
    """Positions by falling ANOVA F on the parts; equal ones by position, undefined ones last."""
    n, sums, cross, _, _ = moments.of(parts)
    mean = sums.sum(axis=0) / max(1.0, n.sum())
    between = sum(n[k] * (sums[k] / max(1.0, n[k]) - mean) ** 2 for k in (0, 1))
    within = sum(np.diagonal(cross[k]) - sums[k] ** 2 / max(1.0, n[k]) for k in (0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where(within > 0, between / within, np.where(between > 0, np.inf, -1.0)) if n.min() > 0 else np.full(len(mean), -1.0)
    return np.lexsort((np.arange(len(f)), -f))


def principal_axes(moments: Moments, parts, positions, n: int | None = None, variance: float | None = None):
    """(axes of all features x components, mean projected) of a PCA on some positions; each axis has its largest loading positive."""
    count, sums, cross, _, _ = moments.of(parts)
    total, at = max(1.0, count.sum()), np.asarray(positions)
    mean = sums.sum(axis=0)[at] / total
    values, vectors = np.linalg.eigh(cross.sum(axis=0)[np.ix_(at, at)] / total - np.outer(mean, mean))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if variance is not None:
        shares = np.cumsum(values) / max(values.sum(), 1e-300)
        n = int(np.argmax(shares >= variance - 1e-12)) + 1
    vectors = vectors[:, :n or len(values)]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    axes = np.zeros((len(moments.base), vectors.shape[1]))
    axes[at] = vectors
    return axes, -(moments.base[at] + mean) @ vectors


def chosen(moments: Moments, positions):
    """(axes, shift) that only picks positions."""
    return np.eye(len(moments.base))[:, list(positions)], np.zeros(len(list(positions)))


def scaled(moments: Moments, parts, positions):
    """(axes, shift) of a min-max map to [0, 1] fitted on the parts; a constant feature becomes zero."""
    _, _, _, low, high = moments.of(parts)
    at = list(positions)
    with np.errstate(invalid="ignore"):
        span = (high - low)[at]
    factor = np.where(np.isfinite(span) & (span > 0), 1.0 / np.where(span > 0, span, 1.0), 0.0)
    return np.eye(len(moments.base))[:, at] * factor, -np.where(np.isfinite(low[at]), low[at], 0.0) * factor


@dataclass
class Design:
    """A model to fit: its names, the parts it learns from, penalty, and inputs x @ axes + shift."""

    name: dict
    learns: frozenset
    axes: np.ndarray
    shift: np.ndarray
    c: float = 1.0
    balanced: bool = False
    limits: tuple | None = None  # inputs are clipped to these


@dataclass
class Fit:
    design: Design
    w: np.ndarray
    b: float
    objective: float = 0.0  # |w|^2 / 2 + C sum hinge
    gap: float = 0.0  # the objective is at most this much above the best one
    rounds: int = 0
    only: int | None = None  # the class of all rows, if there is one only
    corner: float = 0.0  # width of the smoothing at the end

    @property
    def width(self) -> float:
        """Distance between the margins, 2 / |w|."""
        norm = float(np.linalg.norm(self.w))
        return 2.0 / norm if norm > 0 else float("inf")


def input_ranges(rows: DataFrame, designs: list) -> list:
    """(least, largest) inputs of every design over the parts it learns from: one pass for all."""
    def run(batches):
        found = {}
        for b in batches:
            if not b.num_rows:
                continue
            part, _, x = _inputs(b)
            for k, d in enumerate(designs):
                own = x[np.isin(part, list(d.learns))]
                if len(own):
                    p = own @ d.axes + d.shift
                    t = np.concatenate([p.max(axis=0), -p.min(axis=0)])
                    found[k] = (np.zeros(1), np.maximum(found[k][1], t) if k in found else t)
        if found:
            yield _sums_batch(found)

    out = [(np.zeros(d.axes.shape[1]), np.zeros(d.axes.shape[1])) for d in designs]
    for k, _, t in _added(rows.mapInArrow(run, ADDING)):
        size = len(t) // 2
        out[k] = (-t[size:], t[:size])
    return out


def to_angles(rows: DataFrame, designs: list, high: float = np.pi, clipped: bool = True) -> list:
    """The designs with their inputs mapped to [0, high] by the range over the parts they learn from."""
    out = []
    for d, (lo, hi) in zip(designs, input_ranges(rows, designs)):
        factor = np.where(hi > lo, high / np.where(hi > lo, hi - lo, 1.0), 0.0)
        out.append(Design(d.name, d.learns, d.axes * factor, (d.shift - lo) * factor, d.c, d.balanced, (0.0, high) if clipped else None))
    return out


def _project(x: np.ndarray, design: Design) -> np.ndarray:
    same = design.axes.shape[0] == design.axes.shape[1] and not design.shift.any() and np.array_equal(design.axes, np.eye(len(design.axes)))
    p = x if same else x @ design.axes + design.shift
    return np.clip(p, *design.limits) if design.limits else p


def smooth(u: np.ndarray, width: float) -> np.ndarray:
    """max(u, 0) with its corner rounded within ``width``."""
    at = np.minimum(np.maximum(u, 0.0), width)
    return at * (u - 0.5 * at) / width


def smooth_sum(u: np.ndarray, cost: np.ndarray, width: float) -> float:
    """``cost`` times ``smooth``, added up; ``u`` is overwritten."""
    at = np.maximum(u, 0.0)
    np.minimum(at, width, out=at)
    u -= 0.5 * at
    at *= cost
    return float(at @ u) / width


def _round(blocks: DataFrame, trials: list) -> dict:
    """{model: (values of the smoothed loss along the step, its value, that of the hinge, sum of multipliers, rows in the corner, gradient, curvature)} of the trials (model,
    design, start, step, length, costs by class, width), at the length."""
    def run(batches):
        found = {}
        for part, y, x in _blocks(batches):
            sign, held, low, high = 2.0 * y - 1.0, {}, part.min(), part.max()
            for k, design, start, step, length, costs, width in trials:
                if low == high:
                    own = slice(None) if low in design.learns else None
                else:
                    own = np.isin(part, list(design.learns))
                    own = own if own.any() else None
                if own is None:
                    continue
                if id(design.axes) not in held:
                    held[id(design.axes)] = np.hstack([_project(x, design), np.ones((len(x), 1))])
                p, s = held[id(design.axes)][own], sign[own]
                cost = np.where(s > 0, costs[1], costs[0])
                first, change = 1.0 - s * (p @ start), -s * (p @ step)
                u = first + length * change
                above = np.maximum(u, 0.0)
                slope = np.minimum(above, width) * (cost / width)
                line = [smooth_sum(first + t * change, cost, width) for t in LINE]
                band = np.flatnonzero((u > 0) & (u < width))
                q = p[band]
                stats = np.concatenate([line, [smooth_sum(u, cost, width), cost @ above, slope.sum(), len(band)], -((slope * s) @ p), ((q * (cost[band] / width)[:, None]).T @ q).ravel()])
                found[k] = (found[k][0] + stats if k in found else stats, np.zeros(0))
        if found:
            yield _sums_batch(found)

    out, each = {}, sum(len(LINE) + 4 + len(start) * (len(start) + 1) for _, _, start, *_ in trials)
    for k, s, _ in _added(blocks.mapInArrow(run, ADDING), each * blocks.rdd.getNumPartitions()):
        line, (value, hinge, multipliers, corner), rest = s[:len(LINE)], s[len(LINE):len(LINE) + 4], s[len(LINE) + 4:]
        size = round(((4 * len(rest) + 1) ** 0.5 - 1) / 2)  # the gradient and its square
        out[k] = (line, value, hinge, multipliers, int(corner), rest[:size], rest[size:].reshape(size, size))
    return out


@dataclass
class _Moving:
    """A model on its way: the accepted point, the step tried from it, and the stage of the smoothing."""

    at: np.ndarray
    step: np.ndarray
    length: float = 0.0
    value: float = np.inf
    slope: float = 0.0
    stage: int = 0
    rounds: int = 0
    settled: bool = True  # the length is the one to take
    corner: int = 0  # rows within the smoothing at the accepted point


def fit_designs(rows: DataFrame, moments: Moments, designs: list, tol: float = 1e-9, most: int = 300, widths=WIDTHS, mapped: Callable | None = None, few: int = -1) -> list:
    """A ``Fit`` for every design. ``most`` bounds the rounds; models that still move then say so by their gap. ``widths`` are the stages of the smoothing, of which the last is
    the first that leaves at most ``few`` rows within its corner; ``mapped`` goes before the designs' own maps."""
    if sum((d.axes.shape[1] + 1) ** 2 for d in designs) > LARGEST:
        raise ValueError("too many inputs for curvature matrices; use fit_margin, which keeps gradients only")
    fits, moving, costs, weight = [], {}, {}, {}
    for k, d in enumerate(designs):
        n = moments.of(d.learns)[0]
        only = None if n.min() > 0 else int(n[1] > n[0])
        fits.append(Fit(d, np.zeros(d.axes.shape[1]), 0.0, only=only))
        if only is None:
            costs[k] = d.c * (n.sum() / (2 * n) if d.balanced else np.ones(2))
            weight[k] = float(costs[k] @ n)
            moving[k] = _Moving(np.zeros(d.axes.shape[1] + 1), np.zeros(d.axes.shape[1] + 1))
    blocks = packed(rows, mapped) if moving else None
    for _ in range(most):
        if not moving:
            break
        stats = _round(blocks, [(k, designs[k], m.at, m.step, m.length, costs[k], widths[m.stage]) for k, m in moving.items()])
        for k, m in list(moving.items()):
            line, loss, hinge, multipliers, corner, gradient, curvature = stats[k]
            m.rounds += 1
            point = m.at + m.length * m.step
            half = 0.5 * float(point[:-1] @ point[:-1])
            if not m.settled:  # is a shorter step better than the whole one?
                values = np.array([half + loss, *(v + 0.5 * float(w @ w) for v, w in zip(line, (m.at[:-1] + t * m.step[:-1] for t in LINE)))])
                best = int(values.argmin())
                m.settled = True
                if best and m.value - values[0] < 0.9 * (m.value - values[best]):
                    m.length = LINE[best - 1]
                    continue
            moved = m.value - half - loss
            if moved < 0 and m.length > 1e-9:
                m.length *= 0.25 * LINE[-1] if m.length == 1.0 else 0.25
                continue
            if moved < 0:  # no step goes down: as good as rounding lets it be
                point, moved = m.at, 0.0
            else:
                gradient = gradient + np.append(point[:-1], 0.0)
                # the offset has a curvature even where no row is near a corner
                curvature = curvature + np.diag(np.append(np.ones(len(point) - 1), 1e-4 * weight[k]))
                m.step = -np.linalg.solve(curvature, gradient)
                rest = point[:-1] - gradient[:-1]  # the weights that the multipliers give
                m.at, m.length, m.value, m.slope, m.settled, m.corner = point, 1.0, half + loss, float(gradient @ m.step), False, corner
                fits[k] = Fit(designs[k], point[:-1], float(point[-1]), half + hinge, max(0.0, half + hinge - multipliers + 0.5 * float(rest @ rest) + abs(gradient[-1]) * (1 + abs(point[-1]))), m.rounds, corner=widths[m.stage])
            last = m.stage + 1 == len(widths) or m.corner <= few
            if -m.slope <= (tol if last else 1e-3) * max(abs(m.value), 1e-12) or moved <= 1e-14 * abs(m.value):
                if last:
                    del moving[k]
                else:
                    m.stage, m.length, m.value, m.settled = m.stage + 1, 0.0, np.inf, True
    return fits


def test_designs(rows: DataFrame, fits: list, tested: Callable, by_part: bool = False) -> DataFrame:
    """Confusion cells tn, fp, fn, tp of every fit over the parts ``tested(design)``, under the fits' names; with ``by_part`` a row for each part."""
    names = list(fits[0].design.name)
    parts_of = [sorted(tested(f.design)) for f in fits]

    def run(batches):
        counts = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part, y, x = _inputs(batch)
            for k, f in enumerate(fits):
                own = np.isin(part, parts_of[k])
                if not own.any():
                    continue
                pred = (_project(x[own], f.design) @ f.w + f.b > 0).astype(int) if f.only is None else np.full(own.sum(), f.only)
                at, n = np.unique(np.stack([part[own] if by_part else np.zeros(own.sum(), int), 2 * y[own] + pred]), axis=1, return_counts=True)
                for p, cell, c in zip(*at.tolist(), n.tolist()):
                    counts[k, p, cell] = counts.get((k, p, cell), 0) + c
        if counts:
            rows_ = [(*key, n) for key, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["model", "part", "cell", "n"])

    found = rows.mapInArrow(run, "model int, part int, cell int, n long")
    cells = found.groupBy("model", "part").agg(*[F.coalesce(F.sum(F.when(F.col("cell") == i, F.col("n"))), F.lit(0)).cast("long").alias(c) for i, c in enumerate(("tn", "fp", "fn", "tp"))])
    table = model_table(rows.sparkSession, fits).select("model", *names)
    return cells.join(F.broadcast(table), "model").select(*names, *(["part"] if by_part else []), "tn", "fp", "fn", "tp")


def model_table(spark, fits: list) -> DataFrame:
    """A row for every fit: model (its number), names, cost, w, b (as weights of the inputs), axes (row by row) and shift, objective, gap, rounds, only."""
    def kind(v):
        return "int" if isinstance(v, (int, np.integer)) else "double" if isinstance(v, float) else "string"

    names = list(fits[0].design.name)
    schema = ["model int"] + [f"{c} {kind(v)}" for c, v in fits[0].design.name.items()]
    schema += ["cost double", "w array<double>", "b double", "axes array<double>", "shift array<double>", "low double", "high double", "objective double", "gap double", "rounds int", "only int"]
    rows = [(k, *(f.design.name[c] for c in names), float(f.design.c), f.w.tolist(), float(f.b), f.design.axes.ravel().tolist(), f.design.shift.tolist(),
             *(map(float, f.design.limits) if f.design.limits else (None, None)), float(f.objective), float(f.gap), f.rounds, f.only) for k, f in enumerate(fits)]
    return spark.createDataFrame(rows, ", ".join(schema))


def fits_of(table: DataFrame, names: list) -> list:
    """The fits of a (reloaded) model table, in the order of their numbers; what they learnt from is not part of it."""
    out = []
    for r in table.orderBy("model").collect():
        shift = np.array(r["shift"], float)
        design = Design({c: r[c] for c in names}, frozenset(), np.array(r["axes"], float).reshape(-1, len(shift)), shift, r["cost"], limits=(r["low"], r["high"]) if r["low"] is not None else None)
        out.append(Fit(design, np.array(r["w"], float), r["b"], r["objective"], r["gap"], r["rounds"], r["only"]))
    return out


def score_designs(rows: DataFrame, fits: list, tested: Callable, *keep: str) -> DataFrame:
    """(names, part, y, score, pred, keep columns): every row of the parts a fit is tested on. Fits of one class score -1 or 1."""
    parts_of = [sorted(tested(f.design)) for f in fits]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            part, _, x = _inputs(batch)
            for k, f in enumerate(fits):
                own = np.isin(part, parts_of[k])
                if own.any():
                    kept = batch.filter(pa.array(own))
                    score = _project(x[own], f.design) @ f.w + f.b if f.only is None else np.full(own.sum(), 2.0 * f.only - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), k), pa.int32()), kept.column("part"), kept.column("y"), pa.array(score), pa.array((score > 0).astype(np.int32)),
                                                      *(kept.column(c) for c in keep)], ["model", "part", "y", "score", "pred", *keep])

    scored = rows.mapInArrow(run, ", ".join(["model int, part int, y int, score double, pred int", *(f"{c} {types[c]}" for c in keep)]))
    names = list(fits[0].design.name)
    return scored.join(F.broadcast(model_table(rows.sparkSession, fits).select("model", *names)), "model").select(*names, "part", "y", "score", "pred", *keep)


def fit_whole(df: DataFrame, vector: str, label: str, c: float = 1.0, balanced: bool = False, scale: bool = False, keep=()) -> tuple[Fit, DataFrame]:
    """One model of all rows, and its scores (y, score, pred, keep columns) of them."""
    rows = study_rows(df.withColumn("_part", F.lit(0)), vector, label, "_part", *keep)
    moments = part_moments(rows)
    learns, every = frozenset([0]), range(len(moments.base))
    design = Design({"model_name": "whole"}, learns, *(scaled(moments, learns, every) if scale else chosen(moments, every)), c, balanced)
    fit = fit_designs(rows, moments, [design])[0]
    return fit, score_designs(rows, [fit], lambda d: {0}, *keep).drop("model_name", "part")


def project_designs(rows: DataFrame, designs: list, tested: Callable, *keep: str) -> DataFrame:
    """(model, part, y, phi, keep columns): every row of the parts a design is tested on, as its inputs."""
    parts_of = [sorted(tested(d)) for d in designs]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            part, _, x = _inputs(batch)
            for k, d in enumerate(designs):
                own = np.isin(part, parts_of[k])
                if own.any():
                    kept = batch.filter(pa.array(own))
                    phi = _project(x[own], d)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, phi.shape[1]), pa.int32()), pa.array(phi.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(phi), k), pa.int32()), kept.column("part"), kept.column("y"), lists, *(kept.column(c) for c in keep)],
                                                     ["model", "part", "y", "phi", *keep])

    return rows.mapInArrow(run, ", ".join(["model int, part int, y int, phi array<double>", *(f"{c} {types[c]}" for c in keep)]))
