"""All rows against all rows of a table, block by block on Spark: no task holds more than two blocks, the driver none. Each unordered pair of blocks
is one group, and what it computes serves the rows of both.

Kernel statistics of the whole table follow from sums per row over all blocks, whatever the kernel and the class mix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.session import cut_lineage

#: Rows of a block while there are at most ``PIECES`` blocks; from there on blocks grow with the table, so that each row travels ``PIECES`` times,
#: up to ``BLOCK_BYTES`` of vectors, beyond which there are more blocks.
BLOCK, PIECES, BLOCK_BYTES = 2048, 32, 1 << 25
#: Rows and columns of a tile: pairs that are compared at a time.
STRIP, COLUMNS = 128, 1024


def numbered_rows(df: DataFrame, vector: str, *extra) -> DataFrame:
    """(_row, _v, extra columns) of the rows that have a vector, written once so that numbers stay."""
    rows = df.select(F.col(vector).cast("array<double>").alias("_v"), *extra).filter("_v is not null")
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("_row"), "*"))


def over_block_pairs(rows: DataFrame, run: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """Rows of ``run(left, right)`` for each unordered pair of blocks, ``left`` and ``right`` being column dictionaries with ``_v`` as a
    matrix. It returns columns for the rows of ``left`` and columns for those of ``right`` (not read where both are the same block); a caller adds
    them up by ``_row``."""
    names = rows.columns
    n, wide = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("_v")), F.lit(1))).first()
    pieces = max(1, min(-(-n // block), PIECES), -(-8 * n * wide // BLOCK_BYTES))
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64("_row"), F.lit(pieces)).cast("int")) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))) \
        .withColumns({"_first": F.least("_own", "_other"), "_second": F.greatest("_own", "_other")}).drop("_other")

    def part(table: pa.Table, keep: np.ndarray) -> dict:
        own = table.filter(pa.array(keep))
        out = {c: own.column(c).to_numpy() for c in names if c != "_v"}
        flat = own.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return out | {"_v": flat.reshape(own.num_rows, -1) if own.num_rows else np.zeros((0, 1))}

    def pair(table: pa.Table) -> pa.Table:
        own, first, second = (table.column(c).to_numpy() for c in ("_own", "_first", "_second"))
        a, b = part(table, own == first[0]), part(table, own == second[0])
        found = [run(a, a)[0]] if first[0] == second[0] else run(a, b) if len(a["_v"]) and len(b["_v"]) else []
        tables = [pa.table(x) for x in found]
        return pa.concat_tables(tables) if tables else pa.table({c: pa.array([], t) for c, t in kinds.items()})

    def kind(name: str):
        return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[name]

    kinds = {c.split()[0]: kind(c.split()[1]) for c in schema.split(", ")}
    return dealt.groupBy("_first", "_second").applyInArrow(lambda t: pair(t).select(list(kinds)).cast(pa.schema(list(kinds.items()))), schema)


def square_distances(left: np.ndarray, right: np.ndarray, product: bool = False):
    """(slice of left, slice of right, squared Euclidean distances, products on request) in tiles. Where the product form loses digits (near rows), the
    differences are squared themselves, so that equal rows have distance zero."""
    own, other, across = (left * left).sum(axis=1), (right * right).sum(axis=1), np.ascontiguousarray(right.T)
    most = [other[j:j + COLUMNS].max() for j in range(0, len(right), COLUMNS)]
    for k in range(0, len(left), STRIP):
        at = slice(k, min(k + STRIP, len(left)))
        for j, top in zip(range(0, len(right), COLUMNS), most):
            to = slice(j, min(j + COLUMNS, len(right)))
            out = left[at] @ across[:, to]
            kept = out.copy() if product else None
            out *= -2.0
            out += other[to]
            out += own[at, None]
            near = np.flatnonzero(~(out.min(axis=1) >= 1e-5 * (own[at] + top)))  # nothing is near in the other rows
            if len(near):
                i, col = np.nonzero(out[near] < 1e-5 * (own[at][near, None] + other[to]))
                i = near[i]
                for c in range(0, len(i), 1 << 16):
                    x, y = i[c:c + (1 << 16)], col[c:c + (1 << 16)]
                    out[x, y] = ((left[at][x] - right[to][y]) ** 2).sum(axis=1)
            yield at, to, out, kept


def kernel_strips(left: np.ndarray, right: np.ndarray, kernels):
    """(slice of left, slice of right, list of kernel values) in tiles, for kernels (kind, gamma, coef0) of kind "linear", "poly" (squared) or "rbf"."""
    products, radial = (any((kind == "rbf") == is_rbf for kind, _, _ in kernels) for is_rbf in (False, True))

    def value(kind, gamma, coef0, squares, product):
        if kind == "linear":
            return product
        out = -gamma * squares if kind == "rbf" else gamma * product
        if kind == "rbf":
            return np.exp(out, out=out)
        out += coef0
        return np.multiply(out, out, out=out)

    if radial:
        for at, to, squares, product in square_distances(left, right, products):
            yield at, to, [value(*kernel, squares, product) for kernel in kernels]
        return
    across = np.ascontiguousarray(right.T)
    for k in range(0, len(left), STRIP):
        for j in range(0, len(right), COLUMNS):
            at, to = slice(k, min(k + STRIP, len(left))), slice(j, min(j + COLUMNS, len(right)))
            product = left[at] @ across[:, to]
            yield at, to, [value(*kernel, None, product) for kernel in kernels]


#: Sums that ``kernel_sums`` takes of each kernel, and of the first two.
OF_ONE, OF_TWO = ("total", "squares", "signed", "same", "top"), ("cross", "gap", "gap_squares")


def by_class(block: dict) -> tuple[dict, int]:
    """The rows of a block with class 0 first, and their number."""
    order = np.argsort(block["y"] != 0, kind="stable")
    return {c: v[order] for c, v in block.items()}, int(np.count_nonzero(block["y"] == 0))


def kernel_sums(df: DataFrame, vector: str, label: str, kernels, keys=(), block: int = BLOCK, wanted=(*OF_ONE, *OF_TWO)) -> DataFrame:
    """A row for each row: ``keys``, y (0 or 1), n and, for kernel m, sums over all rows: total{m}, squares{m}, signed{m} (times the other's -1 or 1),
    same{m} (rows of its class, n_same of them), top{m} the largest value and self{m} its own. cross is the sum of products of the
    first two kernels, gap and gap_squares those of their absolute and squared differences. Of these sums only ``wanted`` ones are taken.
    A value serves both of its rows, so each unordered pair is computed once."""
    rows = numbered_rows(df, vector, F.col(label).cast("int").alias("y"), *keys)
    columns = [f"{c}{m}" for m in range(len(kernels)) for c in OF_ONE if c in wanted] + [c for c in OF_TWO if c in wanted and len(kernels) > 1]
    classes = {"total", "signed", "same"} & set(wanted)

    def sums(left, right):
        # class sums are those of slices: every block has its class 0 first
        (left, zeros), (right, others) = by_class(left), by_class(right)
        sides = [{c: np.full(len(x["_v"]), -np.inf) if c.startswith("top") else np.zeros(len(x["_v"])) for c in columns} for x in (left, right)]
        halves = [np.zeros((len(kernels), 2, len(x["_v"]))) for x in (left, right)]

        def add(name, of_left, of_right, at, to):
            sides[0][name][at] += of_left
            sides[1][name][to] += of_right

        for at, to, values in kernel_strips(left["_v"], right["_v"], kernels):
            row, col = min(max(zeros - at.start, 0), at.stop - at.start), min(max(others - to.start, 0), to.stop - to.start)
            for m, k in enumerate(values):
                if classes:
                    for y, (r, c) in enumerate(((slice(0, row), slice(0, col)), (slice(row, None), slice(col, None)))):
                        halves[0][m, y, at] += k[:, c].sum(axis=1)
                        halves[1][m, y, to] += k[r].sum(axis=0)
                if "squares" in wanted:
                    add(f"squares{m}", np.einsum("ij,ij->i", k, k), np.einsum("ij,ij->j", k, k), at, to)
                if "top" in wanted:
                    for side, place, most in ((sides[0], at, k.max(axis=1)), (sides[1], to, k.max(axis=0))):
                        side[f"top{m}"][place] = np.maximum(side[f"top{m}"][place], most)
            if len(values) > 1:
                a, b = values[:2]
                if "cross" in wanted:
                    add("cross", np.einsum("ij,ij->i", a, b), np.einsum("ij,ij->j", a, b), at, to)
                if {"gap", "gap_squares"} & set(wanted):
                    gap = a - b
                    if "gap_squares" in wanted:
                        add("gap_squares", np.einsum("ij,ij->i", gap, gap), np.einsum("ij,ij->j", gap, gap), at, to)
                    if "gap" in wanted:
                        np.abs(gap, out=gap)
                        add("gap", gap.sum(axis=1), gap.sum(axis=0), at, to)
        found = []
        for own, side, half, other in ((left, sides[0], halves[0], right), (right, sides[1], halves[1], left)):
            for m in range(len(kernels)):
                for c, x in (("total", half[m, 0] + half[m, 1]), ("signed", half[m, 1] - half[m, 0]), ("same", np.where(own["y"] == 0, half[m, 0], half[m, 1]))):
                    if c in wanted:
                        side[f"{c}{m}"] = x
            matches = np.array([np.count_nonzero(other["y"] == 0), np.count_nonzero(other["y"] == 1)])
            found.append({"_row": own["_row"], "n": np.full(len(own["_row"]), len(other["y"])), "n_same": matches[own["y"]]} | side)
        return found

    met = over_block_pairs(rows.select("_row", "_v", "y"), sums, "_row long, n long, n_same long" + "".join(f", {c} double" for c in columns), block)
    added = met.groupBy("_row").agg(*[(F.max if c.startswith("top") else F.sum)(c).alias(c) for c in ["n", "n_same", *columns]])
    norm = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)
    selves = [(norm if kind == "linear" else (F.lit(gamma) * norm + F.lit(coef0)) ** 2 if kind == "poly" else F.lit(1.0)).alias(f"self{m}") for m, (kind, gamma, coef0) in enumerate(kernels)]
    return rows.select("*", *selves).drop("_v").join(added, "_row")


def whole_statistics(sums: DataFrame, m: int = 0) -> DataFrame:
    """One row of statistics of kernel ``m`` over all pairs, from ``kernel_sums``."""
    n, n1 = F.max("n").cast("double"), F.max("n").cast("double") * (F.max("n") - 1)
    total, squares, trace = F.sum(f"total{m}"), F.sum(f"squares{m}"), F.sum(f"self{m}")
    mean_off = (total - trace) / n1
    within = F.sum(f"same{m}") / F.sum("n_same")
    across = (total - F.sum(f"same{m}")) / F.sum(F.col("n") - F.col("n_same"))
    return sums.agg(F.max("n").alias("n"), (F.sum((2 * F.col("y") - 1) * F.col(f"signed{m}")) / (F.sqrt(squares) * n)).alias("alignment"),
                    (trace * trace / squares).alias("effective_rank"), within.alias("within"), across.alias("across"), mean_off.alias("mean_off"),
                    ((squares - F.sum(F.col(f"self{m}") ** 2)) / n1 - mean_off * mean_off).alias("var_off"), F.min(f"self{m}").alias("min_self"))


def whole_cka(sums: DataFrame) -> DataFrame:
    """Centered alignment of the first two kernels."""
    def hsic(product, a, b):
        n = F.max("n").cast("double")
        return F.sum(product) - 2.0 / n * F.sum(F.col(a) * F.col(b)) + F.sum(a) * F.sum(b) / (n * n)

    parts = sums.agg(hsic("cross", "total0", "total1").alias("ab"), hsic("squares0", "total0", "total0").alias("aa"), hsic("squares1", "total1", "total1").alias("bb"))
    return parts.select((F.col("ab") / (F.sqrt("aa") * F.sqrt("bb"))).alias("cka"))


def whole_difference(sums: DataFrame) -> DataFrame:
    """Cosine, scaled distance, mean absolute and root mean square difference of the first two kernels."""
    pairs = F.max("n").cast("double") * F.max("n")
    return sums.agg((F.sum("cross") / (F.sqrt(F.sum("squares0")) * F.sqrt(F.sum("squares1")) + F.lit(1e-12))).alias("cosine"),
                    (F.sqrt(F.sum("gap_squares")) / pairs).alias("distance"), (F.sum("gap") / pairs).alias("mae"), F.sqrt(F.sum("gap_squares") / pairs).alias("rmse"))


def centered_sums(df: DataFrame, vector: str, label: str, kernel, key: str, block: int = BLOCK) -> DataFrame:
    """(key, squares, top) of each row of the doubly centered kernel: the rows' means first, then the blocks once more."""
    vector_again = F.col(vector).cast("array<double>").alias("_w")
    rows = cut_lineage(kernel_sums(df, vector, label, [kernel], [F.col(key).alias("_key"), vector_again], block, ["total"])
                       .select("_row", "_key", F.col("_w").alias("_v"), (F.col("total0") / F.col("n")).alias("mean")))
    grand = rows.agg(F.avg("mean")).first()[0] or 0.0

    def centered(left, right):
        found = [{"_row": x["_row"], "squares": np.zeros(len(x["_v"])), "top": np.full(len(x["_v"]), -np.inf)} for x in (left, right)]
        for at, to, (k,) in kernel_strips(left["_v"], right["_v"], [kernel]):
            k -= left["mean"][at, None]
            k -= right["mean"][to] - grand
            for out, place, squares, most in ((found[0], at, np.einsum("ij,ij->i", k, k), k.max(axis=1)), (found[1], to, np.einsum("ij,ij->j", k, k), k.max(axis=0))):
                out["squares"][place] += squares
                out["top"][place] = np.maximum(out["top"][place], most)
        return found

    met = over_block_pairs(rows.select("_row", "_v", "mean"), centered, "_row long, squares double, top double", block)
    return met.groupBy("_row").agg(F.sum("squares").alias("squares"), F.max("top").alias("top")).join(rows.select("_row", "_key"), "_row").select(F.col("_key").alias(key), "squares", "top")
