"""Bootstrap resamples as large as the table (inventory F20, G15): all replicates in one pass, by a splitting tree.

A resample of n rows out of n gives every row a multiplicity; together they are multinomial. They are drawn without listing a draw: the rows lie in blocks by
a hash of their key, and the draws of a node of the binary tree over blocks fall to its left half by a binomial number whose random source is seeded by the node. A block
follows its own path from the root, so tasks agree on every node without talking, totals are exact, and lost tasks draw the same numbers again. Inside
a block, strips of rows take their share one after another, and rows of a strip theirs by a multinomial.

Statistics that are sums over rows come from one pass: multiplicities of all replicates (replicates x rows of a strip) times the rows' columns is a matrix product, and
only ``replicates x columns`` sums leave a task. Equal keys are told apart by nothing: their rows are exchangeable.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.trainer import ADDING, _added
from tarnfold.session import cut_lineage

#: Rows of a block while there are at most ``MOST_BLOCKS``; rows of a strip, and rows whose columns are held at a time.
BLOCK_ROWS, MOST_BLOCKS, STRIP, ROWS = 16_384, 1 << 20, 2_048, 256


class Tree:
    """Draws of blocks and rows: numbers only, so it travels to the tasks."""

    def __init__(self, sizes: np.ndarray, replicates: int, seed: int):
        self.blocks, self.before, self.replicates, self.seed = len(sizes), np.concatenate([[0], np.cumsum(sizes)]), replicates, seed
        self.n = int(self.before[-1])

    def draws_of(self, block: int) -> np.ndarray:
        """Draws that fall into a block, for every replicate."""
        low, high, draws = 0, self.blocks, np.full(self.replicates, self.n, np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            whole, left = self.before[high] - self.before[low], self.before[middle] - self.before[low]
            to_left = np.random.default_rng([self.seed, low, high]).binomial(draws, left / whole) if whole else draws * 0
            low, high, draws = (low, middle, to_left) if block < middle else (middle, high, draws - to_left)
        return draws

    def strips(self, block: int, n: int):
        """(rows, multiplicities: replicates x rows) of the strips of a block of ``n`` rows in their order."""
        draws, random = self.draws_of(block), np.random.default_rng([self.seed, block, self.blocks, 1])
        for k in range(0, n, STRIP):
            size = min(STRIP, n - k)
            here = random.binomial(draws, size / (n - k))
            draws = draws - here
            yield slice(k, k + size), np.stack([random.multinomial(d, np.full(size, 1.0 / size)) for d in here])

class Drawn:
    """Rows in blocks with the draws of every replicate: the same ones whatever the partitioning."""

    def __init__(self, df: DataFrame, key, replicates: int = 200, seed: int = 42, block_rows: int = BLOCK_ROWS):
        hashed = df.withColumn("_h", F.xxhash64(*key))
        self.blocks = min(MOST_BLOCKS, max(1, -(-hashed.count() // block_rows)))
        self.rows = cut_lineage(hashed.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_h"), F.lit(self.blocks)).cast("int")))
        sizes = np.zeros(self.blocks, np.int64)
        for b, c in self.rows.groupBy("_block").agg(F.count(F.lit(1))).toLocalIterator():
            sizes[b] = c
        self.tree = Tree(sizes, replicates, seed)

    def sums(self, columns: Callable, *needed: str) -> np.ndarray:
        """replicates x columns: for every replicate the sum over rows of multiplicity times ``columns(table)``, a matrix of a row for each table row."""
        tree = self.tree

        def run(table: pa.Table) -> pa.Table:
            order = table.take(pa.array(np.argsort(table.column("_h").to_numpy(), kind="stable")))
            total = 0.0
            for at, times in tree.strips(int(order.column("_block")[0].as_py()), order.num_rows):
                for k in range(at.start, at.stop, ROWS):  # columns of few rows at a time: they may be thousands
                    size = min(ROWS, at.stop - k)
                    total = total + times[:, k - at.start:k - at.start + size] @ columns(order.slice(k, size))
            return pa.table({"key": pa.array([0], pa.int64()), "sums": pa.array([np.ravel(total)], pa.list_(pa.float64())), "tops": pa.array([[]], pa.list_(pa.float64()))})

        found = _added(self.rows.select("_h", "_block", *needed).groupBy("_block").applyInArrow(run, ADDING))
        return found[0][1].reshape(tree.replicates, -1) if found else np.zeros((tree.replicates, 0))

    def multiplicities(self, *keep: str) -> DataFrame:
        """(replicate, times, keep columns) of the rows drawn at least once."""
        tree, types = self.tree, {f.name: f.dataType.simpleString() for f in self.rows.schema.fields}

        def run(table: pd.DataFrame) -> pd.DataFrame:
            table = table.sort_values("_h", kind="stable")
            out = []
            for at, times in tree.strips(int(table["_block"].iloc[0]), len(table)):
                replicate, row = np.nonzero(times)
                out.append(table.iloc[at].iloc[row][list(keep)].assign(replicate=replicate.astype(np.int32), times=times[replicate, row]))
            return pd.concat(out)[["replicate", "times", *keep]]

        return self.rows.select("_h", "_block", *keep).groupBy("_block").applyInPandas(run, ", ".join(["replicate int, times long", *(f"{c} {types[c]}" for c in keep)]))


def percentile_rows(spark, values: dict, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(statistic, mean, std, low, high) of the replicates of every statistic; replicates without a value are left out."""
    rows = []
    for name, v in values.items():
        v = np.asarray(v, float)
        v = v[np.isfinite(v)]
        rows.append((name, *map(float, (v.mean(), v.std(), *np.quantile(v, [low, high])))) if len(v) else (name, None, None, None, None))
    return spark.createDataFrame(rows, "statistic string, mean double, std double, low double, high double")


def mean_intervals(drawn: Drawn, names: list) -> DataFrame:
    """Intervals of the means of numeric columns; a null counts in neither the sum nor the number."""
    def columns(table):
        x = np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
        return np.hstack([np.nan_to_num(x), np.isfinite(x)])

    s = drawn.sums(columns, *names)
    if not s.size:
        return percentile_rows(drawn.rows.sparkSession, {c: [] for c in names})
    with np.errstate(divide="ignore", invalid="ignore"):
        means = s[:, :len(names)] / s[:, len(names):]
    return percentile_rows(drawn.rows.sparkSession, dict(zip(names, means.T)))


def linear_kernel_values(sums: np.ndarray, dim: int) -> dict:
    """Alignment and centered alignment (CKA) with the labels, and effective rank, of the linear kernel of every resample, from its sums of n, s, x, s x and x xT."""
    n, s = sums[:, 0], sums[:, 1]
    x, sx, xx = sums[:, 2:2 + dim], sums[:, 2 + dim:2 + 2 * dim], sums[:, 2 + 2 * dim:].reshape(-1, dim, dim)
    trace, square = np.trace(xx, axis1=1, axis2=2), np.sqrt((xx * xx).sum(axis=(1, 2)))
    centered = xx - x[:, :, None] * x[:, None, :] / n[:, None, None]
    signed = sx - x * (s / n)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"alignment": (sx * sx).sum(axis=1) / (square * n), "cka": (signed * signed).sum(axis=1) / (np.sqrt((centered * centered).sum(axis=(1, 2))) * (n - s * s / n)),
                "effective_rank": trace ** 2 / square ** 2}


def linear_kernel_intervals(drawn: Drawn, vector: str, label: str, dim: int) -> DataFrame:
    """Intervals of ``linear_kernel_values``; ``label`` is 0 or 1. No kernel matrix is formed."""
    def columns(table):
        x = table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        s = 2.0 * table.column(label).to_numpy() - 1
        return np.hstack([np.ones((len(x), 1)), s[:, None], x, s[:, None] * x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)])

    sums = drawn.sums(columns, vector, label)
    return percentile_rows(drawn.rows.sparkSession, linear_kernel_values(sums, dim) if sums.size else {c: [] for c in ("alignment", "cka", "effective_rank")})
