"""Embedding near-duplicates with a pivot-permutation index (operator 7).

Reference points (pivots) are drawn among the distinct unit vectors, a bounded documented sample: the ``pivots`` first by a hash.
A vector is described by its ``near`` nearest pivots in order; vectors that are close share most of them. The index is an
inverted list for every pair of pivots, so that a list's two members share two pivots at least, and grows with the table:
every vector is in ``near * (near - 1) / 2`` lists. Members of a list are verified by their cosine in double precision. A long
list is cut into pieces that meet pairwise, so no task holds more than two pieces; a pair found in several lists counts in the
first list only, by the two lowest pivots it shares. Lists return link counts and spanning links, never all pairs.

Equal vectors are first joined into one class, whose members link with each other. Vectors that are null, zero, of no length or
hold null or non-finite components link with nothing. Cosines are those of the components as doubles. Each row keeps its own row;
rows of a repeated id count as vectors of their own. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import connected_components, keep, table, width

#: Dimensions whose links are written together, so that plans stay short.
TOGETHER = 50


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / np.where(top > 0, top, 1)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """Numbers of the nearest pivots of each unit vector, nearest first; equal distances by number."""
    close = rows @ pivots.T
    near = min(near, pivots.shape[0])
    first = np.argpartition(-close, near - 1, axis=1)[:, :near]
    order = np.lexsort((first, -np.take_along_axis(close, first, 1)), axis=1)
    return np.take_along_axis(first, order, 1)


def shared_first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For aligned rows of sorted pivot numbers: low * 65536 + next of the two lowest numbers each pair shares."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    order = np.argsort(~both, axis=1, kind="stable")[:, :2]
    two = np.take_along_axis(a, order, 1)
    return two[:, 0].astype(np.int64) * 65536 + two[:, 1]


def list_links(key: int, ids: np.ndarray, rows: np.ndarray, prefix: np.ndarray, size: np.ndarray, piece: np.ndarray, first: int, second: int,
               least: float, block: int = 256):
    """Of the pairs between two pieces of list ``key``: links counted for each id (weighted by the other's class size), and
    spanning links. Pairs whose first list is another one are left to that list."""
    a = np.flatnonzero(piece == first)
    b = a if first == second else np.flatnonzero(piece == second)
    count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for k in range(0, len(a), block):
        part = a[k:k + block]
        i, j = np.nonzero(rows[part] @ rows[b].T >= least - 1e-9)
        i, j = part[i], b[j]
        own = i < j if first == second else np.ones(len(i), bool)
        i, j = i[own], j[own]
        for c in range(0, len(i), 100_000):  # candidates are verified in bounded portions
            x, y = i[c:c + 100_000], j[c:c + 100_000]
            good = (np.einsum("ij,ij->i", rows[x], rows[y]) >= least) & (shared_first(prefix[x], prefix[y]) == key)
            x, y = x[good], y[good]
            np.add.at(count, x, size[y])
            np.add.at(count, y, size[x])
            while len(x):  # hooks each link's higher root below the lower one
                low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
                open_ = low != high
                if not open_.any():
                    break
                x, y = x[open_], y[open_]
                np.minimum.at(root, high[open_], low[open_])
                while (root[root] != root).any():
                    root = root[root]
    linked = np.flatnonzero(root != np.arange(len(ids)))
    counted = np.flatnonzero(count)
    return ids[counted], count[counted], ids[linked], ids[root[linked]]


def near_vectors(rows: DataFrame, least: float = 0.95, pivots: int = 256, near: int = 8, piece: int = 512, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = rows.sparkSession
    vector = F.col(vec_col).cast("array<double>")
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    known = rows.select(F.col(id_col).alias("id"), F.when(fine, F.transform(vector, lambda x: x + F.lit(0.0))).alias("v"))
    known = known.withColumn("v", F.when(F.size("v") > 0, F.col("v")))
    # a class: equal vectors. Its number is the hash of the vector.
    known = known.withColumn("class", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = keep(known.filter("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.first("v").alias("v")))
    # a vector that is the only one of its dimension links to none
    dims = [r[0] for r in classes.groupBy(F.size("v").alias("d")).count().filter("count > 1").orderBy("d").collect()]
    counts, links = [spark.createDataFrame([], "class long, n long")], [spark.createDataFrame([], "a long, b long")]
    for d in dims:
        own = classes.filter(F.size("v") == d)
        chosen = own.orderBy(F.xxhash64("class"), "class").limit(pivots).toArrow()
        c, k = _linked(own, unit(_matrix(chosen["v"])), least, near, piece)
        counts.append(c), links.append(k)
        if len(counts) > TOGETHER:
            counts, links = [keep(reduce(DataFrame.unionByName, counts))], [keep(reduce(DataFrame.unionByName, links))]
    parts = connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "class")
    total = reduce(DataFrame.unionByName, counts).groupBy("class").agg(F.sum("n").alias("n"))
    known_classes = classes.select("class", "size", "low").join(parts, "class", "left").join(total, "class", "left") \
        .withColumn("component", F.coalesce("component", "class"))
    lowest = known_classes.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = known_classes.join(lowest, "component").select("class", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    return known.select("id", "class").join(of_class, "class", "left") \
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _linked(classes: DataFrame, pivots: np.ndarray, least: float, near: int, piece: int) -> tuple[DataFrame, DataFrame]:
    """(class, n) and spanning (a, b) of the classes of one dimension."""
    spark = classes.sparkSession
    near = min(near, len(pivots))

    def describe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows = unit(_matrix(b.column(2)))
            prefix = np.sort(nearest_pivots(rows, pivots, near), axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(prefix), pa.list_(pa.int32())), pa.array(list(rows), pa.list_(pa.float64()))],
                                             ["class", "size", "prefix", "unit"])

    told = keep(classes.select("class", "size", "v").mapInArrow(describe, "class long, size long, prefix array<int>, unit array<double>"))
    if near < 2:  # one vector only
        return told.select("class", F.lit(0).cast("long").alias("n")), told.select(F.col("class").alias("a"), F.col("class").alias("b"))
    keys = F.array(*[F.col("prefix")[i].cast("long") * 65536 + F.col("prefix")[j] for i in range(near) for j in range(i + 1, near)])
    lists = told.select("class", F.explode(keys).alias("key"))
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", F.ceil(F.col("m") / piece).cast("int").alias("pieces"))
    dealt = told.select("*", F.explode(keys).alias("key")).join(sizes, "key") \
        .withColumn("piece", F.pmod(F.xxhash64("class"), F.col("pieces").cast("long")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))) \
        .select("key", F.least("piece", "other").alias("first"), F.greatest("piece", "other").alias("second"), "piece", "class", "size", "prefix", "unit")
    group = ["key", "first", "second"]
    dealt = dealt.repartition(width(spark), *group).sortWithinPartitions(*group, "class")

    def run(batches):
        held = None
        for b in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in b.columns[:6]] + [np.asarray(b.column(6).flatten()).reshape(-1, near), _matrix(b.column(7))]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:3]], axis=0)) + 1
            if len(change):
                yield from links(held, change[:-1], change[-1])
                held = [c[change[-1]:] for c in held]
        if held is not None and len(held[0]):
            yield from links(held, [], len(held[0]))

    def links(cols, inner, end):
        out = [], [], [], []
        for a, b in zip([0, *inner], [*inner, end]):
            if b - a > 1:
                key, first, second, pieces, ids, size, prefix, rows = (c[a:b] for c in cols)
                for o, x in zip(out, list_links(key[0], ids, rows, prefix, size, pieces, first[0], second[0], least)):
                    o.append(x)
        ids, n, a, b = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
        kinds = np.repeat([0, 1], [len(ids), len(a)]).astype(np.int32)
        if len(kinds):
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([n, b]))], ["kind", "a", "b"])

    found = keep(dealt.mapInArrow(run, "kind int, a long, b long"))
    return found.filter("kind = 0").select(F.col("a").alias("class"), F.col("b").alias("n")), found.filter("kind = 1").select("a", "b")


def op7_pivots(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES, ORACLES = {"op7_pivots": op7_pivots}, {}
