"""SimHash near-duplicates over BK-trees (operator 6).

Fingerprints come from word shingles; two fingerprints link when at most ``radius`` of 64 bits differ. Distinct
fingerprints are dealt to shards: 64 bits are cut into ``radius + agree`` blocks, and fingerprints that differ in at most
``radius`` bits agree on ``agree`` blocks at least, so every link lies in the shard of some choice of blocks, whatever
``agree`` is. It follows the number of fingerprints: more of them, longer keys, so that shards do not grow with the table.
Every shard is searched with BK-trees (children keyed by their Hamming distance to the parent, only edges within the radius
followed). A shard with more than ``piece`` fingerprints is cut into pieces: a tree for each piece, asked by each piece, so no
task holds more than two pieces. Trees give spanning links of what they connect, never all pairs.

Trees travel to the tasks of their shard by a shuffle and are not broadcast: all trees together hold the fingerprints of all
documents, which no bound covers and which must not pass through the driver.

A SimHash cannot decide a Jaccard similarity, so ``drop_near_duplicates`` takes fingerprint components for candidates only: inside
each, the shingle sets of its distinct texts are compared exactly, and rows count as duplicates along links of ``least`` or more.
Similar texts may differ in more bits than ``radius``. With ``banded`` a second pass deals the texts by bands of MinHash values, keeps
the groups whose texts the first pass has not connected yet, and compares those exactly too. With 32 bands of 6 values a pair of
similarity 0.8 shares no band in one case of 17,000.

Null and empty texts have fingerprint zero and link like any other. Each row keeps its own row in the result, repeated
rows too. A null id never becomes a component id while the component has another id. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import connected_components, keep, small, width

#: Shingles hashed before their bits are summed.
CHUNK = 1 << 15
#: Rows of a shard part whose tree is built and asked together with those of other parts.
SMALL = 64
#: Bands of MinHash values, and values in a band.
BANDS, BAND = 32, 6


def text_fingerprint_sums(text: bytes | None, size: int, seed: int = 42):
    """(bits set: 64 counts, number of shingles) of a text, A-Z in lower case."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(64, np.int64), 0
    line, at = b" ".join(words), list(accumulate(map(len, words), lambda a, b: a + b + 1, initial=0))
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - size + 1)
    ends = at[size:] if len(words) >= size else at[-1:]
    for k in range(0, n, CHUNK):
        starts = at[k:k + CHUNK]
        hashes = [digest(line[a:b - 1], seed) for a, b in zip(starts, ends[k:k + CHUNK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return total, n


def text_fingerprint(text: bytes | None, size: int) -> int:
    """The fingerprint as a signed 64-bit number."""
    total, n = text_fingerprint_sums(text, size)
    set_bits = (total * 2 > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def text_key(text: bytes | None) -> int:
    """A signed 64-bit number of the text's words: texts of equal words have equal shingles."""
    return _signed(xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()), 7))


def shingle_set(text: bytes | None, size: int, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct shingles that the fingerprint counts, ascending."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k:k + size]), seed) for k in range(max(1, len(words) - size + 1))], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared / max(1, len(both) - shared)


#: Multipliers and offsets of the MinHash values.
MULTIPLY, ADD = (np.array([xxhash.xxh64_intdigest(b"%d" % i, seed) | odd for i in range(BANDS * BAND)], np.uint64) for seed, odd in ((1, 1), (2, 0)))


def band_keys(shingles: np.ndarray) -> list[int] | None:
    """A signed 64-bit number for each band of MinHash values of a shingle set; None for an empty one."""
    if not len(shingles):
        return None
    low = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[k:k + 2048, None] * MULTIPLY + ADD).min(axis=0), out=low)
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(low.reshape(BANDS, BAND))]


def fingerprints(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False,
                 banded: bool = False) -> DataFrame:
    """(id, fp) for every row, with ``keyed`` also the ``key`` of its words and its ``bands`` (empty unless ``banded``)."""
    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(1).cast(pa.binary())]
            cols = [b.column(0), pa.array([text_fingerprint(t, size) for t in texts], pa.int64())]
            if keyed:
                cols.append(pa.array([text_key(t) for t in texts], pa.int64()))
                cols.append(pa.array([band_keys(shingle_set(t, size)) if banded else [] for t in texts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, ["id", "fp", "key", "bands"][:len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, f"id {kind}, fp long" + (", key long, bands array<long>" if keyed else ""))


def shard_keys(radius: int, agree: int = 2) -> list[int]:
    """A mask for each choice of ``agree`` out of ``radius + agree`` blocks of 64 bits."""
    cuts = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def agreeing(n: int, radius: int, piece: int) -> int:
    """Blocks to agree on for ``n`` distinct fingerprints: the number of fewest rows sent, a row of a shard of k pieces being sent k
    times. Evenly spread fingerprints are assumed for the choice alone; every number of blocks finds every link."""
    def sent(agree):
        return comb(radius + agree, agree) * (1 + n / piece / 2 ** (64 * agree // (radius + agree)))

    return min(range(2, max(3, min(6, 65 - radius))), key=sent)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tree_links(tree: np.ndarray, asks: np.ndarray, values: np.ndarray, root: np.ndarray, radius: int) -> None:
    """Ask a BK-tree over ``values[tree]`` for all of ``values[asks]`` at once; ``root`` (an index for each value) then
    tells which values are connected. A node's items at one distance are its child on that edge. A branch whose items and
    queries are all connected already is not entered."""
    stack = [(tree, asks)]
    while stack:
        items, queries = stack.pop()
        one = root[items[0]]
        if (root[items] == one).all() and (root[queries] == one).all():
            continue
        node, rest = items[0], items[1:]
        far = np.bitwise_count(values[queries] ^ values[node])
        hits = root[queries[far <= radius]]
        if len(hits) and (hits != one).any():
            own = np.unique(np.append(hits, one))
            root[np.isin(root, own)] = own[0]
        if len(rest):
            edge = np.bitwise_count(values[rest] ^ values[node])
            for k in np.unique(edge):
                within = queries[(far <= k + radius) & (far + radius >= k)]
                if len(within):
                    stack.append((rest[edge == k], within))


def hook(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join ``x[i]`` and ``y[i]`` for all i: each set's root is its lowest index afterwards."""
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def forest(values: np.ndarray, items: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees over ``values[items]``, one for each ``part`` (a number for each value), built level by level: (root, edges, children).
    ``root`` is the first item of each part or -1; ``edges`` (128 x parent + distance, ascending) leads to the node in ``children``."""
    root, edges, children = np.full(part.max(initial=0) + 1, -1), [], []
    rest, key = items, None
    while len(rest):
        groups, first, which = np.unique(part[rest] if key is None else key, return_index=True, return_inverse=True)
        node = rest[first]
        if key is None:
            root[groups] = node
        else:
            edges.append(groups)
            children.append(node)
        key = node[which] * 128 + np.bitwise_count(values[rest] ^ values[node[which]])
        below = np.ones(len(rest), bool)
        below[first] = False
        rest, key = rest[below], key[below]
    if not edges:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges, children = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(edges)
    return root, edges[order], children[order]


def ask_forest(trees, asks: np.ndarray, part: np.ndarray, values: np.ndarray, root: np.ndarray, radius: int) -> None:
    """Ask the tree of its own part for each of ``values[asks]``, all level by level, and join what lies within the radius in ``root``."""
    top, edges, children = trees
    node = top[part[asks]]
    asks, node = asks[node >= 0], node[node >= 0]
    while len(asks):
        far = np.bitwise_count(values[asks] ^ values[node]).astype(np.int64)
        near = far <= radius
        hook(root, asks[near], node[near])
        low = np.searchsorted(edges, node * 128 + np.maximum(far - radius, 0))
        count = np.searchsorted(edges, node * 128 + np.minimum(far + radius, 64), side="right") - low
        node = children[np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)]
        asks = np.repeat(asks, count)


def shard_roots(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray, piece: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """A root for each row of shard parts that stand one after another. A part holds the pieces ``first`` (the tree) and
    ``second`` (the queries). The trees of parts of up to ``SMALL`` rows are built and asked together, larger ones one by one."""
    root, size = np.arange(len(values)), ends - starts
    part, few = np.repeat(np.arange(len(size)), size), np.repeat(size <= SMALL, size)
    trees = forest(values, np.flatnonzero(few & (piece == first)), part)
    ask_forest(trees, np.flatnonzero(few & (piece == second)), part, values, root, radius)
    for a, b in zip(starts[size > SMALL], ends[size > SMALL]):
        tree = a + np.flatnonzero(piece[a:b] == first[a])
        asks = tree if first[a] == second[a] else a + np.flatnonzero(piece[a:b] == second[a])
        if len(tree) and len(asks):
            own = np.arange(b - a)
            tree_links(tree - a, asks - a, values[a:b], own, radius)
            root[a:b] = a + own
    return root


def fingerprint_links(nodes: DataFrame, radius: int, piece: int = 1024, agree: int | None = None) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints ``nodes.fp``. ``agree``: blocks of a shard key, by default from their number."""
    spark = nodes.sparkSession
    masks = F.array(*[F.lit(_signed(m)) for m in shard_keys(radius, agree or agreeing(nodes.count(), radius, piece))])
    dealt = nodes.select("fp", F.posexplode(masks).alias("pair", "mask")).select("fp", "pair", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = dealt.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1") \
        .select("pair", "key", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    rows = dealt.join(sizes, ["pair", "key"]) \
        .withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces").cast("long")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))) \
        .select("pair", "key", F.least("piece", "other").alias("first"), F.greatest("piece", "other").alias("second"), "piece", "fp")
    group = ["pair", "key", "first", "second"]
    rows = rows.repartition(width(spark), *group).sortWithinPartitions(*group)

    def run(batches):
        held = None
        for b in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)) + 1
            if len(change):
                yield links([c[:change[-1]] for c in held], np.concatenate([[0], change]))
                held = [c[change[-1]:] for c in held]
        if held is not None and len(held[0]):
            yield links(held, np.array([0, len(held[0])]))

    def links(cols, cuts):
        _, _, first, second, pieces, fps = cols
        root = shard_roots(cuts[:-1], cuts[1:], first, second, pieces, fps.view(np.uint64), radius)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fps[linked], pa.int64()), pa.array(fps[root[linked]], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _components(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, component) of every distinct fingerprint."""
    nodes = keep(fps.select("fp").distinct())
    parts = connected_components(fingerprint_links(nodes, radius)).withColumnRenamed("node", "fp")
    return nodes.join(parts, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, radius: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row: the smallest id of the rows that links reach."""
    fps = keep(fingerprints(docs, size, id_col, text_col))
    of_fp = fps.groupBy("fp").agg(F.min("id").alias("low")).join(_components(fps, radius), "fp")
    lowest = of_fp.groupBy("component").agg(F.min("low").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(of_fp.join(lowest, "component").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), hexed, "component_id")


def similar_roots(piece: np.ndarray, first: int, second: int, fps: np.ndarray, sets: list[np.ndarray], least: float, same: np.ndarray) -> np.ndarray:
    """A root for each text of a part: texts of piece ``first`` against those of ``second``, the nearest fingerprints first. Texts that
    are connected already (equal ``same`` to begin with) are not compared again, nor those whose sizes alone rule ``least`` out."""
    sizes = np.array([len(x) for x in sets])
    _, start, which = np.unique(same, return_index=True, return_inverse=True)
    root = start[which]
    right = np.flatnonzero(piece == second)
    for i in np.flatnonzero(piece == first):
        others = right[right > i] if first == second else right
        others = others[root[others] != root[i]]
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[low >= least * high - 1e-6]
        for j in others[np.argsort(np.bitwise_count(fps[others] ^ fps[i]), kind="stable")]:
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= least:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return root


def similar_links(texts: DataFrame, size: int, least: float) -> DataFrame:
    """Spanning links (a, b) between the ``same`` of ``texts`` (component, pieces, key, fp, same, text; a row for each component and key):
    pairs of one component whose shingle sets have a Jaccard similarity of ``least`` or more. Texts of one ``same`` are linked to begin
    with. Components of several pieces are compared piece by piece."""
    rows = texts.withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces").cast("long")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))) \
        .select("component", F.least("piece", "other").alias("first"), F.greatest("piece", "other").alias("second"), "piece", "same", "fp", "text")
    group = ["component", "first", "second"]
    rows = rows.repartition(width(texts.sparkSession), *group).sortWithinPartitions(*group)

    def run(batches):
        part, held = None, []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:6]]
            for component, first, second, own, same, fp, text in zip(*cols, b.column(6).cast(pa.binary())):
                if part != (component, first, second):
                    if len(held) > 1:
                        yield links(part, held)
                    part, held = (component, first, second), []
                held.append((own, same, fp, shingle_set(text.as_py(), size)))
        if len(held) > 1:
            yield links(part, held)

    def links(part, held):
        own, same, fps, sets = zip(*held)
        same = np.array(same, np.int64)
        root = similar_roots(np.array(own), part[1], part[2], np.array(fps, np.int64).view(np.uint64), sets, least, same)
        linked = np.flatnonzero(same[root] != same)
        return pa.RecordBatch.from_arrays([pa.array(same[linked], pa.int64()), pa.array(same[root[linked]], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def drop_near_duplicates(docs: DataFrame, size: int = 5, radius: int = 8, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8,
                         piece: int = 1024, banded: bool = False) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (rows without an id last). Rows equal in id and text count as
    one. Links are pairs whose shingle sets have a Jaccard similarity of ``least`` or more, among texts that fingerprints within
    ``radius`` connect and, if ``banded``, among texts that share a band of MinHash values. Texts of equal words are one text."""
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    tagged = docs.withColumn("_simhash_row", row)
    plain = docs.select(row.alias("_simhash_row"), F.col(text_col).cast("string").alias("text"))

    def linked(groups, asked):
        """(same, merged) of the texts that an exact check connects inside ``groups`` (component, n)."""
        asked = keep(asked.join(groups.select("component", F.ceil(F.col("n") / piece).cast("int").alias("pieces")), "component")
                     .select(F.col("low.row").alias("_simhash_row"), "component", "pieces", "key", "fp", "same"))
        found = plain.join(small(asked), "_simhash_row").dropDuplicates(["_simhash_row", "component"]).drop("_simhash_row")
        return connected_components(similar_links(found, size, least)).select(F.col("node").alias("same"), F.col("component").alias("merged"))

    def merge(texts, parts):
        return texts.join(parts, "same", "left").withColumn("same", F.coalesce("merged", "same")).drop("merged")

    fps = keep(fingerprints(docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), row.alias("row")).alias("id"), F.col(text_col).alias("text")),
                            size, "id", "text", keyed=True, banded=banded))
    texts = fps.groupBy("key", "fp").agg(F.min("id").alias("low"), F.any_value("bands").alias("bands")).withColumn("same", F.col("key"))
    texts = keep(texts.join(_components(fps, radius), "fp"))
    several = texts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    texts = keep(merge(texts, linked(several, texts)).drop("component"))
    if banded:
        dealt = texts.select("key", "fp", "low", "same", F.posexplode("bands").alias("band", "value")) \
            .withColumn("component", F.xxhash64("band", "value")).drop("band", "value")
        groups = dealt.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("members"),
                                                F.min("same").alias("first"), F.max("same").alias("last")).filter("first != last")
        # bands that hold the same texts are asked once
        groups = keep(groups.groupBy("n", "members", "first", "last").agg(F.min("component").alias("component")))
        texts = merge(texts, linked(groups, dealt))
    stay = texts.groupBy("same").agg(F.min("low").alias("low")).select(F.col("low.row").alias("_simhash_row"))
    return tagged.join(stay, "_simhash_row", "left_semi").dropDuplicates(["_simhash_row"]).drop("_simhash_row")


QUERIES, ORACLES = {}, {}


def op6_simhash(spark, sf_dir):
    from tarnfold.llm.common import table
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, radius=4)


QUERIES["op6_simhash"] = op6_simhash
