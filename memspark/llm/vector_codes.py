"""Vector code compression: product codebooks by a dual-tree form of Lloyd's rounds, exact in integers.

A component x counts as floor(scale * x). Vectors are cut into equal consecutive parts, every part
position has a codebook of its own. Vectors are held in blocks; a block has, for each part position,
a tree over its parts: halves by the widest component down to ``LEAF`` parts, with the bounding box, the
count and the sum of every node. The trees are written once and read in every round. A codebook's
entries have such a tree too, down to single entries.

Assigning walks both trees at once, all node pairs of a step as arrays. The distance bounds of two boxes
say what no part of a node can be nearest to, and such pairs go; when only single entries are left
of the other tree, an entry also goes if the whole box is nearer to another one. A node with one entry left is assigned
whole: its cached sum and count are all that the round needs. Leaves with several entries left are
settled part by part. Every bound and distance is an integer, a pair goes only if it is strictly
farther, and ties go to the lower index, so the result is that of plain Lloyd rounds, bit by bit.
Where squares would not fit 64 bits, whole numbers of any length are used.

A round sends the entries (``entries`` x dimension numbers) to the tasks and gets their sums back, which
Spark adds up by (part, entry, component); sums travel in limbs, so none can overflow.

Defined cases: rows whose vector is null or has a null or non-finite component are dropped; so an empty table, or one
without a whole vector, gives an empty result. Null ids come after all others when the first entries
are chosen; repeated ids are ordered by their vectors; fewer vectors than entries make that many entries.
Null labels are one label. An error beyond 64 bits is null. Vectors of no components have one code and
error 0. Vectors of different lengths, or of a length that the parts don't divide, are an error.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import cut, spread

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts of a node that is not split further, and vectors of a block.
LEAF, BLOCK = 32, 2048
#: Bits of a limb of a sum.
LIMB = 30
LONGEST = (1 << 63) - 1


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in 64 bits if all squared distances fit, else as whole numbers of any length."""
    scaled = np.floor(values.astype(np.float64) * scale)
    high = float(np.abs(scaled).max(initial=0))
    if 2 * high < (2.0 ** 60 / max(1, values.shape[-1])) ** 0.5:
        return scaled.astype(np.int64)
    # a float beyond 2^53 is whole
    flat = [int(np.floor(x * scale)) if abs(x) < 2.0 ** 53 else int(x) * scale for x in values.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(values.shape)


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if squared distances between them fit, else both as whole numbers of any length."""
    if a.dtype != object and b.dtype != object:
        high = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
        if max(1, a.shape[-1]) * (2 * high) ** 2 < 1 << 61:
            return a.astype(np.int64), b.astype(np.int64)
    return a.astype(object), b.astype(object)


class Levels:
    """A tree over points: level k has 2^k nodes, runs of ``order`` of equal length but for one."""

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        order = np.arange(n)
        self.starts, self.low, self.high, self.sums = [], [], [], []
        depth = 0
        while -(-n >> depth) > leaf:
            depth += 1
        for k in range(depth + 1):
            starts = np.arange(1 << k) * n >> k
            here = points[order]
            low, high = np.minimum.reduceat(here, starts), np.maximum.reduceat(here, starts)
            for kept, x in ((self.starts, starts), (self.low, low), (self.high, high), (self.sums, np.add.reduceat(here, starts))):
                kept.append(x)
            if k < depth and points.shape[1]:
                node = np.repeat(np.arange(1 << k), np.diff(np.append(starts, n)))
                widest = np.argmax(high - low, axis=1)[node]
                key = here[np.arange(n), widest]
                key = np.unique(key, return_inverse=True)[1] if key.dtype == object else key
                order = order[np.lexsort((key, node))]
        self.order, self.points, self.n = order, points[order], n

    def count(self, level: int) -> np.ndarray:
        return np.diff(np.append(self.starts[level], self.n))


def build(points: np.ndarray, leaf: int = LEAF) -> Levels:
    tree = Levels(points, leaf)
    if points.dtype != object and int(np.abs(points).max(initial=0)) < 1 << 15:  # the smallest form to write
        tree.points = tree.points.astype(np.int16)
        tree.low, tree.high = [x.astype(np.int16) for x in tree.low], [x.astype(np.int16) for x in tree.high]
    return tree


def _best(pairs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The least value of each run of equal numbers in ``pairs`` (sorted), for every member of the run."""
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return np.repeat(np.minimum.reduceat(values, first), np.diff(np.append(first, len(pairs))))


def _bounds(low, high, low_e, high_e) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances that no pair of points of two boxes is under, or over."""
    zero = low.dtype.type(0) if low.dtype != object else 0
    gap = np.maximum(np.maximum(low - high_e, low_e - high), zero)
    far = np.maximum(high - low_e, high_e - low)
    return (gap * gap).sum(1), (far * far).sum(1)


def _undominated(node: np.ndarray, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """False for entries that all of the node's box is strictly farther from than from the entry nearest to its middle."""
    middle = ((2 * entry - low - high) ** 2).sum(1)
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(first, len(node)))
    least = np.repeat(np.minimum.reduceat(middle, first), sizes)
    at = np.flatnonzero(middle == least)
    chosen = at[np.unique(node[at], return_index=True)[1]]  # one for each node
    near = entry[np.repeat(chosen, sizes)]
    # |x - near|^2 - |x - entry|^2 is linear in x: its maximum over the box is at a corner
    slope = 2 * (entry - near)
    most = np.maximum(slope * low, slope * high).sum(1) + (near * near).sum(1) - (entry * entry).sum(1)
    return most >= 0


def walk(tree: Levels, entries: np.ndarray) -> Iterator[tuple[str, tuple]]:
    """('node', (level, nodes, entries)) for nodes assigned whole, ('part', (parts in tree order, entries)) for settled ones."""
    points, entries = _same(tree.points, entries)
    other = Levels(entries, 1)
    depth, depth_e = len(tree.starts) - 1, len(other.starts) - 1
    node, pair_e, level, level_e = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while len(node):
        low, high = tree.low[level].astype(entries.dtype)[node], tree.high[level].astype(entries.dtype)[node]
        nearest, farthest = _bounds(low, high, other.low[level_e][pair_e], other.high[level_e][pair_e])
        keep = nearest <= _best(node, farthest)
        node, pair_e, low, high = node[keep], pair_e[keep], low[keep], high[keep]
        if level_e < depth_e:  # both sides go down a step
            pair_e = np.repeat(2 * pair_e, 2) + np.tile([0, 1], len(pair_e))
            node, level_e = np.repeat(node, 2), level_e + 1
            if level_e == depth_e:  # leaves may hold no entry, where entries are no power of two
                some = np.diff(np.append(other.starts[level_e], other.n))[pair_e] > 0
                node, pair_e = node[some], pair_e[some]
        else:
            single = other.starts[level_e][pair_e]
            keep = _undominated(node, low, high, other.points[single])
            node, pair_e, single = node[keep], pair_e[keep], single[keep]
            alone = np.append(True, node[1:] != node[:-1]) & np.append(node[1:] != node[:-1], True)
            if alone.any():
                yield "node", (level, node[alone], other.order[single[alone]])
                node, pair_e, single = node[~alone], pair_e[~alone], single[~alone]
            if level == depth:
                if len(node):
                    yield "part", _settle(tree, points, node, other.order[single], entries)
                return
        if level < depth:
            # children of a node follow each other, and so do the pairs of a child
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(node)))
            at = np.concatenate([np.tile(np.arange(f, f + s), 2) for f, s in zip(first.tolist(), sizes.tolist())]) if len(first) else first
            node, pair_e = 2 * node[at] + np.repeat(np.tile([0, 1], len(first)), np.repeat(sizes, 2)), pair_e[at]
            level += 1


def _settle(tree: Levels, points: np.ndarray, node: np.ndarray, index: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the entries left to each part of leaves, lower index first."""
    sizes = tree.count(len(tree.starts) - 1)[node]
    pair = np.repeat(np.arange(len(node)), sizes)
    row = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + tree.starts[-1][node][pair]
    entry = index[pair]
    by_part = np.lexsort((entry, row))
    row, entry = row[by_part], entry[by_part]
    gap = points[row] - entries[entry]
    distance = (gap * gap).sum(1)
    best = distance == _best(row, distance)
    parts, first = np.unique(row[best], return_index=True)
    return parts, entry[best][first]


def nearest(tree: Levels, entries: np.ndarray) -> np.ndarray:
    """The entry of every part, in the order that the parts were given in."""
    found = np.empty(tree.n, np.int64)
    for kind, got in walk(tree, entries):
        if kind == "part":
            found[got[0]] = got[1]
        else:
            level, nodes, chosen = got
            sizes = tree.count(level)[nodes]
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(tree.starts[level][nodes], sizes)
            found[at] = np.repeat(chosen, sizes)
    out = np.empty(tree.n, np.int64)
    out[tree.order] = found
    return out


def totals(tree: Levels, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the parts of every entry; whole nodes bring their cached sums."""
    dtype = object if object in (tree.points.dtype, entries.dtype) else np.int64
    count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, dtype)
    for kind, got in walk(tree, entries):
        if kind == "part":
            np.add.at(count, got[1], 1)
            np.add.at(total, got[1], tree.points[got[0]].astype(dtype))
        else:
            level, nodes, chosen = got
            np.add.at(count, chosen, tree.count(level)[nodes])
            np.add.at(total, chosen, tree.sums[level][nodes].astype(dtype))
    return count, total


def whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, vector, label) of rows whose vector is there and finite."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.col(f"`{label_col}`").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite)


def blocks(kept: DataFrame, parts: int, dimension: int, scale: int, size: int = BLOCK) -> DataFrame:
    """(ids, labels, trees): the written trees, a row for each block of vectors."""
    ids, labels = kept.schema["vec_id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            lists = rows.column("vector").combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            values = integers(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dimension), scale)
            trees = pickle.dumps([build(p) for p in np.split(values, parts, axis=1)])
            listed = [pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*listed, pa.array([trees], pa.binary())], ["ids", "labels", "trees"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                held = table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return cut(spread(kept).mapInArrow(run, f"ids array<{ids}>, labels array<{labels}>, trees binary"), "vector-trees")


def assign_round(trees: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, sum by component), added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros(len(b), np.int64), np.zeros(b.shape, object)) for b in books]
        for batch in batches:
            for data in batch.column(0):
                for (count, total), tree, book in zip(sums, pickle.loads(data.as_py()), books):
                    some = totals(tree, book)
                    count += some[0]
                    total += some[1]
        rows = []
        for part, (count, total) in enumerate(sums):
            for entry in np.flatnonzero(count).tolist():
                for place, value in enumerate([int(count[entry]), *map(int, total[entry])], -1):
                    limb = 0
                    while value not in (0, -1):  # the last limb has the sign
                        rows.append((part, entry, place, limb, value & (1 << LIMB) - 1))
                        value, limb = value >> LIMB, limb + 1
                    rows.append((part, entry, place, limb, value))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "limb", "value"])

    limbs = trees.select("trees").mapInArrow(run, "part bigint, entry bigint, place bigint, limb bigint, value bigint")
    out: dict = {}
    # at most parts x entries x (components + 1) sums of a few limbs
    for r in limbs.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():
        count, total = out.setdefault((r["part"], r["entry"]), ({}, {}))
        (count if r["place"] < 0 else total).setdefault(r["place"], []).append(r["value"] << LIMB * r["limb"])
    return {key: (sum(count[-1]), [sum(total[p]) for p in range(len(total))]) for key, (count, total) in out.items()}


def _book(entries: list[list[int]], width: int) -> np.ndarray:
    out = np.empty((len(entries), width), object)
    for i, e in enumerate(entries):
        out[i, :] = e
    return out if any(abs(x) >> 62 for e in entries for x in e) else out.astype(np.int64)


def fit(kept: DataFrame, trees: DataFrame, parts: int, dimension: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """The codebooks of all part positions."""
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    first = integers(np.array([r[0] for r in seeds], np.float64).reshape(len(seeds), dimension), scale)
    books = [b if b.dtype == object else b.astype(np.int64) for b in np.split(first, parts, axis=1)]
    for _ in range(rounds):
        found = assign_round(trees, books)
        books = [_book([[s // found[p, e][0] for s in found[p, e][1]] if (p, e) in found else list(map(int, book[e])) for e in range(len(book))], book.shape[1]) for p, book in enumerate(books)]
    return books


def encode(trees: DataFrame, books: list[np.ndarray], id_type: str, label_type: str) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                codes, error = [], np.zeros(len(ids), object)
                for tree, book in zip(pickle.loads(batch.column(2)[i].as_py()), books):
                    index = nearest(tree, book)
                    codes.append(index)
                    points, entries = _same(tree.points, book)
                    gap = points - entries[index[tree.order]]
                    error[tree.order] += (gap * gap).sum(1)
                texts = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, 1).tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(texts), pa.array([e if e <= LONGEST else None for e in map(int, error)], pa.int64())], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error bigint")


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): what the codes stand for, at the middle of the integers' steps."""
    tables = [((b + 0.5) / scale).astype(float).tolist() for b in books]
    entry = [F.element_at(F.lit(t), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1) for p, t in enumerate(tables)]
    return codes.select("vec_id", F.concat(*entry).alias("vector"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, code, error, label_error, codebooks_sha256) of every whole vector, and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    kept = whole(vectors, id_col, vector_col, label_col)
    shape = kept.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    dimension = shape[0] or 0
    if shape[0] != shape[1] or dimension % parts:
        raise ValueError(f"vectors have {shape[0]} to {shape[1]} components; all must have one number that {parts} divides")
    trees = blocks(kept, parts, dimension, scale, block)
    books = fit(kept, trees, parts, dimension, entries, rounds, scale)
    coded = cut(encode(trees, books, kept.schema["vec_id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()), "vector-codes")
    sums = coded.groupBy("label").agg(F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).alias("total"))
    fits = F.when(F.col("total") <= LONGEST, F.col("total")).cast("bigint").alias("label_error")
    out = coded.alias("c").join(cut(sums, "vector-labels").alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return out.select("vec_id", "code", "error", fits, F.lit(books_sha256(books)).alias("codebooks_sha256")), books


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """Plain Lloyd rounds in DuckDB SQL, for vectors with ids that are neither null nor repeated."""
    def nearest_sql(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{k} b ON x.p = b.p) GROUP BY vec_id, p)"""

    def means_sql(k: int) -> str:
        return f"""
m{k} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(x.v) AS c, unnest(range(len(x.v))) AS i FROM a{k} a JOIN x ON x.vec_id = a.vec_id AND x.p = a.p) GROUP BY p, e, i),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (
  SELECT p, e, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM m{k} GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)"""

    tables = ",".join(nearest_sql(k) + "," + means_sql(k) for k in range(rounds)) + "," + nearest_sql(rounds)
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, w[p * len(w) // {parts} + 1 : (p + 1) * len(w) // {parts}] AS v FROM kept, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, e, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}) USING (vec_id)),{tables},
o AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN kept USING (vec_id), h"""
