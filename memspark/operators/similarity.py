"""Set-similarity joins, duplicate clusters and merging.

Copies are collapsed first: rows of a block with the same word set become one
representative, so a group of copies costs one row however large it is. The
sets are then dealt by size class and hash into parts of bounded weight, and
every two parts that may hold a similar pair meet in one task, which counts the
shared words of all their pairs in strips. Candidates are never shuffled or
written; what is shuffled are the sets, once for each part they meet, as packed
numbers of their words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.text import words_ws
from ..session import cut

#: Words ignored when two entries are compared.
OVERLAP_STOP_WORDS = """the and for are but not you all can her was one our out use get set add fix has had its let say she too
new now old see way may who did got try run api app""".split()

#: Words of a part, and what a set weighs besides its words; pairs of sets a task counts at once; words counted by a matrix product at most.
PART, SET_COST = 10_000_000, 50
STRIP, HOT_WORDS = 2_000_000, 512
#: Words that have a number by their frequency (the others go by a hash), and words of one packed row.
COMMON, PACKED = 1 << 20, 1_000_000


def overlap_words(text):
    return F.filter(F.array_distinct(words_ws(text)), lambda w: (F.length(w) >= 3) & ~w.isin(*OVERLAP_STOP_WORDS))


def representatives(df: DataFrame, block: str, id_: str, words) -> tuple[DataFrame, DataFrame]:
    """(sets, copies): one row per distinct word set of a block, and (id, rep) for every row."""
    w = df.select(F.col(block).alias("block"), F.col(id_).alias("id"), F.sort_array(words).alias("ws"))
    w = w.withColumn("sig", F.sha2(F.concat_ws(" ", "ws"), 256))
    sets = w.groupBy("block", "sig").agg(F.min(F.struct("id", "ws")).alias("r"), F.count("*").alias("copies"))
    sets = sets.select("block", "sig", F.col("r.id").alias("rep"), F.col("r.ws").alias("ws"), "copies", F.size("r.ws").alias("n"))
    # the words need not travel again for the ids
    reps = w.groupBy("block", "sig").agg(F.min(F.struct("id")).alias("r")).select("block", "sig", F.col("r.id").alias("rep"))
    copies = w.select("block", "sig", "id").join(reps, ["block", "sig"]).select("id", "rep")
    return sets, copies


def _weighed(sets: DataFrame, measure: str, t: float, salt_rows: int) -> DataFrame:
    """Every set with its size class, the part of the class it is dealt to, and the number of parts of its class and the next ones.

    Only sets of one class or of neighbouring classes can be similar: with Jaccard a class spans a ratio of ``t`` in size; the
    overlap with the smaller set knows no such bound. A part has about ``PART`` words, so however many sets a class has, a task gets two parts.
    """
    classes = F.floor(F.log("n") / -np.log(t) + 1e-9).cast("int") if measure == "jaccard" and t < 1 else F.col("n") if measure == "jaccard" else F.lit(0)
    s = sets.withColumn("c", classes)
    parts = s.groupBy("block", "c").agg(F.ceil(F.sum(F.col("n") + SET_COST) / F.lit(PART)).cast("int").alias("parts"), F.ceil(F.count("*") / F.lit(salt_rows)).cast("int").alias("least"))
    parts = cut(parts.select("block", "c", F.greatest("parts", "least").alias("parts")), "parts")  # a row per class
    near = lambda by, name: parts.select("block", (F.col("c") + by).alias("c"), F.col("parts").alias(name))
    s = s.join(parts, ["block", "c"]).join(near(-1, "above"), ["block", "c"], "left").join(near(1, "below"), ["block", "c"], "left")
    return s.withColumn("p", F.pmod(F.xxhash64("rep"), "parts").cast("int"))


def _hashed(words: pa.Array, seed: int) -> np.ndarray:
    """A number past those of the common words for every word."""
    h = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), hash_key=f"{seed:016d}", categorize=False)
    return (h >> np.uint64(2)).astype(np.int64) | 1 << 62


def _numbering(sets: DataFrame) -> tuple[pa.Array, int | None]:
    """(common words, the commonest first; the seed by which the hashes of all words differ, none if all other words occur once)."""
    def count(batches):
        for batch in batches:
            found = pc.value_counts(batch.column(0).flatten())
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["w", "f"])

    words = cut(sets.select("ws").mapInArrow(count, "w string, f bigint").groupBy("w").agg(F.sum("f").alias("f")), "words")
    common = words.where("f > 1").orderBy(F.desc("f"), "w").limit(COMMON).select("w").toArrow().column("w").combine_chunks()
    if len(common) < COMMON:
        return common, None

    def coded(seed):
        def code(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_hashed(batch.column(0), seed))], ["h"])
        return words.select("w").mapInArrow(code, "h bigint").groupBy("h").count().where("count > 1")

    seed = 0
    while not coded(seed).isEmpty():  # two words of one number: very rare
        seed += 1
    return common, seed


def _lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """The values of each row, which come in order of rows, as bytes."""
    ends = np.searchsorted(row, np.arange(rows + 1)) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _coded(sets: DataFrame) -> DataFrame:
    """``sets`` with ``common`` (steps between the numbers of common words) and ``rare`` (hashes of others) for ``ws``, as bytes; words that occur once are left out."""
    numbering = sets.sparkSession.sparkContext.broadcast(_numbering(sets))
    keep = [c for c in sets.columns if c != "ws"]

    def code(batches):
        common, seed = numbering.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ws"))
            words = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            number = pc.index_in(words.dictionary, common).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = words.indices.to_numpy(zero_copy_only=False)
            known = number[at] >= 0
            key = np.sort(row[known] * COMMON + number[at[known]])
            of, no = key // COMMON, (key % COMMON).astype(np.int32)
            step = no.copy()
            step[1:] -= np.where(of[1:] == of[:-1], no[:-1], 0)
            rare, codes = row[:0], number[:0]
            if seed is not None and not known.all():
                h = np.zeros(len(number), dtype=np.int64)
                h[number < 0] = _hashed(words.dictionary.filter(pa.array(number < 0)), seed)
                rare, codes = row[~known], h[at[~known]]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, _lists(of, step, len(lists)), _lists(rare, codes, len(lists))], [*keep, "common", "rare"])

    schema = ", ".join(f"{c} {k}" for c, k in sets.dtypes if c != "ws")
    return sets.select(*keep, "ws").mapInArrow(code, f"{schema}, common binary, rare binary").where("octet_length(common) + octet_length(rare) > 0")


def _pack(rows: pa.Table) -> pa.Table:
    """The sets of a part as a few rows of Arrow's bytes."""
    key = rows.slice(0, 1).select(_PART_KEY)
    body = rows.select(["rep", "n", "common", "rare"]).combine_chunks()
    words = np.cumsum(pc.add(pc.divide(pc.binary_length(body.column("common")), 4), pc.divide(pc.binary_length(body.column("rare")), 8)).to_numpy().astype(np.int64))
    first, data = 0, []
    while first < body.num_rows:
        last = max(first + 1, int(np.searchsorted(words, PACKED + (words[first - 1] if first else 0), side="right")))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(body.slice(first, last - first))
        data.append(sink.getvalue().to_pybytes())
        first = last
    return key.take(pa.array([0] * len(data))).append_column("data", pa.array(data, pa.binary()))


_PART_KEY = ["block", "c", "p", "parts", "above", "below"]


def _cells(sets: DataFrame, measure: str, t: float, salt_rows: int) -> DataFrame:
    """(block, ca, pa, cb, pb, side, data): each pair of parts that may hold a similar pair, with both parts' sets as packed rows; side 3 is both."""
    s = _coded(_weighed(sets.where("block IS NOT NULL").select("block", "rep", "n", "ws"), measure, t, salt_rows))
    kinds = dict(s.dtypes)
    s = cut(s.groupBy(*_PART_KEY).applyInArrow(_pack, ", ".join(f"{c} {kinds[c]}" for c in _PART_KEY) + ", data binary"), "parts")
    own = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(
        F.col("c").alias("ca"), F.least("p", q).alias("pa"), F.col("c").alias("cb"), F.greatest("p", q).alias("pb"),
        F.when(q == F.col("p"), 3).when(q > F.col("p"), 1).otherwise(2).alias("side")))
    larger = F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda q: F.struct(
        F.col("c").alias("ca"), F.col("p").alias("pa"), (F.col("c") + 1).alias("cb"), q.cast("int").alias("pb"), F.lit(1).alias("side")))
    smaller = F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda q: F.struct(
        (F.col("c") - 1).alias("ca"), q.cast("int").alias("pa"), F.col("c").alias("cb"), F.col("p").alias("pb"), F.lit(2).alias("side")))
    none = F.array().cast("array<struct<ca:int,pa:int,cb:int,pb:int,side:int>>")
    every = F.concat(own, F.coalesce(larger, none), F.coalesce(smaller, none)) if measure == "jaccard" and t < 1 else own
    return s.select("block", "data", F.explode(every).alias("cell")).select("block", "cell.*", "data")


class _Side:
    """The sets of one side of a cell: ``rep``, ``n``, and their words, each with its set, in order of the sets."""

    def __init__(self, packed):
        rows = pa.concat_tables([pa.ipc.open_stream(d).read_all() for d in packed])
        rep = rows.column("rep").to_pandas()
        rows = rows.take(pa.array(rep.sort_values(kind="stable").index.to_numpy())).combine_chunks()
        self.rep, self.n = rows.column("rep").to_pandas().to_numpy(), rows.column("n").to_numpy()
        step, many = self._flat(rows.column("common"), np.int32)
        whole = np.cumsum(step, dtype=np.int64)
        base = np.append(0, whole)[np.cumsum(many) - many]  # the steps of a set add up from its own start
        self.common, self.common_row = (whole - np.repeat(base, many)).astype(np.int32), np.repeat(np.arange(len(many), dtype=np.int32), many)
        self.rare, many = self._flat(rows.column("rare"), np.int64)
        self.rare_row = np.repeat(np.arange(len(many), dtype=np.int32), many)

    @staticmethod
    def _flat(lists: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
        lists = pa.concat_arrays([c.cast(pa.large_binary()) for c in lists.chunks])
        ends = np.frombuffer(lists.buffers()[1], dtype=np.int64)[lists.offset:lists.offset + len(lists) + 1]
        return np.frombuffer(lists.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]].view(kind), np.diff(ends) // np.dtype(kind).itemsize

    def words(self, common: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, place) of the words that are among ``common`` or ``rare``, by their places in both together; sets in order."""
        number = np.full(int(common[-1]) + 2 if len(common) else 1, -1, dtype=np.int32)
        number[common] = np.arange(len(common))
        place = number[np.minimum(self.common, len(number) - 1)]
        row, word = self.common_row[place >= 0], place[place >= 0]
        at = np.minimum(np.searchsorted(rare, self.rare), max(0, len(rare) - 1))
        held = rare[at] == self.rare if len(rare) else np.zeros(len(at), dtype=bool)
        if not held.any():
            return row, word
        row, word = np.concatenate([row, self.rare_row[held]]), np.concatenate([word, (len(common) + at[held]).astype(np.int32)])
        order = np.argsort(row, kind="stable")
        return row[order], word[order]


def _shared(a: _Side, b: _Side):
    """Yields (rows of a, shared words of these with every row of b), in strips of about ``STRIP`` pairs.

    The words that very many rows hold are counted by a product of 0/1 matrices, the others along their lists of rows.
    """
    na, nb = len(a.n), len(b.n)
    common, rare = np.flatnonzero(np.bincount(b.common)), np.unique(b.rare)
    rb, wb = b.words(common, rare)
    ra, wa = (rb, wb) if a is b else a.words(common, rare)
    width = len(common) + len(rare)
    fa, fb = np.bincount(wa, minlength=width), np.bincount(wb, minlength=width)
    weight = fa.astype(float) * fb
    hot = np.argsort(-weight)[:HOT_WORDS]
    hot = hot[weight[hot] > 0.01 * na * nb]
    column = np.full(width, -1, dtype=np.int32)
    column[hot] = np.arange(len(hot))
    def table(rows, ws, first, last):
        m = np.zeros((last - first, len(hot)), dtype=np.float32)
        keep = column[ws] >= 0
        m[rows[keep] - first, column[ws[keep]]] = 1
        return m
    dense = table(rb, wb, 0, nb).T
    listed = column[wb] < 0
    order = np.argsort(wb[listed], kind="stable")
    listed = rb[listed][order]
    del order
    length = np.where(column < 0, fb, 0)
    start = np.cumsum(length) - length
    strip = max(1, STRIP // nb)
    for first in range(0, na, strip):
        last = min(na, first + strip)
        lo, hi = np.searchsorted(ra, [first, last])
        rows, ws = ra[lo:hi], wa[lo:hi]
        out = np.rint(table(rows, ws, first, last) @ dense).astype(np.int32)
        rows, ws = rows[column[ws] < 0] - first, ws[column[ws] < 0]
        rows = rows.astype(np.int64)
        ends = np.cumsum(length[ws])
        i = 0
        while i < len(ws):  # as many lists at once as have about STRIP rows
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STRIP, side="right")))
            n = length[ws[i:j]]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[ws[i:j]], n)
            out += np.bincount(np.repeat(rows[i:j], n) * nb + listed[place], minlength=out.size).reshape(out.shape).astype(np.int32)
            i = j
        yield np.arange(first, last), out


def _similar(measure: str, t: float, min_shared: int, count: bool):
    """The function of one cell: its similar pairs, or for each set the number of them."""
    def pairs(cell: pd.DataFrame) -> pd.DataFrame:
        one = (cell["side"] == 3).any()
        mine, other = cell["data"][cell["side"] != 2], cell["data"][cell["side"] != 1]
        a = _Side(mine) if len(mine) else None
        b = a if one else _Side(other) if len(other) else None
        ida, idb, na, nb = (a.rep if a else np.array([]), b.rep if b else np.array([]), a.n if a else np.array([]), b.n if b else np.array([]))
        found, links = [], (np.zeros(len(ida), dtype=np.int64), np.zeros(len(idb), dtype=np.int64))
        for rows, shared in _shared(a, b) if a and b else ():
            whole = (na[rows][:, None] + nb[None, :] - shared) if measure == "jaccard" else np.minimum(na[rows][:, None], nb[None, :])
            hit = (shared >= min_shared) & (shared > 0) & (shared >= (t - 1e-9) * whole)
            if one:
                hit &= rows[:, None] < np.arange(len(idb))[None, :]
            if count:
                links[0][rows] += hit.sum(axis=1)
                links[1][:] += hit.sum(axis=0)
                continue
            i, j = np.nonzero(hit)
            found.append((ida[rows[i]], idb[j], shared[i, j], shared[i, j] / whole[i, j]))
        if count:
            out = pd.DataFrame({"rep": np.concatenate([ida, idb]), "links": np.concatenate(links)})
            return out[out["links"] > 0]
        cols = [np.concatenate([f[k] for f in found]) if found else np.array([]) for k in range(4)]
        return pd.DataFrame({"a": np.minimum(cols[0], cols[1]), "b": np.maximum(cols[0], cols[1]), "shared": cols[2], "similarity": cols[3]})
    return pairs


CELL = ["block", "ca", "pa", "cb", "pb"]


def similar_pairs(sets: DataFrame, measure: str, threshold: float, min_shared: int = 1, salt_rows: int = 40000) -> DataFrame:
    """(a, b, shared, similarity) with a < b for all pairs of a block at or above the threshold.

    ``measure`` 'jaccard' (shared / union) or 'overlap' (shared / smaller set); ``salt_rows``: the sets a part has at most, about.
    """
    kind = dict(sets.dtypes)["rep"]
    return _cells(sets, measure, float(threshold), salt_rows).groupBy(*CELL).applyInPandas(
        _similar(measure, float(threshold), min_shared, False), f"a {kind}, b {kind}, shared bigint, similarity double")


def similar_counts(sets: DataFrame, measure: str, threshold: float, min_shared: int = 1, salt_rows: int = 40000) -> DataFrame:
    """(rep, links): the number of similar sets of every set that has some; the pairs are counted where they are found and never written."""
    kind = dict(sets.dtypes)["rep"]
    found = _cells(sets, measure, float(threshold), salt_rows).groupBy(*CELL).applyInPandas(
        _similar(measure, float(threshold), min_shared, True), f"rep {kind}, links bigint")
    return found.groupBy("rep").agg(F.sum("links").alias("links"))


def contradictions(know: DataFrame, min_shared: int = 4, min_ratio: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """Pairs of one category that share many words, between representatives, and the copies each stands for."""
    sets, copies = representatives(know, "category", "id", overlap_words(F.concat_ws(" ", "title", "content")))
    sets = cut(sets, "sets")
    return similar_pairs(sets, "overlap", min_ratio, min_shared), copies


def duplicates(know: DataFrame, block: str, threshold: float = 0.4, min_words: int = 3) -> tuple[DataFrame, DataFrame]:
    sets, copies = representatives(know, block, "id", overlap_words(F.concat_ws(" ", "title", "content")))
    sets = cut(sets.where(F.col("n") >= min_words), "sets")
    return similar_pairs(sets, "jaccard", threshold), copies


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of ``edges(a, b)``; the root is the smallest id.

    Alternating star contraction: every round links nodes to the smallest node
    they know, so long chains shrink quickly. Rounds are written out, and the
    only thing read on the driver is one checksum per round.
    """
    e = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        big = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))      # larger neighbours to the minimum
        big = big.unionByName(low.where(F.col("u") > F.col("m")).select("u", F.col("m").alias("v"))).distinct()
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        star = big.join(low2, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))     # smaller neighbours to the minimum
        e = cut(star.unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        mark = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if mark == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark


def merge_duplicates(know: DataFrame, block: str, merge_at: float = 0.9, suggest_at: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, suggestions, archived): near copies become one entry per cluster, weaker pairs are suggested.

    ``know(id, block, title, content, tags, projects, access_count, last_accessed)``.
    A cluster keeps its smallest id and longest content, its title and category, the union of tags and
    projects, summed access and the latest access time; the others are archived.
    """
    pairs, copies = duplicates(know, block, suggest_at)
    pairs = cut(pairs, "pairs")
    roots = components(pairs.where(F.col("similarity") > merge_at).select("a", "b"))
    of = copies.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    # texts travel once, by their id; those without an id go with their row
    size = F.struct("_size", -F.col("id"))
    narrow = know.withColumns({"_size": F.length("content"), "content": F.when(F.col("id").isNull(), F.col("content"))})
    m = narrow.join(of, "id", "left").withColumn("root", F.coalesce("root", F.col("id")))
    g = m.groupBy("root").agg(
        F.count("*").alias("members"), *[F.min_by(c, "id").alias(c) for c in ("category", "title") if c in know.columns], F.max_by("id", size).alias("_from"), F.max_by("content", size).alias("_own"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("projects")))).alias("projects"),
        F.sum("access_count").alias("access_count"), F.max("last_accessed").alias("last_accessed"))
    texts = know.where("id IS NOT NULL").groupBy(F.col("id").alias("_from")).agg(F.max_by("content", F.length("content")).alias("_text"))
    rest = ["tags", "projects", "access_count", "last_accessed"]
    g = g.join(texts, "_from", "left").select(*[c for c in g.columns if c not in ("_from", "_own", *rest)], F.coalesce("_text", "_own").alias("content"), *rest)
    g = g.withColumn("tags", F.when(F.col("members") > 1, F.array_union("tags", F.array(F.lit("auto-merged")))).otherwise(F.col("tags")))
    weak = pairs.where((F.col("similarity") <= merge_at) & (F.col("similarity") >= suggest_at))
    archived = m.where(F.col("id") != F.col("root")).select("id", F.col("root").alias("merged_into"))
    return g.withColumnRenamed("root", "id"), weak, archived
