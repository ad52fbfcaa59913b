"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits agree in at least four
of their eight bytes: four is the guaranteed minimum of shared positional bytes.
Postings of single bytes would meet in all pairs, so the index is keyed by what a
pair must reach: each choice of four byte positions with their values (70 keys
a fingerprint). Every pair at the minimum meets in such a posting, the shared
positional bytes of the meeting pairs are tallied, pairs below the minimum go,
and the rest is verified bit by bit.

Equal fingerprints are one entry, so copies cost one row. Postings are read as sorted
runs after one shuffle. One of more than ``LARGE`` entries isn't paired off: within it the same argument holds for the
half-bytes of the four free bytes, which leaves 16 free bits, at most 65,536
entries, linked in one small task by a spanning forest instead of all pairs.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like
any other; a text of fewer words than a shingle is one shingle; repeated rows give
repeated results; a null id is never a component's id (null if nothing else is
there); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.similarity import components
from .batches import cut, pieces, two_columns

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
MAX_BITS = 4
#: Bytes (of eight) that fingerprints within MAX_BITS surely share.
SHARED = 8 - MAX_BITS
#: Postings up to this size are paired off, larger ones split further.
LARGE = 256


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(unit: int, free: list[int]) -> list[int]:
    """Masks of every choice of SHARED of the given units (of ``unit`` bits, by lowest bit)."""
    one = (1 << unit) - 1
    return [sum(one << s for s in chosen) for chosen in combinations(free, SHARED)]


BYTE_MASKS = _masks(8, [8 * k for k in range(8)])


def fingerprints_of(texts: list[bytes], size: int) -> np.ndarray:
    """SimHash of each text over its word shingles, as uint64."""
    digest, found, starts = xxhash.xxh64_digest, [], []
    for x in texts:
        words = x.translate(LOWER).split()
        starts.append(len(found))
        if not words:
            found.append(b"\0" * 8)
            continue
        joined = b" ".join(words)
        n = len(words)
        if n <= size:
            found.append(digest(joined, SEED))
            continue
        ends = np.fromiter(map(len, words), np.int64, n)
        ends += 1
        np.cumsum(ends, out=ends)
        firsts = [0, *ends[:n - size].tolist()]
        found += [digest(joined[a:b], SEED) for a, b in zip(firsts, (ends[size - 1:] - 1).tolist())]
    hashes = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8)
    out = np.empty((len(texts), 8), np.uint8)
    bounds = [*starts, len(found)]
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b - a == 1:
            out[i] = hashes[a]
        else:
            set_bits = np.zeros(64, np.int64)
            for c in range(a, b, 1 << 16):  # a very long text is summed in parts
                set_bits += np.unpackbits(hashes[c:min(b, c + (1 << 16))], axis=1).sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * set_bits > b - a)
    return out.view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every row as a signed 64-bit number; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(fingerprints_of(texts, size).view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = two_columns(docs, id_col, text_col).withColumn("text_hash", text_hash("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _postings(fps: DataFrame) -> DataFrame:
    return fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in BYTE_MASKS])).alias("choice", "bytes"))


def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs reach the guaranteed tally of shared positional bytes and then differ in few enough bits."""
    x = a ^ b
    tally = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)
    return (tally >= SHARED) & (np.bitwise_count(x) <= MAX_BITS)


def _pairs(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs within runs of ``fps``, all runs of one size at a time."""
    left, right = [], []
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size]
        step = max(1, (1 << 20) // len(i))
        for k in range(0, len(at), step):
            a, b = fps[at[k:k + step, None] + i], fps[at[k:k + step, None] + j]
            ok = verified(a, b)
            left.append(a[ok])
            right.append(b[ok])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _scan(batches: Iterator[pa.RecordBatch], large: int) -> Iterator[pa.RecordBatch]:
    """Over rows (choice, bytes, fp) sorted by posting: links of small postings, members of large ones.

    At most ``large`` rows of a posting are held; (choice, a, b) has a null ``b`` for a member.
    """
    held = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    open_large = None  # the key of a large posting whose first members have been passed on

    def work(choice, key, fps, final):
        nonlocal open_large
        edge = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.append(starts, len(fps)))
        many = sizes > large
        if open_large is not None and (choice[0], key[0]) == open_large:
            many[0] = True
        kept = len(fps)
        if not final and not many[-1]:  # the last posting may go on
            kept, starts, sizes, many = starts[-1], starts[:-1], sizes[:-1], many[:-1]
        open_large = (choice[-1], key[-1]) if kept == len(fps) and len(many) and many[-1] else None
        some = (sizes > 1) & ~many
        a, b = _pairs(fps, starts[some], sizes[some])
        at = np.flatnonzero(np.repeat(many, sizes))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(len(a), np.int32), choice[at]])), pa.array(np.concatenate([a, fps[at]]).view(np.int64)),
                                          pa.array(np.concatenate([b, fps[at]]).view(np.int64), mask=np.arange(len(a) + len(at)) >= len(a))], ["choice", "a", "b"])
        return choice[kept:], key[kept:], fps[kept:]

    for batch in batches:
        if batch.num_rows:
            new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            held = yield from work(*[np.concatenate(x) for x in zip(held, new)], False)
    if len(held[0]):
        yield from work(*held, True)


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that join exactly what pairs within MAX_BITS join; the values agree but for 16 bits."""
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    block = max(1, (1 << 22) // len(values))
    for s in range(0, len(values), block):
        near = np.bitwise_count(values[s:s + block, None] ^ values[None, :]) <= MAX_BITS
        for i in range(s, min(s + block, len(values))):
            found = np.flatnonzero(near[i - s, i + 1:]) + i + 1
            for j in found[parent[found] != parent[i]].tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((int(values[i].view(np.int64)), int(values[j].view(np.int64))))
    return links


def _large_links(members: DataFrame) -> DataFrame:
    """Links within large postings: their members (choice, fp), split by half-bytes of the free bytes."""
    rows = []
    for choice, chosen in enumerate(combinations(range(8), SHARED)):
        free = [8 * k + h for k in range(8) if k not in chosen for h in (0, 4)]
        rows += [(choice, _signed(BYTE_MASKS[choice] | m)) for m in _masks(4, free)]
    masks = members.sparkSession.createDataFrame(pa.table({"choice": pa.array([r[0] for r in rows], pa.int32()), "mask": pa.array([r[1] for r in rows], pa.int64())}))
    finer = members.join(F.broadcast(masks), "choice").select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))

    groups = finer.groupBy("mask", "bits").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            found = [pair for i in range(len(column)) for pair in _forest(column[i].values.to_numpy(zero_copy_only=False).view(np.uint64))]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.select("fps").mapInArrow(link, "a bigint, b bigint")


def links(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps(fp)``, enough to join what any pair within MAX_BITS joins."""
    index = _postings(fps).repartition("choice", "bytes").sortWithinPartitions("choice", "bytes").select("choice", "bytes", "fp")
    found = cut(index.mapInArrow(lambda batches: _scan(batches, large), "choice int, a bigint, b bigint"), "postings")
    small = found.where("b IS NOT NULL").select("a", "b")
    members = found.where("b IS NULL").select("choice", F.col("a").alias("fp"))
    return small.unionByName(_large_links(members)).distinct()


def _roots(distinct: DataFrame, large: int) -> DataFrame:
    """``distinct(fp, ...)`` with ``root``, one fingerprint that stands for its component."""
    roots = components(links(distinct.select("fp"), large))
    return distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = cut(fingerprints(docs, size, id_col, text_col), "fingerprints")
    linked = _roots(cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct"), large)
    # only linked fingerprints need their component's least id; all others have their own
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.join(least, "root").select("fp", "component_id")
    out = prints.join(of, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """One row, with all its columns, of each component.

    It is the row of the smallest id, null ids after all others; of an id's rows in the component that with the
    smallest fingerprint, then hash of the text; of rows equal in id and text the first by all columns. So an
    id that occurs with different texts loses none of them, unless they are near copies, and every run keeps the same rows.
    """
    prints = cut(fingerprints(docs, size, id_col, text_col), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    linked = _roots(cut(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct"), large)
    best = linked.groupBy("root").agg(F.min(F.struct("first.none", "first.doc_id", "fp", "first.text_hash")).alias("best"))
    chosen = cut(best.select("best.doc_id", "best.text_hash"), "chosen")
    rows = cut(prints.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "rows")
    same = (F.col("r.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("r.text_hash") == F.col("c.text_hash"))
    gone = cut(rows.alias("r").join(chosen.alias("c"), same, "left_anti").select("doc_id", "text_hash"), "gone")
    here = [F.col(f"d.`{c}`") for c in docs.columns]
    match = lambda other: F.col(f"d.`{id_col}`").eqNullSafe(F.col(f"{other}.doc_id")) & (text_hash(f"d.`{text_col}`") == F.col(f"{other}.text_hash"))
    kept = docs.alias("d").join(gone.alias("g"), match("g"), "left_anti")
    # rows that are equal in id and text: only these are grouped
    repeated = cut(rows.where("n > 1").alias("r").join(chosen.alias("c"), same, "left_semi").select("doc_id", "text_hash"), "repeated")
    if repeated.isEmpty():
        return kept.select(*here)
    once = kept.alias("d").join(repeated.alias("r"), match("r"), "left_anti").select(*here)
    row = F.struct(*here)
    several = kept.alias("d").join(repeated.alias("r"), match("r"))
    several = several.groupBy("r.doc_id", "r.text_hash").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return once.unionByName(several)
