"""Jump hashing against a plain loop, its law, slots, and written shards."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np

from memspark.llm import shards
from memspark.llm.positions import numbered
from memspark.session import run_dir


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def plain_key(i):
    return int(hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()[:16], 16)


def test_jump_is_the_plain_loop():
    keys = [0, 1, (1 << 64) - 1, 1 << 63, *(plain_key(i) for i in range(3000))]
    for n in (1, 2, 24, 25, 1000):
        assert shards.jump(np.array(keys, np.uint64), n).tolist() == [plain_jump(k, n) for k in keys]


def test_published_values():
    assert [plain_jump(k, n) for k, n in ((1, 1), (42, 57), (0xDEAD10CC, 1), (0xDEAD10CC, 666), (256, 1024))] == [0, 43, 0, 361, 520]


def test_only_the_needed_share_moves():
    keys = np.array([plain_key(i) for i in range(40_000)], np.uint64)
    now, grown = shards.jump(keys, 24), shards.jump(keys, 25)
    moved = now != grown
    assert set(grown[moved]) == {24}
    assert abs(moved.mean() - 1 / 25) < 0.005
    sizes = np.bincount(now)
    assert len(sizes) == 24 and sizes.min() > 0.9 * 40_000 / 24 and sizes.max() < 1.1 * 40_000 / 24


def brute(rows, n):
    out, shard = [], defaultdict(list)
    for r in rows:
        data = (r["text"] or "").encode()
        shard[plain_jump(plain_key(r["doc_id"]), n)].append((r["doc_id"], len(data) + 8, zlib.crc32(data)))
    for s, found in shard.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        out += [(i, size, crc, "key", s, slot, plain_jump(plain_key(i), n + 1)) for slot, (i, size, crc) in enumerate(found)]
    return Counter(out)


def test_rows_against_brute_force(spark, messy, sf):
    for docs in (messy, spark.read.parquet(f"{sf}/documents.parquet")):
        for n in (1, 24):
            assert Counter(map(tuple, shards.place(docs, n).collect())) == brute(docs.collect(), n)


def test_empty_table(nothing):
    assert shards.place(nothing, 24).count() == 0
    assert shards.moves(nothing, 24).count() == 0


def test_written_shards_hold_every_row(spark, messy):
    root = run_dir(spark, "shards-test")
    shards.write_shards(messy, root, 5)
    back = spark.read.parquet(root)
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in back.collect()) == Counter((r["doc_id"], r["text"], r["lang"]) for r in messy.collect())
    assert all(r["shard"] == plain_jump(plain_key(r["doc_id"]), 5) for r in back.select("doc_id", "shard").collect())


def test_moves_go_to_appended_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in shards.moves(docs, 8, more=3).collect()}
    ids = [r[0] for r in docs.select("doc_id").collect()]
    assert got == {(i, a, b) for i in ids for a, b in [(plain_jump(plain_key(i), 8), plain_jump(plain_key(i), 11))] if a != b}
    assert all(b >= 8 for _, _, b in got)


def test_positions_of_a_hot_group_over_many_tasks(spark):
    rows = [("hot", i % 7, i) for i in range(2000)] + [("hot", 3, -1)] * 500 + [("a", 1, 0), ("b", None, 0)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(9)
    got = numbered(df, "g", ["k", "v"], "test", task_rows=100).collect()
    for g in ("hot", "a", "b"):
        found = sorted((r["position"], r["k"], r["v"]) for r in got if r["g"] == g)
        assert [p for p, _, _ in found] == list(range(len(found))) and all(r["of"] == len(found) for r in got if r["g"] == g)
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
