"""Dual-tree Lloyd rounds against plain ones, in whole numbers."""

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from memspark.llm import vector_codes as V


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error, sha) by plain loops over Python's whole numbers."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(xs) // len(members[j]) for xs in zip(*members[j])) if members[j] else e for j, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found, by_label = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        found.append((i, "".join(f"{j:02x}" for _, j in best), error, label))
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, code, fit(e), fit(by_label[label]), sha) for i, code, e, label in found), key=str)


def rows_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")


def same(spark, rows, kind="float", **args):
    df = rows_of(spark, rows, kind)
    got = V.compress(df, block=64, **args)[0].collect()
    exact = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert sorted(map(tuple, got), key=str) == plain(exact, **args)


def gaussian(n, d, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, d))
    return (centres[r.integers(0, 5, n)] + spread * r.normal(size=(n, d)) * 0.1).astype(np.float32).tolist()


def test_clusters_ties_copies_and_bad_vectors(spark):
    vectors = gaussian(300, 16, 1) + [[0.5] * 16] * 40 + [[0.0] * 16] * 3 + [[1 / 4096, -1 / 4096] * 8] * 5
    rows = [(i, v, None if i % 5 == 0 else i % 3) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 15, 1), (1002, [float("nan")] * 16, 2), (1003, [float("inf")] + [0.0] * 15, 2), (None, vectors[3], 1), (7, vectors[9], 1), (7, vectors[9], None)]
    same(spark, rows)


def test_wide_spread_small_codebooks(spark):
    same(spark, [(i, v, 0) for i, v in enumerate(gaussian(200, 24, 2, 9.0))], parts=4, entries=5, rounds=3)


def test_fewer_vectors_than_entries_and_one(spark):
    same(spark, [(i, v, i) for i, v in enumerate(gaussian(6, 8, 3))])
    same(spark, [(0, [1.0] * 8, None)])


def test_huge_components(spark):
    vectors = gaussian(60, 8, 4) + [[1e30, -1e30] * 4, [3e38] * 8, [-3e38] * 8, [1e12] * 8]
    same(spark, [(i, v, i % 2) for i, v in enumerate(vectors)])
    same(spark, [(i, [x * 1e290 for x in v], i % 2) for i, v in enumerate(gaussian(30, 8, 5))], kind="double")


def test_no_components_and_empty_tables(spark):
    same(spark, [(i, [], 1) for i in range(40)])
    assert V.compress(rows_of(spark, []))[0].count() == 0
    assert V.compress(rows_of(spark, [(1, None, 1), (2, [None], 1)]))[0].count() == 0


def test_unequal_lengths_are_an_error(spark):
    with pytest.raises(ValueError, match="components"):
        V.compress(rows_of(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)]))
    with pytest.raises(ValueError, match="components"):
        V.compress(rows_of(spark, [(1, [1.0] * 9, 1)]))


def test_walk_is_exact_and_assigns_whole_nodes():
    r = np.random.default_rng(6)
    points = np.concatenate([r.integers(-40, 40, (500, 8)) + 1000 * c for c in range(4)])
    entries = np.concatenate([points[r.choice(len(points), 13)], points[:1], points[:1]])
    tree = V.build(points)
    distance = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (V.nearest(tree, entries) == distance.argmin(1)).all()
    count, total = V.totals(tree, entries)
    assert (count == np.bincount(distance.argmin(1), minlength=len(entries))).all()
    assert all((total[e] == points[distance.argmin(1) == e].sum(0)).all() for e in range(len(entries)))
    far = np.array([[1000 * c] * 8 for c in range(4)])
    kinds = [(kind, len(got[1])) for kind, got in V.walk(tree, far)]
    assert {k for k, _ in kinds} == {"node"} and sum(n for _, n in kinds) < 50  # 2,000 parts in a few nodes


def test_codes_decode_near_the_vectors(spark):
    rows = [(i, v, 0) for i, v in enumerate(gaussian(200, 16, 7))]
    df = rows_of(spark, rows)
    codes, books = V.compress(df, block=64)
    got = {r["vec_id"]: r["vector"] for r in V.decode(codes, books).collect()}
    error = {r["vec_id"]: r["error"] for r in codes.collect()}
    for i, v, _ in rows:
        assert abs(sum((a - b) ** 2 for a, b in zip(got[i], v)) - error[i] / 4096 ** 2) < 0.01
