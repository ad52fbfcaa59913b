"""Approximate vector search: inverted lists over coarse centroids, exact scores within the lists that are probed.

Centroids and the number of probes are fitted on a bounded sample; every vector is put into the list of its nearest
centroid. A list is held in blocks, as matrices, so a list with a third of all vectors is many rows. A query goes to
the lists of its nearest centroids; blocks of queries meet blocks of vectors of a list by an equi-join (which the
planner may split where it is skewed), and each meeting is one matrix product that gives k rows a query at most. The exact
search stays in ``retrieval.vector_search``.

Null vectors, and those of another length than most of the sample, are in no list; a zero vector has cosine 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from . import retrieval as R

#: Vectors of the sample, most lists, vectors and queries of a block.
SAMPLE, MOST_LISTS, BLOCK, QUERY_BLOCK = 8192, 4096, 1024, 256
#: Share of the sample's true neighbours that the probes must find there.
TARGET = 0.97


@dataclass
class Lists:
    blocks: DataFrame
    centroids: np.ndarray
    probes: int


def _nearest(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of unit vectors, nearest first."""
    score = rows @ centroids.T - (centroids * centroids).sum(1) / 2
    return np.argsort(-score, axis=1, kind="stable")[:, :n]


def _centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    start = np.linspace(0, len(sample) - 1, lists).astype(int)
    out = sample[start].copy()
    for _ in range(rounds):
        of = _nearest(sample, out, 1)[:, 0]
        total = np.zeros_like(out)
        np.add.at(total, of, sample)
        count = np.bincount(of, minlength=lists)
        out[count > 0] = total[count > 0] / count[count > 0, None]
    return out


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """The fewest lists in which ``target`` of the k nearest of some of the sample's vectors lie."""
    asked = sample[:: max(1, len(sample) // 512)]
    score = asked @ sample.T
    near = np.argsort(-score, axis=1, kind="stable")[:, 1:k + 1]
    of = _nearest(sample, centroids, 1)[:, 0]
    order = np.argsort(_nearest(asked, centroids, len(centroids)), axis=1)  # the place of each list for each query
    places = np.take_along_axis(order, of[near], axis=1).ravel()
    return int(np.sort(places)[max(0, int(np.ceil(target * len(places))) - 1)]) + 1 if len(places) else 1


def build(corpus: DataFrame, k: int = 10, lists: int | None = None, target: float = TARGET, sample: int = SAMPLE) -> Lists:
    """Lists of ``corpus(id, embedding)``; by default as many as the square root of the number of vectors."""
    there = corpus.select("id", F.col("embedding").cast("array<float>").alias("embedding")).where("embedding IS NOT NULL AND size(embedding) > 0")
    n = there.count()
    # the sample depends on the ids alone
    taken = there.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
    if not taken:
        return Lists(there.select(F.lit(0).alias("list"), F.array("id").alias("ids"), F.lit(b"").alias("matrix")).where("false"), np.zeros((0, 0)), 1)
    sizes = pd.Series([len(r[0]) for r in taken])
    dim = int(sizes.mode()[0])
    points = R._unit([r[0] for r in taken if len(r[0]) == dim])
    centroids = _centroids(points, min(len(points), MOST_LISTS, lists or max(1, int(round(n ** 0.5)))))
    probes = _probes(points, centroids, k, target)
    kind = dict(there.dtypes)["id"]
    place = lambda batches: _placed(batches, centroids)
    placed = there.where(F.size("embedding") == dim).mapInPandas(place, f"list int, id {kind}, matrix binary")
    # a list is dealt by id over several tasks, so that none gets more than its share of it
    spread = max(1, n // (200 * BLOCK * max(1, len(centroids))))
    dealt = placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("list", "id")
    return Lists(cut(dealt.mapInPandas(_blocked, f"list int, ids array<{kind}>, matrix binary"), "vector-lists"), centroids, probes)


def _placed(batches, centroids):
    for b in batches:
        if len(b):
            unit = R._unit(b["embedding"])
            yield pd.DataFrame({"list": _nearest(unit, centroids, 1)[:, 0].astype(np.int32), "id": b["id"], "matrix": [x.tobytes() for x in unit]})


def _blocked(batches):
    for b in batches:
        for number, rows in b.groupby("list", sort=True):
            for s in range(0, len(rows), BLOCK):
                part = rows[s:s + BLOCK]
                yield pd.DataFrame({"list": [np.int32(number)], "ids": [part["id"].tolist()], "matrix": [b"".join(part["matrix"])]})


def search(index: Lists, queries: DataFrame, k: int, threshold: float = 0.2, probes: int | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` of the probed lists by exact cosine; ``queries(query_id, embedding)``."""
    centroids, n = index.centroids, probes or index.probes
    dim = centroids.shape[1]
    kind, other = dict(queries.dtypes)["query_id"], index.blocks.schema["ids"].dataType.elementType.simpleString()
    if not len(centroids):
        return index.blocks.select(F.lit(None).cast(kind).alias("query_id"), F.element_at("ids", 1).alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")

    def send(batches):
        for b in batches:
            if len(b):
                unit = R._unit(b["embedding"])
                near = _nearest(unit, centroids, n)
                yield pd.DataFrame({"list": near.ravel().astype(np.int32), "id": np.repeat(b["query_id"].to_numpy(), near.shape[1]), "matrix": [u.tobytes() for u in np.repeat(unit, near.shape[1], axis=0)]})

    asked = queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding")).where(F.size("embedding") == dim)
    sent = asked.mapInPandas(send, f"list int, id {kind}, matrix binary").repartition("list", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("list", "id")
    q = sent.mapInPandas(lambda batches: _query_blocks(batches), f"list int, asked array<{kind}>, vectors binary")

    def score(batches):
        for b in batches:
            for ids, matrix, mine, vectors in zip(b["ids"], b["matrix"], b["asked"], b["vectors"]):
                ids, mine = np.asarray(ids), np.asarray(mine)
                sim = np.frombuffer(vectors).reshape(-1, dim) @ np.frombuffer(matrix).reshape(-1, dim).T
                if exclude_self:
                    sim[mine[:, None] == ids[None, :]] = -2.0
                rows, columns = np.nonzero(sim >= threshold)
                hit = pd.DataFrame({"query_id": mine[rows], "id": ids[columns], "score": sim[rows, columns]})
                hit["_r"] = hit["score"].round(9)
                yield hit.sort_values(["query_id", "_r", "id"], ascending=[True, False, True]).drop(columns="_r").groupby("query_id", sort=False).head(k)

    met = q.join(index.blocks, "list").select("ids", "matrix", "asked", "vectors")
    return R.top_k(met.mapInPandas(score, f"query_id {kind}, id {other}, score double"), k)


def _query_blocks(batches):
    for b in batches:
        for number, rows in b.groupby("list", sort=True):
            for s in range(0, len(rows), QUERY_BLOCK):
                part = rows[s:s + QUERY_BLOCK]
                yield pd.DataFrame({"list": [np.int32(number)], "asked": [part["id"].tolist()], "vectors": [b"".join(part["matrix"])]})


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results (query_id, id) that were found."""
    n = exact.count()
    return found.join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / n if n else 1.0
