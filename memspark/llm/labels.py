"""Folds and bounded training samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(id_col: Column, folds: int, held: int) -> Column:
    """Whether the row is held out: crc32 of the id as text, modulo ``folds``, is ``held``. A null id isn't."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, each: int, id_col: str = "doc_id", text_col: str = "text", max_chars: int = 65536) -> tuple[list[bytes], list[int], dict[int, int]]:
    """(texts, labels, number of training labels of each class): at most ``each`` training rows of each class.

    The rows are those of the smallest id hashes among the labels outside the held-out
    fold; texts over ``max_chars`` are not used to train. At most ``2 * each * max_chars``
    characters reach the driver, whatever the tables' size.
    """
    known = labels.where(F.col(target).isin(0, 1) & ~fold(F.col(id_col), folds, held) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(target).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for k in (0, 1)]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.length("text") <= max_chars)
    # the sample is bounded by ``each``; a repeated id is used once
    found = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
    got = sorted((r["doc_id"], r["label"], r["text"]) for r in found.collect())
    return [t.encode() for _, _, t in got], [int(y) for _, y, _ in got], {k: counts.get(k, 0) for k in (0, 1)}
