"""Joins that Spark has no single operator for, written so that they stay equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from ..functions.text import col


def valid_at(facts: DataFrame, at) -> DataFrame:
    """Facts whose half-open interval [valid_from, valid_to) holds ``at``."""
    t = col(at)
    return facts.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def interval_join(facts: DataFrame, probes: DataFrame, keys: list[str], at: str, width_days: int = 365) -> DataFrame:
    """Every probe with the facts of its key valid at its time; intervals may overlap and be open.

    A fact is copied into each time bucket its interval covers (an open one up
    to the newest probe), so key + bucket is an equi key and the range test is
    a filter: no nested loop, and one long-lived key is split by time.
    """
    width = width_days * 86400
    b = lambda c: F.floor(F.unix_timestamp(c) / width)
    last = probes.agg(F.max(at).alias("m"))
    f = facts.withColumn("_end", F.coalesce(F.least("valid_to", last.scalar()), last.scalar()))
    f = f.where(F.col("_end") >= F.col("valid_from")).withColumn("_b", F.explode(F.sequence(b("valid_from"), b("_end")))).drop("_end")
    p = probes.withColumn("_b", b(at))
    j = p.join(f, [*keys, "_b"])
    return j.where((F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(at)))).drop("_b")


def last_k_before(probes: DataFrame, facts: DataFrame, keys: list[str], k: int, within_seconds: int, bucket_seconds: int | None = None) -> DataFrame:
    """For each probe ``(keys, pid, pts)`` the ``k`` newest facts ``(keys, fid, fts, ...)`` strictly before it and inside the span.

    Facts are numbered along time; a probe at place n reads places n-k+1 .. n by
    an equi-join, so the work is k rows per probe however dense a key is. Without keys the buckets are cut by the facts' density.
    """
    from .ordered import bucket_width, running

    bucket_seconds = bucket_seconds or (86400 if keys else bucket_width(facts, "fts"))
    bucket = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    numbered = running(facts, keys, ["fts", "fid"], bucket("fts"), count="_pos")
    marks = probes.select(*keys, "pid", "pts", F.lit(0).alias("_f")).unionByName(
        facts.select(*keys, F.col("fid").alias("pid"), F.col("fts").alias("pts"), F.lit(1).alias("_f")))
    seen = running(marks.withColumn("_f", F.col("_f").cast("bigint")), keys, ["pts", "_f", "pid"], bucket("pts"), sums={"_n": "_f"})
    want = seen.where("_f = 0").select(*keys, "pid", "pts", F.explode(F.sequence(F.greatest(F.col("_n") - k + 1, F.lit(1)), F.greatest(F.col("_n"), F.lit(1)))).alias("_pos"), "_n")
    j = want.where("_pos <= _n").join(numbered, [*keys, "_pos"])
    far = F.unix_micros("pts") - F.lit(within_seconds).cast("bigint") * 1000000
    return j.where(F.unix_micros("fts") > far).drop("_pos", "_n")


def first_after(df: DataFrame, keys: list[str], bucket) -> DataFrame:
    """Decision → first problem within 7 days → first milestone within 14 days of that problem.

    ``df(keys, id, ts, kind)`` with kinds decision / problem / milestone; two
    passes of nearest-later-row, no self-join.
    """
    from .ordered import neighbours

    m = neighbours(df, keys, ["ts", "id"], bucket, after={"_m_id": "id", "_m_ts": "ts"}, where=F.col("kind") == "milestone")
    p = neighbours(m, keys, ["ts", "id"], bucket, after={"p_id": "id", "p_ts": "ts", "m_id": "_m_id", "m_ts": "_m_ts"}, where=F.col("kind") == "problem")
    gap = lambda a, b: F.unix_micros(a) - F.unix_micros(b)
    day = 86400 * 1000000
    return p.where((F.col("kind") == "decision") & (gap("p_ts", "ts") <= F.lit(7 * day).cast("bigint")) & (gap("m_ts", "p_ts") <= F.lit(14 * day).cast("bigint"))).select(
        *keys, F.col("id").alias("decision_id"), F.col("p_id").alias("problem_id"), F.col("m_id").alias("milestone_id"))


def either_endpoint(edges: DataFrame) -> DataFrame:
    """(node, other, ...): each edge seen from both ends, so an OR over endpoints is one equi-join."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest).unionByName(
        edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    return either_endpoint(edges).groupBy("node").agg(F.count("*").alias("degree"))


def suffix_paths(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of paths where one equals or ends with the other; file names are the equi key."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    j = a.withColumn("_base", base(left)).join(b.withColumn("_base", base(right)), "_base").drop("_base")
    return j.where(F.endswith(F.col(left), F.col(right)) | F.endswith(F.col(right), F.col(left)))
