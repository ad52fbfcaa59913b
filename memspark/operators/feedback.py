"""Usefulness feedback: a search result whose file is modified later in its session was useful.

Two paths name one file if one is the other's ending in whole components (``core/a.ts`` of
``src/core/a.ts``). Each path is indexed by its component suffixes; a pair meets on the shorter
one's whole path, so the join is an equi-join and every pair meets once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import neighbours

#: A useful entry's relevance is multiplied, up to a cap.
BOOST, CAP = 1.1, 5.0


def suffixes(path: str) -> Column:
    """(key, whole) of every suffix of whole components of a path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.array_join(F.slice(parts, n - k + 1, k), "/").alias("key"), (k == n).alias("whole")))


def keyed(rows: DataFrame, path: str = "path") -> DataFrame:
    """Every row once for each suffix of its path, as ``key`` and ``whole``."""
    return rows.withColumn("_s", F.explode(suffixes(path))).select(*rows.columns, "_s.key", "_s.whole")


def first_useful(results: DataFrame, edits: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """(id, useful_at): the first edit of a result's file at or after it, in its session; both are ``(id, session_id, ts, path)``.

    Results look for edits whose suffix they are, and by their own proper suffixes for edits
    of a shorter path; the nearest later row of the key answers, without a list of pairs.
    """
    r = keyed(results).withColumn("_by", F.when(F.col("whole"), "mine").otherwise("theirs")).withColumn("_edit", F.lit(0))
    e = keyed(edits).withColumn("_by", F.explode(F.when(F.col("whole"), F.array(F.lit("mine"), F.lit("theirs"))).otherwise(F.array(F.lit("mine"))))).withColumn("_edit", F.lit(1))
    columns = ["id", "session_id", "ts", "key", "_by", "_edit"]
    both = r.select(*columns).unionByName(e.select(*columns))
    n = neighbours(both, ["session_id", "_by", "key"], ["ts", "_edit", "id"], F.floor(F.unix_timestamp("ts") / bucket_seconds), after={"useful_at": "ts"}, where=F.col("_edit") == 1)
    return n.where("_edit = 0 AND useful_at IS NOT NULL").groupBy("id").agg(F.min("useful_at").alias("useful_at"))


def boosted(entries: DataFrame, useful: DataFrame) -> DataFrame:
    """Entries ``(id, relevance_score, ...)`` with ``last_useful_at`` set and relevance raised where they were useful."""
    u = useful.select("id", F.col("useful_at").alias("last_useful_at"))
    raised = F.least(F.col("relevance_score") * BOOST, F.lit(CAP))
    return entries.join(u, "id", "left").withColumn("relevance_score", F.when(F.col("last_useful_at").isNotNull(), raised).otherwise(F.col("relevance_score")))


def matches(results: DataFrame, edits: DataFrame, within: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """(result_id, edit_id) of two streams ``(id, session_id, ts, path)``: joined on session, suffix and time range, with watermarks."""
    s = keyed(results.withWatermark("ts", delay)).select(F.col("id").alias("result_id"), F.col("session_id").alias("s"), F.col("key").alias("f"), F.col("whole").alias("s_whole"), F.col("ts").alias("t"))
    m = keyed(edits.withWatermark("ts", delay)).select(F.col("id").alias("edit_id"), "session_id", "key", "whole", "ts")
    return s.join(m, F.expr(f"s = session_id AND f = key AND (s_whole OR whole) AND ts >= t AND ts <= t + interval {within}")).select("result_id", "edit_id")
