"""Sequence operators: timelines, pairing, nth occurrence, budgets, chains, top-k, set difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from ..session import cut
from .ordered import bucket_width, neighbours, running


def anchor_timeline(rows: DataFrame, anchors: DataFrame, before: int, after: int, bucket_seconds: int | None = None) -> DataFrame:
    """(anchor_id, id, offset): rows within ``before``/``after`` places of every anchor, anchor at 0.

    Places come from bucketed counting; each anchor asks for its places by an equi-join. Buckets are cut by the rows' density.
    """
    bucket_seconds = bucket_seconds or bucket_width(rows, "ts")
    p = running(rows, [], ["ts", "id"], F.floor(F.unix_timestamp("ts") / bucket_seconds), count="_pos")
    a = p.join(anchors.select("id"), "id", "left_semi").select(F.col("id").alias("anchor_id"), F.col("_pos").alias("_a"))
    want = a.select("anchor_id", "_a", F.explode(F.sequence(F.col("_a") - before, F.col("_a") + after)).alias("_pos"))
    return want.join(p, "_pos").select("anchor_id", "id", (F.col("_pos") - F.col("_a")).alias("offset"))


def error_fixes(events: DataFrame, bucket, keys=("session_id",)) -> DataFrame:
    """A modify whose nearest earlier error/modify of the session is an error fixes that error."""
    keys = list(keys)
    e = events.where(F.col("event_type").isin("error", "file_modify"))
    n = neighbours(e, keys, ["ts", "id"], bucket, before={"_pt": "event_type", "error_id": "id", "_pts": "ts"})
    n = n.where((F.col("event_type") == "file_modify") & (F.col("_pt") == "error"))
    return n.select(*keys, "error_id", F.col("id").alias("fix_id"), ((F.unix_micros("ts") - F.unix_micros("_pts")) / 1e6).alias("seconds"))


def nth_occurrence(df: DataFrame, keys: list[str], order: list, bucket, n: int) -> DataFrame:
    return running(df, keys, order, bucket, count="_n").where(F.col("_n") == n).drop("_n")


def budget_fill(df: DataFrame, keys: list[str], order: list, bucket, size: str, budget: int) -> DataFrame:
    """Ranked rows while their cumulative size fits; the sum only grows, so the first overflow ends the list."""
    return running(df, keys, order, bucket, sums={"used": size}).where(F.col("used") <= budget)


def trim_snapshots(cats: DataFrame, limit: int = 16384) -> DataFrame:
    """Fit each session's categories into ``limit`` characters of JSON.

    Priority 3 goes first, smallest first, then priority 2; what is left of
    priority 1 is cut to equal shares. ``cats(session_id, category, priority, content)``.
    """
    entry = F.to_json(F.create_map("category", "content"))
    c = cats.withColumns({"_len": F.length(entry) - 1, "_bytes": F.octet_length(entry)})  # entry without braces, plus its comma
    total = c.groupBy("session_id").agg((F.sum("_len") + 1).alias("_total"))
    c = c.withColumns({"_neg": -F.col("priority"), "_drop": F.when(F.col("priority") >= 2, F.col("_len")).otherwise(0).cast("bigint")})
    r = running(c, ["session_id"], ["_neg", "_bytes", "category"], F.struct("_neg", F.floor(F.log2("_bytes") * 8)), sums={"_gone": "_drop"})
    r = r.join(total, "session_id")
    kept = r.where((F.col("priority") == 1) | (F.col("_total") - (F.col("_gone") - F.col("_drop")) <= limit))
    left = kept.groupBy("session_id").agg((F.sum("_len") + 1).alias("_left"), F.count("*").alias("_n"))
    k = kept.join(left, "session_id")
    share = F.greatest(F.lit(50).cast("bigint"), F.floor((limit - 2 - 6 * F.col("_n")) / F.col("_n"))).cast("int")
    text = F.when((F.col("_left") <= limit) | (F.length("content") <= share), F.col("content")).otherwise(
        F.concat(F.substr("content", F.lit(1), share - 3), F.lit("...")))
    return k.select("session_id", "category", "priority", text.alias("content"))


def chain_walk(chain: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(seed, id, steps): ancestors of every seed up to ``limit`` entries, by pointer doubling.

    ``chain(id, parent)``. log2(limit) joins instead of one per step; each round is written out.
    """
    jump = cut(chain.where("parent is not null").select("id", "parent"), "jump")
    walk = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("steps"))
    span = 1
    while span < limit:
        more = walk.join(jump, "id").select("seed", F.col("parent").alias("id"), (F.col("steps") + span).alias("steps"))
        walk = cut(walk.unionByName(more), "walk")
        span *= 2
        if span < limit:
            up = jump.select(F.col("id").alias("parent"), F.col("parent").alias("far"))
            jump = cut(jump.join(up, "parent").select("id", F.col("far").alias("parent")), "jump")
    return walk.where(F.col("steps") < limit)


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fill(first: DataFrame, second: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """All of ``first``, then rows of ``second`` with other ids, up to ``k`` per group."""
    rest = second.join(first.select("id"), "id", "left_anti")
    both = first.withColumn("leg", F.lit(0)).unionByName(rest.withColumn("leg", F.lit(1)))
    return top_per_group(both, by, ["leg", *order], k)


def new_since(df: DataFrame, keys: list[str], at: str, baseline) -> DataFrame:
    """Distinct keys seen at or after the baseline time and never before it; one aggregation."""
    return df.groupBy(*keys).agg(F.min(at).alias("_first")).where(F.col("_first") >= baseline).drop("_first")
