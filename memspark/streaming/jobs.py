"""Structured Streaming jobs.

Each takes a streaming frame and returns one; :func:`drain` runs a query over
what is there and writes it to the cluster's shared folder. Rules that need the rows of a
key in order walk them as the watermark passes (``in_order``), across as many micro-batches
as the source's trigger options make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import INPUT
from ..session import run_dir
from .in_order import InOrder, in_order
from .islands import cooldown_rule, dedup_rule, rate_rule

#: Seconds of event time whose rows of one key wait together: a few rows a bucket are cheap, all of them must fit a task.
DAY = 86400


def read_events(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The raw events (one file or a folder of part files) as a stream, times cast for watermarks.

    ``max_files`` bounds a micro-batch; without it a drain takes all files at once.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    s = spark.readStream.schema(INPUT["events"])
    if max_files:
        s = s.option("maxFilesPerTrigger", max_files)
    # as a pattern the path may name a file as well as a folder
    return s.parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, label: str, mode: str = "append", timeout: int = 600) -> DataFrame:
    """Process everything available into a table of the shared folder and return that table."""
    spark = stream.sparkSession
    out, mark = run_dir(spark, label), run_dir(spark, f"{label}-checkpoint")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(label)
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, keys: list[str], label: str, timeout: int = 600) -> DataFrame:
    """Process everything available in update mode and return the last state of every key.

    Unlike an append, windows that are still open when the input ends are in the result.
    """
    spark = stream.sparkSession
    out, mark = run_dir(spark, label), run_dir(spark, f"{label}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again replaces itself

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(label)
    values = [c for c in stream.columns if c not in keys]
    schema = stream.select("*", F.lit(0).alias("_batch")).schema
    rows = spark.read.schema(schema).parquet(f"{out}/batch=*")
    return rows.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in values])


def dedup_exact(events: DataFrame, seconds: float = 60.0, delay: str = "1 hour", bucket: int = DAY) -> InOrder:
    """Keep a row of ``(hash, id, ts)`` unless one with its hash was kept less than ``seconds`` before."""
    step = dedup_rule(seconds)

    def rule(state, t, id_):
        last, kept = step(state[0] if state else None, t)
        return (last,), [(id_,)] if kept else []

    return in_order(events, ["hash"], [], rule, "id bigint", "last double", delay, bucket, span=seconds)


def error_fixes(events: DataFrame, span_days: float | None = None, delay: str = "1 hour", bucket: int = DAY) -> InOrder:
    """A modify that follows an unfixed error of its session fixes the latest one (of the last ``span_days``, where they are given)."""
    def rule(state, t, id_, kind):
        open_id = state[0] if state else -1
        if kind == "error":
            return (id_,), []
        return (-1,), [(open_id, id_)] if open_id >= 0 else []

    e = events.where(F.col("event_type").isin("error", "file_modify"))
    return in_order(e, ["session_id"], ["event_type"], rule, "error_id bigint, fix_id bigint", "open bigint", delay, bucket, span=span_days and span_days * 86400)


def rate_classes(events: DataFrame, window: float = 60.0, full: int = 3, limited: int = 8, delay: str = "1 hour", bucket: int = DAY) -> InOrder:
    """full / limited / blocked per caller; the window restarts at the first call after it expired."""
    step = rate_rule(window, full, limited)

    def rule(state, t, id_):
        state, label = step(state, t)
        return state, [(id_, label)]

    return in_order(events, ["session_id"], [], rule, "id bigint, label string", "start double, n bigint", delay, bucket, span=window)


def running_budget(facts: DataFrame, limit: int, levels=(60, 80, 90, 100), delay: str = "1 hour", bucket: int = DAY) -> InOrder:
    """Cumulative tokens per session; one row whenever a level (percent of ``limit``) is crossed."""
    def rule(state, t, id_, n):
        before = state[0] if state else 0
        used = before + int(n)
        return (used,), [(id_, lv, used) for lv in levels if before * 100 < lv * limit <= used * 100]

    return in_order(facts, ["session_id"], ["tokens_in"], rule, "id bigint, level bigint, used bigint", "used bigint", delay, bucket)


def liveness_stream(beats: DataFrame, gap: float = 300.0, delay: str = "1 hour", bucket: int = DAY) -> InOrder:
    """A row when an agent has been silent for ``gap`` seconds: its beats, the first and the last of them, and when it went stale."""
    us = lambda t: int(round(t * 1e6))
    stale = lambda state: [(state[2], us(state[0]), us(state[1]), us(state[1] + gap))]

    def rule(state, t, id_):
        if state and t - state[1] <= gap:
            return (state[0], t, state[2] + 1), []
        return (t, t, 1), stale(state) if state else []

    return in_order(beats, ["session_id"], [], rule, "beats bigint, first_us bigint, last_us bigint, stale_us bigint", "first double, last double, beats bigint", delay, bucket, span=gap, idle=stale)


def cooldown(events: DataFrame, per_minute: int = 2, topic_seconds: float = 300.0, delay: str = "1 hour", bucket: int = DAY) -> InOrder:
    """Allowed injections per session: a minute limit and a pause per topic."""
    step = cooldown_rule(per_minute, topic_seconds)

    def rule(state, t, id_, topic):
        (recent, topics), ok = step((tuple(state[0]), dict(zip(state[1], state[2]))) if state else None, t, topic)
        return (list(recent), list(topics), [float(x) for x in topics.values()]), [(id_,)] if ok else []

    return in_order(events, ["session_id"], ["k"], rule, "id bigint", "recent array<double>, topics array<string>, times array<double>", delay, bucket, span=max(topic_seconds, 60.0))


def hourly(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Hourly counts, emitted once the watermark has passed the hour."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(
        F.unix_timestamp("window.start").alias("hour"), "event_type", "n")


def liveness(beats: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Periods an agent was alive: heartbeats closer than ``gap`` belong together."""
    return beats.groupBy("session_id", F.session_window("ts", gap)).agg(F.count("*").alias("beats"), F.min("ts").alias("first"), F.max("ts").alias("last"))
