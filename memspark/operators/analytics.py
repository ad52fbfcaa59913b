"""Aggregations over observations, events and token facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from ..functions.text import col


def whole(x):
    """Half-up rounding to a whole number, as BIGINT."""
    return F.floor(x + 0.5).cast("bigint")


def pct(part, total):
    """Whole percent, 0 when there is no total."""
    return F.when(col(total) > 0, whole(col(part) / F.when(col(total) > 0, col(total)) * 100)).otherwise(F.lit(0).cast("bigint"))


def token_economics(t: DataFrame, by: list[str]) -> DataFrame:
    """Messages, lengths, tokens in / out / saved and the saved share, per group."""
    g = t.groupBy(*by).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    g = g.withColumn("saved", F.greatest(F.lit(0).cast("bigint"), F.col("tokens_in") - F.col("tokens_out")))
    return g.withColumn("saved_pct", pct("saved", "tokens_in"))


def store_totals(t: DataFrame) -> DataFrame:
    """Store-wide totals in one pass: saved = store.in - (discovery.out + read.out), never below 0."""
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col(c))), F.lit(0)).cast("bigint")
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("bigint"))
    g = t.agg(of("store", "tokens_in").alias("tokens_in"), of("store", "tokens_out").alias("tokens_out"),
              (of("store", "tokens_in") - of("discovery", "tokens_out") - of("read", "tokens_out")).alias("_s"),
              n("discovery").alias("searches"), n("read").alias("reads"), n("store").alias("stores"))
    return g.select("tokens_in", "tokens_out", F.greatest("_s", F.lit(0).cast("bigint")).alias("saved"),
                    F.greatest(pct("_s", "tokens_in"), F.lit(0).cast("bigint")).alias("saved_pct"), "searches", "reads", "stores")


def compression(o: DataFrame, by: list[str]) -> DataFrame:
    g = o.groupBy(*by).agg(F.count("*").alias("n"), F.sum("original").alias("original"), F.sum("shortened").alias("shortened"))
    return g.withColumn("saved_pct", pct(F.col("original") - F.col("shortened"), "original"))


def sessions_per_entry(access: DataFrame, minimum: int = 1, approximate: bool = False) -> DataFrame:
    """Distinct sessions per knowledge entry; ``approximate`` only for dashboards."""
    n = F.approx_count_distinct("session_id") if approximate else F.countDistinct("session_id")
    return access.groupBy("knowledge_id").agg(n.alias("sessions")).where(F.col("sessions") >= minimum)


def importance_bucket(x):
    c = col(x)
    return (F.when(c >= 0.9, "0.9-1.0").when(c >= 0.8, "0.8-0.9").when(c >= 0.7, "0.7-0.8").when(c >= 0.6, "0.6-0.7")
            .when(c >= 0.5, "0.5-0.6").when(c >= 0.4, "0.4-0.5").when(c >= 0.3, "0.3-0.4").otherwise("0.0-0.3"))


def counts(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(scope, key, n) of several frames, each counted by one column."""
    out = None
    for scope, (df, key) in frames.items():
        one = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(scope).alias("scope"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out


def snapshot(frames: dict[str, tuple[DataFrame, str, str]], at) -> DataFrame:
    """Counts by kind at a point in time: ``{scope: (frame, time column, kind column)}``, plus a total per scope."""
    c = counts({s: (df.where(F.col(t) <= at), k) for s, (df, t, k) in frames.items()})
    return c.unionByName(c.groupBy("scope").agg(F.sum("n").alias("n")).select("scope", F.lit("(total)").alias("key"), "n"))


def then_and_now(frames: dict[str, tuple[DataFrame, str]], at, now) -> DataFrame:
    """Per scope, totals at ``at`` and ``now`` and what came between, one scan each."""
    out = None
    for scope, (df, t) in frames.items():
        one = df.agg(F.sum((F.col(t) <= at).cast("bigint")).alias("total_then"), F.count("*").alias("total_now"),
                     F.sum(((F.col(t) > at) & (F.col(t) <= now)).cast("bigint")).alias("between")).select(F.lit(scope).alias("scope"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("added", F.col("total_now") - F.col("total_then"))


def session_mode(obs: DataFrame) -> DataFrame:
    """Dominant observation type of a session and the mode it stands for; ties go to the later name."""
    c = obs.groupBy("session_id", "type").agg(F.count("*").alias("n"))
    top = c.groupBy("session_id").agg(F.max_by("type", F.struct("n", "type")).alias("type"))
    t = F.col("type")
    return top.withColumn("mode", F.when(t == "error", "investigating").when(t == "code", "implementing").when(t == "decision", "reviewing").otherwise("general"))


def budget(t: DataFrame, by: list[str], limit: int = 100_000, strategy: str = "warn", model_limit: int = 1_000_000) -> DataFrame:
    """Tokens used against a limit, with throttle / block flags and the warning level."""
    g = t.groupBy(*by).agg(F.sum("tokens_in").alias("used"))
    p = F.col("used") / F.lit(float(limit)) * 100 if limit > 0 else F.lit(0.0)
    g = g.withColumn("percentage", p)
    level = F.when(F.col("percentage") >= 90, "critical").when(F.col("percentage") >= 80, "warning").when(F.col("percentage") >= 60, "notice").otherwise("none")
    return g.withColumns({"throttled": F.col("percentage") >= 80, "blocked": (F.col("percentage") >= 100) & F.lit(strategy == "hard_stop"),
                          "level": level, "model_pct": whole(F.col("used") / model_limit * 100)})


def health(know: DataFrame, obs: DataFrame, sessions: DataFrame, chained: DataFrame, as_of) -> DataFrame:
    """One row: the five parts (whole percent) and the score out of 100."""
    day = lambda n: F.unix_micros(as_of) - F.lit(n * 86400 * 1000000).cast("bigint")
    k = know.where("not archived").agg(F.count("*").alias("total"), F.sum((F.unix_micros("last_accessed") > day(14)).cast("bigint")).alias("fresh"),
                                       F.countDistinct("category").alias("cats"), F.sum(F.col("stale").cast("bigint")).alias("stale"))
    pick = lambda df, e: df.agg(e.alias("x")).scalar()
    r = k.withColumns({"recent": pick(obs.where(F.unix_micros("indexed_at") > day(7)), F.count("*")),
                       "sess": pick(sessions, F.countDistinct("session_id")), "chain": pick(chained, F.count("*"))})
    ratio = lambda a, b, none: F.when(F.col(b) > 0, F.least(F.lit(1.0), F.coalesce(F.col(a), F.lit(0)) / F.col(b))).otherwise(F.lit(none))
    r = r.withColumns({"freshness": ratio("fresh", "total", 0.0), "coverage": F.least(F.lit(1.0), F.col("cats") / 5.0), "activity": F.least(F.lit(1.0), F.col("recent") / 100.0),
                       "clean": F.lit(1.0) - ratio("stale", "total", 0.0), "continuity": ratio("chain", "sess", 0.0)})
    score = F.col("freshness") * 30 + F.col("coverage") * 25 + F.col("activity") * 20 + F.col("clean") * 15 + F.col("continuity") * 10
    return r.select(whole(score).alias("score"), *[whole(F.col(c) * 100).alias(c) for c in ("freshness", "coverage", "activity", "clean", "continuity")])
