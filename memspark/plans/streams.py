"""Registered queries: streaming operators (M), each beside its batch twin."""

from pyspark.sql import functions as F

from ..functions.text import round6
from ..operators import feedback as FB, sequences as SQ
from ..operators.ordered import neighbours, running
from ..streaming import islands as IS, jobs as JB
from ..views import events, events_from, table, tokens, ts
from .lifecycle import PATHS_SQL, results_and_edits
from .registry import query, sql

#: A session has a row or two a day here, so a week of them waits together.
WEEK = 7 * JB.DAY


def day():
    return F.floor(F.unix_timestamp("ts") / 86400)


def stream(spark, sf, *more):
    return events_from(JB.read_events(spark, sf), *more)


def hashed(e):
    """The content a queue would hash: kind and payload."""
    return e.select("id", "ts", F.md5(F.concat_ws("|", "event_type", "k")).alias("hash"))


# each kept row leads to the first one of its hash at least an hour later
_M1 = sql("""SELECT hash, id FROM kept""", "v_events", ctes="""h AS (SELECT id, ts, md5(concat_ws('|', event_type, k)) AS hash, row_number() OVER (PARTITION BY md5(concat_ws('|', event_type, k)) ORDER BY ts, id) AS rn FROM v_events),
nx AS (SELECT a.hash, a.rn, min(b.rn) AS nrn FROM h a LEFT JOIN h b ON a.hash = b.hash AND b.rn > a.rn AND b.ts >= a.ts + INTERVAL 3600 SECOND GROUP BY ALL),
kept AS (SELECT hash, rn, id FROM h WHERE rn = 1 UNION ALL SELECT h.hash, h.rn, h.id FROM kept JOIN nx ON nx.hash = kept.hash AND nx.rn = kept.rn JOIN h ON h.hash = nx.hash AND h.rn = nx.nrn)""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("m1_dedup_stream", _M1)
def m1(spark, sf):
    return JB.dedup_exact(hashed(stream(spark, sf)), 3600.0, bucket=WEEK).drain("dedup", at_once=True)[0]


@query("m1_dedup_batch", _M1)
def m1b(spark, sf):
    kept = IS.walk(hashed(events(spark, sf)), ["hash"], 3600, IS.dedup_rule(3600.0), "kept", "boolean")
    return kept.where("kept").select("hash", "id")


_M3 = sql("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM v_events GROUP BY ALL", "v_events")


@query("m3_hourly_stream", _M3)
def m3s(spark, sf):
    return JB.drain_updates(JB.hourly(stream(spark, sf)), ["hour", "event_type"], "hourly")


@query("m3_hourly_batch", _M3)
def m3(spark, sf):
    e = events(spark, sf)
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("window.start").alias("hour"), "event_type", "n")


@query("m4_error_fix_stream", sql("""SELECT session_id, pid AS error_id, id AS fix_id FROM (SELECT *, lag(event_type) OVER w AS pt, lag(id) OVER w AS pid FROM v_events WHERE event_type IN ('error', 'file_modify')
 WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)) WHERE event_type = 'file_modify' AND pt = 'error'""", "v_events"))
def m4(spark, sf):
    return JB.error_fixes(stream(spark, sf), bucket=WEEK).drain("fixes", at_once=True)[0]


# row by row within a session: the window restarts at the first call after it expired
_M5 = sql("""SELECT session_id, id, CASE WHEN n <= 3 THEN 'full' WHEN n <= 8 THEN 'limited' ELSE 'blocked' END AS label FROM st""", "v_events", ctes="""o AS (SELECT session_id, id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS rn FROM v_events),
st AS (SELECT session_id, id, rn, ts AS start, 1 AS n FROM o WHERE rn = 1 UNION ALL
 SELECT o.session_id, o.id, o.rn, CASE WHEN o.ts - start <= INTERVAL 36000 SECOND THEN start ELSE o.ts END, CASE WHEN o.ts - start <= INTERVAL 36000 SECOND THEN n + 1 ELSE 1 END FROM st JOIN o ON o.session_id = st.session_id AND o.rn = st.rn + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("m5_rate_limit_stream", _M5)
def m5s(spark, sf):
    return JB.rate_classes(stream(spark, sf), 36000.0, bucket=WEEK).drain("rate", at_once=True)[0]


@query("m5_rate_limit_batch", _M5)
def m5b(spark, sf):
    return IS.walk(events(spark, sf), ["session_id"], 36001, IS.rate_rule(36000.0), "label", "string")


@query("m5_rate_limit_fixed", sql("""SELECT session_id, id, CASE WHEN n <= 3 THEN 'full' WHEN n <= 8 THEN 'limited' ELSE 'blocked' END AS label FROM (
SELECT session_id, id, row_number() OVER (PARTITION BY session_id, CAST(floor(epoch(ts) / 36000) AS BIGINT) ORDER BY ts, id) AS n FROM v_events)""", "v_events"))
def m5f(spark, sf):
    """Fixed windows: a different operator from the restarting ones."""
    e = events(spark, sf).withColumn("w", F.floor(F.unix_timestamp("ts") / 36000))
    r = running(e, ["session_id", "w"], ["ts", "id"], F.floor(F.unix_timestamp("ts") / 600), count="n")
    return r.select("session_id", "id", F.when(F.col("n") <= 3, "full").when(F.col("n") <= 8, "limited").otherwise("blocked").alias("label"))


_M6 = """SELECT session_id, turn AS id, level, used FROM (SELECT session_id, turn, tokens_in, CAST(sum(tokens_in) OVER (PARTITION BY session_id ORDER BY turn) AS BIGINT) AS used FROM v_tokens), (VALUES (60), (80), (90), (100)) v(level)
WHERE (used - tokens_in) * 100 < level * 500 AND used * 100 >= level * 500"""


@query("m6_budget_crossings", sql(_M6, "v_tokens"))
def m6(spark, sf):
    t = running(tokens(spark, sf), ["session_id"], ["turn"], F.floor(F.col("turn") / 1000), sums={"used": "tokens_in"})
    t = t.withColumn("level", F.explode(F.array(*[F.lit(x) for x in (60, 80, 90, 100)])))
    hit = ((F.col("used") - F.col("tokens_in")) * 100 < F.col("level") * 500) & (F.col("used") * 100 >= F.col("level") * 500)
    return t.where(hit).select("session_id", F.col("turn").alias("id"), "level", "used")


@query("m6_budget_stream", sql("""SELECT session_id, id, level::BIGINT AS level, used FROM (SELECT session_id, id, CAST(k AS BIGINT) AS tk, CAST(sum(CAST(k AS BIGINT)) OVER (PARTITION BY session_id ORDER BY ts, id) AS BIGINT) AS used FROM v_events), (VALUES (60), (80), (90), (100)) v(level)
WHERE (used - tk) * 100 < level * 2000 AND used * 100 >= level * 2000""", "v_events"))
def m6s(spark, sf):
    """Events as token facts: k tokens each, against a limit of 2000."""
    return JB.running_budget(stream(spark, sf).withColumn("tokens_in", F.col("k").cast("bigint")), 2000, bucket=WEEK).drain("budget", at_once=True)[0]


@query("m7_feedback_stream", sql("SELECT id AS result_id, edit_id FROM fp WHERE mts <= ts + INTERVAL 7 DAY", "v_events", ctes=PATHS_SQL + "\n"))
def m7(spark, sf):
    """Results and later edits of the same file, under any ending of its path, as two streams."""
    results, edits = results_and_edits(stream(spark, sf))[0], results_and_edits(stream(spark, sf))[1]
    return JB.drain(FB.matches(results, edits), "feedback")


@query("m8_liveness", sql("""SELECT session_id, count(*) AS beats, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY ts, id) AS g FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM v_events)) GROUP BY session_id, g""", "v_events"))
def m8(spark, sf):
    l = JB.liveness(events(spark, sf), "12 hours")
    return l.select("session_id", "beats", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("m8_liveness_stream", sql("""SELECT session_id, count(*) AS beats, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, CAST(epoch_us(max(ts) + INTERVAL 12 HOUR) AS BIGINT) AS stale_us FROM (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY ts, id) AS g FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM v_events)) GROUP BY session_id, g""", "v_events"))
def m8s(spark, sf):
    """A row for every silence of 12 hours, emitted as the watermark passes it."""
    return JB.liveness_stream(stream(spark, sf), 12 * 3600.0, bucket=WEEK).drain("liveness", at_once=True)[0]


@query("m9_claim_conflicts", sql("""SELECT k, id, session_id, owner FROM (SELECT *, first_value(session_id) OVER (PARTITION BY k, g ORDER BY ts, id) AS owner FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'file_modify' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts, id), 0) AS g
 FROM v_events WHERE event_type IN ('file_read', 'file_modify')) WHERE event_type = 'file_read') WHERE session_id <> owner""", "v_events"))
def m9(spark, sf):
    """Reads claim a file, a modify releases it; the first claimant between releases owns it."""
    e = events(spark, sf).where(F.col("event_type").isin("file_read", "file_modify")).withColumn("_r", (F.col("event_type") == "file_modify").cast("bigint"))
    g = running(e, ["k"], ["ts", "id"], day(), sums={"g": "_r"}).where("event_type = 'file_read'")
    own = g.groupBy("k", "g").agg(F.min(F.struct("ts", "id", "session_id")).alias("f")).select("k", "g", F.col("f.session_id").alias("owner"))
    return g.join(own, ["k", "g"]).where("session_id <> owner").select("k", "id", "session_id", "owner")


# row by row within a session: what of the last minute was allowed, and when each kind was
_M10 = sql("""SELECT session_id, id FROM st WHERE ok""", "v_events", ctes="""o AS (SELECT session_id, id, ts, event_type AS k, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS rn FROM v_events),
st AS (SELECT session_id, id, rn, [ts] AS recent, [{'k': k, 't': ts}] AS topics, true AS ok FROM o WHERE rn = 1 UNION ALL
 SELECT session_id, id, rn, CASE WHEN ok THEN list_append(recent, ts) ELSE recent END, CASE WHEN ok THEN list_append(topics, {'k': k, 't': ts}) ELSE topics END, ok FROM (
  SELECT *, len(recent) < 2 AND len(list_filter(topics, lambda x: x.k = k)) = 0 AS ok FROM (
   SELECT o.session_id, o.id, o.rn, o.ts, o.k, list_filter(st.recent, lambda x: o.ts - x < INTERVAL 60 SECOND) AS recent, list_filter(st.topics, lambda x: o.ts - x.t < INTERVAL 86400 SECOND) AS topics
   FROM st JOIN o ON o.session_id = st.session_id AND o.rn = st.rn + 1)))""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("m10_cooldown_stream", _M10)
def m10s(spark, sf):
    return JB.cooldown(stream(spark, sf).select("session_id", "id", "ts", F.col("event_type").alias("k")), 2, 86400.0, bucket=WEEK).drain("cooldown", at_once=True)[0]


@query("m10_cooldown_batch", _M10)
def m10(spark, sf):
    e = events(spark, sf).select("session_id", "id", "ts", F.col("event_type").alias("topic"))
    return IS.walk(e, ["session_id"], 86400, IS.cooldown_rule(2, 86400.0), "allowed", "boolean", extra=["topic"]).where("allowed").select("session_id", "id")


@query("m11_continuity", sql("""WITH_D""", "v_events").replace("WITH_D", """, d AS (SELECT session_id AS project, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, min(ts) AS f, max(ts) AS l FROM v_events GROUP BY ALL)
SELECT project, day, CASE WHEN p IS NULL THEN 'none' WHEN epoch(f) - epoch(p) < 7200 THEN 'full' WHEN epoch(f) - epoch(p) < 86400 THEN 'light' ELSE 'none' END AS restore FROM (SELECT *, lag(l) OVER (PARTITION BY project ORDER BY day) AS p FROM d)"""))
def m11(spark, sf):
    d = events(spark, sf).groupBy(F.col("session_id").alias("project"), F.unix_timestamp(F.date_trunc("day", "ts")).alias("day")).agg(F.min("ts").alias("f"), F.max("ts").alias("l"))
    n = neighbours(d, ["project"], ["day"], F.floor(F.col("day") / (86400 * 365)), before={"p": "l"})
    gap = (F.unix_micros("f") - F.unix_micros("p")) / 1e6
    return n.select("project", "day", F.when(F.col("p").isNull(), "none").when(gap < 7200, "full").when(gap < 86400, "light").otherwise("none").alias("restore"))
