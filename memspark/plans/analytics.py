"""Registered queries: aggregations (A)."""

from pyspark.sql import functions as F

from ..functions import constants as K, enrich as E
from ..operators import analytics as A
from ..session import spread
from ..views import AS_OF, access_log, events, facts, knowledge, observations, pick, table, tokens, ts
from .enrich import _FLAGS, _IMP, _PRIO
from .registry import query, sql

R0 = lambda x: f"CAST(floor({x} + 0.5) AS BIGINT)"


def obs(spark, sf):
    return spread(observations(spark, sf), "id")


def messages(spark, sf):
    c = table(spark, sf, "conversations")
    tin = E.estimate_tokens("text")
    out = F.when(F.col("role") == "assistant", F.floor(tin / 2)).otherwise(F.floor(tin / 4)).cast("bigint")
    return c.select(F.col("conv_id").alias("session_id"), "turn", F.when(F.col("role") == "user", "store").when(F.col("role") == "assistant", "discovery").otherwise("read").alias("event_type"),
                    F.length("text").cast("bigint").alias("chars"), tin.alias("tokens_in"), out.alias("tokens_out"))


_MSG = """msg AS (SELECT session_id, turn, CASE role WHEN 'user' THEN 'store' WHEN 'assistant' THEN 'discovery' ELSE 'read' END AS event_type, length(text) AS chars, tokens_in,
 CAST(CASE role WHEN 'assistant' THEN tokens_in // 2 ELSE tokens_in // 4 END AS BIGINT) AS tokens_out FROM v_tokens JOIN (SELECT conv_id AS session_id, turn, text FROM conversations) USING (session_id, turn))"""


@query("a1_token_economics", sql(f"""SELECT *, CASE WHEN tokens_in > 0 THEN {R0('saved / tokens_in::DOUBLE * 100')} ELSE 0 END AS saved_pct FROM (SELECT *, greatest(0, tokens_in - tokens_out) AS saved FROM (
SELECT session_id, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM msg GROUP BY session_id))""", "v_tokens", ctes=_MSG + "\n"))
def a1(spark, sf):
    return A.token_economics(messages(spark, sf), ["session_id"])


@query("a2_store_totals", sql(f"""SELECT ti AS tokens_in, t_o AS tokens_out, greatest(s, 0) AS saved, greatest(CASE WHEN ti > 0 THEN {R0('s / ti::DOUBLE * 100')} ELSE 0 END, 0) AS saved_pct, searches, reads, stores FROM (
SELECT CAST(sum(tokens_in) FILTER (event_type = 'store') AS BIGINT) AS ti, CAST(sum(tokens_out) FILTER (event_type = 'store') AS BIGINT) AS t_o,
 CAST(sum(tokens_in) FILTER (event_type = 'store') - coalesce(sum(tokens_out) FILTER (event_type <> 'store'), 0) AS BIGINT) AS s,
 count(*) FILTER (event_type = 'discovery') AS searches, count(*) FILTER (event_type = 'read') AS reads, count(*) FILTER (event_type = 'store') AS stores FROM msg)""", "v_tokens", ctes=_MSG + "\n"))
def a2(spark, sf):
    return A.store_totals(messages(spark, sf))


_TOK = "CAST(ceil(octet_length(encode({})) / 4.0) AS BIGINT)"


@query("a3_compression_by_type", sql(f"""SELECT *, CASE WHEN original > 0 THEN {R0('(original - shortened) / original::DOUBLE * 100')} ELSE 0 END AS saved_pct FROM (
SELECT type, count(*) AS n, CAST(sum({_TOK.format('content')}) AS BIGINT) AS original, CAST(sum({_TOK.format('substr(content, 1, 200)')}) AS BIGINT) AS shortened FROM v_observations GROUP BY type)""", "v_observations"))
def a3(spark, sf):
    o = observations(spark, sf).select("type", E.estimate_tokens("content").alias("original"), E.estimate_tokens(F.substring("content", 1, 200)).alias("shortened"))
    return A.compression(o, ["type"])


@query("a4_top_files", sql("""SELECT k, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM v_events GROUP BY k ORDER BY n DESC, k LIMIT 20""", "v_events"))
def a4(spark, sf):
    g = events(spark, sf).groupBy("k").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))
    return g.orderBy(F.desc("n"), "k").limit(20)


@query("a5_group_counts", sql(f"""SELECT 'type' AS scope, type AS key, count(*) AS n FROM v_observations GROUP BY type UNION ALL SELECT 'event_type', event_type, count(*) FROM v_events GROUP BY 2
UNION ALL SELECT 'priority', CAST({_PRIO} AS VARCHAR), count(*) FROM v_events GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM v_knowledge GROUP BY 2""", "v_observations", "v_events", "v_knowledge"))
def a5(spark, sf):
    e = events(spark, sf).select("event_type", E.event_priority("event_type").alias("priority"))
    return A.counts({"type": (observations(spark, sf), "type"), "event_type": (e, "event_type"), "priority": (e, "priority"), "category": (knowledge(spark, sf), "category")})


@query("a6_hourly_activity", sql("""SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n FROM v_events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1""", "v_events"))
def a6(spark, sf):
    e = events(spark, sf).where(F.col("ts") >= ts("2024-01-25 00:00:00"))
    return e.groupBy(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("hour")).agg(F.count("*").alias("n"))


@query("a7_session_list", sql("SELECT session_id, count(*) AS n, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM v_events GROUP BY session_id", "v_events"))
def a7(spark, sf):
    return events(spark, sf).groupBy("session_id").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("a8_importance_histogram", sql(f"""SELECT CASE WHEN i >= 0.9 THEN '0.9-1.0' WHEN i >= 0.8 THEN '0.8-0.9' WHEN i >= 0.7 THEN '0.7-0.8' WHEN i >= 0.6 THEN '0.6-0.7' WHEN i >= 0.5 THEN '0.5-0.6'
 WHEN i >= 0.4 THEN '0.4-0.5' WHEN i >= 0.3 THEN '0.3-0.4' ELSE '0.0-0.3' END AS bucket, count(*) AS n FROM (SELECT {_IMP.format(ent='false')} AS i FROM v_observations) GROUP BY 1""", "v_observations"))
def a8(spark, sf):
    o = obs(spark, sf).select(E.importance("content", "type", F.lit(False)).alias("i"))
    return o.groupBy(A.importance_bucket("i").alias("bucket")).agg(F.count("*").alias("n"))


@query("a9_flag_counts", sql(f"""SELECT flag, count(*) AS n FROM (SELECT unnest(f) AS flag FROM (SELECT {_FLAGS} AS f FROM v_observations)) GROUP BY flag
UNION ALL SELECT '(pinned)', count(*) FROM (SELECT {_FLAGS} AS f FROM v_observations) WHERE list_has_any(f, ['DECISION', 'MILESTONE'])""", "v_observations"))
def a9(spark, sf):
    f = obs(spark, sf).select(E.significance_flags("content").alias("f"))
    marks = F.concat("f", F.when(E.pinned("f"), F.array(F.lit("(pinned)"))).otherwise(F.array().cast("array<string>")))
    c = f.select(F.explode(marks).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    total = F.lit("(pinned)")
    none = spark.range(1).select(total.alias("flag"), F.lit(0).cast("bigint").alias("n"))
    return c.unionByName(none).groupBy("flag").agg(F.sum("n").alias("n"))


@query("a10_sessions_per_entry", sql("SELECT knowledge_id, count(DISTINCT session_id) AS sessions FROM v_access_log GROUP BY 1 HAVING count(DISTINCT session_id) >= 3", "v_access_log"))
def a10(spark, sf):
    return A.sessions_per_entry(events(spark, sf).select(F.col("k").alias("knowledge_id"), "session_id"), 3)


_AT = "TIMESTAMP '2024-01-20 00:00:00'"


@query("a11_snapshot_counts", sql(f"""SELECT scope, key, n FROM (SELECT 'observations' AS scope, type AS key, count(*) AS n FROM v_observations WHERE indexed_at <= {_AT} GROUP BY ALL UNION ALL SELECT 'knowledge', category, count(*) FROM v_knowledge WHERE created_at <= {_AT} GROUP BY ALL
UNION ALL SELECT 'events', event_type, count(*) FROM v_events WHERE ts <= {_AT} GROUP BY ALL) UNION ALL SELECT 'observations', '(total)', count(*) FROM v_observations WHERE indexed_at <= {_AT}
UNION ALL SELECT 'knowledge', '(total)', count(*) FROM v_knowledge WHERE created_at <= {_AT} UNION ALL SELECT 'events', '(total)', count(*) FROM v_events WHERE ts <= {_AT}""", "v_observations", "v_knowledge", "v_events"))
def a11(spark, sf):
    return A.snapshot({"observations": (observations(spark, sf), "indexed_at", "type"), "knowledge": (knowledge(spark, sf), "created_at", "category"),
                       "events": (events(spark, sf), "ts", "event_type")}, ts("2024-01-20 00:00:00"))


_TN = lambda s, t, c: f"SELECT '{s}' AS scope, count(*) FILTER ({c} <= {_AT}) AS total_then, count(*) AS total_now, count(*) FILTER ({c} > {_AT} AND {c} <= TIMESTAMP '{AS_OF}') AS between, count(*) FILTER (NOT {c} <= {_AT}) AS added FROM {t}"


@query("a12_then_and_now", sql(" UNION ALL ".join([_TN("observations", "v_observations", "indexed_at"), _TN("knowledge", "v_knowledge", "created_at"), _TN("events", "v_events", "ts")]).replace(" AS between", ' AS "between"'),
                               "v_observations", "v_knowledge", "v_events"))
def a12(spark, sf):
    return A.then_and_now({"observations": (observations(spark, sf), "indexed_at"), "knowledge": (knowledge(spark, sf), "created_at"), "events": (events(spark, sf), "ts")},
                          ts("2024-01-20 00:00:00"), ts(AS_OF))


_RNG = "BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"


@query("a13_interval_diff", sql(f"""SELECT 'added' AS scope, CAST(id AS VARCHAR) AS key, 1::BIGINT AS n FROM v_knowledge WHERE created_at {_RNG}
UNION ALL SELECT 'archived', CAST(id AS VARCHAR), 1 FROM v_knowledge WHERE last_accessed {_RNG} AND source_type <> 'explicit'
UNION ALL SELECT 'observations', type, count(*) FROM v_observations WHERE indexed_at {_RNG} GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM v_events WHERE ts {_RNG} GROUP BY 2""", "v_observations", "v_knowledge", "v_events"))
def a13(spark, sf):
    lo, hi = ts("2024-01-10 00:00:00"), ts("2024-01-20 00:00:00")
    k = knowledge(spark, sf).withColumn("archived", F.col("source_type") != "explicit")
    return A.counts({"added": (k.where(F.col("created_at").between(lo, hi)), "id"), "archived": (k.where(F.col("archived") & F.col("last_accessed").between(lo, hi)), "id"),
                     "observations": (observations(spark, sf).where(F.col("indexed_at").between(lo, hi)), "type"), "events": (events(spark, sf).where(F.col("ts").between(lo, hi)), "event_type")})


@query("a14_health_score", sql(f"""SELECT {R0('fr * 30 + co * 25 + ac * 20 + cl * 15 + se * 10')} AS score, {R0('fr * 100')} AS freshness, {R0('co * 100')} AS coverage, {R0('ac * 100')} AS activity, {R0('cl * 100')} AS clean, {R0('se * 100')} AS continuity FROM (SELECT
 count(*) FILTER (last_accessed > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY) / count(*)::DOUBLE AS fr, least(1, count(DISTINCT category) / 5.0e0) AS co,
 1 - count(*) FILTER (last_accessed < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) / count(*)::DOUBLE AS cl,
 (SELECT least(1, count(*) / 100.0e0) FROM v_observations WHERE indexed_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS ac,
 (SELECT least(1, (SELECT count(DISTINCT o_custkey) FROM orders) / count(DISTINCT session_id)::DOUBLE) FROM v_tokens) AS se FROM v_knowledge)""", "v_knowledge", "v_observations", "v_tokens"))
def a14(spark, sf):
    k = knowledge(spark, sf).withColumns({"archived": F.lit(False), "stale": F.col("last_accessed") < ts(AS_OF) - F.expr("interval 30 days")})
    chained = table(spark, sf, "orders").select("o_custkey").distinct()
    return A.health(k, observations(spark, sf), tokens(spark, sf), chained, ts(AS_OF))


@query("a15_session_mode", sql("""SELECT session_id, type, CASE type WHEN 'error' THEN 'investigating' WHEN 'code' THEN 'implementing' WHEN 'decision' THEN 'reviewing' ELSE 'general' END AS mode FROM (
SELECT session_id, type, count(*) AS n FROM v_observations GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, type DESC) = 1""", "v_observations"))
def a15(spark, sf):
    return A.session_mode(observations(spark, sf))


@query("a16_budget", sql(f"""SELECT session_id, used, round(p, 6) AS percentage, p >= 80 AS throttled, p >= 100 AS blocked, CASE WHEN p >= 90 THEN 'critical' WHEN p >= 80 THEN 'warning' WHEN p >= 60 THEN 'notice' ELSE 'none' END AS level,
 {R0('used / 1000000.0e0 * 100')} AS model_pct FROM (SELECT session_id, CAST(sum(tokens_in) AS BIGINT) AS used, sum(tokens_in) / 500.0e0 * 100 AS p FROM v_tokens GROUP BY 1)""", "v_tokens"))
def a16(spark, sf):
    b = A.budget(tokens(spark, sf), ["session_id"], limit=500, strategy="hard_stop")
    return b.withColumn("percentage", F.round("percentage", 6))


@query("a16_budget_store", sql("SELECT CAST(sum(tokens_in) AS BIGINT) AS used, sum(tokens_in) / 100000.0e0 * 100 >= 80 AS throttled FROM v_tokens", "v_tokens"))
def a16s(spark, sf):
    return A.budget(tokens(spark, sf), []).select("used", "throttled")


@query("a17_correlation_groups", sql("SELECT concat(project, '/', session_id) AS correlation_id, count(*) AS n FROM v_observations GROUP BY 1", "v_observations"))
def a17(spark, sf):
    return observations(spark, sf).groupBy(F.concat_ws("/", "project", "session_id").alias("correlation_id")).agg(F.count("*").alias("n"))


@query("a18_fact_counts", sql("""SELECT 'active' AS what, count(*) AS n FROM v_facts WHERE valid_to IS NULL UNION ALL SELECT 'superseded', count(*) FROM v_facts WHERE valid_to IS NOT NULL
UNION ALL SELECT what, n FROM (SELECT concat('last:', id) AS what, superseded_by AS n FROM v_facts WHERE valid_to IS NOT NULL ORDER BY valid_to DESC, id LIMIT 5)""", "v_facts"))
def a18(spark, sf):
    f = facts(spark, sf)
    c = f.groupBy(F.when(F.col("valid_to").isNull(), "active").otherwise("superseded").alias("what")).agg(F.count("*").alias("n"))
    last = f.where("valid_to is not null").orderBy(F.desc("valid_to"), "id").limit(5).select(F.concat(F.lit("last:"), "id").alias("what"), F.col("superseded_by").alias("n"))
    return c.unionByName(last)


@query("a19_extents", sql("""SELECT count(*) AS n, CAST(epoch(min(indexed_at)) AS BIGINT) AS first_s, CAST(epoch(max(indexed_at)) AS BIGINT) AS last_s, count(embedding) AS embedded FROM v_observations LEFT JOIN embeddings ON vec_id = id""", "v_observations"))
def a19(spark, sf):
    o = observations(spark, sf).select("id", "indexed_at").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
    return o.agg(F.count("*").alias("n"), F.unix_timestamp(F.min("indexed_at")).alias("first_s"), F.unix_timestamp(F.max("indexed_at")).alias("last_s"), F.count("embedding").alias("embedded"))


@query("a20_project_rollup", f"""SELECT coalesce(source, '(all)') AS project, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS original, CAST(sum(length(substr(text, 1, 200))) AS BIGINT) AS shortened,
 CASE WHEN sum(length(text)) > 0 THEN {R0('(sum(length(text)) - sum(length(substr(text, 1, 200)))) / sum(length(text))::DOUBLE * 100')} ELSE 0 END AS saved_pct FROM documents GROUP BY ROLLUP (source)""")
def a20(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("project"), F.length("text").alias("o"), F.length(F.substring("text", 1, 200)).alias("s"))
    g = d.rollup("project").agg(F.count("*").alias("n"), F.sum("o").alias("original"), F.sum("s").alias("shortened"))
    return g.select(F.coalesce("project", F.lit("(all)")).alias("project"), "n", "original", "shortened", A.pct(F.col("original") - F.col("shortened"), "original").alias("saved_pct"))


@query("a21_knowledge_usage", sql("""SELECT concat('category:', category) AS what, count(*) AS n FROM v_knowledge GROUP BY 1 UNION ALL SELECT 'archived', count(*) FROM v_knowledge WHERE last_accessed < TIMESTAMP '2024-02-01 00:00:00'
UNION ALL SELECT 'searches', count(*) FROM v_events WHERE event_type = 'search' UNION ALL SELECT what, n FROM (SELECT concat('top:', id) AS what, access_count AS n FROM v_knowledge ORDER BY access_count DESC, id LIMIT 10)""", "v_knowledge", "v_events"))
def a21(spark, sf):
    k = knowledge(spark, sf).select("id", "category", "access_count", (F.col("last_accessed") < ts("2024-02-01 00:00:00")).alias("archived"))
    by = k.groupBy(F.concat(F.lit("category:"), "category").alias("what")).agg(F.count("*").alias("n"))
    arch = k.agg(F.sum(F.col("archived").cast("bigint")).alias("n")).select(F.lit("archived").alias("what"), "n")
    srch = events(spark, sf).agg(F.sum((F.col("event_type") == "search").cast("bigint")).alias("n")).select(F.lit("searches").alias("what"), "n")
    top = k.orderBy(F.desc("access_count"), "id").limit(10).select(F.concat(F.lit("top:"), "id").alias("what"), F.col("access_count").alias("n"))
    return by.unionByName(arch).unionByName(srch).unionByName(top)
