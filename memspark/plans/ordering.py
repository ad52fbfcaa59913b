"""Registered queries: running values (W), top-k (T) and set operations (G)."""

from pyspark.sql import functions as F, Window

from ..functions import enrich as E
from ..functions.text import round6, words_ws
from ..operators import ordered as O, retrieval as R, sequences as S, search as SE
from ..session import spread
from ..views import AS_OF, events, facts, knowledge, observations, table, tokens, ts
from .enrich import _IMP
from .joins import _TOPICS, obs_topics
from .registry import query, sql

def day():
    return F.floor(F.unix_timestamp("ts") / 86400)


@query("w1_anchor_timeline", sql("""SELECT a.id AS anchor_id, p.id, p.rn - a.rn AS offset FROM (SELECT *, row_number() OVER (ORDER BY ts, id) AS rn FROM v_events) a
JOIN (SELECT *, row_number() OVER (ORDER BY ts, id) AS rn FROM v_events) p ON p.rn BETWEEN a.rn - 3 AND a.rn + 2 WHERE a.event_type = 'error'""".replace(" AS offset", ' AS "offset"'), "v_events"))
def w1(spark, sf):
    e = events(spark, sf)
    return S.anchor_timeline(e.select("id", "ts"), e.where("event_type = 'error'").select("id"), 3, 2)


@query("w2_error_fix", sql("""SELECT session_id, pid AS error_id, id AS fix_id, round((epoch_us(ts) - epoch_us(pts)) / 1e6, 6) AS seconds FROM (
SELECT *, lag(event_type) OVER w AS pt, lag(id) OVER w AS pid, lag(ts) OVER w AS pts FROM v_events WHERE event_type IN ('error', 'file_modify') WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)) WHERE event_type = 'file_modify' AND pt = 'error'""", "v_events"))
def w2(spark, sf):
    return S.error_fixes(events(spark, sf), day()).select("session_id", "error_id", "fix_id", round6("seconds").alias("seconds"))


@query("w3_fifth_access", sql("SELECT k, id FROM v_events WHERE event_type IN ('file_read', 'file_modify') QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, id) = 5", "v_events"))
def w3(spark, sf):
    e = events(spark, sf).where(F.col("event_type").isin("file_read", "file_modify"))
    return S.nth_occurrence(e, ["k"], ["ts", "id"], day(), 5).select("k", "id")


@query("w4_budget_fill", sql(f"""SELECT id, project, used FROM (SELECT id, project, CAST(sum(ceil(octet_length(encode(content)) / 4.0)) OVER (PARTITION BY project ORDER BY imp DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
FROM (SELECT *, {_IMP.format(ent='false')} AS imp FROM v_observations)) WHERE used <= 5000""", "v_observations"))
def w4(spark, sf):
    o = spread(observations(spark, sf), "id")
    o = o.select("id", "project", E.estimate_tokens("content").alias("tokens"), (-E.importance("content", "type", F.lit(False))).alias("neg"))
    return S.budget_fill(o, ["project"], ["neg", "id"], F.struct("neg", F.floor(F.col("id") / 100000)), "tokens", 5000).select("id", "project", "used")


_TOP20 = "t AS (SELECT user_id AS query_id, event_id AS id, value AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, event_id) <= 20)"


def top_values(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return R.top_k(e, 20)


@query("w5_min_max", f"""WITH {_TOP20} SELECT query_id, id, round((score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS relevance, round(CASE WHEN n = 1 THEN 1 ELSE (score - mn) / (hi - mn + 1e-8) END, 6) AS block FROM (
SELECT *, count(*) OVER w AS n, max(score) OVER w AS hi, min(score) OVER w AS mn, CASE WHEN count(*) OVER w > 1 THEN min(score) OVER w ELSE 0 END AS lo FROM t WINDOW w AS (PARTITION BY query_id))""")
def w5(spark, sf):
    r = R.block_min_max(R.min_max(top_values(spark, sf)), ["query_id"], out="block")
    return r.select("query_id", "id", round6("relevance").alias("relevance"), round6("block").alias("block"))


@query("w6_softmax_blocks", """SELECT query_id, block, round(a, 6) AS attention FROM (SELECT *, exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS a FROM (
 SELECT user_id AS query_id, event_type AS block, avg(value) / 10 AS score FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY query_id)) WHERE a >= 0.05""")
def w6(spark, sf):
    b = table(spark, sf, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("block")).agg((F.avg("value") / 10).alias("score"))
    return R.softmax(b, ["query_id"]).where("attention >= 0.05").select("query_id", "block", round6("attention").alias("attention"))


@query("w7_snapshot_trim", """WITH c AS (SELECT source AS session_id, concat('d', doc_id) AS category, doc_id % 3 + 1 AS priority, text, length(json_object(concat('d', doc_id), text)::VARCHAR) - 2 AS len,
  octet_length(encode(json_object(concat('d', doc_id), text)::VARCHAR)) AS bytes FROM documents),
t AS (SELECT *, 1 + sum(len + 1) OVER (PARTITION BY session_id) AS total, coalesce(sum(CASE WHEN priority >= 2 THEN len + 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY priority DESC, bytes, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dropped FROM c),
k AS (SELECT * FROM t WHERE priority = 1 OR total - dropped <= 16384),
z AS (SELECT *, 1 + sum(len + 1) OVER (PARTITION BY session_id) AS left_, count(*) OVER (PARTITION BY session_id) AS n FROM k)
SELECT session_id, category, priority, CASE WHEN left_ <= 16384 THEN length(text) ELSE least(length(text), greatest(50, (16384 - 2 - 6 * n) // n)) END AS kept_chars FROM z""")
def w7(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("session_id"), F.concat(F.lit("d"), "doc_id").alias("category"), (F.col("doc_id") % 3 + 1).alias("priority"), F.col("text").alias("content"))
    return S.trim_snapshots(d).select("session_id", "category", "priority", F.length("content").cast("bigint").alias("kept_chars"))


@query("w8_chain_walk", sql("""SELECT s.id AS seed, c.id, 0 AS steps FROM v_facts s JOIN v_facts c ON s.id = c.id WHERE s.valid_to IS NULL""", "v_facts").replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT s.id AS seed, c.id, 0 AS steps FROM v_facts s JOIN v_facts c ON s.id = c.id WHERE s.valid_to IS NULL",
       ", w(seed, id, steps) AS (SELECT id, id, 0 FROM v_facts WHERE valid_to IS NULL UNION ALL SELECT w.seed, f.parent, steps + 1 FROM w JOIN v_facts f ON f.id = w.id WHERE f.parent IS NOT NULL AND steps < 19) SELECT seed, id, steps FROM w"))
def w8(spark, sf):
    f = facts(spark, sf)
    return S.chain_walk(f.select("id", "parent"), f.where("valid_to is null").select("id"), 20)


@query("w9_supersession", sql("SELECT id, entity, CAST(epoch(valid_to) AS BIGINT) AS valid_to_s, superseded_by FROM v_facts", "v_facts"))
def w9(spark, sf):
    return facts(spark, sf).select("id", "entity", F.unix_timestamp("valid_to").alias("valid_to_s"), "superseded_by")


@query("w10_latest_per_key", "SELECT o_custkey AS entity, o_orderkey AS id, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w10(spark, sf):
    o = table(spark, sf, "orders")
    g = o.groupBy(F.col("o_custkey").alias("entity")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))
    return g.select("entity", F.col("m.o_orderkey").alias("id"), F.col("m.o_orderstatus").alias("status"))


# --- T, G ---------------------------------------------------------------------------

@query("t1_newest", sql("SELECT id, type FROM v_observations ORDER BY indexed_at DESC, id LIMIT 100", "v_observations"))
def t1(spark, sf):
    return observations(spark, sf).select("id", "type", "indexed_at").orderBy(F.desc("indexed_at"), "id").limit(100).select("id", "type")


@query("t2_top_per_group", sql("""SELECT 'category' AS scope, category AS key, id FROM v_knowledge QUALIFY row_number() OVER (PARTITION BY category ORDER BY access_count DESC, id) <= 5
UNION ALL SELECT 'type', type, id FROM v_observations QUALIFY row_number() OVER (PARTITION BY type ORDER BY indexed_at DESC, id) <= 10""", "v_knowledge", "v_observations"))
def t2(spark, sf):
    k = S.top_per_group(knowledge(spark, sf).select("category", "id", "access_count"), ["category"], [F.desc("access_count"), "id"], 5)
    o = S.top_per_group(observations(spark, sf).select("type", "id", "indexed_at"), ["type"], [F.desc("indexed_at"), "id"], 10)
    return k.select(F.lit("category").alias("scope"), F.col("category").alias("key"), "id").unionByName(o.select(F.lit("type").alias("scope"), F.col("type").alias("key"), "id"))


@query("t3_ranked_topics", sql(f"SELECT topic, count(*) AS n, CAST(epoch(max(indexed_at)) AS BIGINT) AS last_s FROM ({_TOPICS('v_observations', 'id', 'content', ', indexed_at')}) GROUP BY topic ORDER BY n DESC, last_s DESC, topic LIMIT 10", "v_observations"))
def t3(spark, sf):
    o = spread(observations(spark, sf), "id")
    t = o.select("indexed_at", F.explode(F.transform(E.topics("content"), lambda s: s["topic"])).alias("topic"))
    g = t.groupBy("topic").agg(F.count("*").alias("n"), F.unix_timestamp(F.max("indexed_at")).alias("last_s"))
    return g.orderBy(F.desc("n"), F.desc("last_s"), "topic").limit(10)


@query("t4_filter_then_rank", sql("SELECT category, id FROM v_knowledge WHERE source_type = 'explicit' QUALIFY row_number() OVER (PARTITION BY category ORDER BY access_count DESC, id) <= 10", "v_knowledge"))
def t4(spark, sf):
    k = knowledge(spark, sf).where("source_type = 'explicit'").select("category", "id", "access_count")
    return S.top_per_group(k, ["category"], [F.desc("access_count"), "id"], 10).select("category", "id")


@query("g1_best_per_source", sql("""SELECT session_id AS query_id, event_type AS kind, k AS id, max(round(v, 6)) AS score FROM (SELECT session_id, event_type, k, value AS v FROM v_events JOIN (SELECT event_id, value FROM events) ON event_id = id)
GROUP BY session_id, event_type, k QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round(max(v), 9) DESC, event_type, k) <= 20""", "v_events"))
def g1(spark, sf):
    e = events(spark, sf, "value").select(F.col("session_id").alias("query_id"), F.col("event_type").alias("kind"), F.col("k").alias("id"), F.col("value").alias("score"))
    return SE.best_per_source(e).select("query_id", "kind", "id", round6("score").alias("score"))


@query("g2_array_union", sql(f"""SELECT project, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS labels FROM (SELECT project, list(DISTINCT topic) AS a FROM ({_TOPICS('v_observations', 'id', 'content', ', project')}) GROUP BY project)
JOIN (SELECT project, list(DISTINCT category) AS b FROM v_knowledge GROUP BY project) USING (project)""", "v_observations", "v_knowledge"))
def g2(spark, sf):
    a = obs_topics(spark, sf).groupBy("project").agg(F.collect_set("topic").alias("a"))
    b = knowledge(spark, sf).groupBy("project").agg(F.collect_set("category").alias("b"))
    return a.join(b, "project").select("project", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("labels"))


@query("g3_set_difference", sql("""SELECT DISTINCT session_id, k FROM v_events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' EXCEPT SELECT session_id, k FROM v_events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'""", "v_events"))
def g3(spark, sf):
    e = events(spark, sf)
    return S.new_since(e, ["session_id", "k"], "ts", ts("2024-01-15 00:00:00"))


@query("g4_shared_words", """SELECT conv_id, turn, len(list_intersect(list_distinct(w), list_distinct(p))) AS shared FROM (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (
 SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations)) WHERE p IS NOT NULL""")
def g4(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", words_ws("text").alias("w"))
    n = O.neighbours(c, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1000), before={"p": "w"}).where("p is not null")
    return n.select("conv_id", "turn", F.size(F.array_intersect("w", "p")).cast("bigint").alias("shared"))


@query("g5_local_then_global", sql("""WITH_PLACEHOLDER""", "v_knowledge").replace("WITH_PLACEHOLDER", """, l AS (SELECT category, id, 0 AS leg FROM v_knowledge WHERE project = 'src0' QUALIFY row_number() OVER (PARTITION BY category ORDER BY access_count DESC, id) <= 5),
g AS (SELECT category, id, 1 AS leg FROM v_knowledge WHERE id NOT IN (SELECT id FROM l) QUALIFY row_number() OVER (PARTITION BY category ORDER BY access_count DESC, id) <= 10)
SELECT category, id, leg FROM (SELECT * FROM l UNION ALL SELECT * FROM g) JOIN (SELECT id, access_count FROM v_knowledge) USING (id) QUALIFY row_number() OVER (PARTITION BY category ORDER BY leg, access_count DESC, id) <= 10"""))
def g5(spark, sf):
    k = knowledge(spark, sf).select("category", "id", "access_count", "project")
    local = S.top_per_group(k.where("project = 'src0'"), ["category"], [F.desc("access_count"), "id"], 5)
    every = S.top_per_group(k, ["category"], [F.desc("access_count"), "id"], 15)  # enough to fill ten places after the five local ones
    return S.fill(local.drop("rank"), every.drop("rank"), ["category"], [F.desc("access_count"), "id"], 10).select("category", "id", "leg")
