"""Registered queries: joins (J)."""

from pyspark.sql import functions as F, Window

from ..functions import constants as K, enrich as E
from ..functions.text import tokens_of
from ..operators import index as I, joins as J, retrieval as R, search as S
from ..session import spread
from ..views import edges, events, facts, knowledge, observations, table, ts
from .registry import query, sql

_TOPICS = lambda src, id_, text, extra="": "\nUNION ALL\n".join(
    rf"SELECT {id_} AS id, '{t}' AS topic{extra} FROM {src} WHERE regexp_matches({text}, '(?i)\b(?:{p})\b')" for t, p in K.TOPIC_KEYWORDS.items())


def obs_topics(spark, sf):
    o = spread(observations(spark, sf), "id")
    return o.select("id", "project", F.explode(F.transform(E.topics("content"), lambda s: s["topic"])).alias("topic"))


@query("j1_topic_bridge", sql(f"""SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, newest_s DESC, topic) AS rank FROM (
SELECT o.project, t.topic, count(*) AS n, CAST(max(epoch(o.indexed_at)) AS BIGINT) AS newest_s FROM ({_TOPICS('v_observations', 'id', 'content')}) t JOIN v_observations o USING (id) GROUP BY ALL)""", "v_observations"))
def j1(spark, sf):
    """Topics of each project, the most frequent first, then the newest, then by name; a project has as many rows as topics exist."""
    t = obs_topics(spark, sf).select("id", "topic")
    o = observations(spark, sf).select("id", "project", "indexed_at")
    g = t.join(o, "id").groupBy("project", "topic").agg(F.count("*").alias("n"), F.unix_timestamp(F.max("indexed_at")).alias("newest_s"))
    w = Window.partitionBy("project").orderBy(F.desc("n"), F.desc("newest_s"), "topic")
    return g.withColumn("rank", F.row_number().over(w).cast("bigint"))


@query("j2_sources_with_chunks", """WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT d.doc_id, count(x) AS chunks, CAST(coalesce(sum(octet_length(encode(x))), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(CASE WHEN contains(x, '`') THEN 1 ELSE 0 END), 0) AS BIGINT) AS code_chunks
FROM documents d LEFT JOIN (SELECT * FROM c WHERE length(x) > 80) c USING (doc_id) GROUP BY d.doc_id""")
def j2(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    c = d.select("doc_id", F.explode(F.split("text", "\n")).alias("x")).where(F.length("x") > 80)
    agg = c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("x")).alias("bytes"), F.sum(F.contains("x", F.lit("`")).cast("int")).alias("code_chunks"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n)
    return d.select("doc_id").join(agg, "doc_id", "left").select("doc_id", zero("chunks"), zero("bytes"), zero("code_chunks"))


@query("j3_entity_degrees", sql("""SELECT n.node, coalesce(d, 0) AS degree FROM (SELECT concat('p', p_partkey) AS node FROM part UNION ALL SELECT concat('s', s_suppkey) FROM supplier) n
LEFT JOIN (SELECT node, count(*) AS d FROM (SELECT src AS node FROM v_edges UNION ALL SELECT dst FROM v_edges) GROUP BY node) USING (node)""", "v_edges"))
def j3(spark, sf):
    n = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node")).unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    return n.join(J.degrees(edges(spark, sf)), "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


@query("j4_one_hop", sql("""SELECT n.node, count(*) AS neighbours, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT concat('s', s_suppkey) AS node FROM supplier) n
JOIN v_edges e ON n.node = e.src OR n.node = e.dst GROUP BY n.node""", "v_edges"))
def j4(spark, sf):
    seeds = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return seeds.join(J.either_endpoint(edges(spark, sf)), "node").groupBy("node").agg(F.count("*").alias("neighbours"), F.sum("weight").alias("weight"))


@query("j5_match_set", sql("""SELECT category, count(*) AS n FROM v_knowledge WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY category""", "v_knowledge"))
def j5(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return knowledge(spark, sf).select("id", "category").join(good, "id", "left_semi").groupBy("category").agg(F.count("*").alias("n"))


@query("j6_pending_tasks", sql("""SELECT id, session_id, k FROM v_events s WHERE event_type = 'file_read'
AND NOT EXISTS (SELECT 1 FROM v_events c WHERE c.event_type = 'file_modify' AND c.session_id = s.session_id AND c.k = s.k)""", "v_events"))
def j6(spark, sf):
    e = events(spark, sf)
    done = e.where("event_type = 'file_modify'").select("session_id", "k").distinct()
    return e.where("event_type = 'file_read'").select("id", "session_id", "k").join(done, ["session_id", "k"], "left_anti")


@query("j7_as_of_join", sql("""SELECT c_custkey AS entity, f.id FROM customer JOIN v_facts f ON f.entity = c_custkey AND f.valid_from <= TIMESTAMP '1993-01-01 00:00:00' + INTERVAL 1 DAY * (c_custkey % 2000)
AND (f.valid_to IS NULL OR f.valid_to > TIMESTAMP '1993-01-01 00:00:00' + INTERVAL 1 DAY * (c_custkey % 2000))""", "v_facts"))
def j7(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), (ts("1993-01-01 00:00:00") + F.make_dt_interval(days=(F.col("c_custkey") % 2000).cast("int"))).alias("at"))
    return J.interval_join(facts(spark, sf).select("id", "entity", "valid_from", "valid_to"), p, ["entity"], "at").select("entity", "id")


@query("j8_evidence_session", sql("""SELECT d.id AS decision_id, e.id AS event_id FROM v_events d JOIN v_events e ON d.session_id = e.session_id AND e.ts < d.ts AND e.ts > d.ts - INTERVAL 1 HOUR
WHERE d.event_type = 'decision' QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY e.ts DESC, e.id DESC) <= 20""", "v_events"))
def j8(spark, sf):
    e = events(spark, sf)
    p = e.where("event_type = 'decision'").select("session_id", F.col("id").alias("pid"), F.col("ts").alias("pts"))
    f = e.select("session_id", F.col("id").alias("fid"), F.col("ts").alias("fts"))
    return J.last_k_before(p, f, ["session_id"], 20, 3600).select(F.col("pid").alias("decision_id"), F.col("fid").alias("event_id"))


@query("j8_evidence_global", sql("""SELECT d.id AS decision_id, o.id AS observation_id FROM v_observations d JOIN v_observations o ON o.indexed_at < d.indexed_at AND o.indexed_at > d.indexed_at - INTERVAL 24 HOUR
WHERE d.type = 'decision' AND o.type IN ('error', 'context', 'code') QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY o.indexed_at DESC, o.id DESC) <= 5""", "v_observations"))
def j8g(spark, sf):
    o = observations(spark, sf).select("id", "type", "indexed_at")
    p = o.where("type = 'decision'").select(F.col("id").alias("pid"), F.col("indexed_at").alias("pts"))
    f = o.where(F.col("type").isin("error", "context", "code")).select(F.col("id").alias("fid"), F.col("indexed_at").alias("fts"))
    return J.last_k_before(p, f, [], 5, 86400).select(F.col("pid").alias("decision_id"), F.col("fid").alias("observation_id"))


_CHAIN = """SELECT d.session_id, d.id AS decision_id, p.id AS problem_id, m.id AS milestone_id FROM v_events d,
 LATERAL (SELECT id, ts FROM v_events x WHERE x.session_id = d.session_id AND x.event_type = 'error' AND (x.ts > d.ts OR (x.ts = d.ts AND x.id > d.id)) ORDER BY ts, id LIMIT 1) p,
 LATERAL (SELECT id, ts FROM v_events y WHERE y.session_id = d.session_id AND y.event_type = 'file_modify' AND (y.ts > p.ts OR (y.ts = p.ts AND y.id > p.id)) ORDER BY ts, id LIMIT 1) m
WHERE d.event_type = 'decision' AND p.ts <= d.ts + INTERVAL 7 DAY AND m.ts <= p.ts + INTERVAL 14 DAY"""


def causal(spark, sf):
    e = events(spark, sf)
    t = F.col("event_type")
    kind = F.when(t == "decision", "decision").when(t == "error", "problem").when(t == "file_modify", "milestone")
    return J.first_after(e.select("session_id", "id", "ts", kind.alias("kind")).where("kind is not null"), ["session_id"], F.floor(F.unix_timestamp("ts") / 86400))


@query("j9_causal_chain", sql(_CHAIN, "v_events"))
def j9(spark, sf):
    return causal(spark, sf)


@query("j10_shared_tokens", """WITH t AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents)
SELECT item_id, doc_id, shared FROM (SELECT item_id, doc_id, count(*) AS shared FROM t JOIN d USING (w) GROUP BY ALL) JOIN (SELECT item_id, count(*) AS n FROM t GROUP BY item_id) USING (item_id) WHERE shared * 10 >= n * 8""")
def j10(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(tokens_of("text"))).alias("w"))
    n = b.groupBy("item_id").agg(F.count("*").alias("n"))
    d = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", F.explode(F.array_distinct(tokens_of("text"))).alias("w"))
    s = d.join(b, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return s.join(n, "item_id").where(F.col("shared") * 10 >= F.col("n") * 8).select("item_id", "doc_id", "shared")


_PATHS = """a AS (SELECT DISTINCT concat('s', l_suppkey % 50, '/p', l_partkey, '.ts') AS short FROM lineitem), b AS (SELECT DISTINCT concat('src/', CASE WHEN p_partkey % 2 = 0 THEN concat('s', p_size, '/') ELSE '' END, 'p', p_partkey, '.ts') AS long FROM part)"""


@query("j11_suffix_paths", f"WITH {_PATHS} SELECT short, long FROM a, b WHERE ends_with(short, long) OR ends_with(long, short)")
def j11(spark, sf):
    a = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey") % 50, F.lit("/p"), "l_partkey", F.lit(".ts")).alias("short")).distinct()
    pre = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("s"), "p_size", F.lit("/"))).otherwise("")
    b = table(spark, sf, "part").select(F.concat(F.lit("src/"), pre, F.lit("p"), "p_partkey", F.lit(".ts")).alias("long")).distinct()
    return J.suffix_paths(a, b, "short", "long")


@query("j12_tunnels", sql(f"""SELECT topic, count(DISTINCT p) AS projects FROM (
 SELECT topic, project AS p FROM ({_TOPICS('v_observations', 'id', 'content', ', project')}) UNION SELECT topic, p FROM (SELECT DISTINCT topic FROM ({_TOPICS('v_observations', 'id', 'content')})) l
  JOIN (SELECT project AS p, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM v_knowledge) k ON k.w = l.topic) GROUP BY topic HAVING count(DISTINCT p) >= 2""", "v_observations", "v_knowledge"))
def j12(spark, sf):
    local = obs_topics(spark, sf).select("topic", F.col("project").alias("p")).distinct()
    k = spread(knowledge(spark, sf), "id").select(F.col("project").alias("p"), F.explode(F.array_distinct(tokens_of("content"))).alias("w"))
    names = local.select("topic").distinct()
    other = k.join(names, F.col("w") == F.col("topic")).select("topic", "p")
    return local.unionByName(other).groupBy("topic").agg(F.countDistinct("p").alias("projects")).where("projects >= 2")


@query("j13_topics_without_pattern", sql("""SELECT DISTINCT w AS topic FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) >= 5)) AS w FROM benchmark)
WHERE NOT EXISTS (SELECT 1 FROM v_knowledge WHERE category = 'pattern' AND contains(lower(title), w))""", "v_knowledge"))
def j13(spark, sf):
    """Words of the passages that no pattern title contains."""
    w = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("topic")).where(F.length("topic") >= 5).distinct()
    titles = knowledge(spark, sf).where("category = 'pattern'").select("id", "title")
    have = S.contains_all(R.WordRows(titles, "id", "title"), w.select(F.col("topic").alias("query_id"), F.col("topic").alias("text"))).select(F.col("query_id").alias("topic"))
    return w.join(have, "topic", "left_anti")
