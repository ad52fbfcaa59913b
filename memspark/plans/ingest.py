"""Registered queries: sources, sinks and ingest (S).

Exports of each format are written by Spark from the conversations table, in
pages of at most 50 messages, and read back through the parsers.
"""

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import round6
from ..operators import rollups as RU
from ..schemas import INPUT
from ..session import run_dir, spread
from ..sources import conversations as CV, ingest as IN
from ..views import knowledge, observations, pick, table, ts
from .enrich import _ENT, _FLAGS, _IMP, _SIG2, _ct, _last
from .registry import query, sql


def turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / 50).cast("string")).alias("conv"), "turn", "role", "text")


def paged(spark, sf, entry):
    """One export per page: its messages in order, as an array of ``entry`` structs."""
    t = turns(spark, sf).select("conv", F.struct("turn", entry.alias("e")).alias("s"))
    return t.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["e"]).alias("m"))


_CONV = "concat('c', conv_id, '-', turn // 50)"


@query("s1_read_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, {len(c.split(','))} AS columns FROM {t}" for t, c in INPUT.items()))
def s1(spark, sf):
    """Every stored table through its enforced schema: rows and columns."""
    out = None
    for t, df in IN.read_memory(spark, sf, schemas=INPUT, suffix=".parquet").items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s2_import_lines", f"SELECT {_CONV} AS conv, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'assistant' ELSE 'system' END AS role, turn * 1000 AS ts_ms, text FROM conversations WHERE turn % 4 <> 3")
def s2(spark, sf):
    t = turns(spark, sf)
    j = F.to_json(F.struct("role", F.col("text").alias("content"), (F.col("turn") * 1000).alias("timestamp")))
    line = F.when(F.col("turn") % 4 == 3, F.substring(j, 1, 12)).otherwise(j)  # every fourth line is cut off
    return CV.parse_lines(t.select("conv", F.col("turn").alias("pos"), line.alias("line"))).select("conv", "turn", "role", "ts_ms", "text")


def sender(spark, sf):
    m = paged(spark, sf, F.struct(F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), "text", F.lit("2024-01-02T03:04:05Z").alias("created_at")))
    return m.select("conv", F.to_json(F.struct(F.lit("u").alias("uuid"), F.col("m").alias("chat_messages"))).alias("text"))


_POS = "row_number() OVER (PARTITION BY conv_id, turn // 50 ORDER BY turn) - 1"


@query("s3_import_sender", f"SELECT {_CONV} AS conv, {_POS} AS turn, CASE role WHEN 'user' THEN 'human' ELSE 'assistant' END AS role, CASE role WHEN 'user' THEN 'human' ELSE role END AS speaker, 1704164645000::BIGINT AS ts_ms, text FROM conversations")
def s3(spark, sf):
    return CV.parse_sender_export(sender(spark, sf))


def tree(spark, sf):
    node = F.struct(F.struct(F.struct("role").alias("author"), F.struct(F.array("text", F.lit("(end)")).alias("parts")).alias("content"), (F.col("turn") + 0.5).alias("create_time")).alias("message"))
    m = paged(spark, sf, F.struct(F.concat(F.lit("n"), F.col("turn").cast("string")).alias("key"), node.alias("value")))
    return m.select("conv", F.to_json(F.array(F.struct(F.map_from_entries("m").alias("mapping")))).alias("text"))


@query("s4_import_tree", f"SELECT conv, role, ts_ms, text FROM (SELECT {_CONV} AS conv, CASE role WHEN 'user' THEN 'human' ELSE 'assistant' END AS role, turn * 1000 + 500 AS ts_ms, regexp_replace(concat(text, chr(10), '(end)'), '^\\s+', '') AS text, role AS r FROM conversations) WHERE r <> 'system'")
def s4(spark, sf):
    return CV.parse_message_tree(tree(spark, sf)).select("conv", "role", "ts_ms", "text")


def channel(spark, sf):
    sub = F.when(F.col("turn") % 5 == 4, "channel_join")
    m = paged(spark, sf, F.struct(F.col("role").alias("user"), "text", F.concat(F.col("turn").cast("string"), F.lit(".25")).alias("ts"), sub.alias("subtype")))
    return m.select("conv", F.to_json("m").alias("text"))


@query("s5_import_channel", f"SELECT conv, turn, role, speaker, ts_ms, text FROM (SELECT {_CONV} AS conv, {_POS} AS turn, 'human' AS role, role AS speaker, turn * 1000 + 250 AS ts_ms, text, turn % 5 AS m FROM conversations) WHERE m <> 4")
def s5(spark, sf):
    return CV.parse_channel(channel(spark, sf))


def plain(spark, sf):
    block = F.concat(F.when(F.col("role") == "user", "Human: ").when(F.col("role") == "assistant", "Assistant: ").otherwise(""), "text")
    return paged(spark, sf, block).select("conv", F.array_join("m", "\n\n").alias("text"))


@query("s6_import_plain", r"""WITH t AS (SELECT concat('c', conv_id, '-', turn // 50) AS conv, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn // 50 ORDER BY turn) AS g FROM conversations)
SELECT conv, g - 1 AS turn, max(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'assistant' END) AS role, string_agg(x, chr(10) ORDER BY turn) AS text FROM t WHERE g > 0 GROUP BY conv, g""".replace("SELECT conv, g - 1 AS turn", "SELECT conv, CAST(g - 1 AS BIGINT) AS turn").replace("ORDER BY turn) AS text", "ORDER BY t.turn) AS text"))
def s6(spark, sf):
    return CV.parse_plain(plain(spark, sf)).select("conv", "turn", "role", "text")


def every_export(spark, sf):
    lines = paged(spark, sf, F.to_json(F.struct("role", F.col("text").alias("content")))).select("conv", F.concat(F.array_join("m", "\n"), F.lit("\n{}")).alias("text"))
    out = None
    for name, df in (("jsonl", lines), ("sender", sender(spark, sf)), ("tree", tree(spark, sf)), ("channel", channel(spark, sf)), ("plain", plain(spark, sf))):
        one = df.select(F.concat(F.lit(name + ":"), "conv").alias("conv"), "text")
        out = one if out is None else out.unionByName(one)
    return out


@query("s7_detect_format", "SELECT f AS made, f AS detected, n FROM (VALUES ('jsonl'), ('sender'), ('tree'), ('channel'), ('plain')) v(f), (SELECT count(DISTINCT concat(conv_id, '-', turn // 50)) AS n FROM conversations)")
def s7(spark, sf):
    e = every_export(spark, sf)
    return e.groupBy(F.split("conv", ":")[0].alias("made"), CV.detect_format("text").alias("detected")).agg(F.count("*").alias("n"))


@query("s7_import_any", "SELECT f AS made, CAST(CASE f WHEN 'tree' THEN n - s WHEN 'plain' THEN n - s WHEN 'channel' THEN n - j ELSE n END AS BIGINT) AS messages FROM (VALUES ('jsonl'), ('sender'), ('tree'), ('channel'), ('plain')) v(f), (SELECT count(*) AS n, count(*) FILTER (role = 'system') AS s, count(*) FILTER (turn % 5 = 4) AS j FROM conversations)")
def s7a(spark, sf):
    return CV.parse_any(every_export(spark, sf)).groupBy(F.split("conv", ":")[0].alias("made")).agg(F.count("*").alias("messages"))


@query("s8_chunk_exchanges", """WITH m AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - first_value(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations)
SELECT conv_id AS conv, CAST(e AS BIGINT) AS exchange, CASE WHEN bool_or(role = 'assistant') THEN 'context' ELSE 'log' END AS type, sha256(string_agg(concat(CASE role WHEN 'user' THEN 'human' ELSE role END, ': ', text), chr(10) || chr(10) ORDER BY turn)) AS text_sha FROM m GROUP BY conv_id, e""")
def s8(spark, sf):
    c = table(spark, sf, "conversations")
    m = c.select(F.col("conv_id").alias("conv"), "turn", F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("role"), "text")
    return CV.chunk_exchanges(m).select("conv", "exchange", "type", F.sha2("text", 256).alias("text_sha"))


@query("s9_chunk_paragraphs", r"""WITH p AS (SELECT doc_id, x, i FROM (SELECT doc_id, ps, unnest(ps) AS x, unnest(range(len(ps))) AS i FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\n+') AS ps FROM documents WHERE NOT coalesce(json_valid(text), false))) WHERE regexp_matches(x, '\S')
 UNION ALL SELECT doc_id, text, 0 FROM documents WHERE coalesce(json_valid(text), false))
SELECT doc_id AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk, sha256(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS content_sha FROM p""")
def s9(spark, sf):
    """Every line break doubled, so the lines of a text are its paragraphs."""
    d = spread(table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), "doc_id")
    return IN.chunk_documents(d, "doc_id", "text").select("doc", "chunk", F.sha2("content", 256).alias("content_sha"))


@query("s9_chunk_markdown", """SELECT o_orderkey AS doc, CAST(c AS BIGINT) AS chunk, CASE c WHEN 1 THEN concat('Title ', o_orderkey) WHEN 2 THEN concat('Part ', o_orderpriority) END AS heading, c = 2 AS has_code FROM orders, (VALUES (0), (1), (2)) v(c)""")
def s9m(spark, sf):
    from .rollups import markdown_texts

    return IN.chunk_documents(markdown_texts(spark, sf), "o_orderkey", "text").select("doc", "chunk", "heading", "has_code")


@query("s10_index_source", "SELECT sha256(text) AS source_hash, min(doc_id) AS id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def s10(spark, sf):
    d = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    have = d.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select(F.sha2("text", 256).alias("source_hash"))
    return IN.index_source(d, "text", have).select("source_hash", "id")


@query("s11_export", "SELECT 'knowledge' AS name, count(*) FILTER (doc_id % 3 = 0) AS n FROM documents UNION ALL SELECT 'events', least(1000, count(*)) FROM events")
def s11(spark, sf):
    """Written as JSON to the shared folder and read back."""
    from ..views import events

    path = run_dir(spark, "export")
    k = knowledge(spark, sf).withColumn("archived", F.col("source_type") != "explicit")
    IN.export_tables({"knowledge": k, "events": events(spark, sf)}, path)
    n = lambda t: spark.read.schema("id bigint").json(f"{path}/{t}").agg(F.count("id").alias("n")).select(F.lit(t).alias("name"), "n")
    return n("knowledge").unionByName(n("events"))


@query("s12_import_merge", """SELECT doc_id, 'old' AS origin, NULL AS text FROM labels UNION ALL SELECT o_custkey, 'new', min_by(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT doc_id FROM labels) GROUP BY o_custkey""")
def s12(spark, sf):
    """Insert-or-ignore: known keys stay as they are, of several new rows with one key the first by order key is kept."""
    old = table(spark, sf, "labels").select("doc_id", F.lit("old").alias("origin"), F.lit(None).cast("string").alias("text"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("text"), "o_orderkey")
    return IN.import_tables(old.withColumn("o_orderkey", F.lit(None).cast("bigint")), new, "doc_id", defaults={"origin": "new"}, order="o_orderkey").drop("o_orderkey")


_FIRST = f"""fi AS (SELECT doc_id, c AS content, n FROM {_last} JOIN v_observations o ON o.id = doc_id QUALIFY row_number() OVER (PARTITION BY sha256(c) ORDER BY indexed_at, doc_id) = 1)"""
_ENT13 = _ENT.replace("FROM documents)", "FROM (SELECT doc_id, content AS text FROM fi))")
_SIG13 = _SIG2.replace("FROM documents", "FROM (SELECT doc_id, content AS text FROM fi)")


@query("s13_ingest_pipeline", sql(f"""SELECT f.doc_id AS id, sha256(f.content) AS content_hash, CASE WHEN n > 0 THEN 'redacted' ELSE 'public' END AS privacy_level, round(im * CASE WHEN sig < 0.3e0 THEN 0.5e0 ELSE 1 END, 6) AS importance, CAST(ceil(octet_length(encode(f.content)) / 4.0) AS BIGINT) AS tokens_original
FROM fi f JOIN (SELECT doc_id, CAST({_IMP.format(ent='doc_id IN (SELECT doc_id FROM best)')} AS DOUBLE) AS im FROM (SELECT doc_id, fi.content, type FROM fi JOIN v_observations o ON o.id = doc_id)) i USING (doc_id) JOIN ({_SIG13}) s USING (doc_id)""", "v_observations", ctes=", ".join(_ct) + ", " + _FIRST + ", " + _ENT13 + "\n"))
def s13(spark, sf):
    o = spread(observations(spark, sf), "id").select("id", "type", "content", "indexed_at")
    r = IN.ingest_pipeline(o)
    return r.select("id", "content_hash", "privacy_level", round6("importance_score").alias("importance"), "tokens_original")
