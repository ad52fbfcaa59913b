"""Input tables and the memory-shaped views derived from them.

Each view exists twice: as a DataFrame for the jobs and as a CTE for the SQL
that checks them. Times without zone are cast to TIMESTAMP here, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T, Window

from .schemas import INPUT

AS_OF = "2024-05-01 00:00:00"          # for documents-based views
EVENTS_AS_OF = "2024-02-01 00:00:00"   # for events-based views


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one input table with its enforced schema."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.schema(INPUT[name]).parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def ts(text: str):
    return F.lit(text).cast("timestamp")


def _hours(n):
    return F.make_dt_interval(hours=n.cast("int"))


def pick(index, *names):
    """names[index], as a column; an index past the list takes the last name."""
    out = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        out = F.when(index == i, names[i]).otherwise(out)
    return out


def observations(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"),
        pick(i % 7, "code", "error", "log", "test", "commit", "decision", "context").alias("type"),
        F.col("text").alias("content"),
        F.col("source").alias("project"),
        F.concat(F.lit("s"), (i % 20).cast("string")).alias("session_id"),
        (ts("2024-01-01 00:00:00") + _hours((i * 37) % 2400)).alias("indexed_at"),
        (i % 5).alias("access_count"),
    )


def knowledge(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    base = ts("2024-01-01 00:00:00")
    return d.select(
        i.alias("id"),
        pick(i % 5, "pattern", "decision", "error", "api", "component").alias("category"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("content"),
        pick(i % 3, "explicit", "inferred", "observed").alias("source_type"),
        (base + _hours((i * 37) % 2400)).alias("created_at"),
        (base + _hours((i * 37) % 2400 + (i * 11) % 400)).alias("last_accessed"),
        (i % 9).alias("access_count"),
        F.col("source").alias("project"),
    )


def events(spark, sf_dir, *more: str) -> DataFrame:
    return events_from(table(spark, sf_dir, "events"), *more)


def events_from(e: DataFrame, *more: str) -> DataFrame:
    """The events view over any frame of the raw events (batch or stream)."""
    t = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        F.col("ts"),
        F.when(t == "error", "error").when(t == "purchase", "file_modify").when(t == "view", "file_read")
        .when(t == "click", "search").otherwise("decision").alias("event_type"),
        F.regexp_replace("props", "[^0-9]", "").alias("k"),
        *more,
    )


def access_log(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(F.col("k").alias("knowledge_id"), "session_id").distinct()


def tokens(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("session_id"), "turn", "role",
        F.ceil(F.octet_length("text") / 4.0).cast("bigint").alias("tokens_in"),
    )


def facts(spark, sf_dir) -> DataFrame:
    from .operators.ordered import neighbours

    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("valid_from"))
    out = neighbours(o, ["entity"], ["valid_from", "id"], bucket=F.year("valid_from"),
                     after={"valid_to": "valid_from", "superseded_by": "id"}, before={"parent": "id"})
    return out.select("id", "entity", "valid_from", "valid_to", "superseded_by", "parent")


def edges(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight"))
        .select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
                F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "weight")
    )


def queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


CTE = {
    "v_observations": """v_observations AS (
SELECT doc_id AS id,
       CASE doc_id % 7 WHEN 0 THEN 'code' WHEN 1 THEN 'error' WHEN 2 THEN 'log' WHEN 3 THEN 'test'
                       WHEN 4 THEN 'commit' WHEN 5 THEN 'decision' ELSE 'context' END AS type,
       text AS content, source AS project, concat('s', CAST(doc_id % 20 AS VARCHAR)) AS session_id,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * ((doc_id * 37) % 2400) AS indexed_at,
       doc_id % 5 AS access_count
FROM documents)""",
    "v_knowledge": """v_knowledge AS (
SELECT doc_id AS id,
       CASE doc_id % 5 WHEN 0 THEN 'pattern' WHEN 1 THEN 'decision' WHEN 2 THEN 'error' WHEN 3 THEN 'api' ELSE 'component' END AS category,
       substr(text, 1, 80) AS title, text AS content,
       CASE doc_id % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' ELSE 'observed' END AS source_type,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * ((doc_id * 37) % 2400) AS created_at,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * ((doc_id * 37) % 2400 + (doc_id * 11) % 400) AS last_accessed,
       doc_id % 9 AS access_count, source AS project
FROM documents)""",
    "v_events": """v_events AS (
SELECT event_id AS id, user_id AS session_id, ts,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'file_modify' WHEN 'view' THEN 'file_read'
                       WHEN 'click' THEN 'search' ELSE 'decision' END AS event_type,
       regexp_replace(props, '[^0-9]', '', 'g') AS k
FROM events)""",
    "v_access_log": """v_access_log AS (SELECT DISTINCT k AS knowledge_id, session_id FROM v_events)""",
    "v_tokens": """v_tokens AS (
SELECT conv_id AS session_id, turn, role, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens_in
FROM conversations)""",
    "v_facts": """v_facts AS (
SELECT o_orderkey AS id, o_custkey AS entity, o_orderdate AS valid_from,
       lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to,
       lead(o_orderkey)  OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_by,
       lag(o_orderkey)   OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent
FROM orders)""",
    "v_edges": """v_edges AS (
SELECT concat('s', CAST(l_suppkey AS VARCHAR)) AS src, concat('p', CAST(l_partkey AS VARCHAR)) AS dst, count(*) AS weight
FROM lineitem GROUP BY l_suppkey, l_partkey)""",
    "v_queries": """v_queries AS (SELECT item_id AS query_id, text FROM benchmark)""",
}
