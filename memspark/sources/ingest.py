"""Ingest: chunking, idempotent indexing, the enrichment pipeline, export and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from ..functions import enrich as E, entities as N
from ..functions.text import strip, valid_json
from ..operators import rollups
from ..operators.ordered import running
from ..schemas import MEMORY
from ..session import cut


def read_memory(spark: SparkSession, path: str, tables=None, schemas: dict | None = None, suffix: str = "") -> dict[str, DataFrame]:
    """Scans of the stored tables (folders or files ``name + suffix``) with their enforced schemas."""
    schemas = schemas or MEMORY
    return {t: spark.read.schema(schemas[t]).parquet(f"{path}/{t}{suffix}") for t in (tables or schemas)}


def chunk_documents(df: DataFrame, id_: str, text: str, bucket_lines: int = 10000) -> DataFrame:
    """(doc, chunk, heading, content, has_code).

    JSON stays whole. With two or more markdown headings outside code the text
    splits at headings (what precedes them is a chunk of its own), else at blank
    lines. Fenced code is never split. Line flags are running sums over line
    buckets, so a huge file is not one window.
    """
    d = df.select(F.col(id_).alias("doc"), F.col(text).alias("text")).withColumn("_json", valid_json("text"))
    whole = d.where("_json").select("doc", F.lit(0).cast("bigint").alias("chunk"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("content"), F.lit(False).alias("has_code"))
    ls = rollups.explode_lines(d.where("not _json"), "doc", "text")
    bucket = F.floor(F.col("pos") / bucket_lines)
    ls = ls.withColumn("_f", strip("line").startswith("```").cast("bigint"))
    ls = running(ls, ["doc"], ["pos"], bucket, sums={"_n": "_f"})
    code = (F.col("_n") % 2 == 1) | (F.col("_f") == 1)
    ls = ls.withColumns({"code": code, "_h": (~code & F.col("line").rlike(r"^#{1,6}\s+.+$")).cast("bigint"), "_b": (~code & (F.col("line") == "")).cast("bigint")})
    heads = ls.groupBy("doc").agg(F.sum("_h").alias("heads"))
    ls = ls.join(heads, "doc").withColumn("_s", F.when(F.col("heads") >= 2, F.col("_h")).otherwise(F.col("_b")))
    ls = running(ls, ["doc"], ["pos"], bucket, sums={"part": "_s"})
    ls = ls.where((F.col("heads") >= 2) | (F.col("_b") == 0))
    g = ls.groupBy("doc", "part").agg(
        F.max(F.when((F.col("heads") >= 2) & (F.col("_h") == 1), F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))).alias("heading"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")).alias("content"),
        F.max(F.col("code").cast("int")).alias("c"))
    g = g.where("content <> ''").withColumn("chunk", F.row_number().over(Window.partitionBy("doc").orderBy("part")).cast("bigint") - 1)
    return whole.unionByName(g.select("doc", "chunk", "heading", "content", (F.col("c") == 1).alias("has_code")))


def index_source(df: DataFrame, source: str, existing: DataFrame) -> DataFrame:
    """Rows whose source hash is not stored yet, one per hash."""
    h = df.withColumn("source_hash", F.sha2(F.col(source), 256))
    one = h.groupBy("source_hash").agg(F.min("id").alias("id"))
    return h.join(one.select("id"), "id", "left_semi").join(existing.select("source_hash"), "source_hash", "left_anti")


def ingest_pipeline(raw: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Raw rows ``(id, type, content, indexed_at)`` to enriched observations.

    Redact, hash, keep the earliest row of each hash, drop what is stored, then
    entities, importance with the noise penalty, topics, summary and tokens. The
    hash grouping moves only (hash, time, id), never the texts.
    """
    r = E.redact(raw, "content").drop("content").withColumnRenamed("cleaned", "content")
    r = r.withColumns({"privacy_level": E.privacy_level("had_private", "n_redactions"), "content_hash": F.sha2("content", 256)})
    r = cut(r, "redacted")  # read three times below; redaction runs once, on every row
    first = r.groupBy("content_hash").agg(F.min(F.struct("indexed_at", "id")).alias("f"))
    if stored is not None:
        first = first.join(stored.select("content_hash"), "content_hash", "left_anti")
    r = r.join(first.select(F.col("f.id").alias("id")), "id", "left_semi")
    ents = N.entities(r, "id", "content").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("entities"))  # a document's own names
    r = r.join(ents, "id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    r = r.withColumns({"significance_flags": E.significance_flags("content"), "topics": E.topics("content"),
                       "importance_score": E.penalised(E.importance("content", "type", F.size("entities") > 0), E.signal_score("content"))})
    r = r.withColumn("pinned", E.pinned("significance_flags"))
    r = r.withColumn("summary", F.when(F.col("pinned"), F.col("content")).otherwise(rollups.head_tail("content")))
    return r.withColumns({"tokens_original": E.estimate_tokens("content"), "tokens_summarized": E.estimate_tokens("summary")})


def auto_knowledge(obs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Knowledge rows that observations give rise to.

    A decision becomes a decision, a commit a pattern, an error an error unless
    one of that title exists, and the fifth code observation of a file a component.
    """
    first = F.substring(F.split("content", "\n")[0], 1, 120)
    body = F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.substring("content", 1, 500))
    o = obs.select("id", "type", "indexed_at", "file_path", first.alias("title"), body.alias("content"))
    row = lambda df, cat: df.select("id", F.lit(cat).alias("category"), "title", "content")
    errors = o.where("type = 'error'")
    lead = errors.groupBy("title").agg(F.min(F.struct("indexed_at", "id")).alias("f")).select("title", F.col("f.id").alias("id"))
    if stored is not None:
        lead = lead.join(stored.where("category = 'error'").select("title"), "title", "left_anti")
    errors = errors.join(lead.select("id"), "id", "left_semi")
    code = running(o.where("type = 'code' and file_path is not null"), ["file_path"], ["indexed_at", "id"], F.floor(F.unix_timestamp("indexed_at") / 86400), count="_n")
    comp = code.where("_n = 5").withColumn("title", F.col("file_path"))
    return row(o.where("type = 'decision'"), "decision").unionByName(row(errors, "error")).unionByName(row(o.where("type = 'commit'"), "pattern")).unionByName(row(comp, "component"))


def export_tables(tables: dict[str, DataFrame], path: str, fmt: str = "json", newest_events: int = 1000) -> list[str]:
    """Write the chosen tables: knowledge that is not archived, the newest events, the rest whole."""
    done = []
    for name, df in tables.items():
        if name == "knowledge" and "archived" in df.columns:
            df = df.where(~F.col("archived"))
        if name == "events":
            df = df.orderBy(F.desc("ts"), F.desc("id")).limit(newest_events)
        df.write.format(fmt).save(f"{path}/{name}")
        done.append(name)
    return done


def import_tables(existing: DataFrame, incoming: DataFrame, key: str, mode: str = "merge", defaults: dict | None = None, order: str | None = None) -> DataFrame:
    """merge keeps existing rows and adds unknown keys; replace takes the incoming rows. Missing values get defaults.

    Of incoming rows with one key the first in ``order`` stays; without it the smallest by all columns.
    """
    for c, v in (defaults or {}).items():
        incoming = incoming.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in incoming.columns else F.lit(v))
    row = F.struct(*[c for c in incoming.columns if c != key])
    one = incoming.groupBy(key).agg(F.min_by(row, F.struct(order, row) if order else row).alias("row")).select(key, "row.*") if len(incoming.columns) > 1 else incoming.distinct()
    if mode == "replace":
        return one
    return existing.unionByName(one.join(existing.select(key), key, "left_anti"))
