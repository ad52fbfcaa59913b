"""Decision trails: what led to a decision, what it replaced, what it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from ..session import cut
from . import joins as J, retrieval as R, search as S

EVIDENCE = ["query_id", "type", "source_id", "at", "content"]
#: Event types and the kind of evidence they are; any other event counts as a search.
EVENT_KINDS = {"file_read": "file_read", "error": "error", "file_modify": "fix", "decision": "decision", "search": "search"}


def find_decisions(queries: DataFrame, decisions: DataFrame, index, text_columns: list[str], at: str) -> DataFrame:
    """(query_id, id): the newest of ``decisions(id, <text columns>, <at>)`` that hold a query as a substring (without case).

    ``index`` is the written index of the whole table: its words and trigrams find the candidates.
    """
    found = S.contains_text(decisions, "id", text_columns, queries, index).join(decisions.select("id", F.col(at).alias("_at")), "id")
    newest = Window.partitionBy("query_id").orderBy(F.desc("_at"), F.desc("id"))
    return found.withColumn("_rk", F.row_number().over(newest)).where("_rk = 1").select("query_id", "id")


def session_events(marks: DataFrame, events: DataFrame, most: int = 20, within: int = 3600) -> DataFrame:
    """The newest events ``(id, session_id, event_type, ts, content)`` of the decision's session in the hour before it."""
    p = marks.where("session_id IS NOT NULL").select("session_id", F.col("query_id").alias("pid"), F.col("at").alias("pts"))
    f = events.select("session_id", F.col("id").alias("fid"), F.col("ts").alias("fts"), "event_type", "content")
    kind = F.lit("search")
    for name, value in EVENT_KINDS.items():
        kind = F.when(F.col("event_type") == name, value).otherwise(kind)
    e = J.last_k_before(p, f, ["session_id"], most, within)
    return e.select(F.col("pid").alias("query_id"), kind.alias("type"), F.col("fid").cast("string").alias("source_id"), F.col("fts").alias("at"), "content")


def earlier_observations(marks: DataFrame, obs: DataFrame, most: int = 5, within: int = 86400) -> DataFrame:
    """The newest errors, contexts and code rows of the day before the decision, from any session."""
    p = marks.select(F.col("query_id").alias("pid"), F.col("at").alias("pts"))
    f = obs.where(F.col("type").isin("error", "context", "code")).select(F.col("id").alias("fid"), F.col("indexed_at").alias("fts"), "type", F.substring("content", 1, 200).alias("content"))
    e = J.last_k_before(p, f, [], most, within)
    kind = F.when(F.col("type") == "error", "error").otherwise("file_read")
    return e.select(F.col("pid").alias("query_id"), kind.alias("type"), F.col("fid").cast("string").alias("source_id"), F.col("fts").alias("at"), "content")


def alternatives(chosen: DataFrame, know: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, title, place): entries that the decision replaced, and the one that replaced it; ``know(id, title, superseded_by)``."""
    older = chosen.join(know.where("superseded_by IS NOT NULL").select("title", F.col("id").alias("other"), F.col("superseded_by").alias("id")), "id").select("query_id", "other", "title")
    next_ = chosen.join(know.select("id", "superseded_by"), "id").where("superseded_by IS NOT NULL").select("query_id", F.col("superseded_by").alias("id"))
    newer = next_.join(know.select("id", "title"), "id").select("query_id", F.col("id").alias("other"), "title")
    w = Window.partitionBy("query_id").orderBy("other")
    return older.unionByName(newer).distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "title", "place")


def named_entities(chosen: DataFrame, texts: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, name, place): the entities ``names(name)`` that the decision's text ``texts(id, content)`` holds, by name."""
    body = cut(chosen.join(texts, "id").select("query_id", "content"), "texts")  # one text a query
    held = S.contains_text(body, "query_id", ["content"], names.select(F.col("name").alias("query_id"), F.col("name").alias("text")).distinct())
    w = Window.partitionBy("id").orderBy("query_id")
    return held.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(F.col("id").alias("query_id"), F.col("query_id").alias("name"), "place")


def decision_trails(queries: DataFrame, obs: DataFrame, obs_index, know: DataFrame, know_index, events: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trails, evidence) of every query that some decision answers.

    The newest decision among the observations that hold the query decides, else the newest among the knowledge entries of category
    decision. An observation's evidence are the events of its session in the hour before, the errors, contexts and code of the
    day before, and the decision itself, in order of time; an entry's is the entry.
    ``obs(id, type, content, indexed_at, session_id)``, ``know(id, category, title, content, created_at, superseded_by)``,
    ``events(id, session_id, event_type, ts, content)``, ``names(name)``.
    """
    queries = cut(queries.select("query_id", "text"), "queries")
    decided = obs.where("type = 'decision'")
    first = cut(find_decisions(queries, decided, obs_index, ["content"], "indexed_at"), "decisions")
    rest = queries.join(first, "query_id", "left_anti")
    entries = know.where("category = 'decision'")
    second = cut(find_decisions(rest, entries, know_index, ["title", "content"], "created_at"), "decisions")
    marks = cut(first.join(decided.select("id", "content", "session_id", F.col("indexed_at").alias("at")), "id"), "marks")
    own = marks.select("query_id", F.lit("decision").alias("type"), F.col("id").cast("string").alias("source_id"), "at", F.substring("content", 1, 300).alias("content"))
    entry = second.join(entries, "id").select("query_id", F.lit("knowledge").alias("type"), F.col("id").cast("string").alias("source_id"), F.col("created_at").alias("at"), "content")
    found = cut(session_events(marks, events).unionByName(earlier_observations(marks, obs)).unionByName(own).unionByName(entry), "evidence")
    # at most 26 rows a query
    order = Window.partitionBy("query_id").orderBy("at", "type", F.length("source_id"), "source_id")
    evidence = found.withColumn("place", F.row_number().over(order))
    counts = found.groupBy("query_id").agg(F.count("*").alias("evidence"))
    chosen = cut(first.withColumn("source", F.lit("observation")).unionByName(second.withColumn("source", F.lit("knowledge"))), "chosen")
    listed = lambda rows, c, name: rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda s: s[c]).alias(name))
    other = listed(alternatives(chosen, know), "title", "alternatives")
    texts = decided.select("id", F.lit("observation").alias("source"), "content").unionByName(entries.select("id", F.lit("knowledge").alias("source"), "content"))
    mine = chosen.withColumnRenamed("id", "_id").withColumnRenamed("source", "_source")
    body = mine.join(texts, (F.col("_id") == F.col("id")) & (F.col("_source") == F.col("source"))).select("query_id", F.col("query_id").alias("id"), "content")
    named = listed(named_entities(body.select("query_id", "id"), body.select("id", "content"), names), "name", "entities")
    sure = F.when(F.col("source") == "knowledge", 0.6).otherwise(F.least(F.lit(1.0), 0.3 + 0.1 * F.col("evidence")))
    trails = chosen.join(counts, "query_id").join(other, "query_id", "left").join(named, "query_id", "left")
    none = F.array().cast("array<string>")
    return trails.select("query_id", "source", F.col("id").alias("decision_id"), "evidence", F.coalesce("alternatives", none).alias("alternatives"),
                         F.coalesce("entities", none).alias("entities"), sure.alias("confidence")), evidence.select(*EVIDENCE, "place")
