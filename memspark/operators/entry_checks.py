"""Checks of new knowledge entries against the stored ones of their category: three legs, reason and suggested action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from . import maintenance as M, query_forms as Q, retrieval as R, search as S, similarity as SI

#: Characters of title and content that the full-text leg asks for.
SEARCHED = 200


def search_text(title: str, content: str) -> Column:
    """Title and content, cut at the last space within ``SEARCHED`` characters."""
    raw = F.concat(F.col(title), F.lit(" "), F.col(content))
    head = F.substring(raw, 1, SEARCHED + 1)
    space = F.locate(" ", F.reverse(head))  # from the end; 0: none
    cut_at = F.when((space > 0) & (space <= SEARCHED), SEARCHED + 1 - space).otherwise(SEARCHED)
    return F.when(F.length(raw) > SEARCHED, F.substr(raw, F.lit(1), cut_at.cast("int"))).otherwise(raw)


def full_text_leg(new: DataFrame, know: DataFrame, index, limit: int = 5) -> DataFrame:
    """(query_id, id): the best ``limit`` entries of the category that hold every word of the new one's text.

    The words' postings are read from the index of all entries; the category cuts the hits before they are ranked.
    """
    asked = new.select("query_id", search_text("title", "content").alias("text"))
    scored = R.score_clauses(index, Q.all_words(asked, S.raw_words()))
    same = scored.join(new.select("query_id", "category"), "query_id").join(know.select("id", "category"), ["id", "category"])
    return R.top_k(same, limit).select("query_id", "id")


def title_leg(new: DataFrame, know: DataFrame, shared: int = 2) -> DataFrame:
    """(query_id, id, shared): entries of the category with at least ``shared`` words of the title."""
    words = lambda d, key: d.select(key, "category", F.explode(SI.overlap_words("title")).alias("w"))
    return words(know, "id").join(words(new, "query_id"), ["category", "w"]).groupBy("query_id", "id").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)


def vector_leg(new: DataFrame, know: DataFrame, vectors: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(query_id, id): entries of the category whose vector is near; ``vectors(id, embedding)`` hold those of new and stored ones."""
    mine = vectors.select(F.col("id").alias("query_id"), "embedding").join(new.select("query_id"), "query_id", "left_semi")
    near = R.similar_vectors(vectors, mine, threshold).join(new.select("query_id", "category"), "query_id")
    return near.join(know.select("id", "category"), ["id", "category"]).select("query_id", "id")


def check_entries(new: DataFrame, know: DataFrame, index, vectors: DataFrame, access: DataFrame, as_of) -> DataFrame:
    """(query_id, id, leg, reason, authority, action) of every entry that a new one may contradict.

    Full text answers first; an entry that finds nothing there is compared by title; near vectors are added to either.
    """
    first = cut(full_text_leg(new, know, index).withColumn("leg", F.lit(1)), "leg")
    rest = new.join(first.select("query_id").distinct(), "query_id", "left_anti")
    second = cut(title_leg(rest, know).select("query_id", "id", F.lit(2).alias("leg")), "leg")
    found = first.unionByName(second)
    third = vector_leg(new, know, vectors).join(found, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(3).alias("leg"))
    pair = found.unionByName(third).join(new.select("query_id", F.lower("title").alias("nt")), "query_id").join(know.select("id", F.lower("title").alias("kt")), "id")
    by_title = F.when(F.col("nt") == F.col("kt"), "identical title").when(F.contains("nt", F.col("kt")) | F.contains("kt", F.col("nt")), "overlapping title").otherwise("similar topic")
    reason = F.when(F.col("leg") == 3, "semantic similarity").otherwise(by_title)
    c = pair.select("query_id", "id", "leg", reason.alias("reason")).join(M.with_authority(know, access, as_of).select("id", "authority"), "id")
    fresh = M.authority(F.lit(0.3), F.lit(0), F.lit(0), F.lit(0.0))
    action = F.when(F.abs(F.col("authority") - fresh) > 0.3, F.when(F.col("authority") > fresh, "keep_existing").otherwise("replace")).otherwise("merge")
    return c.withColumn("action", action)
