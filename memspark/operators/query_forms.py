"""Query forms: one query text becomes rows of weighted AND / OR clauses.

Output: (query_id, strategy, weight, mode, phrase), distinct. A clause is a
phrase; a document meets an AND strategy when it holds every clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as K, language as L
from ..functions.text import tokens_of
from ..session import local_table


def synonyms(spark: SparkSession, extra: dict | None = None) -> DataFrame:
    """(word, synonym); ``extra`` adds words or further synonyms."""
    rows = {(w, s) for w, many in K.SYNONYMS.items() for s in many}
    rows |= {(w, s) for w, many in (extra or {}).items() for s in many}
    return local_table(spark, sorted(rows), ["word", "synonym"])


def clauses(queries: DataFrame, syn: DataFrame | None = None, ref_date: str | None = None) -> DataFrame:
    """All eight forms of ``queries(query_id, text[, ref_date])``."""
    syn = synonyms(queries.sparkSession) if syn is None else syn
    none = F.array().cast("array<string>")
    ents = F.transform(L.query_entities("text"), lambda e: F.lower(F.replace(e, F.lit('"'), F.lit(""))))
    q = queries.select("query_id", "text", *([ref_date] if ref_date else []))
    q = q.withColumns({"kw": L.search_keywords("text"), "ent": ents})
    n = F.size("kw")
    pairs = F.when(n >= 2, F.zip_with(F.slice("kw", 1, F.greatest(n - 1, F.lit(0))), F.slice("kw", 2, F.greatest(n - 1, F.lit(0))),
                                      lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(none)
    ent_words = F.filter(F.flatten(F.transform("ent", lambda e: F.split(e, r"\s+"))), lambda w: F.length(w) >= 3)
    relaxed = F.slice(F.array_distinct(F.concat(ent_words, F.filter("kw", lambda w: F.length(w) >= 5))), 1, 4)
    conj = F.when(n >= 2, F.slice("kw", 1, 8)).otherwise(none)
    raw = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    singles = F.slice(F.filter("kw", lambda w: F.length(w) >= 4), 1, 5)
    form = lambda name, weight, mode, arr: F.transform(arr, lambda p: F.struct(
        F.lit(name).alias("strategy"), F.lit(weight).alias("weight"), F.lit(mode).alias("mode"), p.alias("phrase")))
    parts = [
        form("and", 2.0, "AND", conj), form("phrase", 1.9, "OR", pairs), form("entity", 1.8, "AND", F.col("ent")),
        form("raw", 1.5, "AND", raw),
        form("relaxed", 1.2, "AND", F.when((n >= 3) & (F.size(relaxed) >= 2) & (relaxed != conj), relaxed).otherwise(none)),
        form("or", 1.0, "OR", F.col("kw")),
        F.transform(singles, lambda p: F.struct(F.concat(F.lit("single:"), p).alias("strategy"), F.lit(0.5).alias("weight"),
                                                F.lit("OR").alias("mode"), p.alias("phrase"))),
    ]
    if ref_date:
        parts.append(form("temporal", 1.6, "AND", L.temporal_keywords("text", ref_date)))
    rows = q.select("query_id", F.explode(F.concat(*parts)).alias("c")).select("query_id", "c.*")
    more = (rows.where("strategy = 'or'").join(syn, F.col("phrase") == F.col("word"))
            .select("query_id", "strategy", "weight", "mode", F.col("synonym").alias("phrase")))
    return rows.unionByName(more).where(F.size(tokens_of("phrase")) > 0).distinct()


def any_word(queries: DataFrame, words, strategy: str = "or") -> DataFrame:
    """A single OR form over ``words`` (an array column of ``queries``)."""
    return queries.select("query_id", F.lit(strategy).alias("strategy"), F.lit(1.0).alias("weight"), F.lit("OR").alias("mode"),
                          F.explode(words).alias("phrase")).where(F.size(tokens_of("phrase")) > 0).distinct()


def all_words(queries: DataFrame, words, strategy: str = "and") -> DataFrame:
    return any_word(queries, words, strategy).withColumn("mode", F.lit("AND"))
