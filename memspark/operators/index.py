"""Inverted index: occurrences, postings, document and term statistics (written ones: ``segments``).

A document's tokens leave its row by one explode. When the searched vocabulary
is known the occurrences are semi-joined with it in the same stage, before
anything is shuffled; the planner broadcasts that vocabulary only when its
measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col, tokens_of

K1, B = 1.2, 0.75


def tokenised(df: DataFrame, id_: str, text, *keep: str) -> DataFrame:
    """(id, tokens, dl): lower-case ASCII alphanumeric tokens and their number."""
    # the one-element explode keeps later uses of the array from repeating the split
    t = df.select(F.col(id_).alias("id"), F.explode(F.array(tokens_of(text))).alias("tokens"), *keep)
    return t.withColumn("dl", F.size("tokens").cast("bigint"))


def corpus_stats(tok) -> DataFrame:
    """One row: number of documents and their mean length, of tokenised rows or a written index."""
    if not isinstance(tok, DataFrame):
        return tok.stats
    return tok.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def postings(tok: DataFrame, vocabulary: DataFrame | None = None, *keep: str) -> DataFrame:
    """(id, term, dl, tf), optionally only for the terms of ``vocabulary(term)``."""
    occ = tok.select("id", "dl", *keep, F.explode("tokens").alias("term"))
    if vocabulary is not None:
        occ = occ.join(vocabulary, "term", "left_semi")
    return occ.groupBy("id", "term", "dl", *keep).agg(F.count("*").alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def unit_occurrences(tok: DataFrame, *keep: str, with_pairs: bool = True) -> DataFrame:
    """(id, dl, pos, unit): every token, and adjacent pair of tokens if they are asked for, with its place."""
    single = tok.select("id", "dl", *keep, F.posexplode("tokens").alias("pos", "unit"))
    return single.unionByName(pair_occurrences(tok, *keep)) if with_pairs else single


def pair_occurrences(tok: DataFrame, *keep: str) -> DataFrame:
    """(id, dl, pos, unit): every adjacent pair of tokens with its place."""
    t = F.col("tokens")
    rest = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(t, 1, rest), F.slice(t, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))
    return tok.select("id", "dl", *keep, F.posexplode(pairs).alias("pos", "unit"))


def phrase_units(phrases: DataFrame) -> DataFrame:
    """(phrase, need, off, unit): a token alone, or every adjacent pair of a longer phrase."""
    p = phrases.select("phrase").distinct().withColumn("t", tokens_of("phrase")).where(F.size("t") > 0)
    one = F.transform(F.col("t"), lambda x, i: F.struct(i.alias("off"), x.alias("unit")))
    two = F.transform(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(1))), lambda x, i: F.struct(
        i.alias("off"), F.concat(x, F.lit(" "), F.coalesce(F.get("t", i + 1), F.lit(""))).alias("unit")))
    single = F.size("t") == 1
    return p.select("phrase", F.when(single, 1).otherwise(F.size("t") - 1).alias("need"),
                    F.explode(F.when(single, one).otherwise(two)).alias("u")).select("phrase", "need", "u.*")


def phrase_hits(tok, phrases: DataFrame, *keep: str) -> DataFrame:
    """(phrase, id, dl, tf): how often each phrase occurs, its tokens adjacent and in order.

    Exact without a scan per phrase: the pairs of a phrase must all start at
    the same place. Only phrases of three tokens or more need the extra grouping.
    A written index answers from its postings of the searched units.
    """
    if not isinstance(tok, DataFrame):
        return tok.hits(phrases)
    units = phrase_units(phrases)
    occ = unit_occurrences(tok, *keep, with_pairs=not units.where(F.contains("unit", F.lit(" "))).isEmpty())
    occ = occ.join(units, "unit")
    by = ["phrase", "id", "dl", *keep]
    short = occ.where("need = 1").select(*by)
    long = (occ.where("need > 1").groupBy(*by, "need", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("c"))
            .where("c = need").select(*by))
    return short.unionByName(long).groupBy(*by).agg(F.count("*").alias("tf"))


def bm25_weight(tf, dl, df, n_docs, avgdl) -> Column:
    """One clause's share: idf = ln(1 + (N - df + .5)/(df + .5)), k1 = 1.2, b = 0.75."""
    idf = F.log(1 + (col(n_docs) - col(df) + 0.5) / (col(df) + 0.5))
    return idf * col(tf) * (K1 + 1) / (col(tf) + K1 * (1 - B + B * col(dl) / col(avgdl)))


def weighted_hits(hits: DataFrame, stats: DataFrame, key: str = "phrase", df: DataFrame | None = None) -> DataFrame:
    """Add ``w``, the BM25 share of each (key, id) hit; ``df(key, df)`` are the numbers of hits, where they are known."""
    df = hits.groupBy(key).agg(F.count("*").alias("df")) if df is None else df
    one = stats.select(F.struct("n_docs", "avgdl").alias("s")).scalar()
    h = hits.join(df, key).withColumn("_s", one)
    return h.withColumn("w", bm25_weight("tf", "dl", "df", F.col("_s.n_docs"), F.col("_s.avgdl"))).drop("_s", "df")
