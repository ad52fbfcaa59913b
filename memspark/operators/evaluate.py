"""Retrieval evaluation over a run ``(query_id, id, rank)`` and qrels ``(query_id, id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from ..functions.text import words_ws


def recall(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query with relevant ids: any / all of them in the top k, hits, and capped recall."""
    top = run.where(F.col("rank") <= k).select("query_id", "id").distinct().withColumn("_hit", F.lit(1))
    j = qrels.distinct().join(top, ["query_id", "id"], "left")
    g = j.groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("_hit").alias("hits"))
    return g.select("query_id", "relevant", "hits", F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("recall_any"),
                    F.when(F.col("hits") == F.col("relevant"), 1.0).otherwise(0.0).alias("recall_all"),
                    (F.col("hits") / F.least(F.col("relevant"), F.lit(k))).alias("recall_capped"))


def ndcg(run: DataFrame, qrels: DataFrame, k: int, ideal: str = "retrieved") -> DataFrame:
    """Per query dcg and ndcg; the ideal list holds the retrieved items only, or with ideal='qrels' all relevant ones."""
    rel = qrels.distinct().withColumn("_r", F.lit(1.0))
    j = run.where(F.col("rank") <= k).join(rel, ["query_id", "id"], "left").withColumn("rel", F.coalesce("_r", F.lit(0.0)))
    g = j.groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("rel").cast("int").alias("n"))
    if ideal == "qrels":
        g = g.drop("n").join(qrels.distinct().groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n")), "query_id")
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return g.select("query_id", "dcg", F.when(F.col("n") > 0, F.col("dcg") / best).otherwise(0.0).alias("ndcg"))


def evidence_recall(evidence: DataFrame, retrieved: DataFrame, share: float = 0.6) -> DataFrame:
    """Per query the fraction of evidence texts found in a retrieved text.

    Found means either holds the other, or at least ``share`` of the evidence's
    words (longer than 3, three or more) occur in it. ``evidence(query_id, no, text)``,
    ``retrieved(query_id, text)``: the join is per query over its retrieved top k.
    """
    j = evidence.join(retrieved.select("query_id", F.col("text").alias("_t")), "query_id", "left")
    ws = F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 3)
    hits = F.size(F.filter(ws, lambda w: F.contains(F.col("_t"), w)))
    words = (F.size(ws) >= 3) & (hits / F.greatest(F.size(ws), F.lit(1)) >= share)
    hit = F.coalesce(F.contains("text", F.col("_t")) | F.contains(F.col("_t"), F.col("text")) | words, F.lit(False))
    per = j.groupBy("query_id", "no").agg(F.max(hit.cast("int")).alias("f"))
    return per.groupBy("query_id").agg(F.count("*").alias("evidence"), F.sum("f").alias("found")).withColumn("recall", F.col("found") / F.col("evidence"))


def by_category(scores: DataFrame, category: str, metric: str) -> DataFrame:
    """Mean and perfect count per category, plus the overall mean over queries and over categories."""
    c = scores.groupBy(F.col(category).cast("string").alias("category")).agg(F.avg(metric).alias("mean"), F.sum((F.col(metric) >= 1).cast("bigint")).alias("perfect"), F.count("*").alias("n"))
    every = scores.agg(F.lit("(micro)").alias("category"), F.avg(metric).alias("mean"), F.sum((F.col(metric) >= 1).cast("bigint")).alias("perfect"), F.count("*").alias("n"))
    macro = c.agg(F.lit("(macro)").alias("category"), F.avg("mean").alias("mean"), F.sum("perfect").alias("perfect"), F.sum("n").alias("n"))
    return c.unionByName(every).unionByName(macro)


def to_sessions(run: DataFrame, sep: str = "_turn_", distinct: bool = False) -> DataFrame:
    """Cut ids at the turn suffix; duplicates stay unless ``distinct`` (best rank kept, ranks renumbered)."""
    s = run.withColumn("id", F.split_part("id", F.lit(sep), F.lit(1)))
    if not distinct:
        return s
    best = s.groupBy("query_id", "id").agg(F.min("rank").alias("_r"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_r"))).drop("_r")


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated query, document, score with score > 0; a header line has no numeric score and drops out."""
    d = spark.read.csv(path, sep="\t", schema="query_id string, id string, score string")
    return d.where(F.col("score").try_cast("int") > 0).select("query_id", "id").distinct()


def load_texts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an id (``_id`` or ``id``), a text and an optional title."""
    d = spark.read.schema("_id string, id string, title string, text string").json(path)
    return d.select(F.coalesce("_id", "id").alias("id"), F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), "text").alias("text"))
