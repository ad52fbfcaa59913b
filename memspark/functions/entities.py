"""Entities, tags and titles: per-document lists built by explode and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from . import constants as K
from ..session import local_table
from .text import NOT_AFTER, NOT_BEFORE, col, extract_all, first_group, strip


def alias_table(spark: SparkSession, technologies=None, aliases=None) -> DataFrame:
    """(alias, canonical): every canonical name in lower case plus its further names."""
    names = technologies or K.TECHNOLOGIES
    more = K.TECHNOLOGY_ALIASES if aliases is None else aliases
    rows = {n.lower(): n for n in names}
    rows.update({a.lower(): n for n, many in more.items() for a in many})
    return local_table(spark, sorted(rows.items()), ["alias", "canonical"])


def resolve_alias(df: DataFrame, name: str, table: DataFrame | None = None) -> DataFrame:
    """Add ``canonical`` and ``is_alias``; unknown names stay as they are."""
    table = alias_table(df.sparkSession) if table is None else table
    j = df.join(table.withColumnRenamed("canonical", "_canon"), F.lower(F.col(name)) == F.col("alias"), "left")
    return j.withColumns({
        "canonical": F.coalesce("_canon", name),
        "is_alias": F.coalesce(F.lower("_canon") != F.lower(F.col(name)), F.lit(False)),
    }).drop("alias", "_canon")


# --- fixed values: entity patterns --------------------------------------------
TOKEN_SPLIT = r"[\s,;:()\[\]{}\"'`]+"
FILE_PATH = r"(?:^|\s)((?:\.?\.?/)?(?:[\w\-.]+/)+[\w\-.]+(?:\.\w+)?)"
CAMEL_CASE = f"{NOT_BEFORE}([A-Z][a-z]+(?:[A-Z][a-z]+)+){NOT_AFTER}"
ALL_CAPS = f"{NOT_BEFORE}([A-Z][A-Z0-9_]{{2,}}){NOT_AFTER}"
ISSUE_REF = r"(?i)(?:#|(?:issue|bug|ticket)[-\s]?)(\d+)"
VERSION_REF = f"{NOT_BEFORE}v?(\\d+\\.\\d+(?:\\.\\d+)?(?:-[\\w.]+)?)" + "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
PERSON_NAME = f"{NOT_BEFORE}([A-Z][a-z]{{2,}}\\s+[A-Z][a-z]{{2,}}(?:\\s+[A-Z][a-z]{{2,}})?){NOT_AFTER}"


def _ranked(names: Column, prio: int, type_: str) -> Column:
    return F.transform(names, lambda x, i: F.struct(F.lit(prio).alias("prio"), i.alias("pos"), x.alias("name"), F.lit(type_).alias("type")))


def entities(df: DataFrame, id_: str, text: str, table: DataFrame | None = None) -> DataFrame:
    """(id, name, type, confidence), one row per lower-cased name and document.

    Classes in falling priority: technology, file, CamelCase, ALL_CAPS, issue,
    version, person; the first class that finds a name keeps it. One shuffle on
    (document, name) with map-side combining.
    """
    table = alias_table(df.sparkSession) if table is None else table
    c = F.col(text)
    classes = [
        (2, "file", extract_all(c, FILE_PATH, 1)),
        (3, "module", F.filter(extract_all(c, CAMEL_CASE, 1), lambda x: ~x.isin(*K.CAMEL_CASE_SKIP))),
        (4, "config", F.filter(extract_all(c, ALL_CAPS, 1), lambda x: ~x.isin(*K.ALL_CAPS_SKIP))),
        (5, "bug", F.transform(extract_all(c, ISSUE_REF, 1), lambda x: F.concat(F.lit("#"), x))),
        (6, "service", F.transform(extract_all(c, VERSION_REF, 1), lambda x: F.concat(F.lit("v"), x))),
        (7, "person", extract_all(c, PERSON_NAME, 1)),
        (1, "library", F.filter(F.split(c, TOKEN_SPLIT), lambda x: F.length(x) >= 2)),
    ]
    found = F.flatten(F.array(*[
        _ranked(a, prio, type_) for prio, type_, a in classes]))
    rows = df.select(F.col(id_).alias("id"), F.explode(found).alias("e")).select("id", "e.*")
    rows = rows.where((F.col("type") != "file") | (F.length("name") >= 4))
    rows = rows.withColumn("key", F.lower("name")).join(table, F.col("key") == F.col("alias"), "left")
    known = F.col("canonical").isNotNull()
    rows = rows.where(F.when(F.col("type") == "library", known)
                      .when(F.col("type").isin("module", "config", "person"), ~known).otherwise(True))
    tech = F.col("type") == "library"
    rows = rows.withColumn("name", F.when(tech, F.col("canonical")).otherwise(F.col("name")))
    rows = rows.withColumn("key", F.lower("name"))
    best = rows.groupBy("id", "key").agg(F.min(F.struct("prio", "pos", "name", "type")).alias("b"))
    conf = F.create_map(*[F.lit(x) for kv in K.ENTITY_CONFIDENCE.items() for x in kv])
    return best.select("id", F.col("b.name").alias("name"), F.col("b.type").alias("type"), conf[F.col("b.type")].alias("confidence"))


def tag_words(text) -> Column:
    cleaned = F.regexp_replace(F.lower(col(text)), r"[^\w\s-]", " ")
    return F.filter(F.split(cleaned, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*K.TAG_STOP_WORDS))


def top_words(df: DataFrame, id_: str, text: str, k: int) -> DataFrame:
    """(id, words): the k most frequent words of each document, ties alphabetical."""
    counts = (df.select(F.col(id_).alias("id"), F.explode(tag_words(text)).alias("word"))
              .groupBy("id", "word").agg(F.count("*").alias("n")))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    return top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "word"))), lambda s: s["word"]).alias("words"))


def generate_tags(df: DataFrame, id_: str, text: str, k: int = 5) -> DataFrame:
    return top_words(df, id_, text, k).select("id", F.array_join("words", ",").alias("tags"))


def generate_title(df: DataFrame, id_: str, text: str, max_length: int = 80) -> DataFrame:
    """First sentence of 10..n characters, else the top five words, else cut text."""
    first = strip(first_group(text, r"^[^.!?\n]+[.!?]?", 0))
    base = df.select(F.col(id_).alias("id"), first.alias("first"),
                     strip(F.regexp_replace(F.substring(F.col(text), 1, max_length), r"\s+\S*$", "")).alias("cut"), F.col(text).alias("_t"))
    good = F.col("first").isNotNull() & F.length("first").between(10, max_length)
    need = base.where(~F.coalesce(good, F.lit(False)))
    words = top_words(need, "id", "_t", 5)
    out = base.join(words, "id", "left")
    phrase = F.substring(F.array_join("words", " "), 1, max_length)
    return out.select("id", F.when(good, F.col("first")).when(F.size("words") > 0, phrase).otherwise(F.col("cut")).alias("title"))
