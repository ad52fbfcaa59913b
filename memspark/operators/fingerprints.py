"""Working fingerprints: what a project knew, touched, named and failed on at a time, and what changed between two times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from .joins import valid_at

#: What a change of each kind is called when causes are inferred.
KNOWLEDGE_CHANGED = "Knowledge entries changed since last working state"
NEW_COMPONENTS = "New components introduced: "


def items(by: list[str], know: DataFrame, files: DataFrame, entities: DataFrame, errors: DataFrame) -> DataFrame:
    """(<by>, kind, item, valid_from, valid_to): the four kinds as intervals, so that any time's sets can be rebuilt.

    ``know(<by>, id, created_at, archived_at)``, ``files(<by>, file, ts)``, ``entities(<by>, name, seen_at)``, ``errors(<by>, content, indexed_at)``.
    """
    row = lambda d, kind, item, start, end: d.select(*by, F.lit(kind).alias("kind"), item.cast("string").alias("item"), start.alias("valid_from"), end.cast("timestamp").alias("valid_to"))
    none = F.lit(None)
    first = files.groupBy(*by, "file").agg(F.min("ts").alias("ts"))
    named = entities.groupBy(*by, "name").agg(F.min("seen_at").alias("seen_at"))
    failed = errors.groupBy(*by, F.substring("content", 1, 150).alias("content")).agg(F.min("indexed_at").alias("first"), F.max("indexed_at").alias("last"))
    return (row(know, "knowledge", F.col("id"), F.col("created_at"), F.col("archived_at"))
            .unionByName(row(first, "file", F.col("file"), F.col("ts"), none))
            .unionByName(row(named, "entity", F.col("name"), F.col("seen_at"), none))
            .unionByName(row(failed, "error", F.col("content"), F.col("first"), F.col("last") + F.expr("interval 24 hours"))))


def fingerprint(all_items: DataFrame, at) -> DataFrame:
    """The items that hold at a time: entries not archived, files touched and entities seen so far, errors of the last day."""
    return valid_at(all_items, at)


def diff(all_items: DataFrame, by: list[str], baseline, now) -> DataFrame:
    """(<by>, kind, change, item): what is in one of two times' sets only. An error is added if it first occurs in between."""
    holds = lambda t: (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))
    new = (F.col("valid_from") > baseline) & (F.col("valid_from") <= now)
    change = F.when(F.col("kind") == "error", F.when(new, "added")).when(holds(now) & ~holds(baseline), "added").when(holds(baseline) & ~holds(now), "removed")
    return all_items.withColumn("change", change).where("change IS NOT NULL").select(*by, "kind", "change", "item", "valid_from")


def causes(changes: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """(<by>, causes): new errors beside removed entries, and the newest entities that came up."""
    counts = changes.groupBy(*by).agg(F.count_if((F.col("kind") == "error") & (F.col("change") == "added")).alias("errors"),
                                      F.count_if((F.col("kind") == "knowledge") & (F.col("change") == "removed")).alias("gone"))
    w = Window.partitionBy(*by).orderBy(F.desc("valid_from"), "item")
    new = changes.where("kind = 'entity' AND change = 'added'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    names = new.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "item"))), lambda s: s["item"]), ", ").alias("names"))
    told = F.array_compact(F.array(F.when((F.col("errors") > 0) & (F.col("gone") > 0), KNOWLEDGE_CHANGED), F.concat(F.lit(NEW_COMPONENTS), "names")))
    return counts.join(names, by, "left").select(*by, told.alias("causes"))
