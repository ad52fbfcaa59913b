"""Property-graph queries over vertex and edge frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from ..functions.text import extract_all
from ..session import cut
from .joins import either_endpoint

#: Entity type of a knowledge category, and the path pattern.
CATEGORY_ENTITY = {"pattern": "pattern", "decision": "decision", "error": "bug", "api": "service", "component": "module"}
PATH_IN_TEXT = r"(?:^|\s|['\"`(])([./]?(?:[\w-]+/)+[\w.-]+\.\w+)"


def upsert_edges(edges: DataFrame, at: str = "updated_at") -> DataFrame:
    """Last write per (src, dst, type) wins, by time then weight."""
    return edges.groupBy("src", "dst", "type").agg(F.max(F.struct(at, "weight")).alias("m")).select("src", "dst", "type", "m.weight", f"m.{at}")


def upsert_entities(rows: DataFrame, at: str = "updated_at") -> DataFrame:
    return rows.groupBy("name", "type").agg(F.max(at).alias(at), F.min(at).alias("created_at"))


def find_entities(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, <entity columns>): entities ``(id, name, type, ...)`` of exactly the name, and of the type where one is asked; ``asked(query_id, name, type)``."""
    q = asked.select("query_id", "name", F.col("type").alias("_type"))
    return entities.join(q, "name").where(F.col("_type").isNull() | (F.col("type") == F.col("_type"))).select("query_id", *entities.columns)


def update_entities(entities: DataFrame, updates: DataFrame, at) -> DataFrame:
    """Entities with what ``updates(id, ...)`` has put in and ``updated_at`` set; a null there leaves the value as it is.

    Of several updates of an id the values of the last by ``updates.at`` that has one count.
    """
    fields = [c for c in updates.columns if c not in ("id", "at")]
    last = updates.groupBy("id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"_{c}") for c in fields])
    changed = F.lit(False)
    for c in fields:
        changed = changed | F.col(f"_{c}").isNotNull()
    out = entities.join(last, "id", "left").withColumn("updated_at", F.when(F.coalesce(changed, F.lit(False)), at).otherwise(F.col("updated_at")))
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}).select(*entities.columns)


def remove_entities(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that touch a removed node."""
    g = gone.select("node")
    return edges.join(g.withColumnRenamed("node", "src"), "src", "left_anti").join(g.withColumnRenamed("node", "dst"), "dst", "left_anti")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", types=None) -> DataFrame:
    """(seed, node, hops): breadth-first from many seeds at once, the seed itself at 0 hops.

    One equi-join per hop; only the new frontier is joined, what was visited is
    anti-joined away, and each round is written out so lineage stays short.
    """
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        nxt = frontier_step(e, frontier, direction).join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut(nxt.withColumn("hops", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def frontier_step(edges: DataFrame, frontier: DataFrame, direction: str) -> DataFrame:
    """(seed, node): what one hop reaches, each once; edges are not gathered or made distinct before they meet the frontier."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    step = {"out": out, "in": out.select(F.col("other").alias("node"), F.col("node").alias("other")), "both": either_endpoint(edges).select("node", "other")}[direction]
    return frontier.select("seed", "node").join(step, "node").select("seed", F.col("other").alias("node")).distinct()


def subgraph_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """(seed, src, dst): edges met by a walk, i.e. touching a node fewer than ``depth`` hops away; each once."""
    inner = reached.where(F.col("hops") < depth).select("seed", "node")
    a = edges.join(inner.withColumnRenamed("node", "src"), "src").select("seed", "src", "dst")
    b = edges.join(inner.withColumnRenamed("node", "dst"), "dst").select("seed", "src", "dst")
    return a.unionByName(b).distinct()


def neighbour_pairs(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Strongest ``limit`` (node, other) pairs per seed node."""
    w = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    return either_endpoint(edges).join(seeds.select("node"), "node", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def from_knowledge(know: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges): each entry as an entity of its category's type, each path in its text as a documented file."""
    t = F.lit(None).cast("string")
    for c, e in CATEGORY_ENTITY.items():
        t = F.when(F.col("category") == c, e).otherwise(t)
    k = know.select(F.col("title").alias("name"), t.alias("type"), F.explode_outer(F.array_distinct(extract_all("content", PATH_IN_TEXT, 1))).alias("path")).where("type is not null")
    ents = k.select("name", "type").unionByName(k.where("path is not null").select(F.col("path").alias("name"), F.lit("file").alias("type"))).distinct()
    edges = k.where("path is not null").select(F.col("name").alias("src"), F.col("path").alias("dst"), F.lit("documents").alias("type")).distinct()
    return ents, edges
