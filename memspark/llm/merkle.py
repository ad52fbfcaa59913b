"""Merkle manifest of a dataset by slot pivots.

Rows are the leaves of one tree per group, and the groups' subroots the leaves of the tree above.
Nodes have gapless positions within their group; ``fanout`` consecutive ones have one
parent. A level is one aggregation: conditional aggregates spread each parent's children into the
columns ``slot_0 .. slot_{fanout-1}``. Concatenating the columns hashes the parent; leaving out a child's
own column gives its siblings. Going up, a level has a ``fanout``-th of the rows of the one below.
Going down, the paths of a level's parents meet the level's slots and are handed on to
the children, so no join has more rows than the level has parents.

Paths of few parents are broadcast (their bytes are known from the positions: ``BROADCAST_BYTES``);
the rest is shuffled by (group, parent), of which every value has one row a side.

Defined cases: a null field is ``-``, an empty one ``0:``; a null group is a group of its own, before
the others; null ids come first; rows with one id are ordered by their leaf, equal rows are leaves of their own, in
any order, as it makes no difference; an empty table gives empty results; columns that aren't fields are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from .batches import cut
from .positions import numbered
from .shards import CRC_TABLE_SQL, crc32_sql

FANOUT = 3
BROADCAST_BYTES = 8 << 20
STEP = "struct<left:string,right:string>"
PATH = f"array<{STEP}>"


def digest(parts: list[Column]) -> Column:
    """SHA-256, in lower-case hex, of the parts that are there, joined."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(columns: list[Column]) -> Column:
    """Every field with its length in bytes, so that no two rows give the same bytes."""
    texts = [c.cast("string") for c in columns]
    return digest([F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def group_key(column: Column) -> Column:
    """A group as a string without null; it sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


class Tree:
    """The levels of the trees over ``nodes(g, position, of, hash, <carried columns>)``, one tree for each ``g``."""

    def __init__(self, nodes: DataFrame, carried: list[str], fanout: int, label: str):
        self.nodes, self.carried, self.fanout = nodes, carried, fanout
        groups = nodes.groupBy("g").agg(F.max("of").alias("of"))
        high = groups.agg(F.max("of")).first()[0] or 0
        depth = 0
        while fanout ** depth < high:
            depth += 1
        self.depth = depth
        # parents on each level, for the size of what is broadcast
        counts = groups.agg(*[F.sum(F.ceil(F.col("of") / fanout ** k)).alias(f"n{k}") for k in range(depth + 1)]).first()
        self.counts = [n or 0 for n in counts]
        self.levels: list[DataFrame] = []
        below, names = nodes, ["hash", *carried]
        for k in range(depth):
            self.levels.append(cut(self._pivot(below.where("of > 1"), names), f"{label}-{k}"))
            below, names = self._parents(self.levels[-1]), ["hash"]

    def _pivot(self, nodes: DataFrame, names: list[str]) -> DataFrame:
        child = F.struct(*names)
        slot = F.col("position") % self.fanout
        spread = [F.max(F.when(slot == s, child)).alias(f"slot_{s}") for s in range(self.fanout)]
        return nodes.groupBy("g", F.floor(F.col("position") / self.fanout).alias("parent")).agg(F.max("of").alias("of"), *spread)

    def _hashes(self) -> list[Column]:
        return [F.col(f"slot_{s}.hash") for s in range(self.fanout)]

    def _parents(self, level: DataFrame) -> DataFrame:
        return level.select("g", F.col("parent").alias("position"), F.ceil(F.col("of") / self.fanout).alias("of"), digest(self._hashes()).alias("hash"))

    def tops(self) -> DataFrame:
        """(g, depth, hash): the root of every tree and the level it is on."""
        out = self.nodes.where("of = 1").select("g", F.lit(0).alias("depth"), "hash")
        for k, level in enumerate(self.levels):
            out = out.unionByName(self._parents(level).where("of = 1").select("g", F.lit(k + 1).alias("depth"), "hash"))
        return out

    def paths(self, tops: DataFrame, given: list[str], top_bytes: int = 200) -> DataFrame:
        """Siblings of every node, from the bottom up: (g, hash, <carried>, <given>, path) from ``tops(g, depth, path, <given>)``.

        ``path`` of a top is what goes on above it; its columns ``given`` are handed down as they are.
        """
        def starting(depth: int) -> DataFrame:
            return tops.where(F.col("depth") == depth).select("g", F.lit(0).cast("bigint").alias("parent"), "path", *given)

        above = starting(self.depth)
        for k in reversed(range(self.depth)):
            row_bytes = top_bytes + (self.depth - k) * (self.fanout - 1) * 80
            if self.counts[k + 1] * row_bytes <= BROADCAST_BYTES:
                above = F.broadcast(above)
            met = self.levels[k].join(above, ["g", "parent"])
            hashes = self._hashes()
            children = F.array(*[F.when(F.col(f"slot_{s}").isNotNull(), F.struct(
                (F.col("parent") * self.fanout + s).alias("position"), F.concat_ws("", *hashes[:s]).alias("left"), F.concat_ws("", *hashes[s + 1:]).alias("right"),
                F.col(f"slot_{s}").alias("node"))) for s in range(self.fanout)])
            each = met.select("g", "path", *given, F.explode(F.filter(children, lambda c: c.isNotNull())).alias("c"))
            longer = F.concat(F.array(F.struct("c.left", "c.right")).cast(PATH), "path").alias("path")
            if k:
                above = each.select("g", F.col("c.position").alias("parent"), longer, *given).unionByName(starting(k))
            else:
                above = each.select("g", "c.node.*", longer, *given)
        lone = self.nodes.where("of = 1").select("g", "hash", *self.carried).join(starting(0).drop("parent"), "g")
        return above.unionByName(lone.select(above.columns)) if self.depth else lone


def fold(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_hash, lambda h, step: digest([step["left"], h, step["right"]]))


def siblings(path: Column) -> Column:
    """All siblings of a path, joined in order."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(rows: DataFrame, id_col: str, group_col: str, fields: list[str], fanout: int = FANOUT, changed: dict[str, Column] | None = None, label: str = "merkle") -> DataFrame:
    """(id, leaf, found, subroot, root, path) of every row; ``found`` is its leaf with the columns ``changed`` put in.

    ``path`` holds the siblings level by level from the leaf to the root, as (left, right) strings.
    """
    changed = changed or {}
    named = {f: F.col(f"`{f}`") for f in fields}
    leaves = rows.select(group_key(F.col(f"`{group_col}`")).alias("g"), F.col(f"`{id_col}`").alias("id"), leaf(list(named.values())).alias("hash"),
                         leaf([changed.get(f, c) for f, c in named.items()]).alias("found"))
    below = Tree(numbered(leaves, "g", ["id", "hash"], f"{label}-leaves"), ["id", "found"], fanout, f"{label}-rows")
    tops = cut(below.tops(), f"{label}-subroots")
    subroots = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("group"), "depth", "hash"), "g", ["group"], f"{label}-groups")
    top = Tree(subroots, ["group", "depth"], fanout, f"{label}-top")
    root = top.tops().select("g", "depth", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    to_root = top.paths(root, ["root"])
    starts = cut(to_root.select(F.col("group").alias("g"), "depth", F.col("hash").alias("subroot"), "root", "path"), f"{label}-starts")
    found = below.paths(starts, ["subroot", "root"], 400 + top.depth * (fanout - 1) * 80)
    return found.select("id", F.col("hash").alias("leaf"), "found", "subroot", "root", "path")


def check(proofs: DataFrame, id_col: str) -> DataFrame:
    """Digest of every row's siblings, the root recomputed from the leaf as found, and whether it is the root."""
    folded = proofs.select(F.col("id").alias(id_col), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("found"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


DOCUMENT_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def without_newlines(id_col: str, text_col: str) -> Column:
    """The tampering that is tried: newlines deleted where 2 divides the checksum of the id in decimal."""
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, F.translate(F.col(text_col), "\n", "")).otherwise(F.col(text_col))


def oracle(fanout: int = FANOUT) -> str:
    """SQL for the manifest of documents whose ids are neither null nor repeated."""
    fields = " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in DOCUMENT_FIELDS)
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS entries),
d AS MATERIALIZED (SELECT coalesce('1' || source, '0') AS g, doc_id, sha256({fields}) AS h, {crc32_sql('encode(CAST(doc_id AS VARCHAR))', 'entries')} % 2 = 0 AS tampered, source, lang, n_chars, text FROM documents, t),
x AS MATERIALIZED (SELECT doc_id, CASE WHEN tampered THEN sha256({fields.replace('CAST(text AS VARCHAR)', "replace(text, chr(10), '')")}) ELSE h END AS found FROM d),
low AS (
  SELECT g, 0 AS l, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, h FROM d
  UNION ALL
  SELECT g, l + 1, i // {fanout}, (max(n) + {fanout - 1}) // {fanout}, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, l, i // {fanout}),
lows AS MATERIALIZED (SELECT * FROM low),
high AS (
  SELECT 0 AS l, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM lows WHERE n = 1
  UNION ALL
  SELECT l + 1, i // {fanout}, (max(n) + {fanout - 1}) // {fanout}, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // {fanout}),
highs AS MATERIALIZED (SELECT * FROM high),
top AS MATERIALIZED (SELECT g, l AS depth, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM lows WHERE n = 1),
spot AS MATERIALIZED (SELECT d.doc_id, d.g, d.h, row_number() OVER (PARTITION BY d.g ORDER BY d.doc_id) - 1 AS i, depth, subroot, place FROM d JOIN top USING (g)),
ways AS (
  SELECT doc_id, l, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < a.i // CAST(pow({fanout}, l) AS BIGINT)) AS lft, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > a.i // CAST(pow({fanout}, l) AS BIGINT)) AS rgt
  FROM spot a JOIN lows s ON s.g = a.g AND s.n > 1 AND s.i // {fanout} = a.i // CAST(pow({fanout}, l + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT doc_id, depth + l, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < place // CAST(pow({fanout}, l) AS BIGINT)), string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > place // CAST(pow({fanout}, l) AS BIGINT))
  FROM spot a JOIN highs s ON s.n > 1 AND s.i // {fanout} = place // CAST(pow({fanout}, l + 1) AS BIGINT) GROUP BY ALL),
path AS MATERIALIZED (SELECT doc_id, l, coalesce(lft, '') AS lft, coalesce(rgt, '') AS rgt FROM ways),
up AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS l, found AS h FROM x
  UNION ALL
  SELECT doc_id, up.l + 1, sha256(lft || h || rgt) FROM up JOIN path USING (doc_id) WHERE path.l = up.l),
folded AS (SELECT doc_id, arg_max(h, l) AS folded_root FROM up GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY l)) AS proof_sha256 FROM path GROUP BY doc_id)
SELECT doc_id, spot.h AS leaf, subroot, highs.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = highs.h AS verified
FROM spot JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id), highs WHERE highs.n = 1"""
