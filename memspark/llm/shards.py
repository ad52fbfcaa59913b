"""Sharding by jump consistent hashing: a stable key and the number of shards decide, no table of the ring is kept.

A row's key is the first eight bytes of the MD5 of its id in decimal. The jump
function follows the key's own pseudo-random sequence of the shard counts at which the row moves;
with one more shard a row either stays or goes into the new one, so a share of 1/(n+1) moves.
Ids decide alone: equal texts under different ids may lie in different shards.

Slots number the rows of a shard from 0 in the order of their ids (repeated ids: by size and checksum).
A shard is never one task: rows are range-sorted by shard and id over as many tasks as the
table asks for (``positions.numbered``).

Defined cases: a null id has the key of an empty text, so all null ids share a shard, at its first
slots; a null or empty text has no bytes, size ``OVERHEAD`` and checksum 0; repeated rows get slots of their
own; an empty table gives an empty result; other columns are ignored, or written with the shards
(but for those with a name of the result, which are replaced).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .positions import numbered

#: Bytes that a row takes besides its text.
OVERHEAD = 8
LAW = "key"
#: The constants of the published function: its multiplier and the bits of a draw.
MULTIPLIER = 2862933555777941757
DRAW_BITS = 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    state = keys.astype(np.uint64)
    out = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        state = state * np.uint64(MULTIPLIER) + np.uint64(1)  # modulo 2^64
        draw = (state >> np.uint64(64 - DRAW_BITS)).astype(np.float64) + 1.0
        moved = ((out[live] + 1) * (float(1 << DRAW_BITS) / draw)).astype(np.int64)
        go = moved < shards
        live, state = live[go], state[go]
        out[live] = moved[go]
    return out


def key_of(id_col: str) -> Column:
    """The stable key of a row as eight bytes."""
    return F.unhex(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 16))


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(np.frombuffer(b"".join(keys), ">u8"), shards), dtype="int32")

    return place(key)


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Each row's shard among ``shards`` and among one more, its size and checksum; with ``carry`` its other columns too."""
    data = F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b""))
    made = {"size": (F.octet_length(data) + OVERHEAD).cast("bigint"), "text_crc32": F.crc32(data), "law": F.lit(LAW)}
    taken = {"key", "shard", "grown_shard", "slot", *made}
    others = [F.col(f"`{c}`") for c in docs.columns if carry and c != id_col and c not in taken]
    keyed = docs.select(F.col(f"`{id_col}`").alias(id_col), *others, *[c.alias(n) for n, c in made.items()]).withColumn("key", key_of(f"`{id_col}`"))
    return keyed.withColumns({"shard": shard_of(F.col("key"), shards), "grown_shard": shard_of(F.col("key"), shards + 1)}).drop("key")


def place(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    rows = numbered(assign(docs, shards, id_col, text_col), "shard", [id_col, "size", "text_crc32"], "shards")
    return rows.select(id_col, "size", "text_crc32", "law", "shard", F.col("position").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, root: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows under ``root/shard=k``; a heavy shard is many files, a file holds ids of one range."""
    rows = assign(docs, shards, id_col, text_col, carry=True).drop("law", "grown_shard")
    # part files by range of (shard, id); repeated ids are told apart by their text's checksum
    rows.repartitionByRange("shard", id_col, "text_crc32").sortWithinPartitions("shard", id_col, "text_crc32").write.partitionBy("shard").parquet(root)


def moves(docs: DataFrame, shards: int, more: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(id, shard, grown_shard) of the rows that change when ``more`` shards are appended; all go into the new ones."""
    keyed = docs.select(F.col(f"`{id_col}`").alias(id_col)).withColumn("key", key_of(f"`{id_col}`"))
    placed = keyed.select(id_col, shard_of(F.col("key"), shards).alias("shard"), shard_of(F.col("key"), shards + more).alias("grown_shard"))
    return placed.where("shard <> grown_shard")


#: DuckDB SQL: the 256 entries of the CRC-32 table by their rule, and the checksum of a list of byte values.
CRC_TABLE_SQL = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"


def crc32_sql(blob: str, table: str) -> str:
    numbers = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def jump_sql(name: str, keys: str, shards: int) -> str:
    """Common tables for DuckDB that give ``name(id, shard)`` for ``keys(id, k)``; a step is one move of the row."""
    return f"""
{name}_steps AS (
  SELECT id, k, CAST(0 AS BIGINT) AS j FROM {keys}
  UNION ALL
  SELECT id, n, CAST(floor(CAST(j + 1 AS DOUBLE) * (CAST(2147483648 AS DOUBLE) / CAST((n >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT id, j, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS n FROM {name}_steps WHERE j < {shards})),
{name} AS (SELECT id, CAST(max(j) AS INTEGER) AS shard FROM {name}_steps WHERE j < {shards} GROUP BY id)"""


def oracle(shards: int) -> str:
    """SQL for :func:`place` over documents with ids that are neither null nor repeated."""
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS entries),
d AS MATERIALIZED (SELECT doc_id AS id, encode(coalesce(text, '')) AS data, CAST(CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 16)) AS UBIGINT) AS HUGEINT) AS k FROM documents),
{jump_sql('now', 'd', shards)},
{jump_sql('grown', 'd', shards + 1)}
SELECT id AS doc_id, CAST(octet_length(data) + {OVERHEAD} AS BIGINT) AS size, CAST({crc32_sql('data', 'entries')} AS BIGINT) AS text_crc32, '{LAW}' AS law,
       now.shard AS shard, row_number() OVER (PARTITION BY now.shard ORDER BY id) - 1 AS slot, grown.shard AS grown_shard
FROM d JOIN now USING (id) JOIN grown USING (id), t"""
