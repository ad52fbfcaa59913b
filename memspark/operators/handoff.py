"""Session hand-off: chain entry, snapshot, token estimate and continuation text, committed together.

The tables of one hand-off are written to a folder of their own; the manifest names the
folder in one file that is written last. Readers follow the manifest, so a hand-off is seen whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut
from . import maintenance as M

TABLES = ("chains", "snapshots", "texts")
MANIFEST = "name string, number bigint"


def prepare(sessions: DataFrame, chains: DataFrame, snapshots: DataFrame, tokens: DataFrame, as_of, limit: int) -> dict[str, DataFrame]:
    """The three tables of a hand-off.

    ``sessions(session_id, parent_session, reason)`` are handed off: each takes its parent's chain or starts one, unless ``chains(session_id,
    chain_id)`` has it already. ``snapshots(session_id, snapshot, created_at)`` are condensed if old, ``tokens(session_id, tokens)`` are
    summed against ``limit``. A session without snapshot or tokens is handed off with none.
    """
    sessions = cut(sessions.withColumn("summary", F.coalesce("reason", F.lit("Manual handoff"))), "sessions")
    known = sessions.join(chains.select("session_id", "chain_id"), "session_id")
    new = M.append_chain(chains, sessions)
    used = tokens.groupBy("session_id").agg(F.sum("tokens").alias("used"))
    every = known.select("session_id", "parent_session", "summary", "chain_id").unionByName(new.select("session_id", "parent_session", "summary", "chain_id"))
    every = every.join(used, "session_id", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("bigint")))
    estimate = F.floor(F.col("used") * 100 / limit + 0.5).cast("bigint")
    entries = cut(every.withColumns({"token_limit": F.lit(limit).cast("bigint"), "percentage": estimate, "created_at": as_of}), "entries")
    kept = M.restore(snapshots.join(sessions.select("session_id", "summary"), "session_id"), as_of)
    missing = sessions.join(snapshots.select("session_id"), "session_id", "left_anti").select("session_id", "summary")
    none = missing.withColumn("snapshot", F.create_map().cast("map<string,string>"))
    texts = M.continuation(kept.select("session_id", "summary", "snapshot").unionByName(none), as_of, "summary")
    return {"chains": entries, "snapshots": kept.select("session_id", "snapshot", "condensed"), "texts": texts.select("session_id", "text")}


def write(root: str, tables: dict[str, DataFrame]) -> str:
    """Writes the tables under ``root`` and commits them; returns the hand-off's name."""
    spark = next(iter(tables.values())).sparkSession
    name = uuid.uuid4().hex
    for table in TABLES:
        tables[table].write.parquet(f"{root}/{name}/{table}")
    commit(spark, root, name)
    return name


def commit(spark: SparkSession, root: str, name: str) -> None:
    """From now on readers see the tables of ``name``."""
    spark.createDataFrame([(name, len(committed(spark, root)))], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def committed(spark: SparkSession, root: str) -> list[str]:
    """Names of the hand-offs that count, in order: one each, however many sessions it holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return [r["name"] for r in spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy("number", "name").collect()]


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All committed rows of one table, with the hand-off they are of."""
    names = committed(spark, root)
    if not names:
        raise ValueError(f"no hand-off is committed under {root}")
    out = None
    for name in names:
        one = spark.read.parquet(f"{root}/{name}/{table}").withColumn("handoff", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
