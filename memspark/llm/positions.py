"""Gapless positions within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .batches import cut

#: Rows that a task sorts, where the table is large.
TASK_ROWS = 1_000_000
#: Bits below the partition's number in Spark's increasing ids.
PART_BITS = 33


def numbered(df: DataFrame, group: str, order: list[str], label: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` with ``position`` (from 0, along ``order``, nulls first) and ``of`` (rows of the group).

    Rows are range-sorted by group, order and, for rows equal in both, a number that they
    get when they are written, so a group or a value with a third of all rows is
    split over tasks. Sorted rows are written; a position is the row's place in its
    task's run of the group plus the sizes of the group's earlier runs. Runs are as many
    as tasks and groups together. ``group`` must hold no nulls; columns named ``tie``, ``at``,
    ``position`` and ``of`` are taken.
    """
    tied = cut(df.withColumn("tie", F.monotonically_increasing_id()), f"{label}-rows")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tied.count() // task_rows)
    keys = [group, *order, "tie"]
    placed = cut(tied.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("tie"), f"{label}-sorted")
    part = F.shiftright("at", PART_BITS)
    runs = placed.groupBy(group, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(runs.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(of_group).alias("of")), f"{label}-runs")
    return placed.withColumn("part", part).join(starts, [group, "part"]).withColumn("position", F.col("at") + F.col("shift")).drop("at", "part", "shift")
