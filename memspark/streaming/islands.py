"""Sequential rules over a key's rows, split where the rule forgets.

Rules such as "the window restarts at the first call after it expires" cannot
be written as one window function, but after a quiet gap of the rule's span
nothing earlier matters. Rows are cut into islands at those gaps (a bucketed
lag), islands are spread over tasks, and each task walks its sorted rows once
with constant memory. A busy key is split at every quiet gap it has.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import neighbours, running


def islands(df: DataFrame, keys: list[str], gap_seconds: float, at: str = "ts", id_: str = "id", bucket_seconds: int = 86400) -> DataFrame:
    """Add ``island``: rows of a key less than ``gap_seconds`` apart share a number."""
    bucket = F.floor(F.unix_timestamp(at) / bucket_seconds)
    n = neighbours(df, keys, [at, id_], bucket, before={"_prev": at})
    far = F.unix_micros(at) - F.unix_micros("_prev") >= F.lit(int(gap_seconds * 1000000)).cast("bigint")
    n = n.withColumn("_new", F.when(F.col("_prev").isNull() | far, 1).otherwise(0).cast("bigint")).drop("_prev")
    return running(n, keys, [at, id_], bucket, sums={"island": "_new"}).drop("_new")


def walk(df: DataFrame, keys: list[str], gap_seconds: float, rule: Callable, out: str, out_type: str, extra=(), at: str = "ts", id_: str = "id") -> DataFrame:
    """(keys, id, out): ``rule(state, seconds, *extra) -> (state, value)`` applied along each island, state None at its start."""
    d = islands(df.select(*keys, id_, at, *extra), keys, gap_seconds, at, id_)
    d = d.withColumn("_us", F.unix_micros(at)).drop(at)
    part = [*keys, "island"]
    d = d.repartition(*part).sortWithinPartitions(*part, "_us", id_)

    def scan(batches):
        current, state = None, None
        for pdf in batches:
            got = []
            for key, us, *more in zip(zip(*[pdf[c] for c in part]), pdf["_us"], *[pdf[c] for c in extra]):
                if key != current:
                    current, state = key, None
                state, value = rule(state, us / 1e6, *more)
                got.append(value)
            yield pd.DataFrame({**{c: pdf[c] for c in keys}, id_: pdf[id_], out: got})

    types = dict(df.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in [*keys, id_]] + [f"{out} {out_type}"])
    return d.mapInPandas(scan, schema)


def dedup_rule(window: float):
    """True when kept: repeats within ``window`` seconds of the last kept row are dropped."""
    def rule(last, t):
        return (last, False) if last is not None and t - last < window else (t, True)
    return rule


def rate_rule(window: float = 60.0, full: int = 3, limited: int = 8):
    """full / limited / blocked by call number in a window that restarts at the first call after it expired."""
    def rule(state, t):
        start, n = state if state is not None and t - state[0] <= window else (t, 0)
        n += 1
        return (start, n), "full" if n <= full else "limited" if n <= limited else "blocked"
    return rule


def cooldown_rule(per_minute: int, topic_seconds: float):
    """True when allowed: at most ``per_minute`` in 60 s and once per ``topic_seconds`` for a topic."""
    def rule(state, t, topic):
        recent, topics = state if state is not None else ((), {})
        recent = tuple(x for x in recent if t - x < 60)
        topics = {k: x for k, x in topics.items() if t - x < topic_seconds}
        if len(recent) >= per_minute or topic in topics:
            return (recent, topics), False
        return (recent + (t,), {**topics, topic: t}), True
    return rule
