"""Sequential rules over streams: rows of a key are applied in time order, however the input is cut.

Arriving rows wait in state, in buckets of event time. When the watermark passes the end of
a bucket, a timer fires: the bucket's rows are sorted and the rule walks them, then the bucket
goes. A task holds one bucket of one key at a time, not a key's history, and what the rule gave for up to ``GIVEN`` rows.
A key has one timer, for the first bucket that waits; each call of the state costs more than a row. So the answer is
the same for any number of files or rows in a micro-batch, as long as no row is later than
``delay``; a row of a bucket that was walked already goes into the side table with its id.

A rule is ``rule(state, seconds, *values) -> (state, outputs)``: state is a tuple or None, outputs a list of
tuples. ``idle(state)`` gives the outputs for a key that was silent for ``span`` seconds of event time; its state is
forgotten then. Without a span the state stays: a few numbers for each key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..session import run_dir

#: The event time of the row that closes a drained stream.
FAR = "9999-01-01 00:00:00"
#: Before every bucket.
NEVER = -1 << 62
#: Outputs of a key that are given back as one frame, about.
GIVEN = 10_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Walk(StatefulProcessor):
    """Keeps the rows of a key until their bucket is over, then applies the rule to them in order."""

    def __init__(self, keys: list[str], values: dict[str, str], outs: list[str], rule: Callable, state: str, bucket: int, span: float | None, idle: Callable | None):
        self.keys, self.values, self.outs = keys, values, outs
        self.rule, self.state, self.bucket, self.span, self.idle = rule, state, bucket, span, idle

    def init(self, handle) -> None:
        self.handle = handle
        fields = ", ".join([f"{c} array<{t}>" for c, t in {"us": "bigint", "id": "bigint", **self.values}.items()])
        self.pending = handle.getMapState("pending", "bucket bigint", fields)
        self.kept = handle.getValueState("kept", self.state)
        # the last bucket that was walked, the time of the last row the rule has seen, and the first bucket that a timer waits for
        self.seen = handle.getValueState("seen", "bucket bigint, us bigint, next bigint")

    def handleInputRows(self, key, rows, timerValues):
        seen = self.seen.get()
        done, last, next_ = seen or (NEVER, None, None)
        new: dict[int, list] = {}
        late = []
        for frame in rows:
            of = (frame["us"] // (self.bucket * 1000000)).to_numpy(np.int64)
            late += frame["id"].to_numpy()[of <= done].tolist()
            order = np.argsort(of, kind="stable")
            order = order[of[order] > done]
            columns, of = [frame[c].to_numpy() for c in ("us", "id", *self.values)], of[order]
            begins = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
            for first, end in zip(begins, np.append(begins[1:], len(of))):
                new.setdefault(int(of[first]), []).append([c[order[first:end]].tolist() for c in columns])
        for bucket, parts in new.items():
            if seen and self.pending.containsKey((bucket,)):
                parts.insert(0, [list(c) for c in self.pending.getValue((bucket,))])
            self.pending.updateValue((bucket,), tuple(sum(c, []) for c in zip(*parts)))
        if new and (next_ is None or min(new) < next_):
            self.handle.registerTimer(self._end(min(new)))
            self.seen.update((done, last, min(new)))
        if late:
            yield self._frame(key, [], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        kept = self.kept.get()
        state = None if kept is None else tuple(kept)
        done, last, next_ = self.seen.get()
        waiting = sorted(b for (b,) in self.pending.keys()) if next_ is not None and self._end(next_) <= now else []
        over = [b for b in waiting if self._end(b) <= now]
        found: list[tuple] = []
        for bucket in over:
            columns = self.pending.getValue((bucket,))
            for us, id_, *values in sorted(zip(*columns), key=lambda row: row[:2]):
                state, outs = self.rule(state, us / 1e6, id_, *values)
                found += outs
                last = us
            self.pending.removeKey((bucket,))
            if len(found) >= GIVEN:
                yield self._frame(key, found, [])
                found = []
        if waiting:
            done, next_ = over[-1] if over else done, next((b for b in waiting if self._end(b) > now), None)
            if next_ is not None:
                self.handle.registerTimer(self._end(next_))
            self.seen.update((done, last, next_))
        if self.span is not None and state is not None:
            silent = self._end((last + int(self.span * 1e6)) // (self.bucket * 1000000))  # then all rows that could break the silence were walked
            if silent <= now:
                found += self.idle(state) if self.idle else []
                state = None
            elif over:
                self.handle.registerTimer(silent)
        if found:
            yield self._frame(key, found, [])
        if state is not None:
            self.kept.update(state)
        elif kept is not None:
            self.kept.clear()

    def close(self) -> None:
        pass

    def _end(self, bucket: int) -> int:
        """The millisecond a bucket ends at."""
        return (bucket + 1) * self.bucket * 1000

    def _frame(self, key, found: list[tuple], late: list[int]) -> pd.DataFrame:
        rows = [(*key, *f, None) for f in found] + [(*key, *[None] * len(self.outs), i) for i in late]
        out = pd.DataFrame(rows, columns=[*self.keys, *self.outs, "late_id"], dtype=object)
        return out


@dataclass
class InOrder:
    """A stream of the rule's outputs; rows that came too late have ``late_id`` and no output."""

    rows: DataFrame
    keys: tuple[str, ...]
    closing: str
    schema: StructType

    def drain(self, label: str, timeout: int = 900, at_once: bool = False) -> tuple[DataFrame, DataFrame]:
        """Process everything there is, then close the stream: (outputs, late rows as (keys, late_id)).

        ``at_once`` is for a source that gives all its input in one micro-batch: the closing row comes with it, instead of in a second run.
        """
        spark = self.rows.sparkSession
        out, mark = run_dir(spark, label), run_dir(spark, f"{label}-checkpoint")
        for step in ("close",) if at_once else ("input", "close"):
            if step == "close":  # one row that is later than all others lets every bucket end
                last = spark.createDataFrame([], self.schema)
                nulls = [F.to_timestamp(F.lit(FAR)).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in last.schema]
                spark.range(1).select(*nulls).coalesce(1).write.mode("append").parquet(self.closing)
            q = self.rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
            if not q.awaitTermination(timeout):
                q.stop()
                raise TimeoutError(label)
        table = spark.read.schema(self.rows.schema).parquet(out)
        return table.where("late_id IS NULL").drop("late_id"), table.where("late_id IS NOT NULL").select(*self.keys, "late_id")


def in_order(events: DataFrame, keys: list[str], values: list[str], rule: Callable, out: str, state: str, delay: str = "1 hour", bucket: int = 86400, span: float | None = None, idle: Callable | None = None) -> InOrder:
    """The rule over a stream ``events(<keys>, id, ts, <values>)`` by key; ``out`` and ``state`` are schemas as text."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    rows = events.select(*keys, "id", "ts", *values)
    closing = run_dir(spark, "closing")
    spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(closing)
    close = spark.readStream.schema(rows.schema).parquet(closing)
    # the condition on the time keeps the closing row until the watermark has seen it
    marked = rows.unionByName(close).withWatermark("ts", delay).where(F.col("ts") < F.to_timestamp(F.lit(FAR)))
    # without the marked column the operator drops no late row itself; timers still follow the watermark
    given = marked.select(*keys, "id", F.unix_micros("ts").alias("us"), *values)
    types = dict(rows.dtypes)
    names = [c.strip().split(" ")[0] for c in out.split(",")] if out else []
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [out, "late_id bigint"])
    walk = Walk(list(keys), {v: types[v] for v in values}, names, rule, state, bucket, span, idle)
    found = given.groupBy(*keys).transformWithStateInPandas(statefulProcessor=walk, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return InOrder(found, tuple(keys), closing, rows.schema)
