"""A stream's answer doesn't depend on how its table is cut into files, nor on how many a micro-batch takes."""

import pytest
from pyspark.sql import functions as F

from memspark.plans import all_queries
from memspark.streaming import jobs as JB
from memspark.views import events_from

NAMES = ["m3_hourly_stream", "m5_rate_limit_stream", "m7_feedback_stream"]


@pytest.fixture(scope="module")
def cuts(spark, sf, tmp_path_factory):
    """The same events as one file, as eight ranges of time, and as eight files of mixed times."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    root = tmp_path_factory.mktemp("events")
    e.coalesce(1).write.parquet(f"{root}/one/events.parquet")
    e.repartitionByRange(8, "ts").write.parquet(f"{root}/ranges/events.parquet")
    e.repartition(8, "event_id").write.parquet(f"{root}/mixed/events.parquet")
    return {c: f"{root}/{c}" for c in ("one", "ranges", "mixed")}


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_from_every_cut(name, spark, sf, cuts):
    whole = sorted(map(str, all_queries()[name](spark, sf).collect()))
    assert whole
    for folder in (cuts["mixed"],):
        assert sorted(map(str, all_queries()[name](spark, folder).collect())) == whole


RULES = {
    "dedup": lambda e, **a: JB.dedup_exact(e.select("id", "ts", F.md5("event_type").alias("hash")), 3600.0, **a),
    "fixes": lambda e, **a: JB.error_fixes(e, **a),
    "rate": lambda e, **a: JB.rate_classes(e, 36000.0, **a),
    "budget": lambda e, **a: JB.running_budget(e.withColumn("tokens_in", F.col("k").cast("bigint")), 500, **a),
    "liveness": lambda e, **a: JB.liveness_stream(e, 43200.0, **a),
    "cooldown": lambda e, **a: JB.cooldown(e.select("session_id", "id", "ts", F.col("event_type").alias("k")), 2, 86400.0, **a),
}


def drained(spark, folder, rule, max_files, **args):
    out, late = RULES[rule](events_from(JB.read_events(spark, folder, max_files)), **args).drain("test")
    return sorted(map(str, out.collect())), late.count(), out


@pytest.mark.parametrize("rule", RULES)
def test_state_crosses_micro_batches(rule, spark, cuts):
    """Eight micro-batches of one file each give what one micro-batch gives, in and out of order, if the delay covers the disorder."""
    whole, late, _ = drained(spark, cuts["one"], rule, None)
    assert whole and late == 0
    got, late, _ = drained(spark, cuts["mixed"], rule, 1, delay="40 days")
    assert got == whole and late == 0
    if rule == "rate":
        got, late, _ = drained(spark, cuts["mixed"], rule, 8)
        assert got == whole and late == 0


def test_late_rows_are_kept_aside(spark, cuts):
    """Files of mixed times, one at a time, with a short delay: every row is classified or in the side table."""
    total = spark.read.parquet(f"{cuts['mixed']}/events.parquet").count()
    out, late = RULES["rate"](events_from(JB.read_events(spark, cuts["mixed"], 1)), delay="1 hour").drain("late")
    n, lost = out.count(), late.count()
    assert lost > 0 and n + lost == total
    assert out.select("id").intersect(late.select(F.col("late_id").alias("id"))).count() == 0


def test_a_key_has_one_timer_and_gives_one_frame():
    """Five buckets of one key: one timer, and one frame of outputs when all of them are over."""
    import pandas as pd

    from memspark.streaming.in_order import Walk

    class State:
        def __init__(self):
            self.value, self.held = None, {}

        get = lambda self: self.value
        exists = lambda self: self.value is not None
        keys = lambda self: iter(list(self.held))
        containsKey = lambda self, k: k in self.held
        getValue = lambda self, k: self.held[k]
        updateValue = lambda self, k, v: self.held.__setitem__(k, v)
        removeKey = lambda self, k: self.held.pop(k)

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers = set()

        getMapState = getValueState = lambda self, *a: State()
        registerTimer = lambda self, at: self.timers.add(at)

    class Now:
        getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: 10 ** 9

    handle, walk = Handle(), Walk(["k"], {}, ["id"], lambda state, t, id_: ((t,), [(id_,)]), "last double", 60, None, None)
    walk.init(handle)
    frame = pd.DataFrame({"k": 1, "id": [5, 4, 3, 2, 1], "us": [x * 60_000_000 for x in (5, 4, 3, 2, 1)]})
    assert list(walk.handleInputRows((1,), iter([frame]), None)) == [] and handle.timers == {120_000}
    out = list(walk.handleExpiredTimer((1,), Now(), Now()))
    assert len(out) == 1 and out[0]["id"].tolist() == [1, 2, 3, 4, 5] and not walk.pending.held
    late = list(walk.handleInputRows((1,), iter([frame[:1]]), None))
    assert [f["late_id"].tolist() for f in late] == [[5]] and handle.timers == {120_000}
