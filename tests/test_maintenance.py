"""Feedback by path suffixes, hand-offs, entity updates, entry checks: against brute force and hand-made rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import entry_checks as EC, feedback as FB, graph as G, handoff as H, maintenance as M
from memspark.session import run_dir

T0 = dt.datetime(2024, 1, 1)


def test_first_useful_by_brute_force(spark):
    r = random.Random(4)
    path = lambda: "/".join(r.choice("abc") for _ in range(r.randint(1, 4))) + ".ts"
    row = lambda i: (i, r.randrange(3), T0 + dt.timedelta(hours=r.randrange(200)), path())
    results, edits = [row(i) for i in range(150)], [row(1000 + i) for i in range(150)]
    schema = "id bigint, session_id bigint, ts timestamp, path string"
    same = lambda a, b: a == b or a.endswith("/" + b) or b.endswith("/" + a)
    want = {}
    for i, s, t, p in results:
        found = [u for _, s2, u, p2 in edits if s2 == s and u >= t and same(p, p2)]
        if found:
            want[i] = min(found)
    got = FB.first_useful(spark.createDataFrame(results, schema), spark.createDataFrame(edits, schema)).collect()
    assert {r["id"]: r["useful_at"] for r in got} == want and len(got) == len(want)


def test_useful_entries_are_raised_up_to_the_cap(spark):
    e = spark.createDataFrame([(1, 1.0), (2, 4.8), (3, 1.0)], "id bigint, relevance_score double")
    u = spark.createDataFrame([(1, T0), (2, T0)], "id bigint, useful_at timestamp")
    assert {r["id"]: (round(r["relevance_score"], 6), r["last_useful_at"]) for r in FB.boosted(e, u).collect()} == {1: (1.1, T0), 2: (5.0, T0), 3: (1.0, None)}


@pytest.mark.parametrize("raw", ["short text", "x" * 300, "ab " * 100, " " + "y" * 250, "z" * 200 + " tail", "z" * 199 + " tail", ""])
def test_search_text_is_cut_at_the_last_space(spark, raw):
    whole = raw + " " + "c"
    at = whole.rfind(" ", 0, 201)
    want = whole if len(whole) <= 200 else whole[:at] if at > 0 else whole[:200]
    assert spark.createDataFrame([(raw, "c")], "title string, content string").select(EC.search_text("title", "content")).first()[0] == want


def hand_off(spark, ids):
    s = spark.createDataFrame([(i, None, "why") for i in ids], "session_id string, parent_session string, reason string")
    chains = spark.createDataFrame([], "session_id string, chain_id string")
    snaps = spark.createDataFrame([(ids[0], {"decisions": "- d"}, T0)], "session_id string, snapshot map<string,string>, created_at timestamp")
    used = spark.createDataFrame([(ids[0], 120), (ids[0], 30)], "session_id string, tokens bigint")
    return H.prepare(s, chains, snaps, used, F.lit(T0), 1000)


def test_a_half_written_hand_off_is_not_seen(spark):
    root = run_dir(spark, "handoff-test")
    assert H.committed(spark, root) == []
    with pytest.raises(ValueError, match="no hand-off"):
        H.read(spark, root, "texts")
    H.write(root, hand_off(spark, ["a", "b"]))
    tables = hand_off(spark, ["c"])
    for name in ("chains", "snapshots"):  # the texts and the commit are missing
        tables[name].write.parquet(f"{root}/half/{name}")
    for name in H.TABLES:
        assert "c" not in {r["session_id"] for r in H.read(spark, root, name).collect()}
    tables["texts"].write.parquet(f"{root}/half/texts")
    assert H.read(spark, root, "texts").count() == 2
    H.commit(spark, root, "half")
    assert {r["session_id"] for r in H.read(spark, root, "texts").collect()} == {"a", "b", "c"}
    entry = {r["session_id"]: (r["used"], r["percentage"], r["summary"]) for r in H.read(spark, root, "chains").collect()}
    assert entry == {"a": (150, 15, "why"), "b": (0, 0, "why"), "c": (150, 15, "why")}
    texts = {r["session_id"]: r["text"] for r in H.read(spark, root, "texts").collect()}
    assert "### Key decisions\n- d" in texts["a"] and "### Summary\nwhy" in texts["b"]


def test_entities_are_found_and_updated(spark):
    e = spark.createDataFrame([("1", "x", "person", "m", T0), ("2", "x", "module", "m", T0), ("3", "y", "person", None, T0)], "id string, name string, type string, metadata string, updated_at timestamp")
    q = spark.createDataFrame([(1, "x", None), (2, "x", "person"), (3, "X", None)], "query_id int, name string, type string")
    assert sorted((r["query_id"], r["id"]) for r in G.find_entities(e, q).collect()) == [(1, "1"), (1, "2"), (2, "1")]
    up = spark.createDataFrame([("1", 1, "new", None), ("1", 2, None, "z"), ("3", 1, None, None), ("9", 1, "lost", None)], "id string, at int, name string, metadata string")
    later = T0 + dt.timedelta(days=1)
    got = {r["id"]: (r["name"], r["metadata"], r["updated_at"]) for r in G.update_entities(e, up, F.lit(later)).collect()}
    assert got == {"1": ("new", "z", later), "2": ("x", "m", T0), "3": ("y", None, T0)}


def test_private_rows_of_ended_sessions_go(spark):
    rows = spark.createDataFrame([("a", "private", 1), ("a", "public", 2), ("b", "private", 3), (None, "private", 4)], "session_id string, privacy_level string, id int")
    kept = M.cleanup_sessions(rows, spark.createDataFrame([("a",), ("a",), (None,)], "session_id string"))
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 4]


def test_buckets_of_a_dense_table_are_narrow(spark):
    from memspark.operators import sequences as SQ
    from memspark.operators.ordered import bucket_width

    rows = spark.range(5000).select("id", (F.lit(T0) + F.make_dt_interval(secs=F.col("id") / 10)).alias("ts"))
    assert bucket_width(rows, "ts") == 86400 and bucket_width(rows, "ts", 100) == 10 and bucket_width(rows.where("false"), "ts") == 86400
    anchors = rows.where("id % 500 = 7")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(SQ.anchor_timeline(rows, anchors, 3, 2, 10)) == key(SQ.anchor_timeline(rows, anchors, 3, 2))
