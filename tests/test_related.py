"""Related context of many actions: lists by file and by query before they meet the actions."""

import datetime as dt
import math

from pyspark.sql import functions as F

from memspark.operators import index as I, search as S

T0 = dt.datetime(2024, 1, 1)


def test_actions_are_read_once_and_lists_equal_brute_force(spark, tmp_path):
    """Each leg dealt out all actions again, with every line of their files; an action may have two files, a file more rows than are shown."""
    files = ["a.ts", "b.ts", "c.ts"]
    actions = [(f"x{i % 5}", ["alpha beta", "beta", "gamma zz", None][i % 4], files[i % 3]) for i in range(14)] + [("y", "alpha", None)]
    spark.createDataFrame(actions, "action_id string, query string, path string").write.parquet(f"{tmp_path}/actions")
    a = spark.read.parquet(f"{tmp_path}/actions")
    obs = [(i, "error", f"line {i}", T0 - dt.timedelta(days=3 * i), files[i % 3], 0.5, []) for i in range(15)]
    o = spark.createDataFrame(obs, "id bigint, type string, content string, indexed_at timestamp, file_path string, importance double, entities array<string>")
    know = [(i, "pattern", ["alpha", "beta", "gamma"][i % 3], "alpha" if i == 5 else "", i % 4, T0, "explicit", f"p{i}") for i in range(24)]
    k = spark.createDataFrame(know, "id bigint, category string, title string, content string, access_count bigint, created_at timestamp, source_type string, project string")
    e = spark.createDataFrame([(f, f"m{i}", "uses") for f in files[:2] for i in range(7)], "src string, dst string, type string")
    ix = I.tokenised(k.selectExpr("id", "concat_ws(' ', title, content) AS t"), "id", "t")
    df = S.related_context(a, o, k, ix, e, k, ix, F.lit(T0), 0.3, per_action=99)
    got = sorted((r["action_id"], r["leg"], r["line"], round(r["score"], 9)) for r in df.collect())
    want = []
    for action in sorted({x[0] for x in actions}):
        mine = [x for x in actions if x[0] == action]
        held = sorted((r for x in mine for r in obs if r[4] == x[2]), key=lambda r: -r[3].timestamp())[:3]
        strong = [("bug-history", r[2], 0.9 * 0.5 ** ((T0 - r[3]).days / 7)) for r in held]
        hits = lambda q: [r for r in know if q and set(q.split()) & {r[2], r[3]}]
        for x in mine:
            strong += [("pattern", f"pattern: {r[2]}", 0.8 * (0.9 + 0.01 * math.log2(r[4] + 2))) for r in sorted(hits(x[1]), key=lambda r: (-r[4], r[0]))[:3]]
        more = [("graph", f"uses: {n}", 0.5) for n in sorted(r for x in mine if x[2] in files[:2] for r in [f"m{i}" for i in range(7)])[:5]]
        if len(strong) < 2:
            more += [("cross-project", f"[{r[7]}] pattern: {r[2]}", 0.48) for x in mine for r in hits(x[1])[:2]]
        want += [(action, leg, line, round(score, 9)) for leg, line, score in strong + more if score >= 0.3]
    assert got == sorted(want) and {x[1] for x in got} >= {"bug-history", "pattern", "graph"}
    assert f"{tmp_path}/actions" not in df._jdf.queryExecution().executedPlan().toString()  # read once, when they were written


def test_a_listing_takes_the_first_entries_of_each_word(spark, tmp_path):
    """All entries that hold a word were dealt out for every query that asks for it."""
    texts = [(i, "alpha" if i % 2 else "beta alpha", i % 3) for i in range(60)] + [(7, "alpha", 2), (60, "x*** y", 9)]
    spark.createDataFrame(texts, "id bigint, content string, access_count bigint").write.parquet(f"{tmp_path}/texts")
    k = spark.read.parquet(f"{tmp_path}/texts").withColumn("title", F.lit("t"))
    q = spark.createDataFrame([(1, "alpha beta"), (2, "beta!"), (3, "***"), (4, "nothing")], "query_id bigint, text string")
    ix = I.tokenised(k.select("id", "content"), "id", "content")
    df = S.knowledge_list(k, ix, None, q, 5)
    got = sorted((r["query_id"], r["rank"], r["id"], r["access_count"]) for r in df.collect())
    hits = {1: [i for i, t, _ in texts[:60]], 2: [i for i, t, _ in texts[:60] if "beta" in t], 3: [60]}
    want = []
    for n, ids in hits.items():
        rows = sorted((-c, i) for i, _, c in texts if i in ids)[:5]
        want += [(n, rank, i, -c) for rank, (c, i) in enumerate(rows, 1)]
    assert got == sorted(want)
    matched = S.knowledge_list(k, ix, None, q.where("query_id = 2"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" not in matched  # the texts' words are not dealt out behind the written first entries
