"""Operators against brute force or hand-made goldens, with hot keys and other partition counts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import evaluate as EV, graph as G, index as I, joins as J, ordered as O, query_forms as Q, retrieval as R, search as S, sequences as SQ, similarity as SI
from memspark.sources import conversations as CV, ingest as IN
from memspark.streaming import islands as IS

T0 = dt.datetime(2024, 1, 1)


def hot_events(n=600, seed=1):
    """One session holds a third of the rows."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = 0 if r.random() < 1 / 3 else r.randint(1, 12)
        rows.append((i, s, T0 + dt.timedelta(seconds=r.randint(0, 400000)), r.choice(["error", "file_modify", "search", "decision"])))
    return rows


@pytest.fixture(scope="module")
def ev(spark):
    rows = hot_events()
    return rows, spark.createDataFrame(rows, "id bigint, session_id bigint, ts timestamp, event_type string")


def day():
    return F.floor(F.unix_timestamp("ts") / 86400)


def test_running_and_neighbours_match_a_plain_walk(spark, ev):
    rows, df = ev
    got = {r["id"]: (r["n"], r["s"], r["p"], r["q"]) for r in O.neighbours(
        O.running(df, ["session_id"], ["ts", "id"], day(), sums={"s": "id"}, count="n"), ["session_id"], ["ts", "id"], day(),
        before={"p": "id"}, after={"q": "id"}, where=F.col("event_type") == "error").collect()}
    for s in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))
        total = 0
        for k, r in enumerate(mine):
            total += r[0]
            before = [x[0] for x in mine[:k] if x[3] == "error"]
            after = [x[0] for x in mine[k + 1:] if x[3] == "error"]
            assert got[r[0]] == (k + 1, total, before[-1] if before else None, after[0] if after else None)


def test_partition_count_does_not_matter(spark, ev):
    _, df = ev
    a = sorted(map(tuple, SQ.error_fixes(df.repartition(1), day()).collect()))
    b = sorted(map(tuple, SQ.error_fixes(df.repartition(13), F.floor(F.unix_timestamp("ts") / 3600)).collect()))
    assert a == b and a


@pytest.mark.parametrize("name", ["dedup", "rate", "cooldown"])
def test_island_walks_match_a_plain_walk(spark, ev, name):
    rows, df = ev
    gap, rule, extra = {"dedup": (3600, IS.dedup_rule(3600.0), []), "rate": (7201, IS.rate_rule(7200.0), []), "cooldown": (7200, IS.cooldown_rule(2, 7200.0), ["event_type"])}[name]
    out = "string" if name == "rate" else "boolean"
    got = {r["id"]: r["v"] for r in IS.walk(df, ["session_id"], gap, rule, "v", out, extra).collect()}
    for s in {r[1] for r in rows}:
        state = None
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0])):
            t = (r[2] - dt.datetime(1970, 1, 1)).total_seconds()
            state, v = rule(state, t, *([r[3]] if extra else []))
            assert got[r[0]] == v


def test_streams_equal_their_batch_twins(spark, sf):
    from memspark.plans import all_queries

    q = all_queries()
    rows = lambda n: sorted(tuple(str(x) for x in r) for r in _cols(q[n](spark, sf)).collect())
    for a, b in (("m1_dedup_stream", "m1_dedup_batch"), ("m5_rate_limit_stream", "m5_rate_limit_batch"), ("m10_cooldown_stream", "m10_cooldown_batch")):
        assert rows(a) == rows(b)
    stream, batch = set(rows("m3_hourly_stream")), set(rows("m3_hourly_batch"))
    assert stream and stream <= batch  # the newest hours wait for the watermark


def _cols(df):
    return df.select(*sorted(df.columns))


def test_bounded_top_k_loses_nothing(spark, sf):
    from memspark.plans.retrieval import docs, or_form
    from memspark.views import queries

    tok, form = I.tokenised(docs(spark, sf), "id", "content"), or_form(queries(spark, sf))
    hits = R.clause_hits(tok, form)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    assert key(R.top_any(hits, form, 3, plain_rows=0)) == key(R.top_any(hits, form, 3))


def test_fuzzy_pairs_are_complete(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(250)})
    q = words[::7] + ["ab", "a"]
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]
    got = {(x["qword"], x["word"], x["dist"]) for x in R.fuzzy_pairs(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in set(q)], "qword string")).collect()}
    assert got == {(a, b, lev(a, b)) for a in set(q) for b in words if lev(a, b) <= 2}


@pytest.mark.parametrize("measure,t,least", [("jaccard", 0.4, 1), ("jaccard", 0.55, 1), ("overlap", 0.4, 4)])
def test_similar_pairs_are_complete(spark, measure, t, least):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    docs = {i: sorted(set(r.choices(vocab, weights=[1 / (k + 1) for k in range(40)], k=r.randint(1, 20)))) for i in range(80)}
    docs = {i: ws for i, ws in docs.items() if ws not in [docs[j] for j in docs if j < i]}
    sets = spark.createDataFrame([("b", i, ws, len(ws)) for i, ws in docs.items()], "block string, rep bigint, ws array<string>, n int")
    got = {(x["a"], x["b"]) for x in SI.similar_pairs(sets, measure, t, least, salt_rows=7).collect()}
    want = set()
    for a in docs:
        for b in docs:
            x, y = set(docs[a]), set(docs[b])
            whole = len(x | y) if measure == "jaccard" else min(len(x), len(y))
            if a < b and len(x & y) >= least and len(x & y) / whole >= t:
                want.add((a, b))
    assert got == want and got


def test_components_on_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101 + i) for i in range(10)]
    got = {r["node"]: r["root"] for r in SI.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 21)) and all(got[i] == 100 for i in range(101, 111))


def test_merge_keeps_the_longest_and_unions(spark):
    w = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "x", "t", w, ["a"], ["p1"], 2, T0), (2, "x", "t", w + " more", ["b"], ["p2"], 3, T0 + dt.timedelta(1)), (3, "x", "u", "something else entirely different here", ["c"], ["p1"], 1, T0),
            (4, "x", "t", w, ["d"], ["p3"], 5, T0)]
    k = spark.createDataFrame(rows, "id bigint, block string, title string, content string, tags array<string>, projects array<string>, access_count bigint, last_accessed timestamp")
    merged, _, archived = SI.merge_duplicates(k, "block")
    got = {r["id"]: r for r in merged.collect()}
    assert set(got) == {1, 3}
    assert got[1]["members"] == 3 and got[1]["content"].endswith("more") and got[1]["access_count"] == 10
    assert got[1]["tags"] == ["a", "b", "d", "auto-merged"] and got[1]["projects"] == ["p1", "p2", "p3"] and got[3]["tags"] == ["c"]
    assert got[1]["title"] == "t" and sorted(map(tuple, archived.collect())) == [(2, 1), (4, 1)]


def test_vector_passes_agree(spark, sf):
    from memspark.plans.retrieval import vectors

    v = vectors(spark, sf)
    q = v.withColumnRenamed("id", "query_id")
    key = lambda df: sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert key(R.vector_search(v, q, 4)) == key(R.vector_search(v, q, 4, max_queries=37))


def test_phrases_of_three_tokens(spark):
    tok = I.tokenised(spark.createDataFrame([(1, "a b c a b"), (2, "a b x b c"), (3, "a b c. A-B c")], "id bigint, t string"), "id", "t")
    got = {(r["phrase"], r["id"], r["tf"]) for r in I.phrase_hits(tok, spark.createDataFrame([("a b c",), ("b",), ("b c",)], "phrase string")).collect()}
    assert got == {("a b c", 1, 1), ("a b c", 3, 2), ("b", 1, 2), ("b", 2, 2), ("b", 3, 2), ("b c", 1, 1), ("b c", 2, 1), ("b c", 3, 2)}


def test_substring_pairs(spark):
    v = spark.createDataFrame([(w,) for w in ("banana", "ban", "nana", "xyz")], "word string")
    got = {(r["term"], r["word"], r["n"]) for r in R.substring_pairs(v, spark.createDataFrame([("ana",), ("nan",), ("zzz",)], "term string")).collect()}
    assert got == {("ana", "banana", 2), ("ana", "nana", 1), ("nan", "banana", 1), ("nan", "nana", 1)}


def test_rerank_counts_synonyms(spark):
    rows = [(1, "general", i, 1.0, T0, 0, s) for i, s in enumerate(["film night", "movie night", "nothing"])]
    c = spark.createDataFrame(rows, "query_id bigint, intent string, id bigint, score double, ts timestamp, access_count bigint, snippet string")
    q = spark.createDataFrame([(1, "movie")], "query_id bigint, text string")
    score = lambda syn: {r["id"]: r["score"] for r in R.rerank(c, q, F.lit(T0), syn=syn).collect()}
    with_, without = score(Q.synonyms(spark)), score(None)
    assert with_[1] > with_[0] > with_[2] and without[0] == without[2]


def test_conversation_formats(spark):
    D = lambda t: spark.createDataFrame([("f", t)], "conv string, text string")
    texts = lambda df: [(r["role"], r["text"]) for r in df.orderBy("turn").collect()]
    lines = spark.createDataFrame([("f", i, l) for i, l in enumerate(['{"role":"user","content":"hi"}', "{bad", '{"role":"tool","content":"x"}', '{"role":"assistant"}'])], "conv string, pos bigint, line string")
    assert texts(CV.parse_lines(lines)) == [("human", "hi"), ("system", "x")]
    assert texts(CV.parse_sender_export(D('{"messages":[{"sender":"user","text":"q"},{"sender":"bot","content":"a"},{"sender":"bot","text":" "}]}'))) == [("human", "q"), ("assistant", "a")]
    assert texts(CV.parse_message_tree(D('{"mapping":{"n1":{"message":{"author":{"role":"user"},"content":{"parts":["a","b"]},"create_time":1.5}},"n2":{"message":{"author":{"role":"system"},"content":{"parts":["z"]}}},"n3":{}}}'))) == [("human", "a\nb")]
    assert texts(CV.parse_channel(D('{"messages":[{"user":"u","text":"t","ts":"1.5"},{"text":"j","subtype":"channel_join"}]}'))) == [("human", "t")]
    assert texts(CV.parse_plain(D("lost\n\nHuman: one\n\nmore\n\nAssistant: two\n\n> human three\n\nUser:\n\nassistant four"))) == [("human", "one\nmore"), ("assistant", "two"), ("human", "three"), ("assistant", "four")]


def test_read_exports_from_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"role":"user","content":"hi"}\n{"role":"assistant","content":"yo"}\n')
    df = CV.parse_lines(CV.read_exports(spark, str(tmp_path), whole=False))
    assert sorted((r["conv"], r["text"]) for r in df.collect()) == [("a.jsonl", "hi"), ("a.jsonl", "yo")]


def test_markdown_chunks_keep_code_whole(spark):
    t = "pre\n# A\n```\n# not a heading\n\nx\n```\nafter\n## B\nend"
    got = [(r["chunk"], r["heading"], r["has_code"]) for r in IN.chunk_documents(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t", bucket_lines=3).orderBy("chunk").collect()]
    assert got == [(0, None, False), (1, "A", True), (2, "B", False)]
    t = "one\n\n\ntwo\n```\na\n\nb\n```\n\nthree"
    assert [r["content"] for r in IN.chunk_documents(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").orderBy("chunk").collect()] == ["one", "two\n```\na\n\nb\n```", "three"]
    assert IN.chunk_documents(spark.createDataFrame([(1, '{"a":\n\n1}')], "id int, t string"), "id", "t").count() == 1


def test_import_modes(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (2, None)], "id int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(IN.import_tables(old, new, "id", defaults={"v": "d"})) == [(1, "a"), (2, "d")]
    assert rows(IN.import_tables(old, new, "id", "replace", {"v": "d"})) == [(1, "b"), (2, "d")]


def test_ingest_is_idempotent(spark):
    raw = spark.createDataFrame([(1, "log", "same text", T0 + dt.timedelta(1)), (2, "log", "same text", T0), (3, "error", "other", T0)], "id bigint, type string, content string, indexed_at timestamp")
    first = IN.ingest_pipeline(raw)
    assert sorted(r["id"] for r in first.collect()) == [2, 3]
    assert IN.ingest_pipeline(raw, first.select("content_hash")).count() == 0


def test_metrics(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id int, id string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (2, "y")], "query_id int, id string")
    r = {x["query_id"]: x for x in EV.recall(run, rel, 2).collect()}
    assert (r[1]["recall_any"], r[1]["recall_all"], r[1]["recall_capped"]) == (1.0, 0.0, 0.5) and r[2]["recall_any"] == 0.0
    n = {x["query_id"]: x["ndcg"] for x in EV.ndcg(run, rel, 3).collect()}
    assert abs(n[1] - 0.6309297535714575) < 1e-12 and n[2] == 0.0
    std = {x["query_id"]: x["ndcg"] for x in EV.ndcg(run, rel, 3, "qrels").collect()}
    assert std[1] < n[1]


def test_neighbourhood_depth_and_direction(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    hops = lambda **k: {(r["node"], r["hops"]) for r in G.neighbourhood(e, s, 2, **k).collect()}
    assert hops() == {("a", 0), ("b", 1), ("x", 1), ("c", 2)}
    assert hops(direction="out") == {("a", 0), ("b", 1), ("c", 2)} and hops(direction="in") == {("a", 0), ("x", 1)}


def test_interval_join_with_overlaps(spark):
    d = lambda y, m: dt.datetime(y, m, 1)
    f = spark.createDataFrame([(1, "k", d(2020, 1), d(2022, 1)), (2, "k", d(2021, 6), None), (3, "k", d(2021, 1), d(2021, 1))], "id int, key string, valid_from timestamp, valid_to timestamp")
    p = spark.createDataFrame([("k", d(2021, 7)), ("k", d(2019, 1)), ("k", d(2024, 1)), ("k", d(2022, 1))], "key string, at timestamp")
    got = sorted((r["at"].year, r["id"]) for r in J.interval_join(f, p, ["key"], "at", 90).collect())
    assert got == [(2021, 1), (2021, 2), (2022, 2), (2024, 2)]


def test_related_context_and_answers_have_sources(spark):
    o = spark.createDataFrame([(1, "error", "boom in f", T0, "src/f.ts", 0.9, ["React"])], "id bigint, type string, content string, indexed_at timestamp, file_path string, importance double, entities array<string>")
    k = spark.createDataFrame([(7, "pattern", "use retry", "retry on conventions", 3, T0, "explicit", "p2")], "id bigint, category string, title string, content string, access_count bigint, created_at timestamp, source_type string, project string")
    e = spark.createDataFrame([("src/f.ts", "mod", "uses")], "src string, dst string, type string")
    a = spark.createDataFrame([("x", "conventions app", "src/f.ts")], "action_id string, query string, path string")
    ix = I.tokenised(k.selectExpr("id", "concat_ws(' ', title, content) AS t"), "id", "t")
    got = [(r["leg"], round(r["score"], 4)) for r in S.related_context(a, o, k, ix, e, k, ix, F.lit(T0), 0.3).orderBy("rank").collect()]
    assert got == [("bug-history", 0.9), ("pattern", 0.7386), ("graph", 0.5), ("entities", 0.4)]


def test_contains_text_with_long_and_short_queries(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "a brown FOX jumps"), (3, "quickest")], "id bigint, t string")
    q = spark.createDataFrame([(1, "quick brown fox"), (2, "uick"), (3, "k brown f"), (4, "brown foxes run")], "query_id bigint, text string")
    got = sorted(map(tuple, S.contains_text(docs, "id", ["t"], q).collect()))
    assert got == [(1, 1), (2, 1), (2, 3), (3, 1)]
    assert S.contains_text(docs, "id", ["t"], q.where("query_id = 1")).count() == 1


def test_similar_sets_meet_in_parts_and_are_counted_without_their_pairs(spark, monkeypatch):
    """Sets are shuffled once for each part they meet, however many pairs share their words; counts equal the pairs'."""
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    docs = {i: sorted(set(r.choices(vocab, weights=[9 if k < 12 else 1 for k in range(60)], k=r.randint(3, 40)))) for i in range(90)}
    sets = spark.createDataFrame([("b" if i % 3 else "c", i, ws, len(ws)) for i, ws in docs.items()], "block string, rep bigint, ws array<string>, n int")
    monkeypatch.setattr(SI, "PART", 5_000)
    monkeypatch.setattr(SI, "STRIP", 500)
    monkeypatch.setattr(SI, "HOT_WORDS", 5)
    for measure, t, least in (("jaccard", 0.4, 1), ("jaccard", 0.9, 1), ("overlap", 0.4, 4)):
        want = {}
        for a in docs:
            for b in docs:
                x, y = set(docs[a]), set(docs[b])
                whole = len(x | y) if measure == "jaccard" else min(len(x), len(y))
                if a < b and (a % 3 > 0) == (b % 3 > 0) and len(x & y) >= least and len(x & y) / whole >= t:
                    want[a, b] = (len(x & y), round(len(x & y) / whole, 9))
        assert {(p["a"], p["b"]): (p["shared"], round(p["similarity"], 9)) for p in SI.similar_pairs(sets, measure, t, least).collect()} == want
        links = {}
        for pair in want:
            for i in pair:
                links[i] = links.get(i, 0) + 1
        assert {p["rep"]: p["links"] for p in SI.similar_counts(sets, measure, t, least).collect()} == links
    assert SI._cells(sets, "overlap", 0.4, 20000).count() < 10 * len(docs) < len(want)


def test_fuzzy_passes_agree_and_send_only_the_best(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 7)))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(r.randint(0, 12)))) for i in range(120)] + [(500, None)], "id bigint, t string")
    texts = {i: " ".join(word() for _ in range(r.randint(1, 5))) for i in range(9)} | {9: "abc abc cab", 10: "x"}
    q = spark.createDataFrame(list(texts.items()), "query_id bigint, text string")
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]
    want = []
    for k, text in texts.items():
        qs = [w for w in text.split() if len(w) >= 2]
        found = []
        for i, t in docs.collect():
            ws = [w for w in (t or "").split() if len(w) >= 2]
            d = [min([lev(w, x) for x in ws], default=9) for w in qs]
            score = sum(1 / (x + 1) for x in d if x <= 2) / max(1, len(qs))
            found += [(-round(score, 9), i)] * (score > 0)
        want += [(k, i, -s) for s, i in sorted(found)[:3]]
    key = lambda d: sorted((x["query_id"], x["id"], round(x["score"], 9)) for x in d.collect())
    assert key(R.fuzzy_search(R.WordRows(docs, "id", "t"), q, 3)) == sorted(want)
    monkeypatch.setattr(R, "NEAR", 500)
    monkeypatch.setattr(R, "CELLS", 40)
    assert key(R.fuzzy_search(R.WordRows(docs, "id", "t"), q, 3)) == sorted(want)
