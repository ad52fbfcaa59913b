"""The written index: what it answers equals a scan, through inserts, updates, deletes and merges."""

import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import index as I, retrieval as R, segments as SG
from memspark.session import run_dir

PHRASES = ["a", "b c", "a b c", "word7", "word7 a", "zzz", "c"]


def rows(seed, ids):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(["a", "b", "c", f"word{i % 9}", "x-y", "Ab.c"]) for _ in range(r.randint(0, 30))) if i % 13 else None) for i in ids]


def frame(spark, data):
    return spark.createDataFrame(data, "id bigint, t string")


def answers(spark, tok):
    hits = I.phrase_hits(tok, spark.createDataFrame([(p,) for p in PHRASES], "phrase string"))
    return sorted((r["phrase"], r["id"], r["dl"], r["tf"]) for r in hits.collect())


def same_as_new(spark, ix, live, words=True):
    """Hits, statistics, words and trigrams of the index are those of the table it should hold."""
    df = frame(spark, sorted(live.items()))
    plain = I.tokenised(df.withColumn("t", F.coalesce("t", F.lit(""))), "id", "t")
    assert answers(spark, ix) == answers(spark, plain)
    one, two = ix.stats.first(), I.corpus_stats(plain).first()
    assert (one["n_docs"], one["avgdl"]) == (two["n_docs"], two["avgdl"])
    if not words:
        return
    words = R.WordRows(df, "id", "t")
    asked = spark.createDataFrame([("a",), ("word7",), ("x-y",), ("ab.c",), ("none",)], "word string")
    assert sorted(map(tuple, ix.word_postings(asked).select("id", "word", "tf").collect())) == sorted(map(tuple, words.word_postings(asked).select("id", "word", "tf").collect()))
    q = spark.createDataFrame([(1, "ord7 b.c"), (2, "x-y"), (3, "nothing here")], "query_id bigint, text string")
    key = lambda d: sorted((r["query_id"], r["id"], round(r["score"], 6)) for r in d.collect())
    assert key(R.trigram_search(ix, q, 50)) == key(R.trigram_search(words, q, 50))
    assert key(R.fuzzy_search(ix, q, 50)) == key(R.fuzzy_search(words, q, 50))


def test_upkeep(spark):
    live = dict(rows(1, range(40)))
    ix = SG.Index.write(frame(spark, live.items()), "id", "t", run_dir(spark, "segments"))
    same_as_new(spark, ix, live, words=False)
    for step, (kind, data) in enumerate([("append", rows(2, range(40, 70))), ("delete", [(i, "") for i in range(0, 50, 4)] + [(999, "")]), ("upsert", rows(3, range(30, 80, 3))),
                                         ("delete", [(30, ""), (31, ""), (79, "")]), ("upsert", rows(4, [30, 31, 500])), ("append", rows(5, range(1000, 1040)))]):
        df = frame(spark, data)
        if kind == "delete":
            ix.delete(df)
            live = {i: t for i, t in live.items() if i not in dict(data)}
        else:
            getattr(ix, kind)(df, "id", "t")
            live |= dict(data)
    same_as_new(spark, ix, live)
    assert SG.Index(spark, ix.path).n_docs == len(live)
    few = len(ix.segments)
    ix.merge(fan_in=2)
    assert len(ix.segments) < few
    same_as_new(spark, ix, live, words=False)
    ix.delete(frame(spark, [(1000, "")]))
    del live[1000]
    ix.merge(fan_in=1)
    assert len(ix.segments) == 1 and not ix.tombstones
    same_as_new(spark, SG.Index(spark, ix.path), live)


def test_a_partial_merge_keeps_tombstones_of_what_is_left(spark):
    """A large old segment stays, small ones are merged; what is dead in the old one stays dead."""
    live = dict(rows(7, range(300)))
    ix = SG.Index.write(frame(spark, live.items()), "id", "t", run_dir(spark, "segments"), ("tokens", "pairs"))
    for k in range(3):
        ids = [1000 + 2 * k, 1001 + 2 * k, 5 * k + 1]
        ix.upsert(frame(spark, data := rows(10 + k, ids)), "id", "t")
        live |= dict(data)
    ix.merge(fan_in=3)
    assert len(ix.segments) == 2 and ix.tombstones
    ix.delete(frame(spark, [(1, ""), (1000, ""), (2, "")]))
    live = {i: t for i, t in live.items() if i not in (1, 2, 1000)}
    # only what ids, statistics and phrases need
    plain = I.tokenised(frame(spark, live.items()).withColumn("t", F.coalesce("t", F.lit(""))), "id", "t")
    assert answers(spark, ix) == answers(spark, plain) and ix.n_docs == len(live)
    assert sorted(r["id"] for r in ix.docs().collect()) == sorted(live)


def test_uncommitted_and_lost_commits(spark):
    ix = SG.Index.write(frame(spark, rows(1, range(10))), "id", "t", run_dir(spark, "segments"), ("tokens",))
    ix._segment(frame(spark, rows(2, range(20, 30))), "id", "t", ix.version + 1)  # written, never committed
    assert SG.Index(spark, ix.path).n_docs == 10
    other = SG.Index(spark, ix.path)
    other.append(frame(spark, rows(3, range(40, 45))), "id", "t")
    try:  # both write the same version: exactly one of them holds
        ix.append(frame(spark, rows(4, range(50, 57))), "id", "t")
        assert ix.n_docs == 17
    except RuntimeError:
        assert ix.n_docs == 15
    assert SG.Index(spark, ix.path).n_docs == ix.n_docs


def test_empty_tables(spark):
    ix = SG.Index.write(frame(spark, []), "id", "t", run_dir(spark, "segments"))
    assert ix.n_docs == 0 and answers(spark, ix) == []
    ix.append(frame(spark, [(1, "a b c")]), "id", "t").delete(frame(spark, [(7, "")]))
    assert answers(spark, ix) == [("a", 1, 3, 1), ("a b c", 1, 3, 1), ("b c", 1, 3, 1), ("c", 1, 3, 1)]


def test_searches_open_only_pieces_with_their_units(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ix = SG.Index.write(docs, "doc_id", "text", run_dir(spark, "segments"), ("tokens", "pairs"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        wide = SG.Index.write(docs, "doc_id", "text", run_dir(spark, "segments"), ("tokens", "pairs"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    one = spark.createDataFrame([("the",)], "unit string")
    files = len(set(wide.postings("tokens").inputFiles()))
    assert files > 8 and len(wide.postings("tokens", one).inputFiles()) <= 2
    plan = wide.postings("tokens", one)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "PushedFilters: [" in plan and "unit" in plan.split("PushedFilters")[1][:80]
    assert answers(spark, ix) == answers(spark, wide)


@pytest.mark.parametrize("pushed", [0, 3])
def test_more_units_than_are_pushed(spark, monkeypatch, pushed):
    ix = SG.Index.write(frame(spark, rows(1, range(40))), "id", "t", run_dir(spark, "segments"))
    want = answers(spark, ix)
    monkeypatch.setattr(SG, "PUSHED", pushed)
    assert answers(spark, ix) == want


def test_a_changed_table_gets_a_new_index(spark):
    path, known = run_dir(spark, "table"), {}
    frame(spark, rows(1, range(10))).write.parquet(path)
    ask = lambda: SG.kept_index(spark.read.parquet(path), "id", "t", "test", known)
    first = ask()
    assert ask() is first and first.n_docs == 10
    frame(spark, rows(2, range(20, 25))).write.mode("append").parquet(path)
    assert ask().n_docs == 15


def test_kinds_are_written_when_they_are_asked_for(spark, tmp_path):
    """A kept index holds what was asked of it so far; what is added later answers like an index of all kinds."""
    live = dict(rows(7, range(30)))
    frame(spark, live.items()).write.parquet(f"{tmp_path}/t")
    df, known = spark.read.parquet(f"{tmp_path}/t"), {}
    ix = SG.kept_index(df, "id", "t", "kinds", known, ("words",))
    assert ix.kinds == ("words",)
    assert SG.kept_index(df, "id", "t", "kinds", known, ("tokens", "pairs")) is ix and ix.kinds == SG.KINDS
    assert SG.Index(spark, ix.path).kinds == SG.KINDS
    same_as_new(spark, ix, live)


def test_lists_are_packed(spark):
    """Lists are packed records where ids are bigint, with null ids too; string ids keep arrays, and both answer like a scan."""
    data = [(1, "a b c"), (None, "b c"), (2, "c"), (None, "b c c")]
    for of, kind in ((lambda i: i, "bigint"), (lambda i: i and f"d{i}", "string")):
        df = spark.createDataFrame([(of(i), t) for i, t in data], f"id {kind}, t string")
        ix = SG.Index.write(df, "id", "t", run_dir(spark, "segments"), ("tokens", "pairs"))
        lists = spark.read.parquet(f"{ix.path}/segments/{ix.segments[0][1]}/pairs")
        assert (dict(lists.dtypes)["at"] == "binary") == (kind == "bigint")
        asked = spark.createDataFrame([("b c",), ("c",)], "phrase string")
        rows = lambda tok: sorted(map(str, I.phrase_hits(tok, asked).collect()))
        assert rows(ix) == rows(I.tokenised(df, "id", "t"))
