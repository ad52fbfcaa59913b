"""Words and trigrams of an index are made in blocks, and hits meet their forms as packed parts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memspark.functions.text import words_ws
from memspark.operators import index as I, query_forms as Q, retrieval as R, search as S, segments as SG
from memspark.session import run_dir

r = random.Random(5)
TEXTS = ["", " ", "ÄB c\td", "a\x0bb\x0cc\r\nd", "İx K", *["".join(r.choice(" \t\nabÉé.9 ") for _ in range(r.randint(0, 15))) for _ in range(200)]]


def test_words_of_a_block_are_those_of_the_column(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").orderBy("id").select(F.lower("t").alias("low"), words_ws("t").alias("w")).collect()
    for first in (0, 3):  # a slice, too
        lengths, words = SG._words_of(pa.array([x["low"] for x in rows]).slice(first))
        assert lengths.tolist() == [len(x["w"]) for x in rows[first:]] and words.to_pylist() == [w for x in rows[first:] for w in x["w"]]


@pytest.mark.parametrize("limits", [(200_000, 64 << 20), (2, 40)])
def test_trigrams_are_lists_of_words(spark, monkeypatch, limits):
    """A row for each (trigram, word) was shuffled, sorted and written before."""
    monkeypatch.setattr(SG, "GRAM_WORDS", limits[0])
    monkeypatch.setattr(SG, "GRAM_BYTES", limits[1])
    words = [f"abc{i}abc" for i in range(60)] + ["ab", "é😀xé", "zzzz", "abc" * 50]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id bigint, t string")
    ix = SG.Index.write(df, "id", "t", run_dir(spark, "grams"), ("words",))
    written = spark.read.parquet(f"{ix.path}/segments/{ix.segments[0][1]}/grams")
    if limits[0] > 100:
        assert written.where("unit = 'abc'").count() <= 8  # one for each block
    grams = sorted({(w[i:i + 3], w) for w in words for i in range(len(w) - 2)})
    wanted = spark.createDataFrame([(g,) for g, _ in grams] + [("not",)], "gram string").distinct()
    assert sorted(map(tuple, ix.grams(wanted).select("gram", "word").collect())) == grams


def test_hits_meet_their_forms_in_packed_parts(spark):
    """Hits were shuffled by phrase to their frequencies, then as rows by document, and sorted."""
    df = spark.createDataFrame([(i, " ".join(["a", "b", "c", "d"][: 1 + i % 4])) for i in range(40)], "id bigint, t string")
    ix = SG.Index.write(df, "id", "t", run_dir(spark, "hits"), ("tokens", "pairs"))
    forms = Q.any_word(spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "query_id bigint, ws array<string>"), F.col("ws"))
    got = R.score_forms(R.clause_hits(ix, forms), forms, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "SortMergeJoin" not in below and "BroadcastHashJoin" in below and "Sort " not in below
    plain = I.tokenised(df, "id", "t")
    key = lambda d: sorted((x["query_id"], x["id"], round(x["score"], 9), x["rank"]) for x in d.collect())
    assert key(got) == key(R.score_forms(R.clause_hits(plain, forms), forms, 3)) and len(key(got)) == 6


def test_texts_stay_where_they_lie_when_candidates_are_checked(spark):
    """The estimate of candidates times queries was too large to be sent, so all texts were shuffled to meet them."""
    path = run_dir(spark, "texts")
    spark.createDataFrame([(i, " ".join(f"w{(i * 7919 + j * 31) % 9973}" for j in range(200))) for i in range(400)], "id bigint, t string").write.parquet(path)
    df = spark.read.parquet(path)
    ix = SG.Index.write(df, "id", "t", run_dir(spark, "words"), ("words",))
    part = df.where("id % 40 = 0").select(F.col("id").alias("query_id"), F.substring_index("t", " ", 5).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        got = S.contains_text(df, "id", ["t"], part, ix)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts, asked = dict(map(tuple, df.collect())), dict(map(tuple, part.collect()))
    assert rows == sorted((q, i) for q, a in asked.items() for i, t in texts.items() if a in t) and len(rows) >= 10
