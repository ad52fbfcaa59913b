"""The index holds lists that tasks make of blocks of documents, and forms are scored in blocks of documents."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memspark.functions.text import tokens_of
from memspark.operators import index as I, query_forms as Q, retrieval as R, segments as SG
from memspark.session import run_dir

TEXTS = ["Hello, wörld A1", "", "x", "  ", "İstanbul Kelvin AB", "end", "Start a b a b c", "ña_b\nc" * 9]


def test_tokens_of_a_block_are_those_of_the_column(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").orderBy("id").select(tokens_of("t").alias("t")).collect()
    for first in (0, 3):  # a slice, too
        lengths, tokens = SG._tokens_of(pa.array(TEXTS).slice(first))
        assert lengths.tolist() == [len(r["t"]) for r in rows[first:]]
        assert tokens.to_pylist() == [t for r in rows[first:] for t in r["t"]]


@pytest.mark.parametrize("block", [1, 2_000_000])
def test_lists_hold_many_documents_a_row(spark, monkeypatch, block):
    """One row for each (unit, document) was shuffled and sorted before."""
    monkeypatch.setattr(SG, "BLOCK_TOKENS", block)
    df = spark.createDataFrame([(i, "a b a") for i in range(300)] + [(7, "a b a"), (300, None)], "id bigint, t string")  # 7 comes twice
    ix = SG.Index.write(df, "id", "t", run_dir(spark, "lists"))
    written = spark.read.parquet(f"{ix.path}/segments/{ix.segments[0][1]}/tokens")
    assert written.count() <= 4 and written.select(F.max(F.size("at"))).first()[0] == SG.RUN
    hits = ix.hits(spark.createDataFrame([("a",), ("a b",)], "phrase string"))
    got = {(r["phrase"], r["id"]): (r["dl"], r["tf"]) for r in hits.collect()}
    assert len(got) == 600 and got["a", 7] == (3, 4) and got["a b", 7] == (3, 2) and got["a", 8] == (3, 2)


@pytest.mark.parametrize("near", [3, 4_000_000])
def test_forms_in_blocks_equal_joins(spark, monkeypatch, near):
    """AND and OR forms, in one pass or several, by blocks of two documents, with an id that comes twice and one that is null."""
    monkeypatch.setattr(R, "NEAR", near)
    data = [(i, " ".join(["a", "b", "c", "d"][: 1 + i % 4])) for i in range(40)] + [(5, "a c c"), (None, "a b")]
    tok = I.tokenised(spark.createDataFrame(data, "id bigint, t string"), "id", "t")
    q = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["d", "zz"])], "query_id bigint, ws array<string>")
    forms = Q.any_word(q, F.col("ws")).unionByName(Q.all_words(q, F.col("ws")))
    hits = R.clause_hits(tok, forms)
    need = forms.groupBy(*R.FORM, "mode").agg(F.count("*").alias("need"))
    plain = hits.join(forms, "phrase").join(need, [*R.FORM, "mode"]).groupBy(*R.FORM, "id", "mode", "need").agg(F.sum("w").alias("score"), F.count("*").alias("n"))
    plain = plain.where("mode = 'OR' or n = need and id is not null").select(*R.FORM, "id", "score")
    key = lambda d: sorted((r["query_id"], r["strategy"], r["id"] or -1, round(r["score"], 9)) for r in d.collect())
    got = R.score_forms(hits, forms)
    assert key(got) == key(plain) and len(key(got)) > 60
    assert key(R.score_forms(hits, forms, 3)) == key(R.top_k(plain, 3, R.FORM))
    shuffled = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in shuffled.split("MapInArrow")[0]  # scores aren't multiplied by joins
