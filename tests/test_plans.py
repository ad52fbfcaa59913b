"""Plan shape: no nested-loop or cross join over the corpus, filters at the scan, few columns read."""

import pytest

from memspark.plans import all_queries
from memspark.views import events, table, ts
from pyspark.sql import functions as F


def plan(df):
    q = df._jdf.queryExecution()
    return q.optimizedPlan().toString() + q.executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["j4_one_hop", "j7_as_of_join", "j8_evidence_session", "j8_evidence_global", "j9_causal_chain", "j10_shared_tokens", "j11_suffix_paths",
                                  "r2_bm25", "r4_keyword_search", "r6_trigram_search", "r7_fuzzy_search", "r12_chunk_search", "r13_knowledge_search", "k4_contradictions",
                                  "k10_duplicates", "k19_usefulness", "gr3_neighbours", "w1_anchor_timeline", "e4_evidence_recall", "r17_related_context"])
def test_no_nested_loop(name, spark, sf, no_broadcast):
    p = plan(all_queries()[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_and_columns_reach_the_scan(spark, sf):
    e = table(spark, sf, "events").where((F.col("user_id") == 3) & (F.col("event_type") == "error")).select("event_id")
    p = plan(e)
    assert "PushedFilters" in p and "EqualTo(user_id,3)" in p and "EqualTo(event_type,error)" in p
    assert "props" not in p.split("ReadSchema")[-1]


def test_top_k_limits_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(all_queries()["t2_top_per_group"](spark, sf))
    assert "TakeOrderedAndProject" in plan(all_queries()["t1_newest"](spark, sf))


def test_hot_key_windows_are_bucketed(spark, sf):
    p = plan(all_queries()["w2_error_fix"](spark, sf))
    assert "_bucket" in p


def test_searches_read_the_written_index_and_push_their_units(spark, sf):
    from memspark.operators import index as I
    from memspark.plans.retrieval import known, searchable

    phrases = spark.createDataFrame([("the",), ("of the",)], "phrase string")
    hits = I.phrase_hits(searchable(spark, sf), phrases)
    text = hits._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in text and "In(unit, [of the])" in text.replace("EqualTo(unit,of the)", "In(unit, [of the])")
    plain = I.phrase_hits(I.tokenised(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"), phrases)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, plain.collect()))
    assert known(spark, sf) is known(spark, sf)


def test_ranked_rollups_limit_before_the_shuffle(spark, sf):
    for name in ("x2_access_log", "x5_compiler_errors"):
        assert "WindowGroupLimit" in plan(all_queries()[name](spark, sf))


def test_a_walk_does_not_gather_all_edges(spark, sf):
    """Edges meet the frontier as they are; only what a hop has reached is made distinct."""
    from memspark.operators import graph as G

    e = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    seeds = spark.createDataFrame([("s1",), ("s2",)], "node string")
    reached = G.neighbourhood(e.union(e), seeds, 1, "out")
    assert plan(G.frontier_step(e, seeds.select(F.col("node").alias("seed"), "node"), "out")).split("== ")[0].count("Aggregate [seed") == 1
    assert "Aggregate [src" not in plan(G.frontier_step(e, seeds.select(F.col("node").alias("seed"), "node"), "both"))
    assert sorted(map(tuple, reached.collect())) == sorted({(s, s, 0) for s in ("s1", "s2")} | {(r["src"], r["dst"], 1) for r in e.where("src IN ('s1', 's2')").collect()})
