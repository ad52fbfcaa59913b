"""Inverted vector lists: recall against the exact search, hot lists, odd rows."""

import random

import numpy as np

from memspark.operators import retrieval as R, vector_lists as VL


def test_recall_at_ten(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding").repartition(4)
    q = v.where("id % 100 = 0").selectExpr("id AS query_id", "embedding")
    index = VL.build(v)
    found = VL.search(index, q, 10, exclude_self=True)
    exact = R.vector_search(v, q, 10, exclude_self=True)
    share = VL.recall(found, exact)
    print("lists", len(index.centroids), "probes", index.probes, "recall", share)
    assert share >= 0.9
    assert index.blocks.selectExpr("sum(size(ids))").first()[0] == v.count()


def test_all_probes_are_exact_with_a_hot_list_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(VL, "BLOCK", 16)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).astype("float32").tolist()) for i in range(120)] + [(200 + i, [1.0] * 6) for i in range(60)] + [(300, None), (301, []), (302, [1.0]), (303, [0.0] * 6)]
    v = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    q = v.where("id % 7 = 0").selectExpr("id AS query_id", "embedding")
    index = VL.build(v, lists=9)
    key = lambda d: sorted((x["query_id"], x["rank"], x["id"], round(x["score"], 6)) for x in d.collect())
    assert key(VL.search(index, q, 5, probes=9)) == key(R.vector_search(v, q, 5))
    none = v.where("false")
    assert VL.search(VL.build(none), q, 5).count() == 0


def test_exact_search_is_blocked(spark, monkeypatch):
    """A task never holds more similarities than CELLS, and equal scores still end with the id."""
    r = random.Random(9)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(400)] + [(400, None), (401, [1.0])]
    v = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3)
    q = v.where("id < 60").withColumnRenamed("id", "query_id")
    key = lambda d: sorted((x["query_id"], x["id"], round(x["score"], 9), x["rank"]) for x in d.collect())
    whole = key(R.vector_search(v, q, 4, exclude_self=True))
    every = sorted((x["query_id"], x["id"]) for x in R.similar_vectors(v, q, 0.2).collect())
    monkeypatch.setattr(R, "CELLS", 600)
    out = R._vector_pass(v, q.toPandas(), 4, 0.2, True)
    assert key(R.top_k(out, 4)) == whole
    assert out.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 4 * 3  # a task sends on k rows a query
    assert sorted((x["query_id"], x["id"]) for x in R.similar_vectors(v, q, 0.2).collect()) == every


def test_every_vector_is_a_query(spark, tmp_path):
    """Only every hundredth vector was searched for; one without an embedding finds nothing."""
    from memspark.plans import all_queries

    r = random.Random(3)
    rows = [(i, [r.random() for _ in range(4)], 0) for i in range(30)] + [(30, None, 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = all_queries()["r8_vector_search"](spark, str(tmp_path)).collect()
    unit = np.array([x[1] for x in rows[:30]], dtype=np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 9) - 3 * np.eye(30)
    best = {(int(i), int(j)) for i in range(30) for j in sorted(range(30), key=lambda j: (-sim[i, j], j))[:10] if sim[i, j] >= 0.2}
    assert {(x["query_id"], x["id"]) for x in found} == best and len({x["query_id"] for x in found}) == 30
