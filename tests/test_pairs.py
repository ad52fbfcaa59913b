"""Pairs of similar entries: whole lists, and how their sets travel."""

import itertools

from memspark.plans import all_queries


def documents(spark, path, texts):
    rows = [(i, t, "en", "p", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")


def test_contradictions_are_listed(spark, tmp_path):
    """A row for each pair of representatives, not a count for each entry."""
    texts = {5 * i: " ".join(f"word{k}" for k in range(i, i + 8)) for i in range(12)} | {100: "word0 word1 word2 word3 word4 word5 word6 word7", 101: "word0 word1 word2 word3 word4"}
    documents(spark, tmp_path, texts)
    words = {i: set(t.split()) for i, t in texts.items() if i not in (100, 101)}  # 100 is a copy of 0, 101 of another category
    want = sorted((a, b, len(words[a] & words[b]), round(len(words[a] & words[b]) / 8, 6)) for a, b in itertools.combinations(sorted(words), 2) if len(words[a] & words[b]) >= 4)
    got = all_queries()["k4_contradictions"](spark, str(tmp_path))
    assert sorted((r["a"], r["b"], r["shared"], r["similarity"]) for r in got.collect()) == want and len(want) > 30


def test_sets_travel_as_packed_numbers(spark, monkeypatch):
    """A set took eight bytes a word for each part it met; the commonest words have numbers now, the others a hash that no two words share."""
    import random

    import numpy as np

    from memspark.operators import similarity as SI

    r = random.Random(2)
    vocab = [f"w{i}" for i in range(50)]
    docs = {i: sorted(set(r.choices(vocab, weights=[1 / (k + 1) for k in range(50)], k=r.randint(2, 30)))) for i in range(70)}
    sets = spark.createDataFrame([("b", i, ws, len(ws)) for i, ws in docs.items()] + [(None, 99, ["w1"], 1), ("b", 98, [], 0)], "block string, rep bigint, ws array<string>, n int").repartition(3)
    want = {(a, b, len(x & y)) for a, b in itertools.combinations(docs, 2) for x, y in [(set(docs[a]), set(docs[b]))] if len(x & y) / len(x | y) >= 0.4}
    found = lambda: {(p["a"], p["b"], p["shared"]) for p in SI.similar_pairs(sets, "jaccard", 0.4).collect()}
    assert found() == want and want
    monkeypatch.setattr(SI, "PACKED", 40)  # several rows a part
    monkeypatch.setattr(SI, "COMMON", 5)
    whole = SI._hashed
    monkeypatch.setattr(SI, "_hashed", lambda words, seed: whole(words, seed) if seed else np.full(len(words), 1 << 62))
    assert SI._numbering(sets)[1] == 1  # under the first seed words had one number
    assert found() == want
    monkeypatch.undo()
    many = spark.range(400).selectExpr("'b' AS block", "id AS rep", "transform(sequence(0, 299), k -> concat('word', (id * 7 + k) % 1000)) AS ws", "300 AS n")
    cells = SI._cells(many, "overlap", 0.4, 100)
    assert cells.selectExpr("sum(octet_length(data))").first()[0] < 4 * 400 * 300 * 8 / 4  # each set meets four parts
