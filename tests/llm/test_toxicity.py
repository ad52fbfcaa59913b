import zlib
from itertools import product

import numpy as np

from memspark.llm import toxicity as T
from memspark.llm.queries import QUERIES


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.96
    assert np.mean([r["predicted"] for r in held if r["toxic"] == 0]) < 0.02


def test_label_model_finds_accuracies_and_dependence():
    r = np.random.default_rng(1)
    y = r.random(20_000) < 0.2
    votes = np.zeros((len(y), T.VOTERS), bool)
    right = [0.9, 0.8, 0.7, 0.95]
    for j, a in enumerate(right):
        votes[:, j] = r.random(len(y)) < np.where(y, a, 1 - a)
    votes[:, 4] = votes[:, 2]  # a copy of a weak voter
    masks, at = np.unique(votes @ (1 << np.arange(T.VOTERS)), return_inverse=True)
    known = r.random(len(y)) < 0.1
    count = lambda rows: np.bincount(at[rows], minlength=len(masks)).astype(float)
    model = T.fit_label_model(masks, count(~known), count(known & ~y), count(known & y))
    assert np.allclose(model.accuracy[:4], right, atol=0.03)
    assert model.correlation[2, 4] > 0.99 and abs(model.correlation[0, 1]) < 0.5
    for m in masks.tolist():  # posteriors against Bayes' rule; the copy counts once
        bits = [m >> j & 1 for j in range(4)]
        like = [np.prod([a if (b == c) else 1 - a for a, b in zip(right, bits)]) for c in (0, 1)]
        want = 0.2 * like[1] / (0.2 * like[1] + 0.8 * like[0])
        assert abs(model.posterior[m] - want) < 0.1


def test_features_by_brute_force():
    text = "Lostrada lostrada LOSTRAfe x".encode()
    want = set()
    words = ["lostrada", "lostrada", "lostrafe", "x"]
    for n in T.LENGTHS:
        keys = [w if n == 0 else w[:n] + "*" for w in words if len(w) >= n]
        want |= set(keys) | {k + "+" for k in keys if keys.count(k) > 1}
    assert T.document_features(text) == want
    assert T._hits([text, b""], dict.fromkeys(want, 1)) == {0: want}


def test_messy(messy, nothing, labels):
    model = T.fit(messy, labels)
    rows = T.score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1
    kept = T.keep(messy, model)
    assert kept.columns == messy.columns and kept.count() == sum(1 - r["predicted"] for r in rows)
    assert T.score(nothing, T.fit(nothing, labels)).count() == 0
    assert T.score(messy, T.fit(messy, labels.limit(0))).count() == messy.count()


def test_all_vote_patterns_are_counted(spark, messy, labels):
    voters = T.Voters({"idiot": 1})
    counts = T.pattern_counts(messy, labels, voters, "toxic", 4, 2)
    assert counts.agg({"n": "sum"}).first()[0] == messy.count()
    assert len(list(product((0, 1), repeat=2))) == 4
