import math
import re
from collections import Counter

import numpy as np
import xxhash

from memspark.llm import quality_cnn as N, quality_rules as Q
from memspark.llm.queries import QUERIES


def base(text):
    """The base columns as the contract says them."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def grams(text):
    """Buckets of the n-grams, one at a time."""
    tokens = [t for w in text.encode().split() for t in Q.TOKEN.findall(w)]
    h, out = [xxhash.xxh64_intdigest(t) for t in tokens], []

    def bucket(values):
        x = sum(v * o for v, o in zip(values, Q.ODD)) % (1 << 64)
        return (x ^ x >> 29) >> 48

    for i in range(len(h)):
        out += [bucket(h[i:i + 1]), bucket(h[i:i + 2]) if i + 1 < len(h) else bucket(h[i:i + 1])]
    return out


def check(docs, rows):
    target, corpus = Counter(), Counter()
    every = [((r["text"] or ""), base(r["text"] or "")) for r in docs]
    for t, (n, chars, symbols, dup, rep) in every:
        g = grams(t)
        corpus.update(g)
        if n >= 20 and 100 * rep <= 30 * n and 20 * symbols <= n and dup == 0 and 10 * rep <= n and 5 * len(re.findall("[A-Z]", t)) <= chars:
            target.update(g)
    size = [sum(c.values()) + Q.BUCKETS for c in (target, corpus)]
    ratio = lambda b: round((math.log((target[b] + 1) / size[0]) - math.log((corpus[b] + 1) / size[1])) * Q.MICRO)
    want = []
    for r, (t, b) in zip(docs, every):
        g = grams(t)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        score = sum(map(ratio, g)) / max(1, len(g)) / Q.MICRO
        want.append((str(r["doc_id"]), *b, failed, not failed and score >= Q.THRESHOLD))
    got = [(str(r["doc_id"]), *[r[c] for c in Q.BASE], r["base_failed"], r["kept"]) for r in rows]
    assert sorted(got) == sorted(want)


def test_rules_by_brute_force(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet").collect(), QUERIES["op10_quality_rules"](spark, sf).collect())


def test_messy_rules(messy, nothing):
    check(messy.collect(), Q.score(messy, Q.fit(messy)).collect())
    assert Q.score(nothing, Q.fit(nothing)).count() == 0 and Q.keep(nothing).count() == 0


def test_kept_rows_are_those_judged_kept(messy):
    kept = Q.keep(messy)
    assert kept.columns == messy.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in Q.score(messy, Q.fit(messy)).where("kept").collect())


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op10_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert sum(r["kept"] for r in rows if r["quality"] == 0) <= 0.15 * sum(r["quality"] == 0 for r in rows)


def test_chunks_cover_texts():
    for n in (0, 1, N.CHUNK - 1, N.CHUNK, N.CHUNK + 1, 5 * N.CHUNK + 3):
        text = bytes(i * 7 % 251 + 1 for i in range(n))
        x, first = N.chunks([b"before", text])
        assert all(any(text[i:i + 4] in row.tobytes() for row in x[first[1]:]) for i in range(0, max(0, n - 4), 97))


def test_filters_by_plain_convolution():
    net = N.Network()
    x, _ = N.chunks([b"The quick brown fox " * 80])
    h = net.responses(x, net.tables())
    for c, w in ((0, 0), (1, 17), (1, 255)):
        bytes_ = x[c, N.STEP * w:N.STEP * w + N.WIDTH]
        assert np.allclose(h[c, w], np.einsum("oe,oef->f", net.p["embed"][bytes_], net.p["filters"]), atol=1e-4)


def test_gradient_by_differences():
    texts, y = [b"good words here " * 100, b"%%% &&& ### " * 90], [1, 0]

    def loss(net):
        p = net.score(texts, net.tables())
        return -np.mean([math.log(p[0]), math.log(1 - p[1])])

    net = N.Network()
    before = loss(net)
    net.train(texts, y, epochs=30)
    assert loss(net) < 0.3 * before


def test_network_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op6_quality_cnn"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_messy_network(messy, nothing, labels):
    rows = N.score(messy, N.fit(messy, labels)).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert N.score(nothing, N.fit(nothing, labels)).count() == 0
    assert len({r["score"] for r in N.score(messy, N.fit(messy, labels.where("quality = 1"))).collect()}) == 1
