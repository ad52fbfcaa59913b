import random
from collections import Counter

import xxhash

from memspark.llm import simhash_dedup as S
from memspark.llm.queries import QUERIES


def fingerprint(text, size=4):
    """As the contract says it, bit by bit."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """{row number: smallest id reachable} by comparing all pairs."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return Counter((doc, f"{fp:016x}", least.get(g)) for (doc, fp), g in zip(rows, group))


def test_query_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash_dedup"](spark, sf).collect())
    assert got == components([(r["doc_id"], fingerprint(r["text"])) for r in docs])


def test_messy(messy, nothing):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(messy).collect())
    assert got == components([(r["doc_id"], fingerprint(r["text"])) for r in messy.collect()])
    assert S.near_duplicates(nothing).count() == 0


def linked(pairs, values):
    group = {v: v for v in values}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        group[root(a)] = root(b)
    classes = {}
    for v in values:
        classes.setdefault(root(v), set()).add(v)
    return sorted(map(sorted, classes.values()))


def test_links_of_dense_groups_whatever_the_posting_size(spark):
    r = random.Random(5)
    values = set()
    for _ in range(2):  # clusters around a centre, within and beyond four bits, and chains
        c = r.getrandbits(64)
        for _ in range(60):
            c2 = c
            for _ in range(r.randint(0, 7)):
                c2 ^= 1 << r.randrange(64)
            values.add(c2)
    signed = sorted(S._signed(v) for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    want = linked([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4], signed)
    for large in (4, 10_000):
        assert linked([tuple(x) for x in S.links(fps, large).collect()], signed) == want


def test_one_of_each_component_stays(messy, nothing):
    kept = S.keep(messy)
    assert kept.columns == messy.columns
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in messy.collect()]
    left = [(r["doc_id"], fingerprint(r["text"])) for r in kept.collect()]
    parts = linked([(a[1], b[1]) for a in rows for b in rows if (a[1] ^ b[1]).bit_count() <= 4], {fp for _, fp in rows})
    assert len(left) == len(parts)
    for part in parts:
        least = min((i is None, i or 0) for i, fp in rows if fp in part)
        assert [(i is None, i or 0) for i, fp in left if fp in part] == [least]
    assert S.keep(nothing).count() == 0


def test_repeated_ids_with_different_texts_lose_nothing(spark):
    """An id twice with different texts: every component keeps one row, the same on every run and for every order."""
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcd"}
    rows = [(1, "a", 1), (5, "a", 1), (5, "b", 1), (9, "b", 1), (7, "c", 1), (7, "c", 2), (7, "c", 2), (7, "d", 1), (None, "d", 1), (None, "a", 3), (7, "a", 9)]
    got = set()
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        docs = spark.createDataFrame([(i, text[c], n) for i, c, n in order], "doc_id bigint, text string, n int").repartition(3, "n")
        got.add(tuple(sorted((r["doc_id"], r["text"][0], r["n"]) for r in S.keep(docs).collect())))
    assert got == {((1, "a", 1), (5, "b", 1), (7, "c", 1), (7, "d", 1))}
