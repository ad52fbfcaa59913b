"""The manifest against recursion in Python, with hot, null and lone groups."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from memspark.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes, fanout):
    """(root, siblings of each leaf from the bottom up as (left, right))."""
    at, paths, level = list(range(len(hashes))), [[] for _ in hashes], hashes
    while len(level) > 1:
        runs = [level[i:i + fanout] for i in range(0, len(level), fanout)]
        for k, i in enumerate(at):
            run = runs[i // fanout]
            paths[k].append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
            at[k] = i // fanout
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def brute(rows, fanout=3):
    groups = defaultdict(list)
    for r in rows:
        values = [r[f] for f in merkle.DOCUMENT_FIELDS]
        bad = list(values)
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
            bad[-1] = r["text"].replace("\n", "")
        groups[r["source"]].append((r["doc_id"], leaf(values), leaf(bad)))
    subs = []
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        members = sorted(groups[g], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        subs.append((members, *tree([m[1] for m in members], fanout)))
    if not subs:
        return []
    root, above = tree([s[1] for s in subs], fanout)
    out = []
    for (members, subroot, paths), over in zip(subs, above):
        for (i, h, found), path in zip(members, paths):
            whole = path + over
            up = found
            for left, right in whole:
                up = sha(left + up + right)
            out.append((i, h, subroot, root, sha("".join(a + b for a, b in whole)), up, up == root))
    return sorted(out, key=str)


def run(docs, fanout=3):
    changed = {"text": merkle.without_newlines("doc_id", "text")}
    return sorted(map(tuple, merkle.check(merkle.manifest(docs, "doc_id", "source", merkle.DOCUMENT_FIELDS, fanout, changed), "doc_id").collect()), key=str)


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = run(docs)
    assert got == brute(docs.collect())
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_messy_rows_and_other_fanouts(messy):
    for fanout in (2, 3, 5):
        assert run(messy, fanout) == brute(messy.collect(), fanout)


def test_one_group_and_lone_leaves(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for rows in ([(1, "a\nb", "en", "s", 3)], [(i, f"t\n{i}", "en", "s", 3) for i in range(28)], [(i, "same\n", None, f"s{i}", 3) for i in range(10)], [(1, "x", "en", "", 1), (2, "y", "en", None, 1), (3, "é\n", "en", "é", None)]):
        docs = spark.createDataFrame(rows, schema)
        assert run(docs) == brute(docs.collect())


def test_paths_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('t\n', id) AS text", "'en' AS lang", "if(id % 3 = 0, 'hot', concat('s', id % 11)) AS source", "1L AS n_chars")
    assert run(docs) == brute(docs.collect())


def test_empty_table(nothing):
    assert run(nothing) == []


def test_any_change_is_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    changed = {"lang": F.when(F.col("doc_id") % 7 == 0, F.lit("xx")).otherwise(F.col("lang"))}
    got = merkle.check(merkle.manifest(docs, "doc_id", "source", merkle.DOCUMENT_FIELDS, changed=changed), "doc_id").collect()
    assert all(r["verified"] == (r["doc_id"] % 7 != 0) for r in got)
