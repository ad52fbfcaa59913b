import random

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memspark.llm import sentencepiece_viterbi as V, token_counts as T
from memspark.llm.queries import QUERIES

WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


def fuzz():
    r = random.Random(3)
    pool = "aAbBeEéÉ\u0301ñßİΣςσ 's't'll<|endoftext|>  \x1c\x85\n\t12٣中文字😀-.,!?▁_ﬁ\u200b\x00"
    some = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    some += ["".join(r.choice("thaenirsotion") for _ in range(r.randint(1, 40))) for _ in range(1500)]
    return some + ["x<|startoftext|>y <|endoftext|> z<|endoftext|", "aaaaaaaaa" * 50, "!!!!!!!!??????", "ABCDEF" * 300, "", " ", "\n", "▁ ▁▁a"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(library):
    counter, texts = T.WordCounts(WORDS), fuzz()
    assert [counter.count(t.encode()) for t in texts] == [library(t) for t in texts]


def test_counts_with_a_small_cache(library, monkeypatch):
    monkeypatch.setattr(T, "CACHE", 20)
    counter = T.WordCounts(WORDS)
    for t in fuzz()[:200]:
        assert counter.count(t.encode()) == library(t)


def test_truncation_by_brute_force(library):
    counter = T.WordCounts(WORDS)
    for text in ["don't stop, naïveté costs 1234 words", "a " * 9, "thonenstation " * 4 + "ende"]:
        data = text.encode()
        counts = counter.counts(data.split())
        starts = [i for i in range(len(text)) if not text[i].isspace() and (i == 0 or text[i - 1].isspace())] + [len(text)]
        for limit in range(sum(counts) + 1):
            assert counter.kept(data, counts, limit) == max(len(text[:i].encode()) for i in starts if library(text[:i]) <= limit)


def test_every_prefix_of_a_word(library):
    counter = T.WordCounts(WORDS)
    for word in ["thonenstationing", "internationalisation", "x" * 300, "!!??!!"]:
        assert counter.prefix_counts(word) == [library(word[:i]) for i in range(len(word) + 1)]


def test_query_over_whole_texts(spark, sf, library):
    rows = QUERIES["op2_token_counts"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), library(t), library(t) > 2048)
        if r["over_limit"]:
            assert library(t.encode()[:r["kept_bytes"]].decode()) <= 2048


def test_prefix_table_answers_without_encoding(spark, library):
    text = "one two threeeee don't 42"
    df = T.prefix_table(spark.createDataFrame([(1, text)], "doc_id int, text string"), WORDS)
    for budget in range(10):
        end = df.select(T.words_within(F.lit(budget))).first()[0]
        assert library(text[:end]) <= budget
    assert df.select(T.tokens_before(F.lit(7))).first()[0] == library("one two")


def test_messy_counts(messy, nothing, library):
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in T.count_tokens(messy, WORDS).collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"], library(r["text"] or "")) for r in messy.collect())
    assert T.count_tokens(nothing, WORDS).count() == 0 and T.prefix_table(nothing, WORDS).count() == 0


def test_pieces_equal_the_library():
    sp, model, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), V.Pieces(PIECES), fuzz()
    got = [V.ids_of(x) for x, _ in model.encode_all(texts)]
    assert got == sp.encode(texts)
    assert [model.decode(x) for x in got] == sp.decode(got)


def test_messy_pieces(messy, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = V.encode(messy, PIECES)
    assert sorted((r["n_pieces"], r["pieces"]) for r in out.collect()) == sorted((len(x), x) for x in (sp.encode(r["text"] or "") for r in messy.collect()))
    assert out.where("NOT round_trip").count() == 0
    back = V.decode(out, PIECES)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in messy.collect())
    assert V.encode(nothing, PIECES).count() == 0


def test_round_trip_looks_at_the_ids():
    model, texts = V.Pieces(PIECES), fuzz()
    assert [same for _, same in model.encode_all(texts)] == [model.decode(V.ids_of(x)) == t for t, (x, _) in zip(texts, model.encode_all(texts))]
    model.encode_all(["one two", "one  two"])
    model.spaced["two"] = model.known[2 * V.MARK + "two"] = model.spaced["one"]
    assert [same for _, same in model.encode_all(["one two", "one  two", "one"])] == [False, False, True]


def test_prefixes_inside_words(spark, library):
    counter, texts = T.WordCounts(WORDS), [t for t in fuzz()[::15] if len(t) < 100]
    texts += ["they're we'll 've", "x<|startoftext|>y<|endoftext|", "e\u0301a\u0301\u0323\u1100\u1161\u11a8x", "中文字" * 30, "İstanbulΣς\u00a0x"]
    for text in texts:
        data = text.encode()
        for m in T.SPACED.finditer(data):
            word = m.group().decode()
            ends = [len(word[:i].encode()) for i in range(1, len(word) + 1)]
            assert list(counter.prefixes(m.group())) == [(e, library(word[:i])) for i, e in enumerate(ends, 1)], word
        counts = counter.counts(data.split())
        for limit in {0, 1, 2, 5, sum(counts) // 2, sum(counts) - 1} & set(range(sum(counts))):
            end = counter.longest(data, counts, limit)
            assert end == max(len(text[:i].encode()) for i in range(len(text) + 1) if library(text[:i]) <= limit), (text, limit)
    long = "中文字" * 3000
    row = T.count_tokens(spark.createDataFrame([(1, long)], "doc_id int, text string"), WORDS).first()
    kept = long.encode()[:row["kept_bytes"]].decode()
    assert row["over_limit"] and library(kept) <= 2048 < library(long[:len(kept) + 1])
    df = T.prefix_table(spark.createDataFrame([(1, "one internationalisation")], "doc_id int, text string"), WORDS)
    for end in range(5, 25):
        assert df.select(T.tokens_before(F.lit(end))).first()[0] == library("one internationalisation"[:end])
