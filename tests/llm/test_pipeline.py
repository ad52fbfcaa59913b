import public_tokenizers
import sentencepiece

import corpus_pipeline as C
from memspark.llm import decontaminate, quality_rules, simhash_dedup, toxicity
from memspark.llm.batches import read


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_each_stage_does_what_its_operator_says(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents").cache()
    columns = docs.columns
    kept = C.drop_toxic(spark, docs, sf).cache()
    assert ids(kept) == ids(toxicity.score(docs, toxicity.fit(docs, read(spark, sf, "labels"))).where("predicted = 0"))
    good = C.drop_low_quality(spark, kept, sf).cache()
    assert ids(good) == ids(quality_rules.score(kept, quality_rules.fit(kept)).where("kept"))
    single = C.drop_near_duplicates(spark, good, sf).cache()
    assert ids(single) == sorted({r["component_id"] for r in simhash_dedup.near_duplicates(good).collect()})
    fair = C.drop_contaminated(spark, single, sf).cache()
    leaks = {r["doc_id"] for r in decontaminate.leaks(single, read(spark, sf, "benchmark")).collect()}
    assert ids(fair) == [i for i in ids(single) if i not in leaks]
    assert all(df.columns == columns for df in (kept, good, single, fair))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in fair.collect()}
    out = {r["doc_id"]: r["pieces"] for r in C.encode_pieces(spark, fair, sf).collect()}
    assert out == {i: sp.encode(t) for i, t in texts.items()}
    assert sorted(out) == ids(C.run(spark, sf))


def test_messy_and_empty_tables(spark, messy, nothing, sf):
    for docs in (messy, nothing):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert C.encode_pieces(spark, docs, sf).count() == docs.count()


def test_stage_names_and_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality rules", "near-duplicates", "decontamination", "sentencepiece"]
