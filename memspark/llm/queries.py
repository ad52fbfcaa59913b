"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, merkle, quality_cnn, quality_rules, shards, toxicity, url_filter, vector_codes, warc
from .batches import read
from .sentencepiece_viterbi import encode
from .simhash_dedup import near_duplicates
from .token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    """Tokens of every whole text, and how much of it fits into 2,048 tokens."""
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    """Piece ids of every whole text, and whether they decode to it again."""
    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_simhash_dedup")
def op5_simhash_dedup(spark, sf_dir):
    """SimHash of every whole text and the component of near copies it belongs to."""
    return near_duplicates(read(spark, sf_dir, "documents"), size=4)


@query("op9_url_filter", url_filter.oracle())
def op9_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every page's URL."""
    return url_filter.judge(read(spark, sf_dir, "pages"))


@query("op7_warc", warc.oracle())
def op7_warc(spark, sf_dir):
    """Write every page into archives, read the archives back."""
    root = warc.archive_folder(spark)
    manifest = warc.write_archives(read(spark, sf_dir, "pages"), root)
    return warc.read_archives(manifest, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    """Base rules and the n-gram ratio's verdict on every whole text."""
    docs = read(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.fit(docs))


@query("op6_quality_cnn")
def op6_quality_cnn(spark, sf_dir):
    """Quality of every whole text by the byte-level network."""
    docs = read(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.fit(docs, read(spark, sf_dir, "labels")))


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    """Toxicity of every whole text by the weakly supervised classifier."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@query("op3_decontaminate")
def op3_decontaminate(spark, sf_dir):
    """Documents that hold a benchmark item, verbatim or rephrased."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op8_chat_format")
def op8_chat_format(spark, sf_dir):
    """Every conversation as a raw transcript, parsed back into turns and rendered."""
    return chat_format.parse(chat_format.raw_transcripts(read(spark, sf_dir, "conversations")))


@query("op11_jump_shards", shards.oracle(24))
def op11_jump_shards(spark, sf_dir):
    """Shard and slot of every document among 24 shards, and its shard among 25."""
    return shards.place(read(spark, sf_dir, "documents"), 24)


@query("op12_vector_codes", vector_codes.oracle())
def op12_vector_codes(spark, sf_dir):
    """Code of every whole vector, its error and the codebooks' digest."""
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))[0]


@query("op13_merkle_manifest", merkle.oracle())
def op13_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and what the proof says of tampered ones."""
    docs = read(spark, sf_dir, "documents")
    changed = {"text": merkle.without_newlines("doc_id", "text")}
    return merkle.check(merkle.manifest(docs, "doc_id", "source", merkle.DOCUMENT_FIELDS, changed=changed), "doc_id")
