"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Every document's tokens (runs of word characters, runs of other signs) and their
bigrams are hashed into ``BUCKETS`` classes. Two multinomials over the classes are counted
over all documents: one of the whole corpus, one of the trusted target (documents that
the strict rules of :func:`trusted` accept, or a given condition on them). A document's score is
its mean log ratio of target to corpus per n-gram; it is kept from ``THRESHOLD`` on. A
document like the corpus scores about 0 whatever its language; text that the target
hardly has scores far below.

Counts are summed per task before they are shuffled, one row per class; the model on
the driver is ``BUCKETS`` numbers, whatever the input's size. Log ratios are whole
millionths, so that sums, and with them the verdicts, don't depend on order.

Defined cases: a null, empty or blank text has no words and fails the base rules; texts
of any length are read whole; repeated rows count and are answered one by one; an empty
table gives an empty result; columns other than id and text are ignored (``keep`` passes
all columns on unchanged). Repeated windows are told by 64-bit hashes of eight words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .batches import pieces, two_columns

BUCKETS = 1 << 16
THRESHOLD = -0.25
MICRO = 1_000_000
WINDOW = 8
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff]+")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = ", ".join(f"{c} bigint" for c in BASE)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that begin a character of a word, and bytes that are symbols.
WORD_START = ((np.arange(256) & 0xC0) != 0x80) & ~_SPACE
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), list(range(65, 91)))
#: Odd multipliers that mix the word hashes of a window or a bigram.
ODD = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)]


def _mix(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` successive entries."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out += hashes[k:len(hashes) - n + 1 + k] * np.uint64(ODD[k])
    out ^= out >> np.uint64(29)
    return out


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``ends`` (the first segment starts at 0)."""
    up_to = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends]
    return np.diff(up_to, prepend=0)


def repeated_words(windows: np.ndarray) -> int:
    """Words covered by windows that occur at least twice."""
    if len(windows) < 2:
        return 0
    ordered = np.sort(windows)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    steps = np.zeros(len(windows) + WINDOW, np.int64)
    at = np.flatnonzero(np.isin(windows, twice))
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW, -1)
    return int((np.cumsum(steps) > 0).sum())


def analyse(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(base columns, buckets of all n-grams in order, end of each text's n-grams)."""
    split = [x.split() for x in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(n_words)
    size_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    base = {"n_words": n_words, "word_chars": _sums(WORD_START[raw], size_ends), "n_symbols": _sums(SYMBOL[raw], size_ends), "upper": _sums(UPPER[raw], size_ends)}
    dup = []
    for x in texts:
        lines = [line for line in x.split(b"\n") if line.strip()]
        dup.append(len(lines) - len(set(lines)))
    base["n_dup_lines"] = np.array(dup, np.int64)

    encoded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    ids, distinct = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
    of_word = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in distinct]), ">u8").astype(np.uint64)[ids] if distinct else np.zeros(0, np.uint64)
    repeats, start = [], 0
    for end in ends.tolist():
        repeats.append(repeated_words(_mix(of_word[start:end], WINDOW)) if end - start > WINDOW else 0)
        start = end
    base["n_repeat_words"] = np.array(repeats, np.int64)

    # the tokens of each distinct word, then of all words in order
    tokens = [TOKEN.findall(w) for w in distinct]
    per_word = np.fromiter(map(len, tokens), np.int64, len(tokens))
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(t) for ts in tokens for t in ts]), ">u8").astype(np.uint64)
    first = np.cumsum(per_word) - per_word
    counts = per_word[ids]
    token_ends = np.cumsum(counts)
    flat = hashes[np.repeat(first[ids] - (token_ends - counts), counts) + np.arange(int(counts.sum()))] if len(ids) else hashes[:0]
    text_ends = np.concatenate([[0], token_ends])[ends]
    grams = np.empty(2 * len(flat), np.uint64)  # each token, then its bigram with the next one of the text
    grams[0::2] = _mix(flat, 1)
    grams[1::2] = _mix(np.append(flat, np.uint64(0)), 2)
    last = text_ends[np.diff(text_ends, prepend=0) > 0] - 1
    grams[2 * last + 1] = grams[2 * last]  # the last token has no bigram: it counts twice
    return base, (grams >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1), 2 * text_ends


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])


def trusted(base: dict[str, np.ndarray]) -> np.ndarray:
    """The strict rules of the target: enough words, few symbols, capitals, repeats and no repeated lines."""
    return ~base_failed(base) & (20 * base["n_symbols"] <= base["n_words"]) & (base["n_dup_lines"] == 0) & (10 * base["n_repeat_words"] <= base["n_words"]) & (5 * base["upper"] <= base["word_chars"])


def fit(docs: DataFrame, text_col: str = "text", target=trusted) -> np.ndarray:
    """Log ratio of target to corpus of every bucket, in millionths; counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for _, texts in pieces(batches, "text"):
            base, grams, ends = analyse(texts)
            good = np.repeat(target(base), np.diff(ends, prepend=0))
            counts[0] += np.bincount(grams[good], minlength=BUCKETS)
            counts[1] += np.bincount(grams, minlength=BUCKETS)
        seen = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[0][seen]), pa.array(counts[1][seen])], ["bucket", "target", "corpus"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket int, target bigint, corpus bigint")
    sums = rows.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("corpus").alias("corpus")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[:, sums["bucket"].to_numpy(np.int64)] = sums[["target", "corpus"]].to_numpy(np.float64).T
    counts += 1
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    return np.round(ratio * MICRO).astype(np.int64)


def judge(texts: list[bytes], ratios: np.ndarray, threshold: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(base columns, base_failed, score, kept) of each text."""
    base, grams, ends = analyse(texts)
    n = np.diff(ends, prepend=0)
    score = _sums(ratios[grams], ends) / np.maximum(n, 1) / MICRO
    failed = base_failed(base)
    return base, failed, score, ~failed & (score >= threshold)


def score(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            base, failed, value, kept = judge(texts, ratios, threshold)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(base[c]) for c in BASE], pa.array(failed), pa.array(kept), pa.array(value)], ["doc_id", *BASE, "base_failed", "kept", "score"])

    rows = two_columns(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}, base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the rules and the ratio accept; the model is fitted on ``docs``."""
    ratios = fit(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, text_col):
            yield rows.filter(pa.array(judge(texts, ratios, threshold)[3]))

    return docs.mapInArrow(run, docs.schema)
