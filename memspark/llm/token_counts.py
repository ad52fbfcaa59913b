"""Token counts: exact counts at every prefix of a text by prefix dynamic programming.

The vocabulary drops white space, so a text's count is the sum over its
space-separated words, and the count of a prefix is a running sum plus the count
of the cut word's prefix. Word counts come from :class:`bpe.Prefixes`: the
distinct unseen words of a piece of the input are sorted and walked as a trie, so
that shared prefixes are worked out once. Truncation and budget questions are
then look-ups in the running sums; nothing is encoded again.

Defined cases: a null or blank text has no tokens; a text of any length is worked
on whole; repeated rows give repeated results; an empty table an empty result;
columns other than id and text are ignored. Special strings inside a text count
as one token each, as the tokenizer library does by default.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .batches import pieces, two_columns
from .bpe import CACHE, END, byte_characters, unknown, word_vocabulary

#: The pre-tokenizer's pattern, for ASCII texts and for all others.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\p{Z}\p{L}\p{N}]+")
SPACED = re.compile(rb"[^\x20\t-\r]+")


class WordCounts:
    """Counts of space-separated words and of their prefixes, remembered within a worker."""

    def __init__(self, path: str):
        self.bpe, special = word_vocabulary(path)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.bytes = "".join(byte_characters())
        self.words: dict[str, int] = {}
        self.spaced: dict[bytes, int] = {}

    def characters(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.bytes)

    def parts(self, raw: bytes) -> tuple[list[str], int]:
        """(words of the vocabulary's pre-tokenizer in byte characters, special strings) in ``raw``."""
        text = raw.decode("utf-8", "replace")
        specials, runs = 0, [text]
        if self.special and "<|" in text:
            runs = self.special.split(text)
            specials = len(runs) // 2
            runs = runs[::2]
        out: list[str] = []
        for run in runs:
            if run.isascii():
                found = ASCII_WORDS.findall(run.lower())
                if not run.isprintable():
                    found = [self.characters(w) for w in found]
            else:
                if not unicodedata.is_normalized("NFC", run):
                    run = unicodedata.normalize("NFC", run)
                # a final capital sigma has no lower case of its own in the vocabulary's rules
                lower = "".join(c.lower() for c in run) if "Σ" in run else run.lower()
                found = [self.characters(w) for w in WORDS.findall(lower)]
            out += found
        return out, specials

    def learn(self, spaced: set[bytes]) -> None:
        """Store the counts of new space-separated words, sharing the work on common prefixes."""
        split = {raw: self.parts(raw) for raw in spaced}
        fresh = sorted({w for words, _ in split.values() for w in words if w not in self.words})
        if len(self.words) > CACHE:
            self.words = {}
            fresh = sorted({w for words, _ in split.values() for w in words})
        for word, last, count in self.bpe.walk(fresh):
            t = self.bpe.last_token(word, len(word), last, END)
            self.words[word] = count[len(word) - len(t) + 1] + 1
        for raw, (words, specials) in split.items():
            self.spaced[raw] = specials + sum(map(self.words.__getitem__, words))

    def counts(self, words: list[bytes]) -> list[int]:
        if fresh := unknown(words, self.spaced):
            self.learn(fresh)
        return list(map(self.spaced.__getitem__, words))

    def count(self, raw: bytes) -> int:
        return sum(self.counts(raw.split()))

    def prefix_counts(self, word: str) -> list[int]:
        """Exact counts of all prefixes of one word (of the pre-tokenizer, in byte characters), the empty one first."""
        (_, last, count), = self.bpe.walk([word])
        return [0] + [count[i - len(self.bpe.last_token(word, i, last, END)) + 1] + 1 for i in range(1, len(word) + 1)]

    @staticmethod
    def kept(data: bytes, counts: list[int], limit: int) -> int:
        """Bytes up to the first word that would exceed ``limit`` tokens: a look-up in the running sums."""
        k = bisect_right(list(accumulate(counts)), limit)
        if k == len(counts):
            return len(data)
        return next(islice(SPACED.finditer(data), k, None)).start()

    def run_prefixes(self, run: str, budget: int | None) -> Iterator[tuple[int, int]]:
        """(characters, exact count) of the prefixes of a text without special strings, until no longer one fits ``budget``."""
        longest = self.bpe.longest
        if not unicodedata.is_normalized("NFC", run):
            # a combining mark changes the character before it, so a prefix is not always one of the normalised text
            for j in range(1, len(run) + 1):
                words, _ = self.parts(run[:j].encode())
                if budget is not None and sum(map(len, words)) > budget * longest:
                    return
                yield j, sum(self.prefix_counts(w)[-1] for w in words)
            return
        lower = [c.lower() for c in run]
        at, j, base = list(accumulate(map(len, lower), initial=0)), 1, 0
        for m in WORDS.finditer("".join(lower)):
            if budget is not None and base > budget:
                return
            (start, end), word = m.span(), m.group()
            while j < len(at) and at[j] <= start:
                yield j, base
                j += 1
            data = self.characters(word)
            cap = len(data) if budget is None else (budget - base + 1) * longest
            counts = self.prefix_counts(data[:cap])
            sizes = list(accumulate((len(c.encode()) for c in word), initial=0))
            while j < len(at) and at[j] <= end:
                k = at[j] - start
                if sizes[k] >= len(counts):
                    return
                # half a contraction is an apostrophe and a letter
                half = k == 2 and len(word) == 3 and word in ("'re", "'ve", "'ll")
                yield j, base + (self.prefix_counts("'")[-1] + self.prefix_counts(word[1])[-1] if half else counts[sizes[k]])
                j += 1
            if len(counts) <= len(data):
                return
            base += counts[-1]
        for j in range(j, len(at)):
            yield j, base

    def prefixes(self, raw: bytes, budget: int | None = None) -> Iterator[tuple[int, int]]:
        """(bytes, exact count) of the prefixes (whole characters) of one space-separated word, until no longer one fits ``budget``."""
        text = raw.decode("utf-8", "replace")
        if text.encode() != raw:  # broken UTF-8
            for j in range(1, len(raw) + 1):
                if j == len(raw) or raw[j] & 0xC0 != 0x80:
                    words, specials = self.parts(raw[:j])
                    yield j, specials + sum(self.prefix_counts(w)[-1] for w in words)
            return
        split = self.special.split(text) if self.special and "<|" in text else [text]
        offset = base = 0
        for run, special in zip(split[::2], [*split[1::2], ""]):
            # up to its last character a special string is plain text
            plain = run + special[:-1]
            ends = list(accumulate((len(c.encode()) for c in plain), initial=offset))
            reached = of_run = 0
            for reached, n in self.run_prefixes(plain, None if budget is None else budget - base):
                yield ends[reached], base + n
                if reached == len(run):
                    of_run = n
            if special:
                if reached < len(run):
                    return
                base += of_run + 1
                offset = ends[-1] + 1
                yield offset, base
                if budget is not None and base > budget:
                    return

    def longest(self, data: bytes, counts: list[int], limit: int) -> int:
        """Bytes of the longest prefix (whole characters) within ``limit`` tokens: only the word at the cut is looked into."""
        start = self.kept(data, counts, limit)
        if start == len(data):
            return start
        sums = list(accumulate(counts, initial=0))
        left = limit - sums[bisect_right(sums, limit) - 1]
        return start + max((end for end, n in self.prefixes(SPACED.match(data, start).group(), left) if n <= left), default=0)


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def _documents(batches, path):
    counter = word_counts(path)
    for rows, texts in pieces(batches, "text"):
        split = [x.split() for x in texts]
        if len(counter.spaced) > CACHE:
            counter.spaced = {}
        if fresh := unknown(set().union(*split), counter.spaced):
            counter.learn(fresh)
        yield counter, rows.column(0), texts, split


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, kept_bytes) of every document.

    ``kept_bytes`` is the length of the longest prefix of whole characters within ``limit`` tokens. One pass
    over the scan, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counter, ids, texts, split in _documents(batches, path):
            known, total, kept = counter.spaced, [], []
            for data, words in zip(texts, split):
                total.append(sum(map(known.__getitem__, words)))
            for data, words, n in zip(texts, split, total):
                kept.append(len(data) if n <= limit else counter.longest(data, counter.counts(words), limit))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, texts)), pa.int64()), pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_()), pa.array(kept, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_bytes"])

    rows = two_columns(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, kept_bytes bigint")


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ends, counts): after each character of a word, the byte offset and the exact token count up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counter, ids, texts, split in _documents(batches, path):
            ends, sums = [], []
            for data, words in zip(texts, split):
                found = [(m.start() + end, before + n) for m, before in zip(SPACED.finditer(data), accumulate(counter.counts(words), initial=0)) for end, n in counter.prefixes(m.group())]
                ends.append([end for end, _ in found])
                sums.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays([ids, pa.array(ends, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "ends", "counts"])

    rows = two_columns(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ends array<bigint>, counts array<bigint>")


def tokens_before(end: Column, ends: str = "ends", counts: str = "counts") -> Column:
    """Tokens of the whole characters that end by byte ``end``: a look-up in a prefix table."""
    k = F.size(F.filter(ends, lambda e: e <= end))
    return F.when(k > 0, F.element_at(counts, k)).otherwise(F.lit(0).cast("bigint"))


def words_within(budget: Column, ends: str = "ends", counts: str = "counts") -> Column:
    """Byte offset after the last character of a word up to which ``budget`` tokens suffice: a look-up in a prefix table."""
    # a longer prefix of a word may have fewer tokens, so the last that fits is asked for
    fits = F.transform(F.arrays_zip(F.col(ends).alias("e"), F.col(counts).alias("n")), lambda x: F.when(x["n"] <= budget, x["e"]))
    return F.coalesce(F.array_max(fits), F.lit(0).cast("bigint"))
