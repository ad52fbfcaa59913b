"""Byte-pair encoding as a forward pass over prefixes.

BPE gives every prefix of a word exactly one encoding, and a sequence of tokens
is that encoding exactly when every two neighbours in it are what BPE makes of
their joint text. So one left-to-right pass finds, for every prefix, its last
token: the only suffix token that may follow the last token of the remaining,
shorter prefix. It is a Viterbi pass whose transition scores are 0 or minus
infinity. What is known of a prefix depends on nothing after it, hence sorted
words can be walked like a trie, depth first, and share it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

#: Stands for "end of word" in token texts of vocabularies that mark it.
END = "\0"
#: Most entries of a cache in a worker; a full cache starts anew.
CACHE = 500_000


def unknown(words, known: dict) -> set:
    """The distinct words without an entry; its cost doesn't depend on the number of entries."""
    return {w for w in words if w not in known}


class Prefixes:
    """Encodings of prefixes for one vocabulary.

    ``ranks`` maps a pair of tokens (or, with ``by_text``, their joint text) to
    its merge rank; the smallest rank merges first, the leftmost of equals first.
    """

    def __init__(self, ranks: dict, tokens: set[str], by_text: bool):
        self.ranks, self.tokens, self.by_text = ranks, tokens, by_text
        self.longest = max((len(t) for t in tokens), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    @staticmethod
    def symbols(text: str) -> list[str]:
        if text.endswith(END) and len(text) > 1:
            return [*text[:-2], text[-2:]]
        return list(text)

    def merge(self, parts: list[str]) -> list[str]:
        """BPE as it is defined, for short texts: merge the best pair until none is left."""
        ranks, by_text = self.ranks, self.by_text
        parts = list(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1] if by_text else (parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether BPE turns the joint text of tokens ``a`` and ``b`` into these two."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.symbols(a) + self.symbols(b)) == [a, b]
        return known

    def alone(self, token: str) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.symbols(token)) == [token]
        return known

    def fits(self, a: str, b: str) -> bool:
        """Whether ``b`` may follow ``a``, or begin a word if ``a`` is empty."""
        return self.follows(a, b) if a else self.alone(b)

    def last_token(self, word: str, i: int, last: list[str], end: str = "") -> str:
        """The last token of ``word[:i]`` (with ``end`` appended), given those of all shorter prefixes."""
        for j in range(max(0, i - self.longest), i):
            t = word[j:i] + end
            if t in self.tokens and self.fits(last[j], t):
                return t
        raise ValueError(f"no token ends {word[:i]!r}")

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str], list[int]]]:
        """(word, last, count) for sorted words: per prefix length the last token and the number of tokens.

        The two lists are the path from the trie's root to the word; they are
        reused for the next word as far as both share a prefix.
        """
        last, count, before = [""], [0], ""
        tokens, pairs, longest = self.tokens, self.pairs, self.longest
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], count[shared + 1:]
            for i in range(shared + 1, len(word) + 1):
                # exactly one suffix token fits: most often the last token grown by a character
                grown = i - 1 - len(last[i - 1])
                t = word[grown:i]
                if not (t in tokens and (pairs.get((last[grown], t)) or self.fits(last[grown], t))):
                    for j in (*range(grown + 1, i), *range(grown - 1, i - longest - 1 if i > longest else -1, -1)):
                        t = word[j:i]
                        if t in tokens and (pairs.get((last[j], t)) or self.fits(last[j], t)):
                            break
                    else:
                        raise ValueError(f"no token ends {word[:i]!r}")
                last.append(t)
                count.append(count[i - len(t)] + 1)
            before = word
            yield word, last, count

    @staticmethod
    def path(last: list[str]) -> list[str]:
        """The tokens of the whole word, read back from its last one."""
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the others take the code
    points from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


def word_vocabulary(path: str) -> tuple[Prefixes, list[str]]:
    """Prefixes and special strings of a tokenizer file with end-of-word marks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    suffix = spec["model"]["end_of_word_suffix"]
    special = [t["content"] for t in spec["added_tokens"]]

    def text(t: str) -> str:
        return t[:-len(suffix)] + END if suffix and t.endswith(suffix) else t

    ranks = {}
    for i, m in enumerate(spec["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        ranks.setdefault((text(a), text(b)), i)
    tokens = {text(t) for t in spec["model"]["vocab"] if t not in special}
    return Prefixes(ranks, tokens, by_text=False), special
