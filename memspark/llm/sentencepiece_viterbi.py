"""SentencePiece encoding and decoding by a Viterbi pass with shared prefixes.

White space is marked, the text is cut into marked words, and the distinct unseen
words of a piece of the input are sorted and walked as a trie: the forward pass
over a common prefix is done once. The public model at hand is a BPE model whose
piece scores order merges, so the best path under the model is the one whose
neighbouring pieces are all BPE neighbours (see :mod:`bpe`); transition scores
are therefore 0 or minus infinity instead of sums of log-probabilities. Pieces
never cross from text into a new mark, characters without a piece fall back to
bytes and never merge, so cutting there changes nothing.

Defined cases: a null or empty text has no pieces; texts of any length are encoded
whole; repeated rows give repeated results; an empty table an empty result;
columns other than id and text are ignored. Decoding gives the normalised text
(the model's own mark character turns into a space, as in the public library).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import pieces, two_columns
from .bpe import CACHE, Prefixes, unknown

MARK = "▁"
#: Marked words: a run of marks with the text up to the next mark or line end, or a line end alone.
MARKED = re.compile("\n|" + MARK + "+[^" + MARK + "\n]*|[^" + MARK + "\n]+")


def ids_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<i4").tolist()


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = sp.id_to_piece(list(range(size)))
        odd = {i for i in range(size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.id = {names[i]: i for i in range(size) if i not in odd}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # byte pieces give their byte, all others their text with marks as spaces
        self.text = [n.replace(MARK, " ").encode() for n in names]
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.specials = {i for i in odd if not sp.is_byte(i)}
        order = sorted(self.id.values(), key=lambda i: (-sp.get_score(i), i))
        self.bpe = Prefixes({names[i]: r for r, i in enumerate(order)}, set(self.id), by_text=True)
        self.known: dict[str, bytes] = {}  # marked word -> its piece ids, four bytes each
        self.spaced: dict[str, bytes] = {}  # the same by what stands between spaces
        self.packed = {t: np.array([i], "<i4").tobytes() for t, i in self.id.items()}
        self.packed_bytes = [np.array([i], "<i4").tobytes() for i in self.byte]
        # bytes that each id decodes to; specials give nothing
        self.table = pa.array([b"" if i in self.specials else t for i, t in enumerate(self.text)], pa.large_binary())

    def runs(self, word: str) -> list[tuple[str, bool]]:
        """(run, whether its characters have pieces) of a word."""
        out: list[tuple[str, bool]] = []
        for c in word:
            has = c in self.id
            if out and out[-1][1] and has:
                out[-1] = (out[-1][0] + c, True)
            else:
                out.append((c, has))
        return out

    def learn(self, words: set[str]) -> None:
        plain, mixed = [], {}
        for w in words:
            if all(map(self.id.__contains__, w)):
                plain.append(w)
            else:
                mixed[w] = self.runs(w)
        plain = sorted({*plain, *(r for runs in mixed.values() for r, has in runs if has)})
        ids = self.id
        packed = self.packed
        for word, last, _ in self.bpe.walk(plain):
            self.known[word] = b"".join([packed[t] for t in self.bpe.path(last)])
        for w, runs in mixed.items():
            self.known[w] = b"".join([self.known[r] if has else b"".join([self.packed_bytes[b] for b in r.encode("utf-8", "surrogatepass")]) for r, has in runs])

    @staticmethod
    def words(text: str) -> list[str]:
        return MARKED.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(piece ids of four bytes each, whether they decode to the text) of each text."""
        if len(self.known) > CACHE:
            self.known, self.spaced = {}, {}
        # a text without runs of spaces is cut at its spaces; a line end sticks to what follows it, told by a doubled line end
        simple = [bool(t) and "  " not in t and MARK not in t and t[0] != " " for t in texts]
        split = [t.replace("\n", " \n\n").split(" ") if easy else self.words(t) for t, easy in zip(texts, simple)]
        easy = unknown((w for ws, e in zip(split, simple) if e for w in ws), self.spaced)
        marked = {w: "\n" + w[2:] if w[:2] == "\n\n" else MARK + w for w in easy}
        if fresh := unknown([*marked.values(), *(w for ws, e in zip(split, simple) if not e for w in ws)], self.known):
            self.learn(fresh)
        self.spaced.update((w, self.known[m]) for w, m in marked.items())
        out = [b"".join(map((self.spaced if e else self.known).__getitem__, words)) for words, e in zip(split, simple)]
        return list(zip(out, self.round_trips(out, texts)))

    def round_trips(self, packed: list[bytes], texts: list[str]) -> list[bool]:
        """Whether the ids of each text decode to it: all ids are decoded at once and the bytes compared."""
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)])
        decoded = self.table.take(pa.array(np.frombuffer(b"".join(packed), "<i4")))
        _, offsets, data = decoded.buffers()
        at = (np.frombuffer(offsets, np.int64)[decoded.offset:decoded.offset + len(decoded) + 1][ends] if len(decoded) else np.zeros(len(ends), np.int64)).tolist()
        whole = memoryview(data or b"")
        out = []
        for ids, text, start, end in zip(packed, texts, at, at[1:]):
            lead = start + (whole[start:start + 1] == b" " and start < end)
            # bytes that are no UTF-8 differ here and may still decode to the text
            out.append(whole[lead:end] == text.encode("utf-8", "surrogatepass") or self.decode(ids_of(ids)) == text)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces without the leading space that encoding added; specials give nothing."""
        data = b"".join([self.text[i] for i in ids if i not in self.specials])
        return data.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, round_trip, pieces) of every document.

    ``round_trip`` says whether decoding gives the text back (false where the text
    itself holds the mark character). One pass over the scan, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        of_byte = np.zeros(len(model.text), bool)
        of_byte[model.byte] = True
        for rows, texts in pieces(batches, "text"):
            packed, same = zip(*model.encode_all([x.decode("utf-8", "replace") for x in texts]))
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            flat = np.frombuffer(b"".join(packed), "<i4")
            ends = np.concatenate([[0], np.cumsum(sizes)])
            bytes_up_to = np.concatenate([[0], np.cumsum(of_byte[flat])])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes), pa.array(bytes_up_to[ends[1:]] - bytes_up_to[ends[:-1]], pa.int64()), pa.array(same, pa.bool_()),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "n_pieces", "n_byte_pieces", "round_trip", "pieces"])

    rows = two_columns(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces bigint, n_byte_pieces bigint, round_trip boolean, pieces array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(doc_id, text) from piece ids; a null list gives an empty text."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{pieces_col}`").alias("pieces"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
