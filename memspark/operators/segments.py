"""A written positional index that is kept in step with its table.

An append writes a segment: postings of tokens, of adjacent pairs of tokens and of words split on
white space, the trigrams of the distinct words, and the documents' lengths. A delete writes a tombstone table; an update is both in one commit. A merge
rewrites the segments of one size class as one, without what tombstones hide. What counts
is the manifest's last version, one file that is written after all else: a half-written
segment is never seen, and of two writers that commit the same version the second gets an error.

Postings are lists: a row holds a unit and up to ``RUN`` of its documents (of pairs: of its places) with their numbers, as packed
``ENTRY`` records where ids are bigint (writing them as nested columns took most of the index's time), else as an array. Tasks
turn blocks of documents into sorted lists and cut them at the bounds of the pieces; what is shuffled is one row for each block and
piece, and the task of a piece joins the lists of its blocks. A row of the trigrams holds one and its words of a block as one text (words have no blanks). Pieces are ranges of units, by the measured number of tokens. Of every
piece the first and last unit are kept (its zone; the first row of a piece carries the last unit). A search opens only the pieces whose zones
hold a searched unit, and pushes the units to the scan, which skips pages. Beyond ``PUSHED``
searched units all pieces are joined instead.

Corpus statistics are sums of the manifest's numbers: a tombstone table carries how many documents and
tokens it hides. Defined cases: an empty table makes an empty segment; a null text has no units and length 0; a null
id can't be deleted or updated; ``append`` takes new ids (of a known id both rows would count), ``upsert`` any;
repeated ids within one table are rows of their own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from ..functions.text import words_ws
from ..session import cut, local_table, run_dir
from . import index as I

#: Tokens of a piece, on average; a task holds one. The bounds are taken from about so many documents, and so many units of a block.
PIECE_TOKENS, SAMPLE_DOCS, SAMPLE_UNITS = 4_000_000, 2_000, 4_000
#: Tokens that a task turns into lists at a time (a longer document is a block of its own), entries of one list, and entries given back at once.
BLOCK_TOKENS, RUN, GIVEN = 2_000_000, 256, 200_000
#: Words whose trigrams a task sorts at a time, bytes of their lists, and words that the bounds of the trigrams' pieces are taken from, about.
GRAM_WORDS, GRAM_BYTES, SAMPLE_WORDS = 200_000, 64 << 20, 20_000
#: Searched units that choose the pieces, and those that the scan gets one by one to skip pages (of more it gets their range).
PUSHED, PAGED = 10_000, 200
#: Segments of one size class that a merge takes together, and how much larger the next class is.
FAN_IN = 8
#: What an index may hold: ``words`` bring the trigrams of the distinct words with them.
KINDS = ("tokens", "pairs", "words")
MANIFEST = "version bigint, commit string, kind string, name string, seq bigint, docs bigint, tokens bigint, chars bigint"
ROW = ["kind", "name", "seq", "docs", "tokens", "chars"]
ZONES = "segment string, kind string, file string, first string, last string"
#: A packed entry of a list; a null id has ``dl`` as its complement, below 0.
ENTRY = np.dtype([("id", "<i8"), ("dl", "<i4"), ("value", "<i4")])


class Index:
    """``stats`` and ``hits`` answer searches; ``append``, ``upsert``, ``delete`` and ``merge`` keep it up."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(PAGED))
        self.refresh()

    @classmethod
    def create(cls, spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS) -> Index:
        """An index of nothing that will hold ``kinds``."""
        _write_manifest(spark, path, 0, uuid.uuid4().hex, kinds, [])
        return cls(spark, path)

    @classmethod
    def write(cls, df: DataFrame, id_: str, text: str, path: str, kinds: tuple[str, ...] = KINDS) -> Index:
        """An index of one table."""
        return cls.create(df.sparkSession, path, kinds).append(df, id_, text)

    def refresh(self) -> Index:
        """Read the last committed version; a writer that lost the race for it is passed over."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()
        self.version = max(r["version"] for r in rows)
        self.commit = min(r["commit"] for r in rows if r["version"] == self.version)
        live = [r for r in rows if r["version"] == self.version and r["commit"] == self.commit]
        self.kinds = tuple(next(r["name"] for r in live if r["kind"] == "version").split(","))
        self.segments = sorted((tuple(r[c] for c in ROW) for r in live if r["kind"] == "segment"), key=lambda s: (s[2], s[1]))
        self.tombstones = sorted((tuple(r[c] for c in ROW) for r in live if r["kind"] == "tombstones"), key=lambda s: (s[2], s[1]))
        return self

    # --- what searches read ---------------------------------------------------------

    @property
    def n_docs(self) -> int:
        return sum(s[3] for s in self.segments) - sum(t[3] for t in self.tombstones)

    @property
    def stats(self) -> DataFrame:
        """One row: documents, their mean number of tokens and of characters."""
        n = self.n_docs
        tokens, chars = [sum(s[i] for s in self.segments) - sum(t[i] for t in self.tombstones) for i in (4, 5)]
        return local_table(self.spark, [(n, tokens / n if n else None, chars / n if n else None)], ["n_docs", "avgdl", "avgchars"])

    def docs(self) -> DataFrame:
        """(id, dl, chars) of every live document."""
        return self._live(self._union([self._table(s, "docs") for s in self.segments]))

    def postings(self, kind: str, units: DataFrame | None = None, *columns: str) -> DataFrame:
        """(unit, id, tf[, columns]) of the live documents, for ``units(unit)`` or all; kind: tokens, pairs or words."""
        wanted = None if units is None else self._wanted(units)
        if kind != "pairs":
            return self._postings(kind, wanted, units, ["tf", *columns])
        return self._postings(kind, wanted, units, columns).groupBy("unit", "id", *columns).agg(F.count("*").alias("tf")).select("unit", "id", "tf", *columns)

    def hits(self, phrases: DataFrame) -> DataFrame:
        """(phrase, id, dl, tf): how often each phrase occurs, its tokens adjacent and in order."""
        units = I.phrase_units(phrases)
        wanted = self._wanted(units)
        by = ["phrase", "id", "dl"]
        out = None
        for kind in ("tokens", "pairs"):
            mine = units.where(F.contains("unit", F.lit(" ")) == (kind == "pairs"))
            some = None if wanted is None else [u for u in wanted if (" " in u) == (kind == "pairs")]
            if some == []:
                continue
            if kind == "tokens":
                part = self._postings(kind, some, mine, ["tf", "dl"]).join(mine, "unit").select(*by, "tf")
            else:
                found = self._postings(kind, some, mine, ["dl", "pos"]).join(mine, "unit")
                starts = found.where("need > 1").groupBy(*by, "need", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("c")).where("c = need")
                part = found.where("need = 1").select(*by).unionByName(starts.select(*by)).groupBy(*by).agg(F.count("*").alias("tf"))
            out = part if out is None else out.unionByName(part)
        if out is None:  # no phrase has a token
            return self.docs().where("false").select(F.lit("").alias("phrase"), "id", "dl", F.lit(0).cast("bigint").alias("tf"))
        return out

    def word_postings(self, words: DataFrame) -> DataFrame:
        """(id, word, tf) of ``words(word)``: lower-cased, split on white space."""
        return self.postings("words", words.select(F.col("word").alias("unit"))).select("id", F.col("unit").alias("word"), "tf")

    def vocabulary(self) -> DataFrame:
        """(word): every word of a segment; one that is only in buried documents may be among them."""
        words = self._union([self._table(s, "vocabulary") for s in self.segments]).select("word")
        return words.distinct() if len(self.segments) > 1 else words

    def grams(self, wanted: DataFrame) -> DataFrame:
        """(gram, word) of the trigrams ``wanted(gram)``, over the distinct words."""
        units = wanted.select(F.col("gram").alias("unit"))
        found = self._read("grams", self._wanted(units), units, ["word"]).select(F.col("unit").alias("gram"), "word")
        return found.distinct() if len(self.segments) > 1 else found

    # --- upkeep -----------------------------------------------------------------------

    def append(self, df: DataFrame, id_: str, text: str) -> Index:
        """Add documents with new ids."""
        return self._commit([*self.segments, *self.tombstones, self._segment(df, id_, text, self.version + 1)])

    def upsert(self, df: DataFrame, id_: str, text: str) -> Index:
        """Add documents, in place of those that have their ids."""
        gone = self._bury(df.select(F.col(id_).alias("id")), self.version + 1)
        return self._commit([*self.segments, *self.tombstones, *gone, self._segment(df, id_, text, self.version + 1)])

    def delete(self, ids: DataFrame) -> Index:
        """Remove the documents of ``ids(id)``; unknown ids are ignored."""
        gone = self._bury(ids.select("id"), self.version + 1)
        return self._commit([*self.segments, *self.tombstones, *gone]) if gone else self

    def merge(self, fan_in: int = FAN_IN) -> Index:
        """Rewrite each size class that has ``fan_in`` segments as one segment; ``fan_in`` 1 makes one of all."""
        classes: dict[int, list] = {}
        for s in self.segments:
            classes.setdefault(0 if fan_in == 1 else int(np.log(max(1, s[4])) / np.log(FAN_IN)), []).append(s)
        taken = [c for c in classes.values() if len(c) >= max(fan_in, 2) or fan_in == 1 and (len(c) > 1 or self.tombstones)]
        if not taken:
            return self
        kept = [s for s in self.segments if not any(s in c for c in taken)]
        made = [self._merged(c, f"{self.version + 1:08d}-{k}-{uuid.uuid4().hex[:8]}") for k, c in enumerate(taken)]
        # a tombstone table goes on as long as a segment older than it does; what it hid in the merged ones is taken off its numbers
        tombs = []
        for t in self.tombstones:
            if any(s[2] < t[2] for s in kept):
                rest = self._hidden(t, [s for s in kept if s[2] < t[2]])
                tombs.append((*t[:3], *rest))
        return self._commit([*kept, *made, *tombs])

    def widen(self, df: DataFrame, id_: str, text: str, kinds: tuple[str, ...]) -> Index:
        """Add the kinds that an index of one table ``df`` does not hold yet."""
        more = tuple(k for k in kinds if k not in self.kinds)
        if not more:
            return self
        if len(self.segments) != 1 or self.tombstones:
            raise ValueError("kinds can be added to an index of one segment only")
        name, tokens = self.segments[0][1], self.segments[0][4]
        self._write_kinds(name, tokens, self._sources(name, _body(df, id_, text), more))
        self.kinds = tuple(k for k in KINDS if k in (*self.kinds, *more))
        return self._commit(self.segments)

    # --- inside -----------------------------------------------------------------------

    def _table(self, row: tuple, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{row[0]}s/{row[1]}/{name}" if row[0] == "segment" else f"{self.path}/{row[0]}/{row[1]}").withColumn("seq", F.lit(row[2]))

    def _union(self, tables: list[DataFrame]) -> DataFrame:
        if not tables:
            raise ValueError("the index has no segment yet")
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, seq, ...) that no later tombstone hides, without ``seq``."""
        if not self.tombstones:
            return rows.drop("seq")
        dead = self._union([self._table(t, "") for t in self.tombstones]).groupBy("id").agg(F.max("seq").alias("_dead"))
        return rows.join(dead, "id", "left").where("_dead IS NULL OR seq >= _dead").drop("seq", "_dead")

    def _wanted(self, units: DataFrame) -> list[str] | None:
        """The distinct units if they are few enough to push to the scan."""
        some = [r[0] for r in units.select("unit").distinct().limit(PUSHED + 1).collect()]
        return None if len(some) > PUSHED else sorted(some)

    def _postings(self, kind: str, wanted: list[str] | None, units: DataFrame | None, columns) -> DataFrame:
        return self._live(self._read(kind, wanted, units, ["id", *columns]))

    def _read(self, kind: str, wanted: list[str] | None, units: DataFrame | None, columns: list[str]) -> DataFrame:
        """(unit, columns, seq) of the searched units, or of all, with what tombstones hide."""
        files = self._pieces(kind, wanted)
        tables = []
        for s in self.segments:
            folder = f"{self.path}/segments/{s[1]}/{kind}"
            mine = [f"{folder}/{f}" for f in files.get(s[1], [])] if wanted is not None else [folder]
            if mine:
                tables.append(self.spark.read.schema(self._schema(kind)).parquet(*mine).withColumn("seq", F.lit(s[2]).cast("bigint")))
        if tables:
            rows = self._union(tables)
        else:  # no piece may hold a searched unit
            rows = self.spark.createDataFrame([], self._schema(kind)).withColumn("seq", F.lit(0).cast("bigint"))
        if wanted is not None:
            rows = rows.where(F.col("unit").isin(wanted))
        elif units is not None:
            rows = rows.join(units.select("unit").distinct(), "unit", "left_semi")
        if kind == "grams":
            return rows.select("unit", F.explode(F.split("at", " ")).alias("word"), "seq")
        return self._entries(rows, kind, columns)

    def _entries(self, rows: DataFrame, kind: str, columns: list[str]) -> DataFrame:
        """(unit, columns, seq): a row for each entry of the lists."""
        packed = isinstance(self._schema(kind)["at"].dataType, BinaryType)
        if not packed:
            return rows.select("unit", "seq", F.explode("at").alias("e")).select("unit", *[f"e.{c}" for c in columns], "seq")
        types = {"id": ("bigint", pa.int64()), "dl": ("bigint", pa.int64()), "tf": ("bigint", pa.int64()), "pos": ("int", pa.int32())}

        def unpacked(batches):
            for batch in batches:
                at, n = _flat(batch.column(1))
                ends = np.cumsum(n)
                first = 0
                while first < len(n):  # about GIVEN entries at a time
                    begin = int(ends[first - 1]) if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, begin + GIVEN, side="right")))
                    some, row = at[begin:ends[last - 1]], pa.array(np.repeat(np.arange(first, last), n[first:last]))
                    null = some["dl"] < 0
                    value = {"id": lambda: (some["id"], null), "dl": lambda: (np.where(null, ~some["dl"], some["dl"]), None)}
                    made = [pa.array(np.ascontiguousarray(v), types[c][1], mask=mask) for c in columns for v, mask in [value.get(c, lambda: (some["value"], None))()]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *made, batch.column(2).take(row)], ["unit", *columns, "seq"])
                    first = last

        return rows.select("unit", "at", "seq").mapInArrow(unpacked, ", ".join(["unit string", *[f"{c} {types[c][0]}" for c in columns], "seq bigint"]))

    def _schema(self, kind: str):
        if not hasattr(self, "_schemas"):
            self._schemas = {}
        if kind not in self._schemas:
            self._schemas[kind] = self.spark.read.parquet(f"{self.path}/segments/{self.segments[0][1]}/{kind}").schema
        return self._schemas[kind]

    def _pieces(self, kind: str, wanted: list[str] | None) -> dict[str, list[str]]:
        """Files, by segment, whose zones hold a searched unit: at most about one per unit and segment, and those of hot units."""
        if wanted is None or not self.segments:
            return {}
        names, sorted_units = [s[1] for s in self.segments], np.array(wanted, dtype=object)

        @F.pandas_udf("boolean")
        def holds(first: pd.Series, last: pd.Series) -> pd.Series:
            at = np.searchsorted(sorted_units, first.to_numpy(object))
            return pd.Series([a < len(sorted_units) and sorted_units[a] <= e for a, e in zip(at, last)], dtype=bool)

        zones = self.spark.read.schema(ZONES).parquet(*[f"{self.path}/segments/{n}/zones" for n in names]).where(F.col("kind") == kind)
        out: dict[str, list[str]] = {}
        for r in zones.where(holds("first", "last")).select("segment", "file").collect():
            out.setdefault(r["segment"], []).append(r["file"])
        return out

    def _segment(self, df: DataFrame, id_: str, text: str, seq: int) -> tuple:
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        body = _body(df, id_, text)
        tokens = self._write_docs(name, _measured(body))
        self._write_kinds(name, tokens[1], self._sources(name, body, self.kinds))
        return ("segment", name, seq, *tokens)

    def _write_docs(self, name: str, docs: DataFrame) -> tuple[int, int, int]:
        """Write (id, dl, chars); their number, tokens and characters."""
        folder = f"{self.path}/segments/{name}/docs"
        docs.write.parquet(folder)
        return _sums(self.spark.read.parquet(folder))

    def _sources(self, name: str, body: DataFrame, kinds: tuple[str, ...]) -> dict[str, tuple[DataFrame, list[str] | None]]:
        """What the lists of each kind are made of, without bounds: (id, text), for words (id, dl, text) in lower case, or (id, dl, tokens); ``dl`` of words are characters."""
        docs = self.spark.read.parquet(f"{self.path}/segments/{name}/docs")
        out = {}
        for kind in kinds:
            dl = "chars" if kind == "words" else "dl"
            repeated = not docs.groupBy("id", dl).count().where("count > 1").isEmpty()
            if not repeated:
                out[kind] = (body.select("id", F.col("chars").alias("dl"), F.lower("text").alias("text")) if kind == "words" else body.select("id", "text"), None)
                continue
            if kind == "words":
                rows = body.select("id", F.col("chars").alias("dl"), words_ws("text").alias("tokens"))
            else:
                rows = I.tokenised(body, "id", "text").select("id", "dl", "tokens")
            # rows of one id and length count as one document: their tokens follow one another, set apart by a null
            apart = F.transform("texts", lambda t: F.concat(t, F.array(F.lit(None).cast("string"))))
            out[kind] = (rows.groupBy("id", "dl").agg(F.collect_list("tokens").alias("texts")).select("id", "dl", F.flatten(apart).alias("tokens")), None)
        return out

    def _write_kinds(self, name: str, tokens: int, parts: dict[str, tuple[DataFrame, list[str] | None]]) -> None:
        """Add the lists of ``parts``, rows and bounds by kind, and the zones of their pieces, to a segment."""
        folder = f"{self.path}/segments/{name}"
        pieces = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), tokens // PIECE_TOKENS)
        for kind, (rows, known) in parts.items():
            bounds = _bounds(rows, kind, pieces, self.spark.read.parquet(f"{folder}/docs").count()) if known is None else _quantiles(known, pieces)
            blocks = _blocks(rows, kind, bounds).repartitionById(len(bounds) + 1, "piece")
            _joined(blocks, dict(rows.dtypes)["id"], _field(kind)).write.option("parquet.block.size", 32 << 20).option("compression", "zstd").parquet(f"{folder}/{kind}")
        if "words" in parts:
            lists = self.spark.read.parquet(f"{folder}/words")
            n = F.octet_length("at") / ENTRY.itemsize if dict(lists.dtypes)["at"] == "binary" else F.size("at")
            words = lists.groupBy(F.col("unit").alias("word")).agg(F.sum(n.cast("bigint")).alias("docs"))
            words.write.parquet(f"{folder}/vocabulary")
            vocabulary = self.spark.read.parquet(f"{folder}/vocabulary").select("word")
            bounds = _gram_bounds(vocabulary, pieces, vocabulary.count())
            grams = _gram_blocks(vocabulary, bounds).repartitionById(len(bounds) + 1, "piece").mapInArrow(_gram_piece, "unit string, at string, last string")
            grams.write.option("parquet.block.size", 32 << 20).option("compression", "zstd").parquet(f"{folder}/grams")
        zones = None
        for kind in (*parts, *["grams"] * ("words" in parts)):
            read, file = self.spark.read.parquet(f"{folder}/{kind}"), F.col("_metadata.file_name").alias("file")
            zone = read.where("last IS NOT NULL").select(F.lit(name).alias("segment"), F.lit(kind).alias("kind"), file, F.col("unit").alias("first"), "last")
            zones = zone if zones is None else zones.unionByName(zone)
        zones.write.mode("append").parquet(f"{folder}/zones")

    def _merged(self, segments: list[tuple], name: str) -> tuple:
        """One segment of the live rows of several; nothing buried so far concerns it, so it takes the new version's number."""
        sums = self._write_docs(name, self._live(self._union([self._table(s, "docs") for s in segments])))
        rows = lambda k: self._live(self._entries(self._union([self._table(s, k).withColumn("seq", F.col("seq").cast("bigint")) for s in segments]), k, ["id", "dl", _field(k)]))
        firsts = self.spark.read.schema(ZONES).parquet(*[f"{self.path}/segments/{s[1]}/zones" for s in segments]).select("kind", "first").collect()
        self._write_kinds(name, sums[1], {k: (rows(k), [r["first"] for r in firsts if r["kind"] == k]) for k in self.kinds})
        return ("segment", name, self.version + 1, *sums)

    def _bury(self, ids: DataFrame, seq: int) -> list[tuple]:
        """Tombstones for the live documents among ``ids(id)``."""
        if not self.segments:
            return []
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        self.docs().join(ids.distinct(), "id", "left_semi").write.parquet(f"{self.path}/tombstones/{name}")
        n, tokens, chars = _sums(self.spark.read.parquet(f"{self.path}/tombstones/{name}"))
        return [("tombstones", name, seq, n, tokens, chars)] if n else []

    def _hidden(self, tomb: tuple, segments: list[tuple]) -> tuple[int, int, int]:
        """Documents, tokens and characters of ``segments`` that ``tomb`` hides and no earlier tombstone does."""
        before = Index.__new__(Index)
        before.__dict__ = {**self.__dict__, "segments": segments, "tombstones": [t for t in self.tombstones if t[2] < tomb[2]]}
        hidden = before.docs().join(self._table(tomb, "").select("id").distinct(), "id", "left_semi")
        return _sums(hidden)

    def _commit(self, rows: list[tuple]) -> Index:
        commit = uuid.uuid4().hex
        _write_manifest(self.spark, self.path, self.version + 1, commit, self.kinds, rows)
        if self.refresh().commit != commit:
            raise RuntimeError("another writer has committed first; the index shows its version now")
        return self


def _body(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, text, chars) of a table; a null text is empty."""
    body = df.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return body.withColumn("chars", F.length("text").cast("bigint"))


#: What a byte becomes in a token (lower case), 0 outside of tokens.
_BYTE = np.zeros(256, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _BYTE[_c] = _c
    _BYTE[bytes([_c]).upper()[0]] = _c


#: Which bytes are white space to the JVM's ``\\s``.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\x0b\f\r")] = True


def _tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of tokens of each text, all tokens): what ``functions.text.tokens_of`` gives, for a block of texts at once."""
    held = texts.buffers()[2]
    held = held.to_pybytes() if held else b""
    for other, lower in (("\u0130", "i\u0307"), ("\u212a", "k")):  # the two letters outside of ASCII whose lower case holds an ASCII letter
        if other.encode() in held:
            texts = pc.replace_substring(texts, other, lower)
    raw, ends = _bytes_of(texts)
    low = _BYTE[raw]
    return _split(low, low > 0, ends)


def _words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, all words): lower-cased texts split on white space, as ``functions.text.words_ws`` does."""
    raw, ends = _bytes_of(texts)
    return _split(raw, ~_SPACE[raw], ends)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text starts and the last one ends)."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def _split(chars: np.ndarray, inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The runs of bytes that are ``inside``; a run ends with its text."""
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(chars))]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    begin = np.flatnonzero(begins)
    start = np.append(0, np.cumsum(np.flatnonzero(stops) + 1 - begin)).astype(np.int64)
    tokens = pa.LargeStringArray.from_buffers(len(start) - 1, pa.py_buffer(start), pa.py_buffer(chars[inside]))
    return np.diff(np.searchsorted(begin, ends)), tokens


def _measured(body: DataFrame) -> DataFrame:
    """(id, dl, chars): the number of tokens and of characters of each text."""
    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_tokens_of(batch.column(1))[0].astype(np.int64)), batch.column(2)], ["id", "dl", "chars"])

    return body.select("id", "text", "chars").mapInArrow(measure, f"id {dict(body.dtypes)['id']}, dl bigint, chars bigint")


def _runs_of(batches, kind: str):
    """Blocks as sorted runs: (numbers of units, ``name`` and ``number`` between units and numbers, ids, dl, which row each entry is of, its value).

    A batch holds (id, text), (id, dl, text) of words, (id, dl, tokens), or the entries (unit, id, dl, value) of lists that were there already.
    """
    for batch in _gathered(batches):
        names = batch.schema.names
        if names[0] == "unit":
            code, units = _numbered(batch.column(0))
            order = np.argsort(code, kind="stable")
            yield _Runs(code[order], units, False, batch.column(1), batch.column(2), order, batch.column(3).to_numpy(zero_copy_only=False)[order])
            continue
        if names[-1] == "text":
            size = pc.binary_length(batch.column(names.index("text"))).to_numpy(zero_copy_only=False) // 4
        else:
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        held, first = np.cumsum(size, dtype=np.int64), 0
        while first < batch.num_rows:  # a block of about BLOCK_TOKENS
            last = max(first + 1, int(np.searchsorted(held, BLOCK_TOKENS + (held[first - 1] if first else 0), side="right")))
            part = batch.slice(first, last - first)
            if names[1] == "text":
                lengths, tokens = _tokens_of(part.column(1))
                dl = pa.array(lengths.astype(np.int64))
            elif names[-1] == "text":
                lengths, tokens = _words_of(part.column(2))
                dl = part.column(1)
            else:
                lengths, tokens, dl = size[first:last], part.column(2).flatten(), part.column(1)
            yield _turned(part.column(0), dl, lengths, tokens, kind)
            first = last


def _gathered(batches):
    """The batches; those of entries that were there already put together to blocks."""
    held, n = [], 0
    for batch in batches:
        if batch.schema.names[0] != "unit":
            yield batch
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_TOKENS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Runs:
    """Entries sorted by unit: ``unit`` their numbers, of a pair the numbers of both its tokens, ``row`` which of ``ids`` and ``dl`` each is of."""

    def __init__(self, unit: np.ndarray, units: pa.Array, pairs: bool, ids: pa.Array, dl: pa.Array, row: np.ndarray, value: np.ndarray):
        self.unit, self.units, self.pairs, self.ids, self.dl, self.row, self.value = unit, units, pairs, ids, dl, row, value

    def name(self, numbers: np.ndarray) -> pa.Array:
        if not self.pairs:
            return self.units.take(pa.array(numbers))
        n = max(1, len(self.units))
        return pc.binary_join_element_wise(self.units.take(pa.array(numbers // n)), self.units.take(pa.array(numbers % n)), " ")

    def place(self, bound: str) -> int:
        """The first entry whose unit is ``bound`` or behind it."""
        words = bound.split(" ") if self.pairs else [bound]
        at = self._find(words[0])
        if self.pairs:  # the blank sorts before every character of a token, so pairs sort by their tokens
            same = len(words) > 1 and at < len(self.units) and self.units[at].as_py() == words[0]
            at = at * len(self.units) + (self._find(words[1]) if same else 0)
        return int(np.searchsorted(self.unit, at))

    def _find(self, word: str) -> int:
        low, high, word = 0, len(self.units), word.encode()
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.units[mid].as_py().encode() < word else (low, mid)
        return low

    def rows(self, first: int, last: int, field: str, run: int | None = None) -> pa.RecordBatch:
        """(unit, at) of the entries ``first`` to ``last``; lists of at most ``run`` entries, packed where ids are bigint."""
        unit, row = self.unit[first:last], pa.array(self.row[first:last])
        begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        if run:
            inside = np.arange(len(unit)) - np.repeat(begin, np.diff(np.append(begin, len(unit))))
            begin = np.flatnonzero(inside % run == 0)
        ends = np.append(begin, len(unit))
        if pa.types.is_int64(self.ids.type):
            ids, dl = self.ids.take(row), self.dl.take(row).to_numpy(zero_copy_only=False)
            entries = np.empty(len(unit), ENTRY)
            entries["id"], entries["value"] = ids.fill_null(0).to_numpy(zero_copy_only=False), self.value[first:last]
            entries["dl"] = dl if not ids.null_count else np.where(ids.is_null().to_numpy(zero_copy_only=False), ~dl, dl)
            lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer((ends * ENTRY.itemsize).astype(np.int64)), pa.py_buffer(entries)]).cast(pa.binary())
        else:
            entries = pa.StructArray.from_arrays([self.ids.take(row), self.dl.take(row), pa.array(self.value[first:last])], ["id", "dl", field])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)
        return pa.RecordBatch.from_arrays([self.name(unit[begin]), lists], ["unit", "at"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(entries, number in each list) of packed lists."""
    lists = pa.concat_arrays([lists.cast(pa.large_binary())])
    ends = np.frombuffer(lists.buffers()[1], dtype=np.int64)[lists.offset:lists.offset + len(lists) + 1]
    return np.frombuffer(lists.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]].view(ENTRY) if len(lists) else np.empty(0, ENTRY), np.diff(ends) // ENTRY.itemsize


def _numbered(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each string, the distinct strings in their order); a null is -1."""
    coded = strings.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order) + 1, dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    rank[-1] = -1
    return rank[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)], coded.dictionary.cast(pa.string()).take(order)


def _turned(ids: pa.Array, dl: pa.Array, lengths: np.ndarray, tokens: pa.Array, kind: str) -> _Runs:
    """The runs of a block of documents, whose ``tokens`` follow one another."""
    code, units = _numbered(tokens)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    if kind == "pairs":
        new = np.ones(len(code), dtype=bool)  # where a text begins: at a document's first token or behind a null
        new[1:] = (doc[1:] != doc[:-1]) | (code[:-1] < 0)
        place = np.arange(len(code))
        pos = place - np.maximum.accumulate(np.where(new, place, 0))
        at = np.flatnonzero(~new[1:] & (code[1:] >= 0))
        pair = code[at] * len(units) + code[at + 1] if len(at) else at
        order = np.argsort(pair, kind="stable")
        return _Runs(pair[order], units, True, ids, dl, doc[at[order]], pos[at[order]].astype(np.int32))
    width = max(1, len(lengths))
    key = np.sort((code * width + doc)[code >= 0])
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    tf, key = np.diff(np.append(start, len(key))).astype(np.int64), key[start]
    return _Runs(key // width, units, False, ids, dl, key % width, tf)


def _field(kind: str) -> str:
    return "pos" if kind == "pairs" else "tf"


def _bounds(rows: DataFrame, kind: str, pieces: int, n_docs: int) -> list[str]:
    """The first units of all pieces but the first, from some of the documents."""
    def some(batches):
        for runs in _runs_of(batches, kind):
            unit = runs.unit[:: max(1, len(runs.unit) // SAMPLE_UNITS)]
            if len(unit):
                yield pa.RecordBatch.from_arrays([runs.name(unit)], ["unit"])

    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0)
    return _quantiles([r["unit"] for r in sample.mapInArrow(some, "unit string").collect()], pieces)


def _quantiles(units: list[str], pieces: int) -> list[str]:
    units = sorted(units, key=lambda u: u.encode())
    picked = [units[len(units) * i // pieces] for i in range(1, pieces)] if units else []
    return list(dict.fromkeys(picked))


def _blocks(rows: DataFrame, kind: str, bounds: list[str]) -> DataFrame:
    """(piece, data): the lists of a block that fall in a piece, as Arrow's bytes."""
    def blocks(batches):
        for runs in _runs_of(batches, kind):
            ends = [0, *[runs.place(b) for b in bounds], len(runs.unit)]
            for piece, (first, last) in enumerate(zip(ends, ends[1:])):
                if first < last:
                    yield _packed(piece, runs.rows(first, last, _field(kind)))

    if "unit" in rows.columns:
        rows = rows.select("unit", "id", "dl", _field(kind))
    return rows.mapInArrow(blocks, "piece int, data binary")


def _joined(blocks: DataFrame, id_type: str, field: str) -> DataFrame:
    """(unit, at, last): a task joins the lists of its piece, in order."""
    def join(batches):
        held = [pa.ipc.open_stream(data.as_buffer()).read_all() for batch in batches for data in batch.column(1)]
        if held:
            yield from _piece(held, field)

    value = "int" if field == "pos" else "bigint"
    lists = "binary" if id_type == "bigint" else f"array<struct<id: {id_type}, dl: bigint, {field}: {value}>>"
    return blocks.mapInArrow(join, f"unit string, at {lists}, last string")


def _piece(tables: list[pa.Table], field: str):
    whole = pa.concat_tables(tables)
    number, units = _numbered(pa.concat_arrays(whole.column("unit").chunks))
    lists = whole.column("at").chunks
    if pa.types.is_binary(lists[0].type):
        parts = [_flat(c) for c in lists]
        n = np.concatenate([p[1] for p in parts])
        entries = np.concatenate([p[0] for p in parts])
        null = entries["dl"] < 0
        ids, dl, value = pa.array(entries["id"], mask=null), pa.array(np.where(null, ~entries["dl"], entries["dl"])), entries["value"]
    else:
        n = np.concatenate([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in lists]).astype(np.int64)
        entries = pa.concat_arrays([c.flatten() for c in lists])
        ids, dl, value = entries.field("id"), entries.field("dl"), entries.field(field).to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    sizes = n[order]
    row = np.arange(sizes.sum()) + np.repeat((np.cumsum(n) - n)[order] - (np.cumsum(sizes) - sizes), sizes)
    runs = _Runs(np.repeat(number[order], sizes), units, False, ids, dl, row, value[row])
    first = 0
    while first < len(row):  # some entries at a time, however many a unit has
        last = min(len(row), first + GIVEN)
        given = runs.rows(first, last, field, RUN)
        zone = pa.nulls(given.num_rows, pa.string()) if first else pa.concat_arrays([units[-1:].cast(pa.string()), pa.nulls(given.num_rows - 1, pa.string())])
        yield given.append_column("last", zone)
        first = last


def _sums(docs: DataFrame) -> tuple[int, int, int]:
    """Documents, tokens and characters."""
    return tuple(docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first())


def _gram_runs(batches):
    """Blocks of ``GRAM_WORDS`` words as (codes of their distinct trigrams in order, the words of each as one text, set apart by blanks)."""
    held = []

    def turned(words: list[str]):
        points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        apart = points == 10  # no word holds a line feed
        at = np.flatnonzero(~(apart[:-2] | apart[1:-1] | apart[2:])) if len(points) > 2 else np.empty(0, np.int64)
        gram, word = points[at] << 42 | points[at + 1] << 21 | points[at + 2], (np.cumsum(apart) - 1)[at]
        order = np.argsort(gram, kind="stable")
        gram, word = gram[order], word[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (word[1:] != word[:-1]))[:len(gram)]  # a word's trigram counts once
        gram, word = gram[new], word[new]
        texts = pa.array(words, pa.string())
        held = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)[word] + 1)
        first = 0
        while first < len(gram):  # very long words have many trigrams
            last = max(first + 1, int(np.searchsorted(held, GRAM_BYTES + (held[first - 1] if first else 0), side="right")))
            mine = gram[first:last]
            start = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(mine)).astype(np.int32)), texts.take(pa.array(word[first:last])))
            yield mine[start], pc.binary_join(lists, " ")
            first = last

    for batch in batches:
        held += batch.column(0).to_pylist()
        if len(held) >= GRAM_WORDS:
            yield from turned(held)
            held = []
    if held:
        yield from turned(held)


def _gram_names(codes: np.ndarray) -> list[str]:
    points = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    return [text[i:i + 3] for i in range(0, len(text), 3)]


def _gram_bounds(vocabulary: DataFrame, pieces: int, n_words: int) -> list[str]:
    """The first trigrams of all pieces but the first, by the words of some of the vocabulary."""
    def some(batches):
        for codes, words in _gram_runs(batches):
            many = pc.count_substring(words, " ").to_numpy(zero_copy_only=False) + 1
            yield pa.RecordBatch.from_arrays([pa.array(_gram_names(codes), pa.string()), pa.array(many.astype(np.int64))], ["unit", "n"])

    sample = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(max(1, n_words // SAMPLE_WORDS))) == 0)
    counts = sample.mapInArrow(some, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).collect()
    return _quantiles([r["unit"] for r in counts for _ in range(r["n"])], pieces)


def _gram_blocks(vocabulary: DataFrame, bounds: list[str]) -> DataFrame:
    """(piece, data): the lists of a block's trigrams that fall in a piece, as Arrow's bytes."""
    codes_of = [ord(b[0]) << 42 | ord(b[1]) << 21 | ord(b[2]) for b in bounds]

    def blocks(batches):
        for codes, words in _gram_runs(batches):
            ends = [0, *np.searchsorted(codes, codes_of), len(codes)]
            for piece, (first, last) in enumerate(zip(ends, ends[1:])):
                if first < last:
                    part = pa.RecordBatch.from_arrays([pa.array(_gram_names(codes[first:last]), pa.string()), words[first:last]], ["unit", "at"])
                    yield _packed(piece, part)

    return vocabulary.mapInArrow(blocks, "piece int, data binary")


def _gram_piece(batches):
    """(unit, at, last): the lists of a piece in order; a trigram has one of each block."""
    held = [pa.ipc.open_stream(data.as_buffer()).read_all() for batch in batches for data in batch.column(1)]
    if held:
        whole = pa.concat_tables(held).combine_chunks().sort_by("unit")
        last = pa.concat_arrays([whole.column("unit").chunk(0)[-1:], pa.nulls(whole.num_rows - 1, pa.string())])
        yield from whole.append_column("last", last).to_batches(max_chunksize=GIVEN // 10)


def _packed(piece: int, part: pa.RecordBatch) -> pa.RecordBatch:
    """(piece, data) of one part of a block."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(part)
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["piece", "data"])


def _write_manifest(spark: SparkSession, path: str, version: int, commit: str, kinds: tuple[str, ...], rows: list[tuple]) -> None:
    """One file for a version: the rows, and one that stands for the version itself and names the kinds."""
    data = [(version, commit, *r) for r in [("version", ",".join(kinds), 0, 0, 0, 0), *rows]]
    spark.createDataFrame(data, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")


def fingerprint(df: DataFrame) -> str:
    """A digest of the files a table is read from: their names, lengths and times of change."""
    files = df.inputFiles()
    spark = df.sparkSession
    # only the files' metadata is read
    facts = spark.read.format("binaryFile").load(files).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    n, h = facts.agg(F.count("*"), F.bit_xor("h")).first()
    return f"{n}-{h}"


def kept_index(df: DataFrame, id_: str, text: str, label: str, known: dict[tuple[str, str, str], Index], kinds: tuple[str, ...] = KINDS) -> Index:
    """The index of a table in ``known``, made anew where the table's files are others than they were; kinds are written when they are first asked for."""
    key = (df.sparkSession.sparkContext.applicationId, label, fingerprint(df))
    if key not in known:
        known[key] = Index.write(df, id_, text, run_dir(df.sparkSession, label), kinds)
    return known[key].widen(df, id_, text, kinds)
