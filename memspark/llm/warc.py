"""WARC archives: a deterministic sharded writer and a reader.

Writing: payload digests decide which record is the response and which revisit
it. The ids' range is cut into shards of about equal bytes, at edges that depend on
the data alone; rows are dealt by shard, sorted within it and written as one gzip
member per record, and a file is closed when the next member would take it over
``roll_bytes``. Headers and digests are made anew from the payload. A file is written
under a temporary name and then moved to its final one, which is the same for
every attempt as its bytes are; the manifest table, committed by Spark at the
end, names the files that count. So a lost task is simply run again.

Reading: the manifest's files are dealt over tasks, as many as their bytes ask for, and streamed record by
record; every payload is checked against its digest.

Defined cases: null html is an empty payload; a null url an empty target; a null id
is always a response and sorts first, in shards of its own; repeated rows are repeated records, and those
that repeat the smallest id of their payload are all responses; a single record longer
than ``roll_bytes`` has a file of its own; an empty table gives an empty manifest;
other columns are ignored. Files go through ``pyarrow.fs``, so the folder may be in any
store it opens.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import cut, run_dir

#: Payloads under this many bytes are never revisited.
REVISIT_FROM = 100
SHARD_BYTES = 16 << 20
ROLL_BYTES = 4 << 20
#: Bytes of archives that a reading task gets.
READ_BYTES = 8 << 20
#: Cuts of an id range that is still too heavy for one shard.
FANOUT = 1024
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINTABLE = "".join(map(chr, range(33, 127)))


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}'.encode()).digest()[:16], version=5)}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without name or time
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "", safe=PRINTABLE)),
               ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _record(headers, block)


class RollingFiles:
    """Writes the records of one shard after another; a finished file is moved to its final name."""

    def __init__(self, root: str, roll: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.roll, self.shard, self.seq, self.out, self.done = roll, None, 0, None, []

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        elif self.out and self.size + len(record) > self.roll:
            self.close()
        if not self.out:
            self.name = f"{shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/tmp-{uuid.uuid4().hex}-{self.name}"
            self.out, self.sum, self.size, self.records, self.seq = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0, self.seq + 1
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("file", self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")],
                              b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if not self.out:
            return
        self.out.close()
        self.out, final = None, f"{self.root}/{self.name}"
        try:
            self.fs.move(self.temp, final)
        except OSError:  # another attempt has moved the same bytes there, in a store that doesn't replace
            if self.fs.get_file_info(final).size != self.size:
                raise
            self.fs.delete_file(self.temp)
        self.done.append((self.shard, self.name, self.records, self.size, self.sum.hexdigest()))

    def finished(self) -> pa.RecordBatch:
        columns = list(zip(*self.done)) or [()] * 5
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "file", "records", "bytes", "sha256"])


def shard_edges(sizes: DataFrame, shard_bytes: int, fanout: int = FANOUT) -> tuple[list[int], list[int]]:
    """First ids of all shard ranges but the first, and the number of shards of each, from ``sizes(page_id, bytes)``; they depend on the rows alone.

    Each round sums the bytes of id ranges on the cluster and cuts the ranges that are too
    heavy, so the driver sees a few rows per shard. A range of one id that is still too heavy has several
    shards, and so has the range of null ids, which is the first number of the second list.
    """
    ends = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes"), F.sum(F.when(F.col("page_id").isNull(), F.col("bytes")))).first()
    of = lambda size: max(1, -(-int(size or 0) // shard_bytes))
    if ends[0] is None:
        return [], [of(ends[3]), 1]
    # no more first cuts than leaves a hundredth of a shard in each, evenly spread
    step = max(1, min(fanout, int(100 * (ends[2] or 0) / shard_bytes) + 1))
    cuts = sorted({ends[0] + (ends[1] - ends[0] + 1) * k // step for k in range(step)})
    while True:
        def place(batches: Iterator[pd.DataFrame], cuts=np.array(cuts, np.int64)) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["range"] = np.searchsorted(cuts, b["page_id"].to_numpy(), side="right") - 1
                yield b.groupby("range").agg(bytes=("bytes", "sum"), low=("page_id", "min"), high=("page_id", "max")).reset_index()

        rows = sizes.where("page_id IS NOT NULL").select("page_id", "bytes").mapInPandas(place, "range bigint, bytes bigint, low bigint, high bigint")
        ranges = sorted(rows.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high")).collect())
        heavy = [r for r in ranges if r["bytes"] > shard_bytes and r["high"] > r["low"]]
        if not heavy:
            break
        cuts = sorted({*cuts, *(r["low"] + (r["high"] - r["low"] + 1) * k // 16 for r in heavy for k in range(16))})
    edges, filled, counts = [], 0, [of(ends[3])]
    for r in ranges:
        if filled and filled + r["bytes"] > shard_bytes:
            edges.append(r["low"])
            counts.append(of(filled))
            filled = 0
        filled += r["bytes"]
    return edges, [*counts, of(filled)]


def write_archives(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives under ``root`` and returns the committed manifest (shard, file, records, bytes, sha256)."""
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    facts = cut(rows.select("page_id", "digest", "bytes"), "warc-facts")
    shared = cut(facts.where(F.col("bytes") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-shared")
    # every record costs some header bytes besides its payload
    edges, counts = shard_edges(facts.select("page_id", (F.col("bytes") + 600).cast("bigint").alias("bytes")), shard_bytes)

    starts = np.concatenate([[0], np.cumsum(counts)]).tolist()

    @F.pandas_udf("bigint")
    def shard(ids: pd.Series, spread: pd.Series) -> pd.Series:
        ranges = [0 if pd.isna(i) else 1 + bisect_right(edges, int(i)) for i in ids]
        return pd.Series([starts[r] + s % counts[r] for r, s in zip(ranges, spread)], dtype="int64")

    spread = F.shiftrightunsigned(F.xxhash64("digest", F.coalesce("url", F.lit(""))), 1)
    placed = rows.join(shared, "digest", "left").select(
        shard("page_id", spread).alias("shard"), "page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    dealt = placed.repartitionByRange(starts[-1], "shard").sortWithinPartitions("shard", "page_id", "digest", "url").select("shard", "page_id", "url", "payload", "refers_to")
    pafs_fs, path = pafs.FileSystem.from_uri(root)
    pafs_fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = RollingFiles(root, roll_bytes)
        for batch in batches:
            for s, i, u, p, r in zip(*(c.to_pylist() for c in batch.columns)):
                files.add(s, page_record(i, u, p, r))
            yield files.finished()
        files.close()
        yield files.finished()

    return cut(dealt.mapInArrow(write, "shard bigint, file string, records bigint, bytes bigint, sha256 string"), "warc-manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of gzip members."""
    data, eof = b"", False
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                return
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    raise ValueError("the archive ends within a record")
            out.append(member.decompress(data))
            data = member.unused_data
        record = b"".join(out)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if len(rest) != size + 4:
            raise ValueError("a member of the archive is not one whole record")
        yield headers, rest[:size]


def read_archives(manifest: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """One row per page record of the manifest's files, every digest checked; with ``payloads`` also the payload."""
    fields = [("page_id", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_digest", "string", pa.string()), ("record_type", "string", pa.string()), ("refers_to", "bigint", pa.int64()),
              ("url", "string", pa.string()), ("file", "string", pa.string())] + [("payload", "binary", pa.binary())] * payloads

    def rows_of(name: str, store, path: str) -> Iterator[tuple]:
        with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
            for headers, block in records(stream):
                kind = headers["WARC-Type"]
                if kind == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length: ")[2])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest() or kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{name}: a record does not have its digest")
                page, to = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                out = (page and int(page), size, digest, kind, to and int(to), headers.get("WARC-Target-URI", ""), name)
                yield out + (payload,) * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                some, size = [], 0
                for row in rows_of(name, store, path):
                    some.append(row)
                    size += row[1] if payloads else 200
                    if size > 8 << 20:
                        yield _batch(some, fields)
                        some, size = [], 0
                yield _batch(some, fields)

    # as many tasks as the archives' bytes ask for
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    names = manifest.select("file").repartition(int(total // READ_BYTES) + 1)
    return names.mapInArrow(read, ", ".join(f"{n} {s}" for n, s, _ in fields))


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, fields)], [n for n, _, _ in fields])


def archive_folder(spark: SparkSession) -> str:
    return run_dir(spark, "warc")


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE strlen(html) >= {REVISIT_FROM} GROUP BY d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)"""
