import gzip

import pytest

from memspark.llm import warc as W
from memspark.llm.queries import ORACLES, QUERIES
from tests.compare import connect, diff

SCHEMA = "page_id bigint, url string, html string, shard int, digest string, first bigint"


def pages(spark):
    big, same = "z" * 100, "copy " * 40
    rows = [(i, f"http://h{i}.net/\n é?", f"<p>{i}</p>" * (i % 7 + 1)) for i in range(60)]
    rows += [(100 + i, "http://a.com", same) for i in range(50)] + [(7, None, big[:99]), (8, "u", big[:99]), (9, "u", big), (10, "u", big), (200, "u", None), (201, "", ""), (-5, "neg", same), (1 << 60, "far", "far"),
                                                                   (300, "long", "long " * 300_000), (None, "none", same), (-5, "neg", same), (None, None, None)]
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], SCHEMA)


def test_query_equals_sql(spark, sf):
    assert diff(QUERIES["op7_warc"](spark, sf), connect(sf), ORACLES["op7_warc"]) is None


def written(df, folder, **more):
    folder.mkdir()
    return W.write_archives(df, f"file://{folder}", **more)


def test_round_trip_of_messy_pages(spark, tmp_path):
    df = pages(spark)
    manifest = written(df, tmp_path / "a", shard_bytes=4000, roll_bytes=2000)
    got = W.read_archives(manifest, f"file://{tmp_path}/a", payloads=True).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    by = {}
    for r in rows:
        if r["page_id"] is not None and len((r["html"] or "").encode()) >= 100:
            by[r["html"]] = min(by.get(r["html"], r["page_id"]), r["page_id"])
    want = []
    for r in rows:
        html = r["html"] or ""
        first = by.get(html) if r["page_id"] is not None else None
        revisit = first is not None and first != r["page_id"]
        want.append((str(r["page_id"]), len(html.encode()), "revisit" if revisit else "response", str(first if revisit else None), b"" if revisit else html.encode()))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"]), bytes(r["payload"])) for r in got) == sorted(want)
    assert manifest.where("bytes > 2000 AND records > 1").count() == 0


def test_files_depend_on_the_rows_alone(spark, tmp_path):
    df = pages(spark)
    a = written(df, tmp_path / "a", shard_bytes=4000, roll_bytes=2000).collect()
    b = written(df.repartition(5), tmp_path / "b", shard_bytes=4000, roll_bytes=2000).collect()
    assert sorted(a) == sorted(b) and len(a) > 3
    assert not list((tmp_path / "a").glob("tmp-*"))


def test_damage_is_noticed(spark, tmp_path):
    manifest = written(pages(spark).where("page_id < 5"), tmp_path / "a")
    file = next((tmp_path / "a").glob("*.warc.gz"))
    whole = file.read_bytes()
    with file.open("rb") as f:
        found = list(W.records(f))
    headers, block = found[-1]
    changed = W._record([(k, v) for k, v in headers.items() if k not in ("Content-Length",)], block.replace(b"<p>", b"<q>", 1))
    last = W._record([(k, v) for k, v in headers.items() if k not in ("Content-Length",)], block)
    assert whole.endswith(last)
    for damaged in (whole[:-len(last)] + changed, whole[:-20], gzip.compress(gzip.decompress(whole))):
        file.write_bytes(damaged)
        with pytest.raises(Exception, match="digest|ends within|one whole record"):
            W.read_archives(manifest, f"file://{tmp_path}/a").collect()


def test_uncommitted_files_are_ignored(spark, tmp_path):
    manifest = written(pages(spark).where("page_id < 5"), tmp_path / "a")
    (tmp_path / "a" / "000009-00000.warc.gz").write_bytes(b"not an archive")
    assert W.read_archives(manifest, f"file://{tmp_path}/a").count() == pages(spark).where("page_id < 5").count()


def test_empty(spark, tmp_path):
    manifest = written(spark.createDataFrame([], SCHEMA), tmp_path / "a")
    assert manifest.count() == 0 and W.read_archives(manifest, f"file://{tmp_path}/a").count() == 0


def test_one_hot_id_and_null_ids_span_shards(spark, tmp_path):
    """A repeated id and null ids heavier than a shard lie in several, every row is read back, reading has a task for each so many bytes."""
    rows = [(5, f"u{i}", f"{i} " * 400) for i in range(60)] + [(None, f"n{i}", f"{i} - " * 300) for i in range(60)] + [(i, "u", "x" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = written(df, tmp_path / "a", shard_bytes=20_000, roll_bytes=8_000)
    shards = {r["shard"] for r in manifest.collect()}
    assert len(shards) > 5
    back = W.read_archives(manifest, f"file://{tmp_path}/a", payloads=True)
    assert sorted((str(r["page_id"]), bytes(r["payload"])) for r in back.collect()) == sorted((str(i), h.encode()) for i, _, h in rows)


def test_reading_is_spread_by_bytes(spark, tmp_path, monkeypatch):
    manifest = written(pages(spark), tmp_path / "a", shard_bytes=4000, roll_bytes=2000)
    monkeypatch.setattr(W, "READ_BYTES", 3000)
    total = manifest.agg({"bytes": "sum"}).first()[0]
    assert W.read_archives(manifest, f"file://{tmp_path}/a").rdd.getNumPartitions() == total // 3000 + 1
