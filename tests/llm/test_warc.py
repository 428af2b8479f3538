"""WARC archives: round trips, ranges, revisits, damaged archives."""

import base64
import gzip
import hashlib
import io
import json
import zipfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from prosemill.llm import warc

SCHEMA = "page_id long, url string, html string, path string, payload string, same string"


def brute(rows, least=0):
    known = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None:
            known[p] = min(i, known.get(p, i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = known.get(p)
        again = len(p) >= least and first is not None and i != first
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ROWS = [(9, "http://b.example/x?q=1", "<p>one</p>"), (2, "http://a.example/", "<p>one</p>"), (3, None, None), (4, "http://a.example/é b\r\nX: y", ""), (5, "HTTP://[bad", "é😀\r\n\r\n" * 9), (None, "http://n.example", "<p>one</p>"), (None, "http://n.example", "only here"), (7, "http://a.example/big", "z" * 300_000), (7, "http://a.example/big", "z" * 300_000), (8, "u", "z" * 300_000), (-1, "u", "WARC/1.1\r\n\r\n")]
ROWS += [(100 + i, f"http://c.example/{i}", f"page {i % 40} " * (i % 13)) for i in range(200)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("least", [0, 12])
def test_records(spark, least):
    got = warc.warc_records(spark, frame(spark, ROWS), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS, least)


def test_no_pages(spark):
    assert warc.warc_records(spark, frame(spark, [])).collect() == []


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    return warc.write_archives(warc.marked(frame(spark, ROWS)), f"file://{tmp_path_factory.mktemp('wacz')}/a", member_mb=0.002).cache()


def test_payloads_come_back(spark, archives):
    got = warc.read_archives(archives, block_mb=0.001)
    assert "payload" in got.columns
    back = {(r.page_id, r.payload_digest): bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    for i, _, h in ROWS:
        p = (h or "").encode()
        digest = warc.digest_of(p)
        if (i, digest) in back:
            assert back[i, digest] == p
    assert {d for _, d in back} == {warc.digest_of((h or "").encode()) for _, _, h in ROWS}
    assert got.where("record_type = 'revisit' and payload is not null").count() == 0


def test_one_archive_is_read_by_many_tasks(spark, archives):
    got = warc.read_archives(archives.coalesce(1), block_mb=0.001)
    assert got.select(F.spark_partition_id()).distinct().count() > 1 and got.count() == len(ROWS)


def test_archives_are_plain_zip_and_gzip(archives):
    """The standard library reads what is written: stored members, a gzip member a record, an index in order."""
    n = 0
    for r in archives.collect():
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            lines = z.read(warc.INDEX).decode().splitlines()
            assert lines == sorted(lines, key=lambda x: x.split(" ")[0]) and len(lines) == r.records
            for line in lines:
                at = json.loads(line[line.index("{") :])
                raw = gzip.decompress(z.read("archive/" + at["filename"])[at["offset"] : at["offset"] + at["length"]])
                headers, payload, size = warc.parse_record(raw)
                assert headers["warc-payload-digest"] == at["digest"] and (payload is None or len(payload) == size)
                n += 1
    assert n == len(ROWS)


def archive(tmp_path, members, prefix=b"", method=zipfile.ZIP_STORED, index=True, comment=b""):
    out, records, lines = io.BytesIO(), [warc.build_record(i, f"http://x/{i}", b"text %d" % i, None)[0] for i in range(members)], []
    with zipfile.ZipFile(out, "w", method) as z:
        for i, raw in enumerate(records):
            data = gzip.compress(raw) if i % 2 else raw
            with z.open(zipfile.ZipInfo(f"archive/{i}.warc{'.gz' * (i % 2)}"), "w", force_zip64=True) as f:
                f.write(data)
            lines.append(json.dumps({"filename": f"{i}.warc{'.gz' * (i % 2)}", "offset": "0", "length": str(len(data))}))
        if method:
            z.writestr("archive/packed.warc", b"x" * 99)
        if index:
            z.writestr("indexes/index.cdx.gz", gzip.compress(("!meta\n" + "\n".join(f"key 1970 {x}" for x in lines)).encode()), compress_type=zipfile.ZIP_DEFLATED)
        z.comment = comment
    path = tmp_path / "made.wacz"
    path.write_bytes(prefix + out.getvalue())
    return f"file://{path}"


@pytest.mark.parametrize("prefix,comment", [(b"", b""), (b"#!/bin/sh\n", b"a comment PK\x05\x06 within")])
def test_archives_of_others(spark, tmp_path, prefix, comment):
    """Packed index, numbers as text, uncompressed members, data before the archive, a comment after it."""
    uri = archive(tmp_path, 6, prefix, comment=comment)
    got = warc.read_archives(spark.createDataFrame([(uri,)], "path string"))
    assert sorted((r.page_id, bytes(r.payload)) for r in got.collect()) == [(i, b"text %d" % i) for i in range(6)]


def test_refused_archives(tmp_path):
    def places(uri):
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            return list(warc.locate(f, f.size()))

    with pytest.raises(ValueError, match="no index"):
        places(archive(tmp_path, 2, index=False))
    with pytest.raises(ValueError, match="stored"):
        places(archive(tmp_path, 2, method=zipfile.ZIP_DEFLATED))
    with pytest.raises(ValueError, match="differs from its digest"):
        warc.parse_record(warc.build_record(1, None, b"payload", None)[0].replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
