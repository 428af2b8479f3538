"""The zip reader against the standard library's writer."""

import io
import struct
import zipfile

import pytest

from prosemill.sources import zips


def packed(entries, wide=False, comment=b"", prefix=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data, method in entries:
            info = zipfile.ZipInfo(name)
            info.compress_type = method
            with z.open(info, "w", force_zip64=wide) as f:
                f.write(data)
        z.comment = comment
    return prefix + out.getvalue()


def forced_zip64(entries):
    """An archive whose directory and end record give all their numbers in Zip64 fields."""
    local, central = b"", b""
    for name, data in entries:
        crc, at, n = zips.zlib.crc32(data), len(local), len(data)
        local += struct.pack(zips.LOCAL_LAYOUT, zips.LOCAL, 45, 0, 0, 0, 0, crc, n, n, len(name), 5) + name + b"\x99\x99\x01\x00x" + data
        extra = struct.pack("<2H1s", 0x7777, 1, b"y") + struct.pack("<2H3Q", 1, 24, n, n, at)
        central += struct.pack(zips.CENTRAL_LAYOUT, zips.CENTRAL, 45, 45, 0, 0, 0, 0, crc, zips.FULL32, zips.FULL32, len(name), len(extra), 2, 0, 0, 0, zips.FULL32) + name + extra + b"hi"
    end64 = struct.pack(zips.END64_LAYOUT, zips.END64, 44, 45, 45, 0, 0, len(entries), len(entries), len(central), len(local))
    locator = struct.pack(zips.LOCATOR_LAYOUT, zips.LOCATOR, 0, len(local) + len(central), 1)
    return local + central + end64 + locator + struct.pack(zips.END_LAYOUT, zips.END, 0, 0, zips.FULL16, zips.FULL16, zips.FULL32, zips.FULL32, 0)


def read(raw):
    f = io.BytesIO(raw)
    return {e.name: zips.read_entry(f, e) for e in zips.directory(f, len(raw))}


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment,prefix", [(b"", b""), (b"PK\x05\x06" * 9, b"leading bytes")])
def test_entries(wide, comment, prefix, monkeypatch):
    monkeypatch.setattr(zips, "PIECE", 50)  # the directory comes in many pieces
    entries = [("a.txt", b"alpha" * 50, zipfile.ZIP_DEFLATED), ("d/é.txt", b"", zipfile.ZIP_STORED), ("d/", b"", zipfile.ZIP_STORED), ("b" * 200, bytes(range(256)), zipfile.ZIP_STORED)]
    assert read(packed(entries, wide, comment, prefix)) == {n: d for n, d, _ in entries}


@pytest.mark.parametrize("prefix", [b"", b"junk before"])
def test_zip64_everywhere(prefix):
    entries = [(b"one", b"1" * 10), (b"two", b"")]
    assert read(prefix + forced_zip64(entries)) == {"one": b"1" * 10, "two": b""}


def test_many_entries():
    raw = packed([(f"{i}.txt", b"", zipfile.ZIP_STORED) for i in range(70_000)])
    assert sum(1 for _ in zips.directory(io.BytesIO(raw), len(raw))) == 70_000


def test_damage():
    raw = packed([("a.txt", b"alpha", zipfile.ZIP_STORED)])
    with pytest.raises(ValueError, match="not a zip"):
        read(b"plain text")
    with pytest.raises(ValueError, match="checksum"):
        read(raw.replace(b"alpha", b"alphA", 1))
    with pytest.raises(ValueError, match="no entry"):
        read(b"XX" + raw[2:])
    broken = packed([("a.txt", b"alpha", zipfile.ZIP_BZIP2)])
    with pytest.raises(ValueError, match="packing"):
        read(broken)


def test_empty_archive():
    assert read(packed([])) == {}


def test_addresses():
    assert zips.filesystem("file:///tmp/x")[1] == "/tmp/x" and zips.filesystem("file:/tmp/x")[1] == "/tmp/x"
    assert zips.filesystem("nosuch://host/x") is None


def test_one_archive_is_read_by_all_tasks(spark, tmp_path):
    """Ten thousand entries of one archive, dealt by byte range; hidden, foreign and other entries stay out."""
    from pyspark.sql import functions as F

    from prosemill.sources.files import read_zip, zip_entries

    entries = [(f"d/{i}.md", f"text {i}".encode() * (1 + i % 50), zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED) for i in range(10_000)]
    others = [(n, b"x", zipfile.ZIP_STORED) for n in ("__MACOSX/a.md", "d/.b.md", "c.png", "d/e/", "md")]
    (tmp_path / "a.zip").write_bytes(packed(entries + others, wide=True))
    (tmp_path / "b.zip").write_bytes(packed([("only.HTML", "﻿é".encode(), zipfile.ZIP_STORED)]))
    (tmp_path / "c.zip").write_bytes(packed([]))
    got = read_zip(spark, str(tmp_path / "*.zip"), least=1 << 10)
    back = {r.name.rpartition("!")[2]: (r.src, r.kind) for r in got.collect()}
    assert back == {n: (d.decode(), "md") for n, d, _ in entries} | {"only.HTML": ("é", "html")}
    by_task = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) == 4 and max(r["count"] for r in by_task) < 5000
    assert zip_entries(spark, str(tmp_path / "c.zip")).count() == 0 and read_zip(spark, str(tmp_path / "c.zip")).count() == 0


def test_archives_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    from prosemill.sources import files

    (tmp_path / "a.zip").write_bytes(packed([("a.md", b"alpha", zipfile.ZIP_STORED), ("__MACOSX/a.md", b"x", zipfile.ZIP_STORED)]))
    monkeypatch.setattr(files.zips, "filesystem", lambda _: None)
    assert [(r.src, r.kind) for r in files.read_zip(spark, str(tmp_path / "a.zip")).collect()] == [("alpha", "md")]
