"""WARC records in zip-packaged archives: written by task, read back by byte range.

An archive is a zip file with stored members only: `archive/*.warc.gz` (a gzip
member for each record) and `indexes/index.cdxj` (a line for each record with the
member, offset and length). The reader finds the members through the zip
directories (sources.zips: central and Zip64), takes the records' places from the
index, and reads ranges of whole records; no archive or member is unpacked.

Records of pages: the payload is the html in UTF-8 (null: empty). Of pages with
equal payloads of `least` bytes or more, the one with the smallest page_id is the
response, and the others are revisits of it; smaller payloads are all responses.

Defined results: rows that share the smallest page_id of their payload are all
responses; a null page_id revisits the smallest one that is known, and is a
response where none is. Addresses are percent-encoded where a header needs it and
left out where null. Each row is a record of its own. No rows: no archive, no rows.
Other columns of the table play no part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import zips
from .common import partitions, saved, scratch

# Names of the record format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "indexes/index.cdxj"
#: Pages carry no time of capture.
UNDATED = "1970-01-01T00:00:00Z"

MEMBER_MB, BLOCK_MB = 16, 4
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


# ---------------------------------------------------------------- records


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(name: str) -> int | None:
    number = name.strip("<>").split(":")[2]
    return int(number) if number else None


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = UNDATED) -> tuple[bytes, str]:
    """(bytes, payload digest) of a response, or of a revisit where refers_to is given."""
    digest = digest_of(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_name(refers_to, digest)}", f"WARC-Profile: {SAME_PAYLOAD}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes | None, int]:
    """(headers, payload or None for a revisit, the full payload's bytes) of one record; a payload that differs from its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no record begins here")
    headers = _headers(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "revisit":
        return headers, None, int(_headers(http)["content-length"])
    if told != digest_of(payload):
        raise ValueError(f"{headers.get('warc-record-id')}: its payload differs from its digest")
    return headers, payload, len(payload)


# ---------------------------------------------------------------- archives


def _key(url: str | None) -> str:
    """The address with its host turned round, by which an index is sorted."""
    try:
        parts = urlsplit(url or "")
        key = ",".join(reversed((parts.hostname or "").split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")
    except ValueError:
        key = url or ""
    return quote(key, safe=",()/?=&%:")


class ArchiveWriter:
    """Streams records into the stored members of one zip file; its index is held until the end (one line a record)."""

    def __init__(self, uri: str, member_mb: float = MEMBER_MB, level: int = 1):
        fs, path = zips.filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.most, self.level = int(member_mb * 1e6), level
        self.member, self.name, self.at, self.members, self.records = None, "", 0, 0, 0
        self.lines: list[tuple[str, str]] = []

    def _open(self, name: str) -> None:
        self.member = self.zip.open(zipfile.ZipInfo(name), "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        if self.member is None or self.at >= self.most:
            if self.member is not None:
                self.member.close()
            self.name, self.at = f"data-{self.members:05d}.warc.gz", 0
            self._open(f"archive/{self.name}")
            self.members += 1
        raw, digest = build_record(page_id, url, payload, refers_to)
        pack = zlib.compressobj(self.level, zlib.DEFLATED, zlib.MAX_WBITS | 16)
        packed = pack.compress(raw) + pack.flush()
        self.member.write(packed)
        self.lines.append((_key(url), json.dumps({"url": url, "digest": f"sha1:{digest}", "filename": self.name, "offset": self.at, "length": len(packed)})))
        self.at += len(packed)
        self.records += 1

    def close(self) -> None:
        if self.member is not None:
            self.member.close()
        self._open(INDEX)
        date = UNDATED.translate(str.maketrans("", "", "-:TZ"))
        for key, line in sorted(self.lines):
            self.member.write(f"{key} {date} {line}\n".encode())
        self.member.close()
        self.zip.close()
        self.out.close()


def locate(f, size: int):
    """(start in the file, length) of each record of an archive, from its directories and indexes."""
    starts: dict[str, int] = {}
    ends: dict[str, int] = {}
    indexes = []
    for e in zips.directory(f, size):
        folder, _, name = e.name.rpartition("/")
        if folder == "archive" and name:
            if e.method != zips.STORED or e.flags & zips.ENCRYPTED:
                raise ValueError(f"{e.name}: only stored members can be read by range")
            starts[name] = zips.data_start(f, e)
            ends[name] = starts[name] + e.packed
        elif folder == "indexes" and name.endswith((".cdxj", ".cdxj.gz", ".cdx", ".cdx.gz")):
            indexes.append(e)
    if starts and not indexes:
        raise ValueError("the archive has no index")
    for e in indexes:
        lines = zips.read_entry(f, e)
        lines = zlib.decompress(lines, zlib.MAX_WBITS | 32) if e.name.endswith(".gz") else lines
        for line in lines.splitlines():
            if b"{" in line:
                at = json.loads(line[line.index(b"{") :])
                start, n = starts[at["filename"]] + int(at["offset"]), int(at["length"])
                if start + n > ends[at["filename"]]:
                    raise ValueError(f"{at['filename']}: the index leads beyond its end")
                yield start, n


def ranges(places, most: int):
    """Runs of neighbouring records with about `most` bytes: lists of (start, length)."""
    run: list[tuple[int, int]] = []
    for start, n in sorted(places):
        if run and (start != run[-1][0] + run[-1][1] or start + n - run[0][0] > most):
            yield run
            run = []
        run.append((start, n))
    if run:
        yield run


# ---------------------------------------------------------------- operator


def marked(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the page of the response where a page is to be a revisit."""
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("same", F.unhex(F.sha2("payload", 256)))
    # a written table of the payloads that come more than once: its join has an exchange on both sides, so a hot payload is split
    firsts = saved(rows.where(F.length("payload") >= least).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("same", "first"), "warc-firsts")
    refers = F.when((F.length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, "same", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(rows: DataFrame, out_dir: str, member_mb: float = MEMBER_MB) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) as one archive a task and returns their (path, records), written down.

    A task that runs again writes a file of its own; what is returned are the files of the tasks that succeeded.
    """

    def write(batches):
        from pyspark import TaskContext

        path, writer = f"{out_dir}/part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.wacz", None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                writer = writer or ArchiveWriter(path, member_mb)
                writer.add(*row)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([writer.records], pa.int64())})

    return saved(rows.mapInArrow(write, "path string, records long"), "warc-archives")


def read_archives(archives: DataFrame, payloads: bool = True, block_mb: float = BLOCK_MB) -> DataFrame:
    """The records of archives (column path): RECORD, and payload (null for revisits) if asked for.

    One task an archive reads its directories and index; the byte ranges it finds are dealt over all tasks, so one
    large archive is read by many.
    """

    def find(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = zips.filesystem(path)
                with fs.open_input_file(name) as f:
                    for run in ranges(locate(f, f.size()), int(block_mb * 1e6)):
                        yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "start": pa.array([run[0][0]], pa.int64()), "lengths": pa.array([[n for _, n in run]], pa.list_(pa.int64()))})

    def read(batches):
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs, name = zips.filesystem(path)
                with fs.open_input_file(name) as f:
                    f.seek(start)
                    data = memoryview(f.read(sum(lengths)))
                rows, bodies, at, held = [], [], 0, 0
                for n in lengths:
                    raw = bytes(data[at : at + n])
                    at += n
                    headers, payload, size = parse_record(zlib.decompress(raw, zlib.MAX_WBITS | 32) if raw.startswith(b"\x1f\x8b") else raw)
                    to = headers.get("warc-refers-to")
                    rows.append((_page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], size, headers["warc-payload-digest"].removeprefix("sha1:"), _page_of(to) if to else None))
                    if payloads:
                        bodies.append(payload)
                        held += len(payload or b"")
                    if held > 2 * block_mb * 1e6:
                        yield _batch(names, rows, bodies, payloads)
                        rows, bodies, held = [], [], 0
                if rows:
                    yield _batch(names, rows, bodies, payloads)

    spark = archives.sparkSession
    found = saved(archives.select("path").mapInArrow(find, "path string, start long, lengths array<long>"), "warc-ranges")
    n = max(spark.sparkContext.defaultParallelism, partitions(found, 1))
    return found.repartition(n, "path", "start").mapInArrow(read, RECORD + (", payload binary" if payloads else ""))


def _batch(names, rows, bodies, payloads):
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = {c: pa.array(v, kinds[t.split()[1]]) for c, v, t in zip(names, zip(*rows, strict=True), RECORD.split(", "), strict=True)}
    return pa.RecordBatch.from_pydict(columns | ({"payload": pa.array(bodies, pa.binary())} if payloads else {}))


def warc_records(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to archives in the shared folder, and their records as read back, without payloads."""
    return read_archives(write_archives(marked(pages, least=least), scratch(spark, "warc")), payloads=False)




SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INTEGER) >> (5 * (3 - i % 4))) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
