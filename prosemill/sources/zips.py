"""Zip archives by byte range: the directories are read from the end of the file, entries where they lie.

Nothing is unpacked to disk and no archive is held whole: what is read is the end
record, the central directory in pieces, and the ranges of the entries asked for.
Archives of any size (Zip64), with a comment at their end or other data before
their start are read; encrypted entries and other packings than stored and
deflated are refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

# Signatures and layouts of the zip format.
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_LAYOUT, END64_LAYOUT, LOCATOR_LAYOUT = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL"
CENTRAL_LAYOUT, LOCAL_LAYOUT = "<4s6H3L5H2L", "<4s5H3L2H"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STORED, DEFLATED = 0, 8
UTF8_NAME, ENCRYPTED = 1 << 11, 1

PIECE = 1 << 20


class Entry(NamedTuple):
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header: int


def filesystem(uri: str):
    """(pyarrow file system, path) of an address, or None where only Spark's own readers know its scheme."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    for mine, theirs in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = theirs + uri.removeprefix(mine) if uri.startswith(mine) else uri
    try:
        return pafs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def _at(f, start: int, n: int) -> bytes:
    f.seek(start)
    got = f.read(n)
    if len(got) < n:
        raise ValueError(f"the archive ends before byte {start + n}")
    return got


def directory_place(f, size: int) -> tuple[int, int, int]:
    """(start of the central directory, its length, bytes that lie before the archive's own start)."""
    tail_at = max(0, size - struct.calcsize(END_LAYOUT) - FULL16)
    tail = _at(f, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0:
        if at + struct.calcsize(END_LAYOUT) <= len(tail):
            *_, length, offset, comment = struct.unpack_from(END_LAYOUT, tail, at)
            entries = struct.unpack_from(END_LAYOUT, tail, at)[4]
            if at + struct.calcsize(END_LAYOUT) + comment == len(tail):
                break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end record: this is not a zip archive")
    ends, n = tail_at + at, struct.calcsize(LOCATOR_LAYOUT)
    if FULL32 in (length, offset) or entries == FULL16:
        locator = _at(f, ends - n, n) if ends >= n else b""
        if locator.startswith(LOCATOR):
            # what lies before the archive shifts the offset that the locator names; the record stands right before it
            told, m = struct.unpack(LOCATOR_LAYOUT, locator)[2], struct.calcsize(END64_LAYOUT)
            for place in (ends - n - m, told):
                if 0 <= place <= size - m and (record := _at(f, place, m)).startswith(END64):
                    *_, length, offset = struct.unpack(END64_LAYOUT, record)
                    ends = place
                    break
            else:
                raise ValueError("the Zip64 end record is missing")
    before = ends - length - offset
    if before < 0:
        raise ValueError("the central directory does not fit into the file")
    return offset + before, length, before


def directory(f, size: int) -> Iterator[Entry]:
    """The entries of the archive in file f, in the order of its central directory, which is read in pieces."""
    at, left, before = directory_place(f, size)
    fixed, held = struct.calcsize(CENTRAL_LAYOUT), b""

    def more(n: int) -> None:
        nonlocal held, at, left
        while len(held) < n:
            piece = _at(f, at, min(left, max(PIECE, n - len(held))))
            if not piece:
                raise ValueError("the central directory is cut off")
            held, at, left = held + piece, at + len(piece), left - len(piece)

    while left or held:
        more(fixed)
        sign, _, _, flags, method, _, _, crc, packed, full, name_n, extra_n, comment_n, _, _, _, header = struct.unpack_from(CENTRAL_LAYOUT, held)
        if sign != CENTRAL:
            raise ValueError("the central directory holds something else")
        more(fixed + name_n + extra_n + comment_n)
        raw, extra = held[fixed : fixed + name_n], held[fixed + name_n : fixed + name_n + extra_n]
        held = held[fixed + name_n + extra_n + comment_n :]
        wide = iter(_wide(extra))
        full, packed, header = (next(wide, x) if x == FULL32 else x for x in (full, packed, header))
        yield Entry(raw.decode("utf-8" if flags & UTF8_NAME else "cp437", "replace"), method, flags, crc, packed, full, header + before)


def _wide(extra: bytes) -> list[int]:
    """The 64-bit numbers of an entry's Zip64 field, in its order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            return [struct.unpack_from("<Q", extra, at + 4 + k)[0] for k in range(0, min(n, len(extra) - at - 4) // 8 * 8, 8)]
        at += 4 + n
    return []


def data_start(f, e: Entry) -> int:
    """Where an entry's bytes begin: its local header may be longer than the directory's."""
    head = struct.unpack(LOCAL_LAYOUT, _at(f, e.header, struct.calcsize(LOCAL_LAYOUT)))
    if head[0] != LOCAL:
        raise ValueError(f"{e.name}: no entry at byte {e.header}")
    return e.header + struct.calcsize(LOCAL_LAYOUT) + head[-2] + head[-1]


def read_entry(f, e: Entry) -> bytes:
    """An entry's bytes, unpacked and checked."""
    if e.flags & ENCRYPTED:
        raise ValueError(f"{e.name}: encrypted")
    if e.method not in (STORED, DEFLATED):
        raise ValueError(f"{e.name}: packing {e.method}")
    data = _at(f, data_start(f, e), e.packed)
    data = zlib.decompress(data, -zlib.MAX_WBITS) if e.method == DEFLATED else data
    if len(data) != e.size or zlib.crc32(data) != e.crc:
        raise ValueError(f"{e.name}: its checksum differs")
    return data
