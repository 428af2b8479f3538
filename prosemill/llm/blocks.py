"""Vectors as whole numbers in columnar blocks, and exact distances to few centres.

A component x becomes floor(scale * x), held as a double (which is exact for any
finite x whose product is finite) until it is computed with: as 64-bit integers
where every number of a block and of the centres is within SAFE, as Python
integers otherwise. So all results are exact at any magnitude.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Squares of differences add up over 4096 components, and components over 2^39 vectors, within 63 bits.
SAFE = float(1 << 24)
ROWS = 8192


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector has components, none of them null, NaN or infinite."""
    x = F.col(vec_col)
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))))


def quantised(column: pa.Array, scale: int, divisor: int = 1):
    """(rows, matrix of floor(scale * x)) for each length that is a multiple of divisor; rows whose product is not finite are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    for d in np.unique(lengths).tolist():
        if d and d % divisor == 0:
            rows = np.flatnonzero(lengths == d)
            with np.errstate(over="ignore"):
                m = np.floor(values[offsets[rows][:, None] + np.arange(d)] * float(scale)) + 0.0
            good = np.isfinite(m).all(axis=1)
            yield rows[good], m[good]


def whole(m: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The arrays as 64-bit integers where all are within SAFE, as Python integers otherwise."""
    arrays = [m, *others]
    if all(a.size == 0 or bool((np.abs(a) <= SAFE).all()) for a in arrays):
        return [a.astype(np.int64) for a in arrays]
    big = np.vectorize(int, otypes=[object])
    return [big(a) if a.size else a.astype(object) for a in arrays]


def distances(columns: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (vectors x centres) of columnar vectors (dimensions x vectors), added up dimension by dimension."""
    out = np.zeros((columns.shape[1], len(centres)), columns.dtype)
    for d in range(len(columns)):
        gap = columns[d][:, None] - centres[None, :, d]
        gap *= gap
        out += gap
    return out


def nearest(columns: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, lowest of equals; its squared distance) of columnar vectors."""
    far = distances(columns, centres)
    best = np.argmin(far, axis=1)
    return best, far[np.arange(len(best)), best]


def add_at(sums: np.ndarray, where: np.ndarray, values: np.ndarray) -> np.ndarray:
    """sums with values added at the places `where`; it turns to Python integers if they are."""
    if values.dtype == object and sums.dtype != object:
        sums = sums.astype(object)
    np.add.at(sums, where, values)
    return sums


def pack_column(m: np.ndarray) -> bytes:
    """Columnar bytes of a matrix of vectors: 32-bit integers where they fit."""
    small = m.size == 0 or bool((np.abs(m) < 1 << 31).all())
    return (b"i" if small else b"d") + np.ascontiguousarray(m.T, "<i4" if small else "<f8").tobytes()


def unpack_column(data: bytes, d: int) -> np.ndarray:
    """Dimensions x vectors, as doubles or 32-bit integers."""
    return np.frombuffer(data, "<i4" if data[:1] == b"i" else "<f8", offset=1).reshape(d, -1)


def column_blocks(rows: DataFrame, vec_col: str, scale: int, divisor: int = 1) -> DataFrame:
    """(dims int, n long, data binary): the usable vectors as columnar blocks of one length each."""

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                for kept, m in quantised(batch.slice(a, ROWS).column(0), scale, divisor):
                    if len(kept):
                        yield pa.RecordBatch.from_pydict({"dims": pa.array([m.shape[1]], pa.int32()), "n": pa.array([len(kept)], pa.int64()), "data": pa.array([pack_column(m)], pa.binary())})

    return usable(rows, vec_col).select(vec_col).mapInArrow(pack, "dims int, n long, data binary")


def digest_of(numbers) -> str:
    """Lowercase hex SHA-256 of decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in numbers).encode()).hexdigest()


def as_long(x: int) -> int | None:
    """x, or None beyond 64 bits."""
    return int(x) if -(1 << 63) <= int(x) < 1 << 63 else None
