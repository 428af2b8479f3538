"""Shared helpers: the shared scratch folder, intermediate tables and words."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: Five-word windows, similarities and so on are parameters of the operators; this is the one token definition they share.
WORD = r"[^\x20\x09-\x0D]+"


#: Batches of text between the JVM and Python workers; larger ones are held several times over outside the heap.
BATCHES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def modest_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches from its default; one that was set stays."""
    name, default, ours = BATCHES
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, ours)


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a local session may leave that unset (tests), a cluster may not."""
    modest_batches(spark)
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, mb: float, least: int = 1) -> int:
    """How many partitions of about mb megabytes the planner's size estimate of df makes (input file sizes for a scan)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 57:  # no estimate, as for rows that come from the driver
        return max(least, shuffles(df.sparkSession))
    return max(least, min(100_000, -(-size // int(mb * 1e6))))


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held(key: str, make, tag: str = ""):
    """A value kept by a Python worker over tasks: one for each key, made anew when the tag is another."""
    box = sys.__dict__.setdefault("_prosemill_held", {})
    if key not in box or box[key][0] != tag:
        box[key] = tag, make()
    return box[key][1]


def lower_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lowered, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes], cache: dict, limit: int = 150_000):
    """64-bit hashes of words; cache maps word to hash, is shared by the operators (held("words", dict)) and emptied at its limit."""
    import numpy as np
    import xxhash

    if len(cache) > limit:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def is_id_null_safe(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


class Hasher:
    """Vectorised 64-bit hashes of the words of many texts at once.

    A word's hash is the mixed sum of random byte values times powers of an odd
    base, taken from one prefix sum; a and b with equal bytes have equal hashes.
    """

    BASE, SEED, SLICE = 0x9E3779B97F4A7C15, 20240501, 500_000

    def __init__(self):
        import numpy as np

        self.values = np.random.default_rng(self.SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        self.blank = blank
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int):
        import numpy as np

        if len(self.up) < n:
            inverse = pow(self.BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (self.BASE, inverse))
        return self.up, self.down

    def words(self, raws: list[bytes], lower: bool = True):
        """(hashes, first word of each text and the total) of words [^\\x20\\x09-\\x0D]+; no text's word runs into the next."""
        import numpy as np

        x = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        if lower:
            x = self.lower[x]
        blank = self.blank[x]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        # slices of whole words, so that what is held a byte is bounded by SLICE (or the longest word)
        cuts = np.flatnonzero(np.diff(start // self.SLICE)) + 1
        hashes = [self._hashes(x, start[a:b], end[a:b]) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)], strict=True)]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return np.concatenate(hashes), np.searchsorted(start, offsets)

    def _hashes(self, x, start, end):
        import numpy as np

        if not len(start):
            return np.zeros(0, np.uint64)
        low = int(start[0])
        x, start, end = x[low : int(end[-1])], start - low, end - low
        up, down = self.powers(len(x) + 1)
        with np.errstate(over="ignore"):
            p = np.empty(len(x) + 1, np.uint64)
            p[0] = 0
            np.cumsum(self.values[x] * up[: len(x)], out=p[1:])
            h = (p[end] - p[start]) * down[start] + (end - start).astype(np.uint64)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h


def text_blocks(batch, column: int, limit: int = 1_000_000):
    """(first row, UTF-8 texts) of runs of rows with about `limit` bytes, null as empty."""
    held_, size, first = [], 0, 0
    for k, t in enumerate(batch.column(column).to_pylist()):
        raw = (t or "").encode("utf-8", "surrogatepass")
        held_.append(raw)
        size += len(raw)
        if size >= limit:
            yield first, held_
            held_, size, first = [], 0, k + 1
    if held_:
        yield first, held_
