"""Token-ID files: patched frame-of-reference (PFOR) blocks.

A shard holds the ids of a run of documents in ascending doc_id order:

    magic "PFR1" | blocks | block index | document index | footer (9 little-endian unsigned 64-bit integers)

Each block codes BLOCK ids: subtract the block's minimum, pack the low bits at
the width that the given percentile of the ids needs, and list the outliers
(position, remaining high bits) after the packed words. The block index has the
byte offset of every block start, so any id range is read without decoding the
rest.

Defined results: a null text counts as empty and yields the end id alone; null
ids sort first; repeated ids are kept as separate documents, in text order; an
empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import struct
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, partitions, scratch, shuffles

BLOCK = 256
MAGIC = b"PFR1"


# ---------------------------------------------------------------- block coder


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, width: int) -> bytes:
    """Rows of 64k values below 2**width as little-endian 64-bit words, lowest bits first."""
    if not width:
        return b""
    v = values.reshape(-1, 64).astype(np.uint64)
    out = np.zeros((len(v), width), np.uint64)
    for j in range(64):
        word, at = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(at)
        if at + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - at)
    return out.tobytes()


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack: words has a row of `width` words for each 64 values."""
    out = np.zeros((len(words), 64), np.uint64)
    if not width:
        return out
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, at = divmod(j * width, 64)
        x = words[:, word] >> np.uint64(at)
        if at + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - at))
        out[:, j] = x & mask
    return out


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """ids as PFOR blocks; the last one may be short (it is padded with its minimum)."""
    n = len(ids)
    if not n:
        return []
    full = -(-n // BLOCK)
    v = np.empty(full * BLOCK, np.uint32)
    v[:n] = ids
    v[n:] = ids[(n - 1) // BLOCK * BLOCK :].min()
    v = v.reshape(full, BLOCK)
    low = v.min(axis=1)
    rest = v - low[:, None]
    need = _bits(rest)
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.partition(need, rank, axis=1)[:, rank]
    out: list[bytes] = [b""] * full
    count = np.full(full, BLOCK)
    count[-1] = n - (full - 1) * BLOCK
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        part = rest[rows]
        payload = pack((part & np.uint32((1 << int(w)) - 1)).reshape(-1), int(w))
        size = BLOCK // 64 * int(w) * 8
        over = need[rows] > w
        r, c = np.nonzero(over)
        high = (part[r, c] >> np.uint32(w)).astype("<u4") if w < 32 else np.zeros(0, "<u4")
        cuts = np.searchsorted(r, np.arange(len(rows) + 1))
        where = c.astype("u1").tobytes()
        high_bytes = high.tobytes()
        for k, row in enumerate(rows):
            a, b = int(cuts[k]), int(cuts[k + 1])
            head = struct.pack("<IBHH", int(low[row]), int(w), int(count[row]), b - a)
            out[row] = head + payload[k * size : (k + 1) * size] + where[a:b] + high_bytes[4 * a : 4 * b]
    return out


def decode_blocks(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """ids of the blocks that start at offsets in data."""
    heads = [struct.unpack_from("<IBHH", data, o) for o in offsets]
    if not heads:
        return np.zeros(0, np.uint32)
    low, width, count, extra = (np.array(x, np.int64) for x in zip(*heads, strict=True))
    out = np.empty((len(heads), BLOCK), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    body = np.asarray(offsets, np.int64) + 9
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        size = BLOCK // 64 * int(w) * 8
        if w:
            words = np.ascontiguousarray(raw[body[rows][:, None] + np.arange(size)[None, :]].reshape(-1, int(w) * 8)).view("<u8")
        else:
            words = np.zeros((len(rows) * (BLOCK // 64), 0), np.uint64)
        out[rows] = unpack(words, int(w)).reshape(len(rows), BLOCK).astype(np.uint32)
    for k in np.flatnonzero(extra):
        at, n, w = int(body[k] + BLOCK // 64 * width[k] * 8), int(extra[k]), int(width[k])
        where = raw[at : at + n]
        high = raw[at + n : at + 5 * n].copy().view("<u4")
        out[k, where] |= high << np.uint32(w)
    out += low.astype(np.uint32)[:, None]
    keep = np.arange(BLOCK)[None, :] < count[:, None]
    return out[keep] if count.sum() != out.size else out.reshape(-1)


# ---------------------------------------------------------------- shard files


class ShardWriter:
    """Writes one shard under a temporary name and moves it into place, so a retried task leaves one whole file."""

    CHUNK = BLOCK * 4096

    def __init__(self, base: str, shard: int, percentile: float):
        import uuid

        self.fs, root = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/shard-{shard:08d}.pfor"
        self.temp = f"{root}/.{shard:08d}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.percentile = len(MAGIC), percentile
        self.parts, self.held = [], 0
        self.offsets: list[int] = []
        self.docs: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids, null.astype(np.int64), lengths.astype(np.int64)]))
        self.tokens += len(ids)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.CHUNK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, cut, self.CHUNK):
            for b in encode_blocks(ids[a : min(cut, a + self.CHUNK)], self.percentile):
                self.offsets.append(self.at)
                self.out.write(b)
                self.at += len(b)
        self.parts, self.held = [ids[cut:]], len(ids) - cut

    def close(self) -> tuple[int, int]:
        self._flush(True)
        docs = np.concatenate(self.docs, axis=1) if self.docs else np.zeros((3, 0), np.int64)
        index_at = self.at
        block_index = zlib.compress(np.diff(np.array(self.offsets, "<i8"), prepend=0).tobytes(), 1)
        doc_index = zlib.compress(docs.astype("<i8").tobytes(), 1)
        self.out.write(block_index + doc_index)
        self.out.write(struct.pack("<9Q", index_at, len(block_index), len(doc_index), len(self.offsets), docs.shape[1], self.tokens, BLOCK, 1, int.from_bytes(MAGIC, "little")))
        self.out.close()
        self.fs.move(self.temp, self.path)
        return docs.shape[1], self.tokens


class ShardReader:
    """Reads a shard: whole documents, or any id range through the block index."""

    def __init__(self, base: str, shard: int):
        fs, root = pafs.FileSystem.from_uri(base)
        with fs.open_input_file(f"{root}/shard-{shard:08d}.pfor") as f:
            self.data = f.read()
        at, nb, nd, blocks, docs, self.tokens, _, _, magic = struct.unpack("<9Q", self.data[-72:])
        if magic != int.from_bytes(MAGIC, "little"):
            raise ValueError(f"shard {shard} of {base} is not a PFR1 file")
        self.offsets = np.cumsum(np.frombuffer(zlib.decompress(self.data[at : at + nb]), "<i8")) if blocks else np.zeros(0, np.int64)
        self.docs = np.frombuffer(zlib.decompress(self.data[at + nb : at + nb + nd]), "<i8").reshape(3, docs)

    def ids(self, start: int, n: int) -> np.ndarray:
        a, b = start // BLOCK, -(-(start + n) // BLOCK)
        out = decode_blocks(self.data, self.offsets[a:b])
        return out[start - a * BLOCK : start - a * BLOCK + n]

    def documents(self, tokens_at_once: int = 1 << 20):
        """(doc_id or None, ids) for each document, decoding a bounded run of blocks at a time."""
        starts = np.concatenate([[0], np.cumsum(self.docs[2])])
        k, n = 0, self.docs.shape[1]
        while k < n:
            end = max(k + 1, int(np.searchsorted(starts, starts[k] + tokens_at_once, "right")) - 1)
            ids = self.ids(int(starts[k]), int(starts[end] - starts[k]))
            for i in range(k, end):
                a = int(starts[i] - starts[k])
                yield (None if self.docs[1, i] else int(self.docs[0, i])), int(starts[i]), ids[a : a + int(self.docs[2, i])]
            k = end


# ---------------------------------------------------------------- tokenizer


# The steps before the model that the short way for stretches of letters stands on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level letters: printable bytes stand for themselves, the others for 256 and up in order.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def _all_letters(text: str) -> bool:
    """Letters that stay letters when lowered and composed: none that leaves a combining mark, which would join the marks behind it."""
    if not text.isalpha() or "\u0130" in text:
        return False
    return max(text) < "\u0250" or unicodedata.normalize("NFC", text.lower()).isalpha()


class _Words(dict):
    """Ids by word; a missing word is learned."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class WordEncoder:
    """Encodes whole texts with a file of the tokenizers library whose pre-tokenizer drops white space.

    Such a tokenizer treats the stretches between ASCII white space independently,
    so each distinct stretch goes through the library once per worker and a text
    is the concatenation of its stretches' ids.
    """

    #: Words of a generation; at most two generations are held.
    LIMIT = 600_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.cache, self.last = Tokenizer.from_file(path), _Words(self.learn), {}
        top = max(self.lib.get_vocab().values(), default=0) + 1
        self.packed = [struct.pack("<I", i) for i in range(top)]
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        self.model = self.lib.model if (plan["normalizer"], plan["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER) else None

    def _letters(self, core: bytes) -> bytes | None:
        """The ids of a stretch of letters straight from the library's model, where its other steps are known to change nothing but case."""
        if self.model is None:
            return None
        if core.isascii():
            text = core.decode()  # lowered before; its bytes stand for themselves
        else:
            text = core.decode("utf-8", "replace")
            if max(text) >= "\u0250":
                return None
            text = text.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(text)])

    def _whole(self, w: bytes) -> bytes:
        return array("I", self.lib.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def learn(self, w: bytes) -> bytes:
        """The ids of a stretch that is not in the cache."""
        # words in use come back from the last generation as they are met
        ids = self.last.get(w)
        if ids is not None:
            return ids
        # marks after letters are one piece of their own, and ASCII letters are lowered anyway
        core = w.rstrip(MARKS)
        if core.isalpha() or (core and _all_letters(core.decode("utf-8", "replace"))):
            mark, core = w[len(core) :], core.lower()
            if mark or core != w:
                return self.cache[core] + self.cache[mark] if mark else self.cache[core]
            ids = self._letters(core)
        return self._whole(w) if ids is None else ids

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and each text's count with it."""
        if len(self.cache) > self.LIMIT:
            self.last, self.cache = self.cache, _Words(self.learn)
        end, known = struct.pack("<I", end_id), self.cache.__getitem__
        # a word is looked up once: what is missing is learned where it is met
        out = [b"".join(map(known, (t or "").encode("utf-8", "replace").split())) + end for t in texts]
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4


# ---------------------------------------------------------------- operator


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 1, percentile: float = 0.9, shard_mb: float = 8, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int]]:
    """Encode docs and write them to out_dir as PFOR shards in ascending id order.

    Returns (shard, documents, tokens) by shard: the only thing that reaches the driver.
    """
    spark = docs.sparkSession
    n = max(partitions(docs, shard_mb), min(shuffles(spark), 1 << 16))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = slim.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def write(batches):
        from pyspark import TaskContext

        gc.disable()  # nothing here makes cycles, and scans of a large word cache cost much
        shard = TaskContext.get().partitionId()
        encoder, writer = held(f"words {tokenizer_path}", lambda: WordEncoder(tokenizer_path)), None
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                writer = writer or ShardWriter(out_dir, shard, percentile)
                ids, lengths = encoder.encode(part.column(1).to_pylist(), end_id)
                keys = part.column(0)
                writer.add(keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), lengths, ids)
        if writer:
            docs_n, tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "docs": pa.array([docs_n], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return sorted(tuple(r) for r in placed.mapInArrow(write, "shard long, docs long, tokens long").collect())


def read_token_files(spark: SparkSession, out_dir: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """One row per document from the files: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    names = [s for s, _, _ in shards]
    before = np.concatenate([[0], np.cumsum([t for _, _, t in shards])[:-1]]).tolist()

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc, start, ids in ShardReader(out_dir, names[k]).documents():
                    rows["doc_id"].append(doc)
                    rows["start"].append(before[k] + start)
                    rows["n_tokens"].append(len(ids))
                    rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in rows.items()})

    return spark.range(0, len(names), 1, len(names)).mapInArrow(read, schema)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write docs to PFOR shards in the shared folder and report them as read back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    out = scratch(spark, "tokens")
    return read_token_files(spark, out, write_token_files(docs, out, tokenizer_path, end_id))
