"""Token ids as wavelet matrices: one succinct, compressed file row per shard of documents.

A shard stores its ids as bit-planes, most significant bit first; each plane is followed by a stable partition of the
ids by that bit. Rank directories over the planes answer access, counting and occurrence look-up in one step per
plane, without decoding the shard. Shards are rows of a Parquet table (``payload``), written through Spark so that any
store Spark reaches can hold them and a lost executor's task is simply written again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import chunked, pieces_of, whole_text, with_running_base
from platewise.llm.word_encoder import encoder

MAGIC = b"WMX1"
#: Bits between two entries of a rank directory.
STRIDE = 512
#: Ids after which a shard is closed, at the end of a document.
SHARD_IDS = 1 << 19
SHARDS = "part long, seq long, n_ids long, n_docs long, doc_ids binary, doc_nulls binary, doc_lengths binary, payload binary"
_ARROW = pa.schema(
    [("part", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.binary()),
     ("doc_nulls", pa.binary()), ("doc_lengths", pa.binary()), ("payload", pa.binary())]
)


class WaveletMatrix:
    """A sequence of unsigned ids below 2**width with access, rank, count and select."""

    def __init__(self, n: int, width: int, planes: list[np.ndarray]):
        self.n, self.width = n, width
        self.planes = planes  # packed bits, little bit order
        self.zeros: list[int] = []
        self.ranks: list[np.ndarray] = []
        for plane in planes:
            ones = np.bitwise_count(plane)
            per = np.add.reduceat(ones, np.arange(0, len(ones), STRIDE // 8), dtype=np.int64) if len(ones) else ones.astype(np.int64)
            self.ranks.append(np.concatenate([[0], np.cumsum(per)]))
            self.zeros.append(n - int(self.ranks[-1][-1]))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        cur = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes = []
        for level in range(width - 1, -1, -1):
            bit = (cur >> level) & 1 != 0
            planes.append(np.packbits(bit, bitorder="little"))
            cur = np.concatenate([cur[~bit], cur[bit]])
        return cls(len(ids), width, planes)

    def to_bytes(self) -> bytes:
        packer = zstandard.ZstdCompressor(level=1)
        parts = [packer.compress(p.tobytes()) for p in self.planes]
        head = struct.pack("<4sQB", MAGIC, self.n, self.width) + struct.pack(f"<{self.width}I", *map(len, parts))
        return head + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, n, width = struct.unpack_from("<4sQB", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        sizes = struct.unpack_from(f"<{width}I", data, 13)
        at, planes, unpacker = 13 + 4 * width, [], zstandard.ZstdDecompressor()
        for size in sizes:
            planes.append(np.frombuffer(unpacker.decompress(data[at : at + size], max_output_size=(n + 7) // 8), np.uint8))
            at += size
        return cls(n, width, planes)

    def _ones_before(self, level: int, i: int) -> int:
        """Set bits of a plane among its first ``i``."""
        block, plane = i // STRIDE, self.planes[level]
        first, last = block * STRIDE // 8, i // 8
        out = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first:last]).sum())
        if i % 8:
            out += (int(plane[last]) & ((1 << i % 8) - 1)).bit_count()
        return out

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            ones = self._ones_before(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.width):
            a, b = self._ones_before(level, lo), self._ones_before(level, hi)
            if token >> (self.width - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` stands at positions lo..hi-1."""
        if token < 0 or token >> self.width:
            return 0
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The position of occurrence ``k`` (from 0) of ``token``; -1 if there are fewer."""
        if token < 0 or token >> self.width:
            return -1
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(self.width - 1, -1, -1):
            one = token >> (self.width - 1 - level) & 1
            at = self._select_bit(level, one, at - self.zeros[level] if one else at)
        return at

    def _select_bit(self, level: int, one: int, k: int) -> int:
        """The position of set (or unset) bit number ``k`` (from 0) of a plane."""
        ranks = self.ranks[level]
        if not one:
            ranks = np.minimum(np.arange(len(ranks), dtype=np.int64) * STRIDE, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * STRIDE // 8 : (block + 1) * STRIDE // 8], bitorder="little")
        bits = bits[: self.n - block * STRIDE]
        return block * STRIDE + int(np.flatnonzero(bits == one)[k - int(ranks[block])])

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the partitions from the last plane up."""
        cur = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(cur)
            up[~bit] = cur[: self.zeros[level]]
            up[bit] = cur[self.zeros[level] :] | cur.dtype.type(1 << (self.width - 1 - level))
            cur = up
        return cur


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text and write the ids, with ``end_id`` after each document, as wavelet shards under ``path``.

    Documents are ordered by doc_id (null first, equal ids by a hash of the text) through a range partitioning; each task writes the
    shards of its range one after another and holds one shard at a time. A null text is empty. Rows that repeat are
    written as often as they come. An empty table writes no shard. Other columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()

        def row(seq, names, texts, lengths):
            ids = np.frombuffer(b"".join(texts), "<u4")
            doc = np.array([0 if d is None else d for d in names], "<i8").tobytes()
            nulls = np.packbits([d is None for d in names]).tobytes()
            return part, seq, len(ids), len(names), doc, nulls, np.array(lengths, "<i8").tobytes(), WaveletMatrix.build(ids).to_bytes()

        def rows():
            names, texts, lengths, total, seq = [], [], [], 0, 0
            for batch in batches:
                for doc, text in zip(pieces_of(batch, "doc_id"), pieces_of(batch, "text")):
                    ids = enc.encode(text) + end
                    names.append(doc)
                    texts.append(ids)
                    lengths.append(len(ids) // 4)
                    total += len(ids) // 4
                    if total >= shard_ids:
                        yield row(seq, names, texts, lengths)
                        names, texts, lengths, total, seq = [], [], [], 0, seq + 1
            if names:
                yield row(seq, names, texts, lengths)

        yield from chunked(rows(), _ARROW)

    read = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("tie"))
    # The sample that cuts the ranges goes to the driver; with a hash for ties it holds no texts.
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    ordered = read.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    ordered.mapInArrow(shards, SHARDS).write.option("compression", "uncompressed").parquet(path)


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """The shards under ``path``, with ``base``: how many ids stand in the shards before."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = shards.select("part", "seq", "n_ids")
    bases = with_running_base(sizes, "part", ["seq"], "n_ids", "base").select("part", "seq", "base")
    return shards.join(bases, ["part", "seq"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit, with the end id)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for shard in batch.to_pylist():
                    ids = WaveletMatrix.from_bytes(shard["payload"]).decode().astype("<u4").tobytes()
                    nulls = np.unpackbits(np.frombuffer(shard["doc_nulls"], np.uint8)).tolist()
                    names = np.frombuffer(shard["doc_ids"], "<i8").tolist()
                    at = 0
                    for doc, null, n in zip(names, nulls, np.frombuffer(shard["doc_lengths"], "<i8").tolist()):
                        yield None if null else doc, shard["base"] + at, n, ids[4 * at : 4 * (at + n)]
                        at += n

        yield from chunked(rows(), schema)

    columns = ["doc_ids", "doc_nulls", "doc_lengths", "payload", "base"]
    return shard_table(spark, path).select(*columns).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Where ``token`` stands: one row per shard with its count and global positions, by rank and select alone."""
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("positions", pa.list_(pa.int64()))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for shard in batch.to_pylist():
                    matrix = WaveletMatrix.from_bytes(shard["payload"])
                    n = matrix.count(token)
                    if n:
                        yield shard["part"], shard["seq"], n, [shard["base"] + matrix.select(token, k) for k in range(n)]

        yield from chunked(rows(), schema)

    columns = ["part", "seq", "payload", "base"]
    return shard_table(spark, path).select(*columns).mapInArrow(found, "part long, seq long, n long, positions array<long>")
