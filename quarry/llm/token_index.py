"""Token ids in one wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit-planes: the first plane has the highest bit of every id in text
order, and each further plane has the next bit after a stable partition by the bit before. Counts of ones before every
512th bit give rank and select, so that a token at a place, the count of an id in a range and the places of an id come
from the compressed shard without decoding it.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import id_and_text, slices
from quarry.llm.tokens import BYTE_BPE, Encoder

MAGIC = b"WVM1"
BLOCK = 512
#: A shard is closed once it holds so many ids; documents are not cut.
SHARD_TOKENS = 1 << 20
#: Characters of a text that take part in the choice of its task, next to the id.
RANGE_CHARS = 64
FILE_SCHEMA = "part int, shard int, n_tokens long, doc_ids array<long>, lengths array<long>, body binary"


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        ids = np.ascontiguousarray(ids, np.uint32 if len(ids) and int(ids.max()) > 0xFFFF else np.uint16)
        planes, zeros, ranks = [], [], []
        for bit in range(int(ids.max()).bit_length() - 1 if len(ids) else -1, -1, -1):
            ones = (ids >> bit & 1).astype(bool)
            packed = np.packbits(ones)
            planes.append(packed)
            zeros.append(len(ids) - int(np.count_nonzero(ones)))
            ranks.append(_block_ranks(packed))
            ids = np.concatenate([ids[~ones], ids[ones]])
        return cls(len(ids), planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [MAGIC, struct.pack("<QI", self.n, len(self.planes))]
        for plane, zero, rank in zip(self.planes, self.zeros, self.ranks):
            a, b = pack(plane.tobytes()), pack(rank.astype("<u4").tobytes())
            parts += [struct.pack("<QII", zero, len(a), len(b)), a, b]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, body: bytes) -> "WaveletMatrix":
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        if body[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        (n, levels), at = struct.unpack_from("<QI", body, 4), 16
        planes, zeros, ranks = [], [], []
        for _ in range(levels):
            zero, a, b = struct.unpack_from("<QII", body, at)
            at += 16
            planes.append(np.frombuffer(unpack(body[at : at + a]), np.uint8))
            ranks.append(np.frombuffer(unpack(body[at + a : at + a + b]), "<u4"))
            zeros.append(zero)
            at += a + b
        return cls(n, planes, zeros, ranks)

    def decode(self) -> np.ndarray:
        """All ids in text order: the planes are merged back from the last to the first."""
        ids = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for level, (plane, zero) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            ones = np.unpackbits(plane, count=self.n).astype(bool)
            before = np.empty_like(ids)
            before[~ones] = ids[:zero]
            before[ones] = ids[zero:] | ids.dtype.type(1 << level)
            ids = before
        return ids

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3] >> (7 - (at & 7)) & 1)

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before place ``at``."""
        block = at // BLOCK
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (at + 7) // 8])
        return int(self.ranks[level][block]) + int(bits[: at - block * BLOCK].sum())

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, at), self._ones(level, at)
            out = out << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, end)
            one = token >> (len(self.planes) - 1 - level) & 1
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if one else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id stands in places ``start`` to ``end`` (exclusive)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of an id."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            at = self._nth(level, at - self.zeros[level] if one else at, one)
        return at

    def _nth(self, level: int, k: int, one: int) -> int:
        """The place of the k-th one (or zero) of a plane."""
        before = self.ranks[level].astype(np.int64)
        if not one:
            before = np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], count=min(BLOCK, self.n - block * BLOCK))
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def _block_ranks(packed: np.ndarray) -> np.ndarray:
    """Ones before every block of bits, and before the end."""
    ones = np.add.reduceat(np.bitwise_count(packed).astype(np.int64), np.arange(0, len(packed), BLOCK // 8)) if len(packed) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(ones)])


def write(docs: DataFrame, path: str, vocabulary: str = BYTE_BPE, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every text and writes shards to ``path``, a folder all machines share, in ascending doc_id order.

    NULL text counts as empty and gives the end id alone; NULL ids come first; rows with the same id stay, ordered by
    text. Texts of any length are encoded whole, in slices. An empty table gives an empty file. Other columns
    are not read.
    """

    def shards(batches):
        encoder, part, shard = Encoder.of(vocabulary), TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, total = [], [], [], 0

        def close():
            body = WaveletMatrix.build(np.concatenate(ids)).to_bytes()
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_tokens": total, "doc_ids": doc_ids, "lengths": lengths, "body": body}], schema=_FILE)

        for batch in batches:
            for rows in slices(batch):
                found, offsets = encoder.encode(rows.column("text"))
                for i, doc in enumerate(rows.column("doc_id").to_pylist()):
                    own = np.append(found[offsets[i] : offsets[i + 1]], np.uint16(end_id))
                    ids.append(own)
                    doc_ids.append(doc)
                    lengths.append(len(own))
                    total += len(own)
                    if total >= shard_tokens:
                        yield close()
                        ids, doc_ids, lengths, total, shard = [], [], [], 0, shard + 1
        if ids:
            yield close()

    # Ranges split the rows of one id by how their texts begin, and short texts that are alike by where they are read; what
    # is sampled for the ranges stays short. Each task then orders whole texts.
    begin, place = F.substring("text", 1, RANGE_CHARS), F.when(F.length(F.coalesce("text", F.lit(""))) <= RANGE_CHARS, F.monotonically_increasing_id()).otherwise(F.lit((1 << 63) - 1))
    rows = id_and_text(docs).select("doc_id", begin.alias("begin"), place.alias("place"), "text")
    ordered = rows.repartitionByRange("doc_id", "begin", "place").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    ordered.mapInArrow(shards, FILE_SCHEMA).write.parquet(path)


_FILE = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("body", pa.binary())])


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, start): how many ids all earlier shards hold. Only one number per part meets in one task."""
    sizes = spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = sizes.withColumn("inner", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens"))
    return within.join(parts, "part").select("part", "shard", (F.col("before") + F.col("inner")).alias("start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, shard) of every document, decoded from the shards."""

    def decoded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["body"]).decode().astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + starts), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "part", "shard"],
                )

    files = spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "shard", "doc_ids", "lengths", "body")
    return files.join(F.broadcast(shard_starts(spark, path)) if _few(spark, path) else shard_starts(spark, path), ["part", "shard"]).mapInArrow(
        decoded, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int"
    )


def _few(spark: SparkSession, path: str) -> bool:
    """Whether the starts of all shards are certain to fit a broadcast (at most 100,000 rows of three numbers)."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).select("shard").count() <= 100_000


def token_counts(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(part, shard, n): how often an id stands in each shard, counted on the planes."""

    def counted(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "shard": row["shard"], "n": WaveletMatrix.from_bytes(row["body"]).count(token)}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())]))

    return spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "shard", "body").mapInArrow(counted, "part int, shard int, n long")


def token_places(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(place long): where an id stands in the whole corpus, by select on the planes."""

    def found(batches):
        for batch in batches:
            for row in batch.to_pylist():
                places = WaveletMatrix.from_bytes(row["body"]).occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + p for p in places], pa.int64())], ["place"])

    files = spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "shard", "body")
    return files.join(shard_starts(spark, path), ["part", "shard"]).mapInArrow(found, "place long")
