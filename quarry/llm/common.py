"""What several text operators share: reading, whole texts as byte buffers, words and their hashes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Texts of one Arrow batch are worked on in slices of about so many bytes, to bound memory next to very long texts.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text); a NULL text counts as empty. Other columns are left out, so that clashing names cannot matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def unused(name: str, columns: list[str]) -> str:
    """A name like ``name`` that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(rows: DataFrame, text_hash: Column) -> DataFrame:
    """One row for each doc_id and text, with all its columns. Nothing is compared but these two, so columns may have any type."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    keyed = rows.select(F.col("doc_id").alias("id"), text_hash.alias("hash"), whole)
    return keyed.groupBy("id", "hash").agg(F.first("row").alias("row")).select("row.*")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row slices whose texts sum to about ``limit`` bytes (one row at least)."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte buffer, and the offsets of its rows (one more than rows). NULL is empty."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for every span; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    powers = _powers(n + 1, _BASE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[:n], out=sums[1:])
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return mix((sums[ends] - sums[starts]) * _powers(n + 1, inverse)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _class_table(separators: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[separators] = 0
    return table


#: Lower-cases A-Z and turns separators into 0. WORDS separates at white space, TOKENS at every ASCII character that is no letter or digit.
WORDS = _class_table(np.array([0x20, *range(0x09, 0x0E)]))
TOKENS = _class_table(np.array([c for c in range(128) if not chr(c).isalnum()]))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows of a buffer: lower-cased data, starts and ends, and how many words lie before each row's end (rows + 1)."""
    low = table[data]
    inside = np.empty(len(low) + 2, bool)
    inside[0] = inside[-1] = False
    separators = np.zeros(256, bool)
    separators[[c for c in range(256) if table[c] == 0 and c != 0 or table is TOKENS and c == 0]] = True
    np.logical_not(separators[data], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    finish = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[1:-1][edges]
    finish[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def byte_blocks(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive blocks of a buffer of about ``limit`` bytes. A row that is longer goes on in the
    next block; it is cut before a separator (``separators`` says which bytes are), so that no word is torn."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + limit)
        if b < n:
            at, to = b, int(offsets[np.searchsorted(offsets, b)])  # the next row begins there
            b = to
            while at < to:
                found = np.flatnonzero(separators[data[at : min(to, at + (1 << 16))]])
                if len(found):
                    b = at + int(found[0])
                    break
                at += 1 << 16
        first = int(np.searchsorted(offsets, a, side="right")) - 1
        last = int(np.searchsorted(offsets, b, side="left"))
        yield first, data[a:b], np.clip(offsets[first : last + 1], a, b) - a
        a = b
