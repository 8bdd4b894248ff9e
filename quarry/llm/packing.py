"""Packing documents into fixed-length sequences by the sum-of-squares rule.

Documents longer than a sequence are cut into full pieces; the rest are placed, longest first, each into the open
sequence (or a new one) that makes the sum over residual gaps of squared counts of open sequences smallest; of equals,
the smallest gap. Groups of pieces are packed apart; sequences that stay open are taken apart again and packed anew in
fewer groups, so that each group of the last round, and not each group of the first, has a few open sequences.

NULL texts count as empty, rows that are alike are packed like any others, in all groups alike, and texts of any length are
cut into as many pieces as they need. An empty table gives no piece. Other columns are not read.
"""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, slices
from quarry.llm.tokens import WORD_BPE, Encoder
from quarry.session import cut

#: Pieces that are packed together; groups are drawn by hash, so each has the length mix of the whole.
GROUP_PIECES = 20_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 4096, vocabulary: str = WORD_BPE, end_id: int = 1) -> DataFrame:
    """One row per piece of every document. NULL text counts as empty and gives the end id alone; repeated rows stay."""

    def cut_up(batches):
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for rows in slices(batch):
                found, offsets = encoder.encode(rows.column("text"))
                out = []
                for i, doc in enumerate(rows.column("doc_id").to_pylist()):
                    ids = np.append(found[offsets[i] : offsets[i + 1]], np.uint16(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return id_and_text(docs).mapInArrow(cut_up, PIECE_SCHEMA)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence (from 0) of every piece, in the order given."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made, never = np.empty(len(lengths), np.int64), 0, np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        # Moving a sequence from gap g to g - size changes the sum by 2 * (counts[g - size] - counts[g] + 1); a full one leaves it.
        change = np.where(counts[size:] > 0, 2 * (counts[: capacity + 1 - size] - counts[size:] + 1), never)
        if counts[size]:
            change[0] = 1 - 2 * counts[size]
        fresh = 2 * counts[capacity - size] + 1 if size < capacity else 0
        k = int(np.argmin(change))
        if change[k] <= fresh:
            gap = size + k
            at = by_gap[gap].pop()
            counts[gap] -= 1
            left = gap - size
        else:
            at, made, left = made, made + 1, capacity - size
        if left:
            by_gap[left].append(at)
            counts[left] += 1
        out[i] = at
    return out


def _packed(round_: int, capacity: int, last: bool):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], ignore_index=True)
        bins = sum_of_squares(pdf["length"].to_numpy(), capacity)
        order = np.argsort(bins, kind="stable")
        sizes = pdf["length"].to_numpy()[order]
        ends = np.cumsum(sizes)
        first = np.append(True, bins[order][1:] != bins[order][:-1]) if len(order) else np.zeros(0, bool)
        offset = np.empty(len(pdf), np.int64)
        offset[order] = ends - sizes - np.repeat((ends - sizes)[first], np.diff(np.append(np.flatnonzero(first), len(order))))
        filled = np.bincount(bins, weights=pdf["length"])
        pdf["sequence_id"] = (np.int64(round_) << np.int64(60)) + (pdf["bucket"].to_numpy(np.int64) << np.int64(24)) + bins
        pdf["offset"] = offset
        pdf["done"] = True if last else filled[bins] >= capacity
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "done"]]

    return packed


def pack(parts: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES, rounds: int = 3) -> DataFrame:
    """Adds sequence_id and offset to pieces of ``length`` up to ``capacity``; other columns than those of ``pieces`` are left out."""
    schema = f"{PIECE_SCHEMA}, sequence_id long, offset long, done boolean"
    todo, out = cut(parts.select("doc_id", "piece", "start", "length", "ids_crc32")), None
    for round_ in range(rounds):
        n = todo.count()
        groups, last = max(1, -(-n // group_pieces)), round_ == rounds - 1
        last = last or groups == 1
        # The place in the written table spreads rows that are alike in every column.
        bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(round_), F.monotonically_increasing_id()), F.lit(groups)).cast("int")
        packed = cut(todo.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_packed(round_, capacity, last), schema))
        done = packed.where("done").drop("done")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        todo = packed.where("not done").drop("sequence_id", "offset", "done")
    return out


def pack_documents(docs: DataFrame, capacity: int = 4096, vocabulary: str = WORD_BPE, end_id: int = 1) -> DataFrame:
    return pack(pieces(docs, capacity, vocabulary, end_id), capacity)
