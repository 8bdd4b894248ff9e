"""Importance resampling of documents towards a target, by hashed n-gram models and Gumbel top-k.

A text is a bag of words and runs of signs (ASCII lower case) and of their neighbouring pairs, hashed into a fixed number of
buckets. The raw model counts every document, the target model a bounded sample of documents labelled good. A document's
log weight is the sum of its log ratios of the two models; adding Gumbel noise and taking the largest k draws k documents
without replacement in proportion to their weights. The noise is a hash of the row, so a run can be repeated.

By default k is the share of good ones among the labelled documents, of all rows. NULL and empty texts have no n-grams and are
drawn last. Without good labels both models are equal and the draw is uniform. Repeated rows count each time; rows with a NULL
doc_id take part, labels with a NULL doc_id or quality do not. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, id_and_text, mix, slices, span_hashes
from quarry.session import cut

BUCKET_BITS = 14
#: Good documents that the target model counts, at most.
TARGET_ROWS = 20_000
#: A log weight below all others, for texts without n-grams.
NOTHING = -1e12
_KIND = np.full(256, 2, np.uint8)
_KIND[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of a column, and the row of each."""
    data, offsets = as_bytes(texts)
    kind = _KIND[data]
    cut_ = np.ones(len(data) + 1, bool)
    if len(data):
        cut_[1:-1] = kind[1:] != kind[:-1]
        cut_[offsets] = True
    starts = np.flatnonzero(cut_[:-1])
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    row = np.searchsorted(offsets, starts, side="right") - 1
    hashes = span_hashes(_LOWER[data], starts, ends)
    same = row[1:] == row[:-1]
    pairs = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[same]
    shift = np.uint64(64 - BUCKET_BITS)
    return (np.concatenate([hashes, pairs]) >> shift).astype(np.int64), np.concatenate([row, row[:-1][same]])


def log_ratios(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log(target / raw) of every bucket, both with one added to each count."""
    good = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("good", F.lit(True))
    rows = id_and_text(docs).join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches):
        raw, target = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                bucket, row = grams(part.column("text"))
                raw += np.bincount(bucket, minlength=len(raw))
                own = np.asarray(part.column("good"))[row] if part.num_rows else np.zeros(0, bool)
                target += np.bincount(bucket[own.astype(bool)], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(1 << BUCKET_BITS), np.ones(1 << BUCKET_BITS)
    for r in sums.collect():  # one row per bucket, a fixed number
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == len(target):
        return np.zeros(len(raw))
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratios: np.ndarray, seed: int = 1) -> DataFrame:
    """(doc_id, log_weight, n_grams, key); key is the log weight with Gumbel noise."""

    def weigh(batches):
        for batch in batches:
            for rows in slices(batch):
                bucket, row = grams(rows.column("text"))
                n = np.bincount(row, minlength=rows.num_rows)
                total = np.where(n > 0, np.bincount(row, weights=ratios[bucket], minlength=rows.num_rows), NOTHING)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(total), pa.array(n.astype(np.int64)), rows.column("noise")], ["doc_id", "log_weight", "n_grams", "noise"])

    rows = id_and_text(docs).withColumn("noise", F.xxhash64("doc_id", "text", F.lit(seed)))
    out = rows.mapInArrow(weigh, "doc_id long, log_weight double, n_grams long, noise long")
    uniform = (F.shiftrightunsigned("noise", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return out.select("doc_id", "log_weight", "n_grams", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key"))


def largest(rows: DataFrame, k: int, key: str = "key", tie: str = "doc_id") -> DataFrame:
    """The k rows with the largest ``key``, ties by the smallest ``tie``. The bound is found by counting keys in ranges that
    narrow 4096-fold each time; only ties of the last one are sorted. ``rows`` should be a written table."""
    n = rows.count()
    if k >= n:
        return rows
    if k <= 0:
        return rows.limit(0)
    low, high, above = *rows.agg(F.min(key), F.max(key)).first(), 0
    parts = 4096
    while low < high:
        width = (high - low) / parts
        if width <= 0 or low + width == low:
            break
        own = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        slot = F.least(F.floor((F.col(key) - low) / width), F.lit(parts - 1))
        found = {r.s: (r.c, r.lo, r.hi) for r in own.groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for s in sorted(found, reverse=True):
            c, lo, hi = found[s]
            if above + c >= k:
                break
            above += c
        if (lo, hi) == (low, high):
            break
        low, high = lo, hi
    surely = rows.where(F.col(key) > high)
    edge = rows.where((F.col(key) >= low) & (F.col(key) <= high)).orderBy(F.desc(key), tie).limit(k - above)
    return surely.unionByName(edge)


def good_share(labels: DataFrame) -> float:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return known.agg(F.avg("q")).first()[0] or 0.0


def draw(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, log_weight, n_grams, key) of the documents drawn."""
    weighed = cut(weights(docs, log_ratios(docs, labels), seed))
    return largest(weighed, round(good_share(labels) * weighed.count()) if k is None else k)
