"""Removal of repeated substrings: every byte covered by a string of ``length`` bytes that also starts earlier.

Earlier is a smaller doc_id, or an earlier start in the same document; strings never cross documents and are judged on
the input. The suffixes that matter are found and refined in four steps over blocks of documents:

1. Each window of ``length`` bytes is anchored at the smallest hash of its grams. Equal windows have equal anchors, so a
   window whose anchor occurs once in the corpus is unique, whatever stands around it.
2. Anchors are counted over the corpus; blocks get back those that occur more than once.
3. The surroundings of these anchors are sent to the bucket of the anchor. Surroundings that stood before in the same task
   are settled there, so a passage in a third of all documents arrives once per task.
4. Bucket-pointer refinement: all places in a bucket start in buckets by their first 25 bytes. Buckets are split by sorting
   on the bucket of the place 25 bytes on, and the refined buckets are used again for the place 50 bytes on, until a bucket
   holds equal strings of the full length. All but the first place of a bucket are removed.

NULL texts count as empty and texts shorter than ``length`` keep all bytes. Rows with the same doc_id count as separate
documents (in order of their blocks); NULL ids come first. Other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _BASE, _BYTE, _powers, as_bytes, id_and_text, mix, slices, span_hashes
from quarry.session import cut

LENGTH = 100
GRAM = 32
#: Text bytes of a block of documents, of a bucket, and of what is worked on at once.
BLOCK_BYTES, BUCKET_BYTES, PIECE = 2 << 20, 8 << 20, 1 << 20
_NO_ID = np.iinfo(np.int64).min
_BLOCK = "block long, doc_ids array<long>, sizes array<long>, n_bytes long, body binary"


def _compress(raw: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(raw)


def _decompress(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(body)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of a task in rows of about ``block_bytes`` of text each."""

    def packed(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, limit=block_bytes):
                data, offsets = as_bytes(rows.column("text"))
                yield pa.RecordBatch.from_pylist(
                    [{"block": (part << 32) + at, "doc_ids": rows.column("doc_id").to_pylist(), "sizes": np.diff(offsets).tolist(), "n_bytes": len(data), "body": _compress(data.tobytes())}],
                    schema=pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("body", pa.binary())]),
                )
                at += 1

    return id_and_text(docs).mapInArrow(packed, _BLOCK)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    n = len(data) - size + 1
    powers = _powers(len(data), _BASE)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers, out=sums[1:])
    return mix((sums[size:] - sums[:n]) * _powers(n, np.uint64(pow(int(_BASE), -1, 1 << 64))))


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    out, reach = keys, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(keys) - width + 1], out[width - reach : width - reach + len(keys) - width + 1])


def anchored(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, last window, row) of runs of windows with one anchor, piece by piece of the buffer."""
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        piece = data[at : at + PIECE + length - 1]
        if len(piece) < length:
            return
        hashes = _gram_hashes(piece, gram)
        # The smallest upper half of a hash wins, of equals the first: both depend on the bytes of the window alone.
        keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_window_minima(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        window = np.arange(at, at + len(anchor))
        row = np.searchsorted(offsets, window, side="right") - 1
        inside = window + length <= offsets[row + 1]
        window, anchor, row = window[inside], anchor[inside], row[inside]
        if not len(window):
            continue
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (np.diff(window) != 1)))
        yield hashes[anchor[new]], window[new], window[np.append(new[1:], len(window)) - 1], row[new]


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(_decompress(row["body"]), np.uint8), np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))])


def _anchor_counts(table: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """(bucket, block, body): the anchors of every block, those that occur in it several times twice."""

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data, offsets = _opened(row)
                found = [h for h, *_ in anchored(data, offsets, length, gram)]
                if not found:
                    continue
                h = np.sort(np.concatenate(found))
                h = h[(np.append(True, h[1:] != h[:-1])) | (np.append([True, True], h[2:] != h[:-2])[: len(h)])]
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, bucket = h[order], bucket[order]
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                bodies = [h[a:b].tobytes() for a, b in zip(edges, np.append(edges[1:], len(h)))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges]), pa.array([row["block"]] * len(edges), pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "block", "body"])

    return table.mapInArrow(scan, "bucket long, block long, body binary")


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block of a bucket the anchors that occur more than once in the corpus."""
    own = [np.frombuffer(b, np.uint64) for b in pdf["body"]]
    values, counts = np.unique(np.concatenate(own), return_counts=True)
    values = values[counts > 1]
    out = []
    for block, h in zip(pdf["block"], own):
        h = np.unique(h)
        at = np.searchsorted(values, h)
        at[at == len(values)] = 0
        hit = h[values[at] == h] if len(values) else h[:0]
        if len(hit):
            out.append((block, hit.tobytes()))
    return pd.DataFrame(out, columns=["block", "anchors"])


_SENT = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("block", "<i8"), ("row", "<i4"), ("start", "<i8"), ("size", "<i4")])


def _surroundings(table: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """From blocks with their repeated anchors: surroundings for buckets (bucket, meta, body), and windows settled within the
    task as spans (block, body)."""

    def scan(batches):
        best: dict[tuple[int, int, int], tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data, offsets = _opened(row)
                wanted = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in row["anchors"]]))
                docs = np.array([_NO_ID if d is None else d for d in row["doc_ids"]], np.int64)
                parts = list(anchored(data, offsets, length, gram))
                h, first, last, of = (np.concatenate([p[j] for p in parts]) for j in range(4))
                at = np.searchsorted(wanted, h)
                at[at == len(wanted)] = 0
                keep = wanted[at] == h
                h, first, last, of = h[keep], first[keep], last[keep], of[keep]
                whole = np.concatenate([span_hashes(data[a : a + PIECE + 4 * length], first[m] - a, last[m] + length - a) for a in range(0, max(1, len(data)), PIECE) if (m := (first >= a) & (first < a + PIECE)).any()] or [np.zeros(0, np.uint64)])
                if len(best) > 1 << 19:
                    best.clear()
                send = np.zeros(len(h), bool)
                order = np.lexsort((first - offsets[of], of, docs[of]))
                keys = list(zip(h[order].tolist(), whole[order].tolist(), (last - first)[order].tolist()))
                places = list(zip(docs[of[order]].tolist(), [row["block"]] * len(order), of[order].tolist(), first[order].tolist()))
                for j, key, place in zip(order.tolist(), keys, places):
                    known = best.get(key)
                    if known is None or place < known:
                        best[key] = place
                        send[j] = True
                settled = ~send
                if settled.any():
                    yield _batch(block=[row["block"]], spans=[_spans(of[settled], first[settled] - offsets[of[settled]], last[settled] + length - offsets[of[settled]])])
                h, first, last, of = h[send], first[send], last[send], of[send]
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, first, last, of, bucket = h[order], first[order], last[order], of[order], bucket[order]
                sent = np.empty(len(h), _SENT)
                sent["hash"], sent["doc"], sent["block"], sent["row"], sent["start"], sent["size"] = h, docs[of], row["block"], of, first - offsets[of], last - first + length
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.zeros(0, np.int64)
                metas, bodies = [], []
                for a, b in zip(edges, np.append(edges[1:], len(h))):
                    sizes = sent["size"][a:b].astype(np.int64)
                    place = np.repeat(first[a:b] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                    metas.append(_compress(sent[a:b].tobytes(), 1))
                    bodies.append(_compress(data[place].tobytes()))
                if metas:
                    yield _batch(bucket=bucket[edges].tolist(), meta=metas, body=bodies)

    return table.mapInArrow(scan, "bucket long, meta binary, body binary, block long, spans binary")


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"bucket": pa.int64(), "meta": pa.binary(), "body": pa.binary(), "block": pa.int64(), "spans": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], list(kinds))


_SPAN = np.dtype([("row", "<i4"), ("start", "<i8"), ("end", "<i8")])


def _spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    out = np.empty(len(row), _SPAN)
    out["row"], out["start"], out["end"] = row, start, end
    return _compress(out.tobytes(), 1)


def refine(data: np.ndarray, left: np.ndarray, length: int, first: int = 25) -> np.ndarray:
    """The bucket of the ``length``-byte string at each place that has ``left`` >= length bytes before its end, else -1."""
    step = min(first, length)
    pointer = np.full(len(data), -1, np.int64)
    if len(data) < step:
        return pointer
    hashes, at = _gram_hashes(data, step), np.flatnonzero(left[: len(data) - step + 1] >= step)
    pointer[at] = np.unique(hashes[at], return_inverse=True)[1]
    while step < length:
        on = min(step, length - step)  # the string of step + on bytes is the string here and the one that begins ``on`` later
        at = at[left[at] >= step + on]
        refined = np.unique(pointer[at] * np.int64(len(data)) + pointer[at + on], return_inverse=True)[1]
        pointer = np.full(len(data), -1, np.int64)
        pointer[at] = refined
        step += on
    return pointer


def _refined(length: int):
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = np.concatenate([np.frombuffer(_decompress(m), _SENT) for m in pdf["meta"]])
        bodies = [np.frombuffer(_decompress(b), np.uint8) for b in pdf["body"]]
        data = np.concatenate(bodies)
        ends = np.cumsum(sent["size"].astype(np.int64))
        begins = ends - sent["size"]
        by_hash = np.argsort(sent["hash"], kind="stable")
        same = np.append(sent["hash"][by_hash][1:] != sent["hash"][by_hash][:-1], True)
        volume = np.cumsum(sent["size"][by_hash].astype(np.int64))
        out, at = [], 0
        while at < len(by_hash):  # whole groups of anchors, about PIECE bytes at a time
            to = int(np.searchsorted(volume, (volume[at - 1] if at else 0) + PIECE))
            to = at + int(np.argmax(same[max(at, to - 1) :])) + max(0, to - 1 - at) + 1
            own = by_hash[at:to]
            at = to
            own = own[np.lexsort((sent["start"][own], sent["row"][own], sent["block"][own], sent["doc"][own]))]
            s = sent[own]
            sizes = s["size"].astype(np.int64)
            base = np.cumsum(sizes) - sizes
            n = int(sizes.sum())
            text = data[np.repeat(begins[own] - base, sizes) + np.arange(n)]
            left = np.repeat(base + sizes, sizes) - np.arange(n)
            pointer = refine(text, left, length)
            window = np.flatnonzero(pointer >= 0)
            _, first = np.unique(pointer[window], return_index=True)  # places stand in their order in the corpus
            gone = np.ones(len(window), bool)
            gone[first] = False
            window = window[gone]
            if not len(window):
                continue
            context = np.searchsorted(base, window, side="right") - 1
            new = np.flatnonzero(np.append(True, (np.diff(window) != 1) | (np.diff(context) != 0)))
            last = np.append(new[1:], len(window)) - 1
            c = context[new]
            start = s["start"][c] + window[new] - base[c]
            end = s["start"][c] + window[last] - base[c] + length
            order = np.argsort(s["block"][c], kind="stable")
            block = s["block"][c][order]
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(order))):
                o = order[a:b]
                out.append((int(block[a]), _spans(s["row"][c][o], start[o], end[o])))
        return pd.DataFrame(out, columns=["block", "spans"])

    return settle


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            data, offsets = _opened(row)
            change = np.zeros(len(data) + 1, np.int32)
            for body in row["spans"] or ():
                s = np.frombuffer(_decompress(body), _SPAN)
                np.add.at(change, offsets[s["row"]] + s["start"], 1)
                np.subtract.at(change, offsets[s["row"]] + s["end"], 1)
            gone = np.cumsum(change[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            begins = gone & ~np.concatenate([[False], gone[:-1]])
            edges = offsets[:-1][offsets[:-1] < len(data)]
            begins[edges] = gone[edges]
            runs = np.concatenate([[0], np.cumsum(begins)])
            digests = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(offsets)), pa.array(np.diff(before[offsets])), pa.array(np.diff(runs[offsets])), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The blocks of ``docs`` and, by block, the spans to remove."""
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    table = cut(blocks(docs, block_bytes))
    total = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-int(total) // bucket_bytes))
    anchors = _anchor_counts(table, buckets, length, gram).groupBy("bucket").applyInPandas(_repeated, "block long, anchors binary")
    per_block = cut(anchors.groupBy("block").agg(F.collect_list("anchors").alias("anchors")))
    around = cut(_surroundings(table.join(per_block, "block"), buckets, length, gram))
    refined = around.where("bucket is not null").select("bucket", "meta", "body").groupBy("bucket").applyInPandas(_refined(length), "block long, spans binary")
    spans = around.where("spans is not null").select("block", "spans").unionByName(refined)
    return table, cut(spans.groupBy("block").agg(F.collect_list("spans").alias("spans")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``."""
    table, spans = find_repeats(docs, length, gram, block_bytes, bucket_bytes)
    return table.join(spans, "block", "left").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept binary): the remaining bytes of every document; cuts may fall within a character."""

    def texts(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data, offsets = _opened(row)
                change = np.zeros(len(data) + 1, np.int32)
                for body in row["spans"] or ():
                    s = np.frombuffer(_decompress(body), _SPAN)
                    np.add.at(change, offsets[s["row"]] + s["start"], 1)
                    np.subtract.at(change, offsets[s["row"]] + s["end"], 1)
                keep = np.cumsum(change[:-1]) == 0
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([data[a:b][keep[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], ["doc_id", "kept"])

    table, spans = find_repeats(docs, length, gram)
    return table.join(spans, "block", "left").mapInArrow(texts, "doc_id long, kept binary")
