"""Ranked lexical search by presence masks.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. One pass over the documents
keeps, per shard of documents, the postings of the terms that any item asks for (a column of terms and their counts for each
document), and counts for the weights. A second pass ranks shard by shard. There each document gets, for each item, a mask of the item's terms
that it holds, made by OR-ing the terms' bits over their postings. Documents with one mask form a group, whose maximum score is
the sum of the best contributions of the mask's terms in the shard. Masks are evaluated by falling maximum until no mask left
can reach the worst of the ``k`` best documents so far; these are carried from shard to shard of a task. The best of all tasks
are ranked together.

Scores are exact integers. Terms are looked up by a hash and compared byte by byte. The items are the query set: they go to
the tasks in blocks of bounded size, each against all documents.

NULL and empty texts have no terms: such a document is ranked nowhere, such an item gives no rows. Each row of the items is an
item of its own, repeated ones too; each row of the documents is ranked, with equal scores by doc_id, NULL last. Very long texts
are read whole, in blocks that end between terms. Without documents, or with fewer than ``k`` that score above 0, an item has
fewer rows. Other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import TOKENS, as_bytes, byte_blocks, id_and_text, slices, span_hashes, words
from quarry.session import cut

TOP = 10
#: Bytes of items that go to the tasks at once, about, and documents and postings of one shard, about.
BLOCK_BYTES = 4 << 20
SHARD_DOCUMENTS = 1 << 13
SHARD_POSTINGS = 1 << 21
#: Documents that are evaluated at once at first; each further step takes twice as many.
STEP = 32
_SPLIT = TOKENS == 0


def terms(text: str) -> list[bytes]:
    """All terms of a text, with repeats."""
    low, starts, ends, _ = words(*as_bytes(pa.array([text], pa.string())), TOKENS)
    body = low.tobytes()
    return [body[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class Vocabulary:
    """The terms of a block of items, looked up by hash and bytes."""

    def __init__(self, found: set[bytes]):
        own = sorted(found)
        sizes = np.array([len(t) for t in own], np.int64)
        at = np.append(0, np.cumsum(sizes))
        data = np.frombuffer(b"".join(own), np.uint8)
        hashes = span_hashes(data, at[:-1], at[1:])
        order = np.argsort(hashes, kind="stable")
        self.terms = [own[i] for i in order]
        self.index = {t: i for i, t in enumerate(self.terms)}
        self.hashes, self.at, self.size, self.data = hashes[order], at[:-1][order], sizes[order], data
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def look_up(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which spans, their term) of the spans that are terms."""
        hashes = span_hashes(low, starts, ends)
        which = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
        term = np.searchsorted(self.hashes, hashes[which])
        found = term < len(self.hashes)
        which, term = which[found], term[found]
        same = (self.hashes[term] == hashes[which]) & (self.size[term] == (ends - starts)[which])
        which, term = which[same], term[same]
        size = self.size[term]
        first = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = low[np.repeat(starts[which], size) + inside] == self.data[np.repeat(self.at[term], size) + inside]
        ok = np.logical_and.reduceat(equal, first) if len(first) else np.zeros(0, bool)  # no term is empty
        return which[ok], term[ok]


def postings(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms with repeats of each row), and row, term, count of every pair, by row and term."""
    data, offsets = as_bytes(texts)
    n, keys, counts = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, part, own in byte_blocks(data, offsets, _SPLIT):
        low, starts, ends, at = words(part, own, TOKENS)
        n[first : first + len(own) - 1] += np.diff(at)
        which, term = vocabulary.look_up(low, starts, ends)
        row = first + np.searchsorted(at, which, side="right") - 1
        key, count = np.unique(row * len(vocabulary.terms) + term, return_counts=True)
        keys.append(key)
        counts.append(count)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
    return n, *np.divmod(key, max(1, len(vocabulary.terms))), count


_SHARD = "docs array<bigint>, missing array<boolean>, n array<bigint>, ends array<int>, term array<int>, tf array<bigint>, held bigint, total bigint, df_term array<int>, df array<bigint>"


def index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per shard: its documents that hold a term of the vocabulary (id, terms with repeats), their postings one document
    after the other (``ends``), and counts over all its documents: those with terms, all terms, documents per term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c.split()[0] for c in _SHARD.split(", ")]
    kinds = [pa.list_({"array<bigint>": pa.int64(), "array<int>": pa.int32(), "array<boolean>": pa.bool_()}[k]) if "<" in k else pa.int64() for k in (c.split()[1] for c in _SHARD.split(", "))]

    def shard(parts: list[tuple]) -> pa.RecordBatch:
        ids, missing, n, sizes, term, tf, held, total = (list(c) for c in zip(*parts))
        term = np.concatenate(term)
        there, df = np.unique(term, return_counts=True)
        columns = [np.concatenate(ids), np.concatenate(missing), np.concatenate(n), np.cumsum(np.concatenate(sizes)), term, np.concatenate(tf), sum(held), sum(total), there, df]
        return pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(columns, kinds)], names)

    def scan(batches):
        parts, size, count = [], 0, 0
        for batch in batches:
            for rows in slices(batch):
                n, row, term, tf = postings(rows.column("text"), shared.value)
                own, sizes = np.unique(row, return_counts=True)
                ids = rows.column("doc_id").take(pa.array(own))
                parts.append((np.asarray(pa.compute.fill_null(ids, 0)), np.asarray(ids.is_null()), n[own], sizes, term, tf, int((n > 0).sum()), int(n.sum())))
                size, count = size + len(own), count + len(term)
                if size >= SHARD_DOCUMENTS or count >= SHARD_POSTINGS:
                    yield shard(parts)
                    parts, size, count = [], 0, 0
        if parts:
            yield shard(parts)

    return id_and_text(docs).mapInArrow(scan, _SHARD)


def length_factor(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with n terms: 25 and three quarters of 100 times n over the mean, rounded down."""
    if int(n.max(initial=0)) * 75 * documents < 1 << 63:
        return 25 + 75 * n * documents // total
    return np.array([25 + 75 * int(v) * documents // total for v in n], np.int64)


def contributions(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Item:
    """Distinct terms (places in the vocabulary) with weight times repeats; those of weight 0 are left out."""

    term: np.ndarray
    gain: np.ndarray


class Shard:
    """A shard's postings by document and by term, with their contributions."""

    def __init__(self, docs: np.ndarray, missing: np.ndarray, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int, total: int):
        self.docs, self.missing = docs, missing
        sizes = np.diff(ends, prepend=0)
        self.begins, self.ends = ends - sizes, ends
        row = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        self.term, self.part = term, contributions(tf, length_factor(n, documents, total)[row])
        by = np.argsort(term, kind="stable")
        self.rows = row[by]
        self.terms, self.at = np.unique(term[by], return_index=True)
        self.to = np.append(self.at[1:], len(by))
        self.best = np.maximum.reduceat(self.part[by], self.at) if len(by) else np.zeros(0, np.int64)

    def masks(self, item: Item) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents by mask, end of each mask's run, maximum score of each mask); masks by falling maximum."""
        at = np.searchsorted(self.terms, item.term)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == item.term[here]
        at, gain = at[here], item.gain[here]
        width = -(-len(at) // 64) or 1
        masks = np.zeros((width, len(self.docs)), np.uint64)
        for bit, a in enumerate(at.tolist()):
            masks[bit >> 6, self.rows[self.at[a] : self.to[a]]] |= np.uint64(1 << (bit & 63))
        rows = np.flatnonzero(masks.any(0))
        own = masks[:, rows]
        order = np.lexsort(own)
        own, rows = own[:, order], rows[order]
        first = np.flatnonzero(np.append(True, (own[:, 1:] != own[:, :-1]).any(0))[: len(rows)])
        bits = np.unpackbits(np.ascontiguousarray(own[:, first].T).view(np.uint8), axis=1, bitorder="little")[:, : len(at)]
        most = bits.astype(np.int64) @ (gain * self.best[at])
        falling = np.argsort(-most, kind="stable")
        sizes = np.diff(np.append(first, len(rows)))[falling]
        ends = np.cumsum(sizes)
        inside = np.arange(len(rows)) - np.repeat(ends - sizes, sizes)
        return rows[np.repeat(first[falling], sizes) + inside], ends, most[falling]

    def scores(self, rows: np.ndarray, gains: np.ndarray) -> np.ndarray:
        """Exact scores of documents; ``gains`` has a term's weight times repeats at its place, 0 elsewhere."""
        sizes = self.ends[rows] - self.begins[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.begins[rows] - (ends - sizes), sizes)
        return np.add.reduceat(gains[self.term[at]] * self.part[at], ends - sizes)


def best_of(shard: Shard, item: Item, gains: np.ndarray, best: list[tuple], top: int) -> tuple[list[tuple], int]:
    """The best (-score, id is NULL, id) of ``best`` and a shard, and how many of its documents were evaluated."""
    rows, ends, most = shard.masks(item)
    gains[item.term] = item.gain
    mask = done = 0
    step = STEP
    while mask < len(ends) and most[mask] > 0 and (len(best) < top or most[mask] >= -best[-1][0]):
        to = min(len(ends), int(np.searchsorted(ends, done + step)) + 1)
        if len(best) == top:  # masks that cannot reach the worst of the best wait for nothing
            to = max(mask + 1, min(to, int(np.searchsorted(-most, best[-1][0], side="right"))))
        own = rows[done : ends[to - 1]]
        score = shard.scores(own, gains)
        if len(score) > top:
            near = np.flatnonzero(score >= np.partition(score, -top)[-top])
            own, score = own[near], score[near]
        found = zip((-score).tolist(), shard.missing[own].tolist(), shard.docs[own].tolist())
        best = sorted([*best, *(f for f in found if f[0] < 0)])[:top]
        mask, done, step = to, int(ends[to - 1]), 2 * step
    gains[item.term] = 0
    return best, done


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """(item_id, text) of the items, a block of bounded size after the other."""
    rows = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for block in range(n):
        yield [(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == block).orderBy("item_id", "text").collect()]


def _ranked(docs: DataFrame, block: list[tuple], top: int) -> DataFrame:
    """(item, rank, doc_id, score) for the items of a block by their place."""
    spark = docs.sparkSession
    asked = [terms(text) for _, text in block]
    vocabulary = Vocabulary({t for own in asked for t in own})
    shards = cut(index(docs, vocabulary))
    documents, total = shards.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def added(batches):
        df = np.zeros(len(vocabulary.terms), np.int64)
        for batch in batches:
            np.add.at(df, np.asarray(batch.column("df_term").flatten()), np.asarray(batch.column("df").flatten()))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(df[there])], ["term", "df"])

    counts = shards.select("df_term", "df").mapInArrow(added, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r.term: r.df for r in counts.collect()}
    items = []
    for own in asked:
        place, repeats = np.unique([vocabulary.index[t] for t in own if vocabulary.index[t] in df], return_counts=True)
        gain = repeats * np.array([weight(df[p], documents) for p in place.tolist()], np.int64)
        items.append(Item(place[gain > 0].astype(np.int64), gain[gain > 0].astype(np.int64)))
    shared = spark.sparkContext.broadcast((items, len(vocabulary.terms)))

    def rank(batches):
        items, size = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        gains = np.zeros(size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                own = [np.asarray(batch.column(c)[i].values) for c in ("docs", "missing", "n", "ends", "term", "tf")]
                shard = Shard(*own, documents, total)
                for k, item in enumerate(items):
                    if len(item.term) and len(shard.docs):
                        best[k], _ = best_of(shard, item, gains, best[k], top)
        rows = [(k, None if missing else doc, -score) for k, own in enumerate(best) for score, missing, doc in own]
        columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([TaskContext.get().partitionId() % 64] * len(rows), pa.int32())], ["item", "doc_id", "score", "part"])

    found = shards.select("docs", "missing", "n", "ends", "term", "tf").mapInArrow(rank, "item int, doc_id long, score long, part int")
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).where(F.col("rank") <= top)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` documents of every item."""
    out = None
    kind = dict(items.dtypes)["item_id"]
    for block in blocks(items, block_bytes):
        names = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item int, item_id {kind}")
        own = _ranked(docs, block, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = own if out is None else out.unionByName(own)
    return out
