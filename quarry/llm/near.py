"""Near copies: an exact Jaccard join over word shingles and the components of its links.

A text's set holds its distinct runs of ``k`` words (ASCII lower case; with fewer words the whole sequence as one; none
without words). Texts with the same set form a class, and classes are joined:

* shingles are ordered rare-first by a count over all texts, and only a set's prefix is indexed: two sets that reach the
  threshold share a shingle of both prefixes;
* entries that meet are filtered by length, by position, and by a bound on how far the sets differ (suffix filter);
* each pair is verified once, on the whole sets.

Only components are asked for, so a shingle shared by many classes does not need all its pairs. First its classes are
verified against a few of them (a star). Then, for as long as classes of different components share an indexed shingle,
those pairs alone are verified: no link between components can be missed.

NULL and empty texts are linked with nothing; repeated rows share a class; a NULL doc_id is a row like others, its
component is the smallest id that its links reach (NULL if there is none). Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORDS, as_bytes, id_and_text, mix, one_of_each, slices, span_hashes, unused, words
from quarry.session import cut, drop

WORDS_PER_SHINGLE = 5
PERCENT = 80
#: Counters of the frequency sketch (a fixed size: it only orders shingles, collisions cost time but no result).
SKETCH_BITS = 22
_BLOCKS = 64
#: A shingle in so many classes or fewer has all its pairs verified at once.
SMALL_GROUP = 8
#: Classes that all others of a large group are verified against first.
PIVOTS = 3
#: Pairs between components that are verified at once; with more, further stars come first.
MAX_PAIRS = 1 << 24
#: Links that one task contracts to stars.
LINKS_PER_TASK = 1 << 20
#: Entries of one shingle that meet in one task at most, about; those of more frequent shingles are spread by class.
HOT_ENTRIES = 1 << 15
#: Index bytes (before compression) that a bucket is meant to hold.
BUCKET_BYTES = 16 << 20
#: Sets that verification remembers, in bytes, and compressed bodies of pairs that it unpacks at once (one pair at least).
SETS_BYTES = 16 << 20
PAIR_BYTES = 1 << 20
_STEPS = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = WORDS_PER_SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, offsets = as_bytes(texts)
    low, starts, ends, at = words(data, offsets, WORDS)
    hashes = span_hashes(low, starts, ends)
    n = len(hashes)
    runs = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        runs += hashes[j : j + len(runs)] * _STEPS[j]
    runs = mix(runs)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield mix((hashes[a:b] * _STEPS[k : k + b - a]).sum(dtype=np.uint64).reshape(1) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _class(s: np.ndarray) -> int:
    """A hash of a set."""
    return int(mix(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).reshape(1) + np.uint64(len(s))).view(np.int64)[0])


def _sketch_at(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _prefix(s: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The indexed shingles of a set, rarest first."""
    n = len(s)
    size = n - -(-percent * n // 100) + 1
    own = level[_sketch_at(s, SKETCH_BITS)]
    if size < n:
        at = np.argpartition((own.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), size - 1)[:size]
        s, own = s[at], own[at]
    return s[np.lexsort((s, own))]


def _signature(s: np.ndarray) -> int:
    """Counts of a set's shingles in eight ranges of hashes, a byte each; 255 means unknown."""
    counts = np.bincount((s >> np.uint64(61)).astype(np.int64), minlength=8)
    return int(np.minimum(counts, 255).astype(np.uint8).view(np.uint64)[0])


def _parities(s: np.ndarray) -> np.ndarray:
    """For 512 ranges of hashes whether a set has an odd number of shingles there, as eight words. Where two sets differ in a
    range, so do their shingles."""
    odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the number of shingles in exactly one of two sets."""
    x, y = a.view(np.uint8).reshape(-1, 8).astype(np.int64), b.view(np.uint8).reshape(-1, 8).astype(np.int64)
    return np.where((x == 255) | (y == 255), 0, np.abs(x - y)).sum(1)


def _overlap(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that two sets must share."""
    return -(-percent * (n1 + n2) // (100 + percent))


_ENTRY = np.dtype([("shingle", "<u8"), ("class", "<i8"), ("signature", "<u8"), ("n", "<i4"), ("i", "<i4")])


def _pack(entries: np.ndarray) -> bytes:
    """Entries column by column: columns compress, rows of hashes do not."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(entries[f]).tobytes() for f in _ENTRY.names))


def _unpack(body: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body)
    out = np.empty(len(raw) // _ENTRY.itemsize, _ENTRY)
    at = 0
    for f in _ENTRY.names:
        out[f] = np.frombuffer(raw, _ENTRY[f], len(out), at)
        at += _ENTRY[f].itemsize * len(out)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key): doc_id and a hash of the text tell rows apart where an id is NULL or stands on several texts."""
    return id_and_text(docs).withColumn("text_key", F.xxhash64("text"))


def _classes_and_counts(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, text_key, class, n, parities) of every text, and rows (block, part, counts) of the frequency sketch of every task."""
    schema = "doc_id long, text_key long, class long, n int, parities array<long>, block int, part int, counts binary"
    names = ["doc_id", "text_key", "class", "n", "parities", "block", "part", "counts"]
    words_ = pa.list_(pa.int64())

    def scan(batches):
        import zstandard

        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for rows in slices(batch):
                found = [(_class(s) if len(s) else None, len(s), _parities(s)) for s in _counted(shingle_sets(rows.column("text"), k), sketch)]
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text_key"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], words_), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names,
                )
        pack = zstandard.ZstdCompressor(level=3).compress
        if sketch.any():
            part = TaskContext.get().partitionId()
            blocks = [pack(b.tobytes()) for b in sketch.reshape(_BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(_BLOCKS, pa.int64())] * 3, pa.nulls(_BLOCKS, pa.int32()), pa.nulls(_BLOCKS, words_), pa.array(range(_BLOCKS), pa.int32()), pa.array([part] * _BLOCKS, pa.int32()), pa.array(blocks, pa.binary())],
                names,
            )

    return _keyed(docs).mapInArrow(scan, schema)


def _counted(sets: Iterator[np.ndarray], sketch: np.ndarray) -> Iterator[np.ndarray]:
    for s in sets:
        np.add.at(sketch, _sketch_at(s, SKETCH_BITS), np.uint32(1))
        yield s


def _levels(counted: DataFrame) -> np.ndarray:
    """The logarithm of every counter over all tasks, in steps of a quarter; task sums are added in two stages. 4 MB in all."""

    def added(log: bool):
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            import zstandard

            total = np.zeros((1 << SKETCH_BITS) // _BLOCKS, np.uint64)
            for body in pdf["counts"]:
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint32)
            total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
            out = (4 * np.log2(total + 1.0)).astype(np.uint8) if log else total
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [zstandard.ZstdCompressor(level=3).compress(out.tobytes())]})

        return add

    import zstandard

    sums = counted.select("block", "counts", (F.col("part") % 64).alias("salt")).groupBy("block", "salt").applyInPandas(added(False), "block int, counts binary")
    out = np.zeros((_BLOCKS, (1 << SKETCH_BITS) // _BLOCKS), np.uint8)
    for r in sums.groupBy("block").applyInPandas(added(True), "block int, counts binary").collect():
        out[r.block] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.counts)), np.uint8)
    return out.reshape(-1)


def _spread(hot: int) -> np.ndarray:
    """Over how many parts the entries of a shingle of a level are spread."""
    return np.uint64(1) << np.maximum(0, (np.arange(256) - int(4 * np.log2(hot))) // 4 + 1).clip(0, 40).astype(np.uint64)


def _index(docs: DataFrame, shared, buckets: int, k: int, percent: int, hot: int) -> DataFrame:
    """(bucket, body): prefix entries of the classes of each task, once per class and task."""

    def scan(batches):
        level, seen, spread = shared.value, set(), _spread(hot)

        def flush(found):
            entries = np.concatenate(found)
            salt = mix(entries["class"].view(np.uint64)) % spread[level[_sketch_at(entries["shingle"], SKETCH_BITS)]]
            bucket = (mix(entries["shingle"] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            entries, bucket = entries[order], bucket[order]
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            bodies = [_pack(entries[a:b]) for a, b in zip(edges, np.append(edges[1:], len(bucket)))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array(bodies, pa.binary())], ["bucket", "body"])

        found, held = [], 0
        for batch in batches:
            for rows in slices(batch):
                for s in shingle_sets(rows.column("text"), k):
                    if not len(s) or (c := _class(s)) in seen:
                        continue
                    seen.add(c)
                    prefix = _prefix(s, level, percent)
                    own = np.empty(len(prefix), _ENTRY)
                    own["shingle"], own["class"], own["signature"], own["n"], own["i"] = prefix, c, _signature(s), len(s), np.arange(len(prefix))
                    found.append(own)
                    held += len(own)
                if held > 1 << 20:
                    yield flush(found)
                    found, held = [], 0
        if found:
            yield flush(found)

    return id_and_text(docs).mapInArrow(scan, "bucket int, body binary")


def _possible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Length, positional and suffix filters for pairs of entries of one shingle.

    A pair is judged as if the shingle were its first common one, before which nothing is shared. At later ones the bound is
    only smaller, so a pair that can link passes at its first common shingle and no other pair passes anywhere.
    """
    n1, n2 = a["n"].astype(np.int64), b["n"].astype(np.int64)
    need = _overlap(n1, n2, percent)
    out = (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (np.minimum(n1 - a["i"], n2 - b["i"]) >= need)
    return out & (_apart(np.ascontiguousarray(a["signature"]), np.ascontiguousarray(b["signature"])) <= n1 + n2 - 2 * need)


_MEET = "kind int, shingle long, a long, b long, n int, i int, signature long"


def _meet(index: DataFrame, shared, percent: int, small: int, pivots: int, hot: int) -> DataFrame:
    """What the entries of a bucket give: pairs (kind 0: a, b), members of large or spread groups (1: shingle, a, n, i,
    signature) and the first pivot of each such group (2: shingle, a)."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.concatenate([_unpack(b) for b in pdf["body"]])
        e = e[np.lexsort((e["class"], e["shingle"]))]
        e = e[np.append(True, (e["shingle"][1:] != e["shingle"][:-1]) | (e["class"][1:] != e["class"][:-1]))]  # copies fall together
        edges = np.flatnonzero(np.append(True, e["shingle"][1:] != e["shingle"][:-1]))
        sizes = np.diff(np.append(edges, len(e)))
        left, right, large = [], [], []
        whole = (sizes <= small) & (_spread(hot)[shared.value[_sketch_at(e["shingle"][edges], SKETCH_BITS)]] == 1)
        for size in range(2, small + 1):
            at = edges[whole & (sizes == size)]
            for x in range(size):
                for y in range(x + 1, size):
                    left.append(at + x)
                    right.append(at + y)
        first = []
        for at, size in zip(edges[~whole].tolist(), sizes[~whole].tolist()):
            ranks = np.lexsort((mix(e["class"][at : at + size].view(np.uint64)), e["i"][at : at + size]))  # fewest rarer shingles first
            large.append(np.arange(at, at + size))
            first.append(at + int(ranks[0]))
            for p in ranks[:pivots]:
                others = np.delete(np.arange(at, at + size), p)
                left.append(np.full(size - 1, at + p))
                right.append(others)
        out = []
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        if len(a):
            ok = np.concatenate([_possible(e[a[t : t + 100_000]], e[b[t : t + 100_000]], percent) for t in range(0, len(a), 100_000)])
            a, b = e["class"][a[ok]], e["class"][b[ok]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            out.append(pd.DataFrame({"kind": 0, "shingle": 0, "a": pairs[:, 0], "b": pairs[:, 1], "n": 0, "i": 0, "signature": 0}))
        if large:
            m = e[np.concatenate(large)]
            out.append(pd.DataFrame({"kind": 1, "shingle": m["shingle"].view(np.int64), "a": m["class"], "b": 0, "n": m["n"], "i": m["i"], "signature": m["signature"].view(np.int64)}))
            m = e[np.array(first)]
            out.append(pd.DataFrame({"kind": 2, "shingle": m["shingle"].view(np.int64), "a": m["class"], "b": 0, "n": 0, "i": 0, "signature": 0}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: pd.Series([], dtype="int64") for c in _MEET.split(", ")})

    return index.groupBy("bucket").applyInPandas(meet, _MEET)


def _sieve(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits by hash, two in one of 256 blocks for each of the n values of ``hashes(h)``: 16 bits for a value, 32 MB at most. Every
    block is filled by a task of its own."""
    bits = int(min(max(1 << 16, 1 << (16 * max(1, n)).bit_length()), 1 << 28)) // 256

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(bits, bool)
        for at in _places(pdf["h"].to_numpy(np.int64).view(np.uint64), bits):
            own[at] = True
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(own).tobytes()]})

    out = np.zeros((256, bits // 8), np.uint8)
    for r in hashes.select("h", F.shiftrightunsigned("h", 56).cast("int").alias("block")).groupBy("block").applyInPandas(fill, "block int, bits binary").toLocalIterator():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> np.uint64(shift)).astype(np.int64) & (bits - 1) for shift in (0, 28)]


def _in_sieve(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64)
    block = (h >> np.uint64(56)).astype(np.int64)
    first, second = ((sieve[block, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 for at in _places(h, sieve.shape[1] * 8))
    return (first & second).astype(bool)


def _texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(class, body): the compressed text of one row of each class that is verified. ``reps`` is (class, doc_id, text_key, n),
    a row that stands n times. Texts that no class asks for mostly do not leave their task."""
    row = F.xxhash64("doc_id", "text_key")
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(reps.select(row.alias("h")), reps.count()))

    def packed(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for rows in slices(batch.filter(pa.array(_in_sieve(shared.value, np.asarray(batch.column("h")))))):
                bodies = [pack(t.encode()) for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(bodies, pa.binary())], ["id", "key", "body"])

    bodies = _keyed(docs).withColumn("h", row).mapInArrow(packed, "id long, key long, body binary")
    out = bodies.join(reps, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).select("class", "body")
    return out.dropDuplicates(["class"]) if reps.where("n > 1").limit(1).count() else out


def runs(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes sum to ``limit`` at most, or of one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield slice(at, to)
        at = to


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs that link."""

    def linked(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        memory: dict[int, np.ndarray] = {}
        size = 0

        def sets(classes, bodies):
            nonlocal size
            if size > SETS_BYTES:
                memory.clear()
                size = 0
            new = {c: body for c, body in zip(classes, bodies) if c not in memory}
            held = pa.array([unpack.decompress(b).decode() for b in new.values()], pa.string())
            for c, own in zip(new, shingle_sets(held, k)):
                memory[c] = own.copy()
                size += own.nbytes

        for batch in batches:
            packed = np.add(*(np.asarray(pa.compute.binary_length(batch.column(n)), np.int64) for n in ("body_a", "body_b")))
            for part in runs(packed, PAIR_BYTES):
                rows = batch.slice(part.start, part.stop - part.start).to_pydict()
                sets(rows["a"] + rows["b"], rows["body_a"] + rows["body_b"])
                keep = []
                for a, b in zip(rows["a"], rows["b"]):
                    x, y = memory[a], memory[b]
                    shared = np.intersect1d(x, y, assume_unique=True).size
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                keep = np.array(keep, bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(rows["a"], np.int64)[keep]), pa.array(np.array(rows["b"], np.int64)[keep])], ["a", "b"])

    a = texts.select(F.col("class").alias("a"), F.col("body").alias("body_a"))
    b = texts.select(F.col("class").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "body_a", "body_b").mapInArrow(linked, "a long, b long")


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node reachable) by the links of one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def components(links: DataFrame, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (a, b) that is not its own root.

    The links of a task are contracted to stars there. Across tasks nodes are joined to the smallest node of their neighbours
    until only stars are left; sums per node are made before rows are shuffled. ``links`` should be a written table.
    """
    tasks = max(1, -(-links.count() // per_task))
    edges = cut(links.select("a", "b").coalesce(tasks).mapInArrow(_rooted, "a long, b long"))
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        wide = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        below = wide.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(below.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        same = [e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first() for e in (edges, new)]
        edges = new
        if same[0] == same[1]:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _crossing(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of shingles whose classes are in several components, with their own (root) and the largest (main) of these."""
    m = members.join(roots, members["a"] == roots["node"], "left").select(*members.columns, F.coalesce("root", "a").alias("root"))
    by = m.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"))
    main = by.groupBy("shingle").agg(F.max(F.struct("c", F.col("root").alias("r"))).alias("top"), F.count(F.lit(1)).alias("parts"))
    return cut(m.join(main.where("parts > 1").select("shingle", F.col("top.r").alias("main")), "shingle"))


def near_components(docs: DataFrame, k: int = WORDS_PER_SHINGLE, percent: int = PERCENT, small: int = SMALL_GROUP, pivots: int = PIVOTS, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT_ENTRIES, star_rounds: int = 4, max_pairs: int = MAX_PAIRS, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(doc_id, n_shingles, component_id, class, root, text_key), one row per row of ``docs``; ``root`` names a component, NULL
    without words."""
    spark = docs.sparkSession
    scanned = cut(_classes_and_counts(docs, k))
    rows, parities = scanned.where("block is null").select("doc_id", "text_key", "class", "n"), scanned.where("class is not null").select("class", "parities")
    shared = spark.sparkContext.broadcast(_levels(scanned.where("block is not null").select("block", "part", "counts")))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = int(max(1, -(-total * (101 - percent) // 100 * _ENTRY.itemsize // bucket_bytes)))
    met = cut(_meet(_index(docs, shared, buckets, k, percent, hot), shared, percent, small, pivots, hot))
    pairs = met.where("kind = 0").select("a", "b")
    members = met.where("kind = 1").select("shingle", "a", "n", "i", "signature")
    heads = met.where("kind = 2").select("shingle", "a").distinct()
    top = heads.groupBy("shingle").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pairs = pairs.unionByName(heads.join(top, "shingle").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    reps = rows.where("class is not null").groupBy("class", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    reps = reps.groupBy("class").agg(F.min(F.struct("n", "doc_id", "text_key")).alias("row")).select("class", "row.doc_id", "row.text_key", "row.n")
    reps = cut(reps)

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among written pairs; bodies are fetched for their classes alone and deleted again."""
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        own = cut(reps.join(wanted, "class", "left_semi"))
        texts = cut(_texts_of(docs, own))
        found = cut(_verify(pairs, texts, k, percent))
        drop(own)
        drop(texts)
        return found

    pairs = cut(pairs.distinct())
    links = verified(pairs)
    roots = components(links, links_per_task)
    held = members.select(F.col("a").alias("class")).distinct()
    held = cut(parities.join(held, "class").dropDuplicates(["class"]).select(F.col("class").alias("a"), "parities"))
    members = cut(members.join(held, "a").select("shingle", "a", "n", "i", "parities"))
    done = pairs
    stars, round_ = True, -1
    while True:
        round_ += 1
        m = _crossing(members, roots)
        between = _pairs_between(m, percent)
        # Stars go on for as long as they link anything; what is left then is few pairs or pairs that do not link.
        star = (stars or round_ < star_rounds) and between.limit(max_pairs + 1).count() > max_pairs
        if star:  # too many pairs for now: verify the classes outside against one of the main component first
            lead = m.where("root = main").groupBy("shingle").agg(F.min(F.struct("i", F.xxhash64("a", F.lit(round_)).alias("h"), "a")).alias("l"))
            between = m.where("root <> main").join(lead, "shingle").select("a", F.col("l.a").alias("b"))
        new = between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = cut(new.join(done, ["a", "b"], "left_anti"))
        more = verified(new)
        links = links.unionByName(more)
        roots = components(links, links_per_task)
        if not star:
            break
        stars = not more.isEmpty()
        done = done.unionByName(new)
    return _by_document(rows, roots)


def _pairs_between(m: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of one shingle in different components, of which one is outside the main component, that pass the
    length, positional and suffix filters."""
    x = m.where("root <> main").select("shingle", "a", "n", "i", "root", "main", "parities")
    y = m.select("shingle", F.col("a").alias("b"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("root").alias("root2"), F.col("parities").alias("parities2"))
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / F.lit(100 + percent))
    apart = sum((F.bit_count(F.col("parities")[j].bitwiseXOR(F.col("parities2")[j])) for j in range(8)), F.lit(0))
    pairs = x.join(y, "shingle").where("root <> root2").where((F.col("root2") == F.col("main")) | (F.col("a") < F.col("b")))
    pairs = pairs.where(F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2"))
    pairs = pairs.where(F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) >= need)
    return pairs.where(apart <= F.col("n") + F.col("n2") - 2 * need).select("a", "b")


def _by_document(rows: DataFrame, roots: DataFrame) -> DataFrame:
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    known = classes.join(roots, classes["class"] == roots["node"], "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    known = cut(known)
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = known.join(smallest, "root").select("class", "component_id", "root")
    out = rows.join(of_class, "class", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class", "root", "text_key")


def keep_rows(docs: DataFrame, k: int = WORDS_PER_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component (that of the smallest doc_id, NULL last), with all its columns, whatever their names and types;
    rows without words all stay."""
    found = cut(near_components(docs, k, percent))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("class").isNotNull()).alias("words"))
    id_, key_ = unused("_keep", docs.columns), unused("_keep_key", docs.columns)
    if not ids.where("words and (c > 1 or doc_id is null)").limit(1).count():
        kept = found.where("class is null or doc_id = component_id").select(F.col("doc_id").alias(id_))
        return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)), "left_semi")
    # An id alone does not tell the rows apart: its text does, and of equal texts with one id any row is as good.
    kept = found.where("class is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("row"))
    kept = kept.select(F.col("row.doc_id").alias(id_), F.col("row.text_key").alias(key_))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    empty = ~text.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(~empty).join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(key_)), "left_semi")
    return one_of_each(rows, F.xxhash64(text)).unionByName(docs.where(empty))
