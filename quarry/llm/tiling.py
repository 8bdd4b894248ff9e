"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased (A-Z) runs of letters and digits. A document and a benchmark item that share a run of
``min_match`` tokens are tiled: the longest match of tokens not yet marked in either is marked, and so on until no match
of ``min_match`` tokens is left. Matches are found by Karp-Rabin hashes of token runs and may stand in any order, so
reordered passages count. An item leaks into a document when tiles cover at least ``threshold`` of the item's tokens.

NULL or empty texts have no tokens, match nothing and are clean, and so are items of fewer than ``min_match`` tokens.
Repeated rows give repeated results; a NULL doc_id or item_id stays NULL. Very long and repetitive texts are tiled whole: what
is held is as long as the text and its matches, not their product. Other columns are not read. The benchmark is the query set: it is sent to the
tasks in blocks of bounded size, each against all documents.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import TOKENS, _powers, as_bytes, id_and_text, mix, slices, span_hashes, words

MIN_MATCH = 5
THRESHOLD = 0.5
#: Bytes of benchmark text that go to the tasks at once, about.
BLOCK_BYTES = 4 << 20
#: Pairs of places that are looked at together, about.
PAIRS = 1 << 20
_STEP = np.uint64(0x9FB21C651E98DF25)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a column, and the offsets of its rows."""
    data, offsets = as_bytes(texts)
    low, starts, ends, per_row = words(data, offsets, TOKENS)
    return span_hashes(low, starts, ends), per_row


def run_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of the runs of k tokens that begin at each place (the last k - 1 places have none)."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = _powers(len(tokens), _STEP)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * powers, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * _powers(n, np.uint64(pow(int(_STEP), -1, 1 << 64))))


def tiles(i: np.ndarray, j: np.ndarray, n: np.ndarray, k: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, length) from the maximal matches of at least k tokens: again and again the longest
    match is marked, the first in the document and the item on ties, and what is marked is cut out of all others."""
    out, left = [], n_item
    while len(n):
        longest = np.flatnonzero(n == n.max())
        best = longest[np.lexsort((j[longest], i[longest]))[0]]
        a, b, size = int(i[best]), int(j[best]), int(n[best])
        out.append((a, b, size))
        left -= size
        if left <= 0:
            break
        # From a match at (i, j) the mark takes the tokens from a - i on as well as those from b - j on, size of each.
        first, second = np.minimum(a - i, b - j), np.maximum(a - i, b - j)
        begins = np.stack([np.zeros_like(n), np.maximum(first + size, 0), np.maximum(second + size, 0)])
        ends = np.stack([np.minimum(first, n), np.minimum(second, n), n])
        keep = ends - begins >= k
        i, j, n = np.broadcast_to(i, keep.shape)[keep] + begins[keep], np.broadcast_to(j, keep.shape)[keep] + begins[keep], (ends - begins)[keep]
    return out


class Items:
    """A block of benchmark items with the seeds that documents are looked up by."""

    def __init__(self, ids: list, texts: list[str], min_match: int):
        tokens, offsets = token_hashes(pa.array(texts, pa.string()))
        self.ids, self.k = ids, min_match
        self.sizes = np.diff(offsets)
        runs = run_hashes(tokens, min_match)
        at = np.arange(len(runs))
        item = np.searchsorted(offsets, at, side="right") - 1
        inside = at + min_match <= offsets[item + 1]
        runs, item, at = runs[inside], item[inside], at[inside]
        order = np.argsort(runs, kind="stable")
        self.seeds, self.item, self.place = runs[order], item[order], (at - offsets[item])[order]
        whole, item_of = np.append(runs, np.uint64(0)), np.append(item, -1)
        self.before, self.has_before = whole[order - 1], (order > 0) & (item_of[order - 1] == self.item)
        self.after, self.has_after = whole[order + 1], item_of[order + 1] == self.item
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(runs >> np.uint64(42)).astype(np.int64)] = True

    def matches(self, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item, tiles) of the pairs whose tiles cover at least ``threshold`` of the item."""
        tokens, offsets = token_hashes(texts)
        runs = run_hashes(tokens, self.k)
        at = np.flatnonzero(self.sieve[(runs >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.seeds, runs[at], "left"), np.searchsorted(self.seeds, runs[at], "right")
        row = np.searchsorted(offsets, at, side="right") - 1
        keep = (hi > lo) & (at + self.k <= offsets[row + 1])
        at, lo, hi, row = at[keep], lo[keep], hi[keep], row[keep]
        # Pairs of places with equal runs of k tokens may be very many in repetitive texts. They are looked at in slices, and only
        # the first and the last pair of each diagonal match are kept.
        firsts, lasts, done = [], [], np.cumsum(hi - lo)
        step = 0
        while step < len(at):
            to = max(step + 1, int(np.searchsorted(done, (done[step - 1] if step else 0) + PAIRS, side="right")))
            n = (hi - lo)[step:to]
            seed = np.repeat(lo[step:to], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            here, own = np.repeat(at[step:to], n), np.repeat(row[step:to], n)
            going = (here > offsets[own]) & self.has_before[seed] & (runs[here - 1] == self.before[seed])
            on = np.minimum(here + 1, len(runs) - 1)
            coming = (here + 1 + self.k <= offsets[own + 1]) & self.has_after[seed] & (runs[on] == self.after[seed])
            for found, pick in ((firsts, ~going), (lasts, ~coming)):
                found.append(np.stack([own[pick], self.item[seed[pick]], here[pick] - offsets[own[pick]], self.place[seed[pick]]]))
            step = to
        if not firsts:
            return
        firsts, lasts = (np.concatenate(f, axis=1) for f in (firsts, lasts))
        firsts, lasts = (f[:, np.lexsort((f[2], f[2] - f[3], f[1], f[0]))] for f in (firsts, lasts))
        row, item, i, j = firsts
        sizes = lasts[2] - i + self.k
        edges = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0)))
        for a, b in zip(edges, np.append(edges[1:], len(row))):
            size = int(self.sizes[item[a]])
            reach = np.zeros(size + 1, np.int64)  # tokens of the item in any match: tiles cannot cover more
            np.add.at(reach, j[a:b], 1)
            np.add.at(reach, j[a:b] + sizes[a:b], -1)
            if np.count_nonzero(np.cumsum(reach)[:size]) < threshold * size:
                continue
            found = tiles(i[a:b], j[a:b], sizes[a:b], self.k, size)
            if sum(t[2] for t in found) >= threshold * size:
                yield int(row[a]), int(item[a]), found


def blocks(benchmark: DataFrame, min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    rows = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for block in range(n):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in own], [r.text for r in own], min_match)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, tiles) of every leak; tiles are (document token, item token, length)."""
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id long, item_id {kind}, coverage double, n_tiles int, longest int, tiles array<struct<doc_token:int,item_token:int,length:int>>"
    out = None
    for items in blocks(benchmark, min_match, block_bytes):

        def scan(batches, items=items):
            for batch in batches:
                for rows in slices(batch):
                    ids, found = rows.column("doc_id").to_pylist(), []
                    for row, item, own in items.matches(rows.column("text"), threshold):
                        found.append({
                            "doc_id": ids[row], "item_id": items.ids[item], "coverage": sum(t[2] for t in own) / int(items.sizes[item]), "n_tiles": len(own),
                            "longest": max(t[2] for t in own), "tiles": [{"doc_token": a, "item_token": b, "length": n} for a, b, n in sorted(own)],
                        })
                    if found:
                        yield pd.DataFrame(found)

        def scan_arrow(batches, scan=scan):
            tile = pa.list_(pa.struct([("doc_token", pa.int32()), ("item_token", pa.int32()), ("length", pa.int32())]))
            for pdf in scan(batches):
                columns = [pa.array(pdf["doc_id"].tolist(), pa.int64()), pa.array(pdf["item_id"].tolist(), _ARROW.get(kind, pa.int64())), pa.array(pdf["coverage"]), pa.array(pdf["n_tiles"], pa.int32()), pa.array(pdf["longest"], pa.int32()), pa.array(pdf["tiles"].tolist(), tile)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "coverage", "n_tiles", "longest", "tiles"])

        own = id_and_text(docs).mapInArrow(scan_arrow, schema)
        out = own if out is None else out.unionByName(own)
    return out


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def leaks_column(items: Items, text: Column, threshold: float = THRESHOLD) -> Column:
    """Whether any item of the block leaks into a text."""

    @F.pandas_udf("boolean")
    def leaking(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        at = 0
        for rows in slices(batch):
            for row, _, _ in items.matches(rows.column("text"), threshold):
                out[at + row] = True
            at += rows.num_rows
        return pd.Series(out)

    return leaking(F.coalesce(text.cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows into which no benchmark item leaks, with all their columns."""
    for items in blocks(benchmark, min_match, block_bytes):
        docs = docs.where(~leaks_column(items, F.col("text"), threshold))
    return docs
