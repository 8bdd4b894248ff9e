import bisect
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm.common import documents


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_placements_follow_the_rule():
    lengths = np.random.default_rng(5).integers(1, 60, 400)
    gaps, open_ = [], defaultdict(int)

    def score():
        return sum(c * c for g, c in open_.items() if g)

    for size, at in zip(lengths.tolist(), packing.sum_of_squares(lengths, 64).tolist()):
        options = []
        for g in [*[g for g, c in open_.items() if c and g >= size], None]:
            if g is not None:
                open_[g] -= 1
            left = (64 if g is None else g) - size
            open_[left] += 1
            options.append((score(), g is None, g or 0, left))
            open_[left] -= 1
            if g is not None:
                open_[g] += 1
        best = min(options)
        if best[1]:
            gaps.append(64)
        assert gaps[at] == (64 if best[1] else best[2])
        if not best[1]:
            open_[best[2]] -= 1
        gaps[at] -= size
        open_[gaps[at]] += 1


def test_pieces_hold_all_ids_and_few_sequences(spark, edge, none):
    docs = edge.select("doc_id", "text").union(documents(spark, "/root/testdata/sf0.01").selectExpr("doc_id + 100", "text"))
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode.encode_special_tokens = True
    want = []
    for r in docs.collect():
        ids = np.array([*encode.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k, at, len(p), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), 512)) for p in [ids[at : at + 512]]]
    rows = packing.pack_documents(docs, 512).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    gaps = []  # longest first, each into the fullest sequence that takes it: never more than a fifth over the best packing
    for n in sorted((r.length for r in rows), reverse=True):
        at = bisect.bisect_left(gaps, n)
        left = gaps.pop(at) - n if at < len(gaps) else 512 - n
        bisect.insort(gaps, left)
    assert check(rows, 512) <= 1.02 * len(gaps) + 1
    assert packing.pack_documents(none).count() == 0


def test_groups_are_packed_again(spark):
    parts = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("length"), F.col("id").alias("ids_crc32"))
    rows = packing.pack(parts, 100, group_pieces=300).collect()
    assert len(rows) == 6000 and check(rows, 100) <= 1.02 * sum(r.length for r in rows) / 100 + 1


def test_rows_alike_in_every_column(spark):
    """Two thirds of the pieces are one row repeated: they take part in every group."""
    same = spark.range(4000, numPartitions=4).selectExpr("cast(null as long) doc_id", "0 piece", "0L start", "1L length", "7L ids_crc32")
    other = spark.range(2000).selectExpr("id doc_id", "0 piece", "0L start", "pmod(xxhash64(id), 90) + 1 length", "id ids_crc32")
    rows = packing.pack(same.unionByName(other), 100, group_pieces=300).collect()
    assert len(rows) == 6000 and sum(r.doc_id is None for r in rows) == 4000 and check(rows, 100) <= 1.02 * sum(r.length for r in rows) / 100 + 1
    groups = {}
    for r in rows:
        groups.setdefault(r.sequence_id >> 24, []).append(r.doc_id)
    first = [g for k, g in groups.items() if k >> 36 == 0]
    assert len(first) == 20 and max(len(g) for g in first) <= 400
