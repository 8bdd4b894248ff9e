import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import tiling
from quarry.llm.common import documents


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def greedy(doc, item, k):
    """The published rule, step by step: mark the longest match of unmarked tokens until none of k tokens is left."""
    in_doc, in_item, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (k - 1, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not in_doc[a + n] and not in_item[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < k:
            return covered
        in_doc[a : a + n], in_item[b : b + n] = [True] * n, [True] * n
        covered += n


def test_coverage_as_step_by_step(spark):
    rnd, rows = random.Random(2), []
    items = [(i, " ".join(f"t{rnd.randrange(60)}" for _ in range(rnd.randrange(3, 30)))) for i in range(8)]
    for d in range(60):
        words = [f"t{rnd.randrange(60)}" for _ in range(rnd.randrange(40))]
        item = rnd.choice(items)[1].split()
        cut = rnd.randrange(1, len(item))
        words[rnd.randrange(len(words) + 1) : 0] = rnd.choice([item, item[cut:] + ["x"] + item[:cut], item[:cut]])
        rows.append((d, " ".join(words)))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for k, block_bytes in ((3, 1 << 20), (5, 200)):
        got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in tiling.leaks(docs, benchmark, 0.5, k, block_bytes).collect()}
        want = {}
        for d, t in rows:
            for i, u in items:
                if len(u.split()) >= k and (c := greedy(t.split(), u.split(), k) / len(u.split())) >= 0.5:
                    want[d, i] = round(c, 9)
        assert got == want
        assert {r.doc_id for r in tiling.keep_rows(docs, benchmark, 0.5, k, block_bytes).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_reordered_passage_is_found_and_others_are_left(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu."
    moved = "start KAPPA lambda mu zeta eta theta iota kappa; lambda mu alpha beta gamma delta epsilon end"
    docs = spark.createDataFrame([(1, moved), (2, "alpha beta gamma delta something else"), (3, item)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = tiling.leaks(docs, benchmark).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [1, 3] and got[0].n_tiles >= 2 and got[1].coverage == 1.0


def test_edge_cases(spark, edge, none):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "it it"), (None, "word word word word word word"), (4, "no such passage in any text")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in tiling.leaks(edge, benchmark).collect()]
    assert got == [(13, None)]
    assert tiling.keep_rows(edge, benchmark).columns == edge.columns and tiling.keep_rows(edge, benchmark).count() == edge.count() - 1
    assert tiling.leaks(none, benchmark).count() == 0
    assert tiling.leaks(edge, benchmark.limit(0)).count() == 0 and tiling.keep_rows(edge, benchmark.limit(0)).count() == edge.count()


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_documents_with_a_whole_item(spark, sf):
    docs, benchmark = documents(spark, f"/root/testdata/{sf}"), spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet")
    items = {r.item_id: tokens(r.text) for r in benchmark.collect()}
    got = {(r.doc_id, r.item_id) for r in tiling.leaks(docs, benchmark).collect()}
    for r in docs.where(F.col("text").isNotNull()).collect():
        text = " " + " ".join(tokens(r.text)) + " "
        for i, own in items.items():
            if " " + " ".join(own) + " " in text:
                assert (r.doc_id, i) in got
            elif not any(" " + " ".join(own[k : k + 5]) + " " in text for k in range(len(own) - 4)):
                assert (r.doc_id, i) not in got


@pytest.mark.parametrize("pairs", [7, 1 << 20])
def test_repetitive_texts_as_step_by_step(monkeypatch, pairs):
    """Three letters, so that matches overlap in every way; pairs of places looked at in slices of any size."""
    monkeypatch.setattr(tiling, "PAIRS", pairs)
    rnd = random.Random(4)
    word = lambda n: [rnd.choice("aab" if rnd.random() < 0.5 else "abc") for _ in range(n)]
    items, docs = [word(rnd.randrange(0, 25)) for _ in range(12)], [word(rnd.randrange(0, 60)) for _ in range(40)]
    block = tiling.Items(list(range(len(items))), [" ".join(i) for i in items], 3)
    got = {(d, i): sum(t[2] for t in own) for d, i, own in block.matches(pa.array([" ".join(d) for d in docs]), 0.0)}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            assert got.get((d, i), 0) == greedy(doc, item, 3), (doc, item)


def test_memory_of_a_repetitive_text():
    block = tiling.Items([0, 1], ["a " * 400, ("a " * 150 + "b ") * 2], 5)
    tracemalloc.start()
    got = list(block.matches(pa.array(["a " * 150_000, "b " + "a " * 90]), 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, i) for d, i, _ in got] == [(0, 0), (0, 1)] and got[0][2] == [(0, 0, 400)] and peak < 300e6
