import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lexical
from quarry.llm.common import byte_blocks

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    tf = [Counter(split(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    N, L = sum(v > 0 for v in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c, size in zip(docs, tf, n):
            m = 100 - 75 + 75 * size * N // L if L else 0
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, **settings):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(4)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = lexical.search(d, b, **settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    """Few words, so that masks are shared and scores tie; small shards; items of more than 64 terms."""
    monkeypatch.setattr(lexical, "SHARD_DOCUMENTS", 40)
    rng = random.Random(seed)
    words = ["the", "of", "a1", "É", "ligne", "中文", "x", *(f"w{i}" for i in range(120))]
    weights = [40, 30, 5, 5, 5, 3, 20, *[1] * 120]
    text = lambda n: rng.choice([" ", ", ", "_", "\x00"]).join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(None, "the w1 w2"), (None, None), (7, "the w1 w2"), (7, "the w1 w2"), (900, "  "), (901, "")]
    items = [(i, text(rng.randint(1, 20))) for i in range(12)] + [(50, " ".join(words)), (51, "the"), (52, "unknown words only"), (53, None), (54, "w1 w1 w1 w2"), (None, "w5 the")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, top=3, block_bytes=200) == brute(docs, items, 3)


def test_edge_tables(spark, edge, none):
    items = spark.createDataFrame([(1, "one two words"), (2, "it")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted(map(tuple, lexical.search(edge, items).collect()), key=str) == brute(rows, [(1, "one two words"), (2, "it")])
    assert lexical.search(none, items).count() == 0 and lexical.search(edge, items.limit(0)).count() == 0


def test_masks_stop_safely():
    """Far fewer documents are evaluated than hold a term, with the same best ones."""
    rng = np.random.default_rng(0)
    d, terms = 4000, 12
    rows = [np.flatnonzero(rng.random(terms) < np.geomspace(0.9, 0.01, terms)) for _ in range(d)]
    rows = [r if len(r) else np.array([0]) for r in rows]
    n, tf = rng.integers(20, 400, d), [rng.integers(1, 4, len(r)) for r in rows]
    shard = lexical.Shard(np.arange(d), np.zeros(d, bool), n, np.cumsum([len(r) for r in rows]), np.concatenate(rows), np.concatenate(tf), d, int(n.sum()))
    item = lexical.Item(np.arange(terms), np.linspace(100, 4000, terms).astype(np.int64))
    gains = np.zeros(terms, np.int64)
    best, looked = lexical.best_of(shard, item, gains, [], 10)
    gains[item.term] = item.gain
    score = shard.scores(np.arange(d), gains)
    assert best == sorted((-int(s), False, i) for i, s in enumerate(score))[:10] and looked < d / 5


def test_long_texts_in_blocks():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "x" * 50]) for _ in range(2000)).encode()
    data, offsets = np.frombuffer(text + text[:100], np.uint8), np.array([0, 0, len(text), len(text) + 100])
    parts = list(byte_blocks(data, offsets, lexical._SPLIT, 700))
    assert b"".join(p.tobytes() for _, p, _ in parts) == data.tobytes() and len(parts) > 10
    assert sum(len(p.tobytes().split()) for _, p, _ in parts) >= len(text.split()) and all(f in (1, 2) for f, _, _ in parts)
    vocabulary = lexical.Vocabulary({b"alpha", b"beta"})
    import pyarrow as pa

    whole = lexical.postings(pa.array([None, text.decode()]), vocabulary)
    assert whole[0].tolist() == [0, 2000] and dict(zip(whole[2].tolist(), whole[3].tolist())) == {vocabulary.index[t]: text.split().count(t) for t in (b"alpha", b"beta")}
