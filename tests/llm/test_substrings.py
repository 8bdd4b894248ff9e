import hashlib
import random

import numpy as np
import pytest

from quarry.llm import substrings
from quarry.llm.common import documents
from tests.llm.conftest import EDGE


def brute(rows, length):
    seen, out = set(), []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            g = b[s : s + length]
            if g in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(g)
        kept = bytes(c for c, k in zip(b, gone) if not k)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "gram"), [(100, 32), (12, 5), (7, 7)])
def test_edge_cases(spark, none, length, gram):
    rnd = random.Random(1)
    pool = [t or "" for i, t in EDGE if i is not None] + ["".join(rnd.choice(s) for _ in range(3000)) for s in ("ab", "abcd ")]
    rows = list(enumerate(pool)) + [(100 + i, "".join(rnd.choice(pool) for _ in range(3))[rnd.randrange(50) :]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(docs, length, gram, block_bytes=3000, bucket_bytes=4000)
    assert sorted(map(tuple, got.collect())) == brute(rows, length)
    assert substrings.remove_repeats(none).count() == 0


def test_repeated_ids_and_nulls(spark, edge):
    got = substrings.remove_repeats(edge).collect()
    assert len(got) == edge.count()
    assert sum(r.n_removed for r in got if r.doc_id is None) == 0


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001").repartition(4)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect())) == brute(rows, 100)
    kept = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in substrings.kept_texts(docs).collect()}
    assert kept == {r[0]: r[4] for r in brute(rows, 100)}


def test_refinement():
    data = np.frombuffer(b"abcabcabcabdabcabcabc", np.uint8)
    left = np.arange(len(data), 0, -1)
    pointer = substrings.refine(data, left, 6, first=2)
    strings = [bytes(data[i : i + 6]) for i in range(len(data) - 5)]
    assert all((pointer[i] == pointer[j]) == (strings[i] == strings[j]) for i in range(len(strings)) for j in range(len(strings)))
    assert (pointer[len(strings) :] == -1).all()
