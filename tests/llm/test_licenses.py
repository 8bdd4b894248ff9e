import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import licenses
from quarry.llm.common import documents


def test_increasing():
    rnd = random.Random(1)
    for _ in range(200):
        v = [rnd.randrange(9) for _ in range(rnd.randrange(8))]
        got = licenses.increasing(v)
        assert all(v[a] < v[b] and a < b for a, b in zip(got, got[1:]))
        assert len(got) == max((n for n in range(len(v) + 1) for c in combinations(v, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)


def test_alignment_is_increasing_and_equal():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.randrange(12) for _ in range(rnd.randrange(25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert licenses.align([1, 2, 9, 3, 1, 2], [1, 2, 3, 1, 2]) == [(0, 0), (1, 1), (3, 2), (4, 3), (5, 4)]


def test_notices_in_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    named = {"GPL-3.0": "GNU General Public License, version 3", "MIT": "under the MIT License", "Apache-2.0": "under the Apache License, Version 2.0", "CC-BY-NC-4.0": "under CC BY-NC 4.0"}
    want = {(r.doc_id, name) for name, words in named.items() for r in docs.where(F.col("text").contains(words)).select("doc_id").collect()}
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == want


def test_edited_and_repeated_notices(spark, edge, none):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, f"x y. {apache} {apache}"), (2, f"THIS is LICENSED under the   apache license -- version 2.0 {'word ' * 4000}"), (3, "licensed under the version of the license"),
        (4, "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0."), (5, re.sub("merge, ", "", licenses.TEMPLATES["MIT"][2])), (6, "the license of the apache"),
    ]
    got = [(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "first_token").collect()]
    assert got == [(1, "Apache-2.0"), (1, "Apache-2.0"), (2, "Apache-2.0"), (4, "CC-BY-4.0"), (4, "CC-BY-NC-4.0"), (5, "MIT")]
    assert licenses.scan(edge).count() == 0 and licenses.scan(none).count() == 0


def test_many_adjacent_copies():
    known = licenses.Templates(licenses.TEMPLATES)

    def found(text):
        tokens = known.coded(licenses.token_hashes(pa.array([text]))[0])
        pair = np.where((tokens[:-1] >= 0) & (tokens[1:] >= 0), tokens[:-1] * len(known.vocabulary) + tokens[1:], -1)
        return known.notices(tokens, np.flatnonzero(np.isin(pair, known.pair_codes)), licenses.COVERAGE)

    for name, own in licenses.TEMPLATES.items():
        for template in own:
            for k in (3, 4, 7):
                got = found(" ".join([template] * k))
                assert [g[0] for g in got] == [name] * k and all(g[2] == g[4] - g[3] for g in got), template
    words = "Licensed under the Apache License, Version 2.0.".split()
    for edited in (["x", *words], [*words[:4], "x", *words[4:]], words[:3] + words[4:]):  # a word more, before and within, and one less
        assert [g[0] for g in found(" ".join(edited * 5))] == ["Apache-2.0"] * 5, edited
