import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import near
from quarry.llm.common import documents


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having, classes = defaultdict(set), defaultdict(list)
    for i, s in sets.items():
        classes[s].append(i)
    keys = [s for s in classes if s]
    for n, s in enumerate(keys):
        for g in s:
            having[g].add(n)
    links = [(i, classes[s][0]) for s in keys for i in classes[s]]
    for n, s in enumerate(keys):
        for m, shared in Counter(m for g in s for m in having[g] if m < n).items():
            if 100 * shared >= 80 * (len(s) + len(keys[m]) - shared):
                links.append((classes[s][0], classes[keys[m]][0]))
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {(i, len(s), root(i)) for i, s in sets.items()}


FORCED = {"small": 2, "hot": 8, "pivots": 1, "bucket_bytes": 100_000, "max_pairs": 0, "star_rounds": 2, "links_per_task": 40}


def variants(seed, n):
    """Families of texts with edits around the threshold, and unrelated ones."""
    rnd, out = random.Random(seed), []
    bases = [[f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(20, 150))] for _ in range(3)]
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(9999)}"
        out.append((i, " ".join(words[rnd.randrange(3) :])))
    return out


@pytest.mark.parametrize("options", [{}, FORCED])
def test_families(spark, options):
    rows = variants(4, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r)[:3] for r in near.near_components(docs, **options).collect()} == brute(rows)


@pytest.mark.parametrize("options", [{}, FORCED])
def test_documents(spark, options):
    docs = documents(spark, "/root/testdata/sf0.01")
    assert {tuple(r)[:3] for r in near.near_components(docs, **options).collect()} == brute([(r.doc_id, r.text or "") for r in docs.collect()])


def test_edge_cases(spark, edge, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near.near_components(edge).collect()}
    assert got >= {(i, n, c) for i, n, c in brute([(r.doc_id, r.text or "") for r in edge.where("doc_id is not null").collect()])}
    assert (None, 0, None) in got and near.near_components(edge).count() == edge.count()
    assert near.near_components(none).count() == 0
    kept = near.keep_rows(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id in (8, 9)").count() == 1 and kept.where("doc_id in (0, 1, 2)").count() == 3
    assert near.keep_rows(none).count() == 0


A, B, C = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")


def test_kept_rows_with_null_and_repeated_ids(spark):
    rows = [(None, A), (None, B), (None, ""), (None, " "), (7, C), (7, "other words"), (7, ""), (3, "other  words"), (9, "x y"), (9, "x y"), (9, "X  y"), (2, "x y z")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(4)
    kept = near.keep_rows(docs)
    got = [r.n for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == 9
    assert set(got) - {8, 9, 10} == {0, 1, 2, 3, 4, 6, 7, 11}


@pytest.mark.parametrize("options", [{}, FORCED])
def test_links_with_null_and_repeated_ids(spark, options):
    texts = [t for _, t in variants(5, 60)]
    texts += [A, A, A + " tail", B, B + " tail", C, C + " tail"]
    ids = [None if n % 3 == 0 else n % 7 for n in range(len(texts) - 7)] + [None, None, 100, None, None, 1, 2]
    rows = list(enumerate(texts))
    root = {i: c for i, _, c in brute(rows)}
    least = {}
    for (i, _), d in zip(rows, ids):
        least[root[i]] = min((x for x in (d, least.get(root[i])) if x is not None), default=None)
    want = Counter((d, n, least[c]) for (i, n, c), d in ((r, ids[r[0]]) for r in brute(rows)))
    docs = spark.createDataFrame([(d, t) for d, t in zip(ids, texts)], "doc_id long, text string").repartition(4)
    found = near.near_components(docs, **options)
    got = found.collect()
    assert Counter(tuple(r)[:3] for r in got) == want and len({r.root for r in got}) == len(set(root.values()))
    if not options:
        assert near.keep_rows(docs).count() == len(set(root.values()))


def test_components(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(F.col("id") - 1).alias("b")).repartition(7)
    for per_task in (20, 1000):
        got = {r.node: r.root for r in near.components(links, per_task).collect()}
        assert all(got.get(i, i) == i // 100 * 100 for i in range(300))


def test_clashing_names_and_maps(spark):
    """Columns with the names used inside, one that cannot be ordered, NULL and repeated ids, two texts under one id."""
    names = "_keep _keep_key _keep_sha _key _sha _id _row row id hash class root bucket".split()
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (None, "seven eight nine ten eleven"), (None, "a b c d e f g"), (4, "x y z w v u"), (4, "p q r s t u"), (4, "p q r s t u"), (5, None)]
    docs = spark.createDataFrame([(i, t, *range(len(names)), {"a": 1}) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names) + ", m map<string,int>")
    got = near.keep_rows(docs)
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted({(i, t) for i, t in rows if i != 2}, key=str)
    assert near.keep_rows(docs.where("doc_id is not null and doc_id <> 4")).count() == 2
