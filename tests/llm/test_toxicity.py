import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity
from quarry.llm.common import documents


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    rows = scored.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out))
    own = rows[rows.held_out]
    assert (own.predicted == own.toxic).mean() > 0.97 and ((own.score >= 0.5) == own.predicted).all()
    assert own.predicted[own.toxic == 1].mean() > 0.85 and own.predicted[own.toxic == 0].mean() < 0.01
    # Held-out labels are not learned from: turning them round changes nothing.
    other = toxicity.fit(docs, labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    texts = pd.Series([r.text for r in docs.limit(50).collect()])
    assert (model.score(texts) == other.score(texts)).all()


def test_disguise_and_address():
    names = toxicity.FEATURES
    row = dict(zip(names, toxicity.feature_matrix(pd.Series(["you are an 1d10t and a st*pid clown, you i-d-i-o-t"]), [])[0]))
    assert row["disguised_hits"] >= 2 and row["addressed"] == 1 and row["hits"] == 1
    assert dict(zip(names, toxicity.feature_matrix(pd.Series(["schadenkeit"]), ["schad"])[0]))["stem_hits"] == 1
    assert dict(zip(names, toxicity.feature_matrix(pd.Series(["xschadenkeit, whatever"]), ["schad"])[0]))["hits"] == 0


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    margin = toxicity.Boosted().fit(x, y).margin(x)
    assert ((margin > 0) == (y > 0)).mean() > 0.98
    at, value = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 0]))
    assert (np.diff(value) >= 0).all() and np.interp([1, 2, 3, 5], at, value).tolist() == [0, 0.5, 0.5, 2 / 3]


def test_edge_cases(spark, edge, none):
    labels = spark.createDataFrame([(0, 0), (1, 0), (4, 1), (4, 0), (6, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    got = toxicity.score(edge, toxicity.fit(edge, labels)).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    model = toxicity.fit(edge, labels.limit(0))
    assert {r.score for r in toxicity.score(edge, model).collect()} == {0.0}
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.keep_rows(edge, model).columns == edge.columns and toxicity.keep_rows(edge, model).count() == edge.count()


@pytest.mark.parametrize("opening", ["", "Posted in the general forum, section four, reply: --- "])
def test_common_opening_hides_nothing(spark, opening):
    """One made-up toxic word, with and without an opening that all texts share."""
    rng = random.Random(5)
    syllables = ["ka", "mo", "li", "tu", "ren", "sol", "ba", "nim", "dor", "fe"]
    word = lambda: "".join(rng.choices(syllables, k=3))
    rows, labels = [], []
    for i in range(600):
        words, toxic = [word() for _ in range(40)], int(i % 3 == 0)
        if toxic:
            words[rng.randrange(40)] = "grelvox"
        rows.append((i, opening + " ".join(words)))
        labels.append((i, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score(docs, model).join(known, "doc_id").where("held_out").toPandas()
    assert any("grelvox".startswith(s) for s in model.stems)
    assert got.predicted[got.toxic == 1].mean() > 0.95 and got.predicted[got.toxic == 0].mean() < 0.02


def test_near_copies_count_once(spark):
    base = " ".join(f"word{i}x" for i in range(300))
    rows = [(base.replace(f"word{k}x", "other"), 0, 1) for k in range(30)] + [(f"unlike {k} grelvox number {k * 7}", 0, 1) for k in range(30)]
    toxic, clean = toxicity._stem_counts(spark.createDataFrame(rows, "text string, fold int, toxic int"))
    assert sum(toxic["grelvox"].values()) > 20 and sum(toxic.get("word1", {}).values()) < 5 and clean == {}


def naive_margin(model, row):
    out = model.base
    for tree, value in model.trees:
        node = 0
        for split in tree:
            j, at = split[node]
            node = 2 * node + int(row[j] > at)
        out += value[node]
    return out


def test_trees_and_pooling_equal_naive_ones():
    rng = np.random.default_rng(3)
    x = np.round(rng.random((120, 3)), 1)
    y = (x[:, 0] + rng.random(120) * 0.4 > 0.6).astype(float)
    model = toxicity.Boosted(rounds=1, depth=1, rate=1.0, penalty=1.0).fit(x, y)
    assert np.allclose(model.margin(x), [naive_margin(model, r) for r in x])
    # The best single split by trying every feature and every value between its quantiles.
    g, h, best = y.mean() - y, y.mean() * (1 - y.mean()), []
    for j in range(3):
        for at in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])):
            left = x[:, j] <= at
            best.append(sum(g[s].sum() ** 2 / (h * s.sum() + 1) for s in (left, ~left)))
    (j, at), = model.trees[0][0][0]
    left = x[:, j] <= at
    assert np.isclose(sum(g[s].sum() ** 2 / (h * s.sum() + 1) for s in (left, ~left)), max(best))
    margin = np.round(rng.random(40), 1)
    label = rng.integers(0, 2, 40).astype(float)
    at, value = toxicity.isotonic(margin, label)
    levels = np.unique(margin)
    sums, sizes = [label[margin == v].sum() for v in levels], [(margin == v).sum() for v in levels]
    for k, v in enumerate(levels):  # the largest of the smallest means over ranges that hold the level
        want = max(min(sum(sums[a : b + 1]) / sum(sizes[a : b + 1]) for b in range(k, len(levels))) for a in range(k + 1))
        assert np.isclose(np.interp(v, at, value), want)
