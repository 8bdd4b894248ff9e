import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import language
from quarry.llm.common import as_bytes, documents


def brute_subwords(text):
    """Runs of bytes of every word with its marks, word by word."""
    data = text.encode()
    low = bytes(b if b > 127 else b | 0x20 if chr(b).isalpha() else 0 for b in data)
    out = []
    for word in low.split(b"\0"):
        if word:
            marked = b"\0" + word + b"\0"
            out += [marked[i : i + n] for n in language.SIZES for i in range(len(marked) - n + 1)]
    return sorted(out)


def bucket_of(gram, bits):
    h = 0
    for b in gram:
        h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
    h = ((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
    return h >> (32 - bits)


TEXTS = ["", "a", "The  end.", "l'été à Genève", "x1y2z", "...", "中文 text", "word " * 50, "A", None]


def test_subwords_equal_brute_force():
    data, offsets = as_bytes(pa.array(TEXTS, pa.string()))
    got = [[] for _ in TEXTS]
    for bucket, row in language.subwords(data, offsets, 20):
        for b, r in zip(bucket.tolist(), row.tolist()):
            got[r].append(b)
    for text, own in zip(TEXTS, got):
        want = sorted(bucket_of(g, 20) for g in brute_subwords(text or ""))
        assert sorted(own) == want, text


@pytest.mark.parametrize("languages", [3, 20])
def test_probabilities_equal_brute_force(languages, monkeypatch):
    """Embeddings averaged one by one, whether the model folds its two layers or not, and whether a text is cut into blocks or not."""
    from quarry.llm import common

    rng = np.random.default_rng(0)
    e, w = rng.normal(size=(1 << 12, 8)), rng.normal(size=(8, languages))
    model = language.Model([f"l{i}" for i in range(languages)], e, w, 0.7)
    for limit in (1 << 20, 60):
        monkeypatch.setattr(language, "byte_blocks", lambda d, o, s, limit=limit: common.byte_blocks(d, o, s, limit))
        got, known = model.probabilities(pa.array(TEXTS, pa.string()))
        assert known.tolist() == [float(bool(brute_subwords(t or ""))) for t in TEXTS]
        for text, row in zip(TEXTS, got):
            grams = brute_subwords(text or "")
            hidden = np.mean([e[bucket_of(g, 12)] for g in grams], axis=0) if grams else np.zeros(8)
            want = np.exp(hidden @ w / 0.7)
            assert np.allclose(row, want / want.sum(), atol=1e-5)


def test_training_descends():
    rng = np.random.default_rng(1)
    target = rng.integers(0, 3, 600)
    buckets = [np.concatenate([rng.integers(0, 100, 5), 100 + 50 * t + rng.integers(0, 50, 5)]) for t in target]
    e, w = language.train(buckets[:400], target[:400], 3, bits=8, dim=8)
    right = [np.argmax(e[b].mean(0) @ w) == t for b, t in zip(buckets[400:], target[400:])]
    assert np.mean(right) > 0.97 and not e[250:].any()


def test_calibration():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(20000, 3)) * 2
    p = language.softmax(logits)
    target = (p.cumsum(1) > rng.random((len(p), 1))).argmax(1)
    t, threshold = language.calibrate(3 * logits, target, 0.9)
    assert abs(t - 3) < 0.15
    q = language.softmax(3 * logits / t)
    taken = q.max(1) >= threshold
    assert (q.argmax(1) == target)[taken].mean() >= 0.9 and 0.05 < taken.mean() < 0.9
    assert language.calibrate(np.zeros((4, 2)), np.array([1, 1, 1, 1]))[1] == 1.0 and language.calibrate(np.zeros((0, 2)), np.zeros(0, int)) == (1.0, 0.0)


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    model = language.fit(docs)
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(rows.doc_id, rows.held_out))
    own = rows[rows.held_out]
    assert (own.lang == own.lang_pred).mean() > 0.99 and own.accepted.mean() > 0.97
    assert (own.lang == own.lang_pred)[own.accepted].mean() > 0.99 and own.score.between(0, 1).all()
    # Held-out languages are not learned from: changing them changes nothing.
    other = language.fit(docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))))
    assert other.languages == model.languages and (other.table == model.table).all() and other.threshold == model.threshold


def test_foreign_texts_are_rejected(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = language.fit(docs)
    strange = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок"), (2, "一二三四五六七八九十"), (3, "qzx wvq xjk zzq")], "doc_id long, text string")
    assert not any(r.accepted for r in language.predict(strange, model).collect())


def test_edge_cases(spark, edge, none):
    known = edge.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").when(F.col("doc_id") < 9, "fr"))
    got = language.predict(edge, language.fit(known)).collect()
    assert len(got) == edge.count()
    for r, (_, text) in zip(sorted(got, key=str), sorted(((r.doc_id, r.text) for r in edge.collect()), key=str)):
        assert 0 <= r.score <= 1 and r.lang_pred in ("de", "fr", "und")
    und = {r.doc_id for r in got if r.lang_pred == "und" and r.doc_id is not None}
    assert und == {0, 1, 2} and all(r.score == 0 and not r.accepted for r in got if r.lang_pred == "und")
    assert language.fit(none) is None and language.fit(edge.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in language.predict(edge, None).collect()} == {"und"}
    assert language.predict(none, language.fit(known)).count() == 0
