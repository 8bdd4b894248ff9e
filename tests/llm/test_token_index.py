import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_index, tokens
from quarry.llm.common import documents
from quarry.llm.tokens import BYTE_BPE, WORD_BPE, Encoder
from quarry.session import scratch

TEXTS = [
    "", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "it's we'll 'tis", "a\tb. c,d 1.5 $.x ½ ²", "ça. Été, ñ\n\nx", "中文 text. a", "é. x", "<|endoftext|> a",
    "a.\x1cb", "x\xa0y \xa0z", "İstanbul ΣΑΣ.", "don't. DON'T.", "\r\n a", "a.b. c..d ... e,", "ͅ", "ab.\n", "\nab", "12 345 a1b", " \n", "$ a$ 5$", "\x00a \x00", "x×y ÷",
]


def reference(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_same_ids_as_whole_texts(spark, name):
    texts = TEXTS + [r.text for r in documents(spark, "/root/testdata/sf0.001").collect()]
    ids, offsets = Encoder.of(name).encode(pa.array([*texts, None]))
    for i, e in enumerate(reference(name).encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids, texts[i][:80]
    assert offsets[-1] == offsets[-2]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_more_new_words_than_the_table_holds(name, monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 64)
    texts = ["a b", " ".join(f"w{i}x {i * 7919}" for i in range(500)), "", "it's  odd", " ".join(f"{i} word" for i in range(400)), "a b c"]
    encoder = Encoder(name)
    for batch in (texts, texts[::-1]):
        ids, offsets = encoder.encode(pa.array(batch))
        for i, e in enumerate(reference(name).encode_batch(batch, add_special_tokens=False)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 50, n).astype(np.uint16)
    w = token_index.WaveletMatrix.from_bytes(token_index.WaveletMatrix.build(ids).to_bytes())
    assert (w.decode() == ids).all()
    for token in (0, 3, 49, 60):
        at = np.flatnonzero(ids == token).tolist()
        assert w.occurrences(token) == at and w.count(token, n // 3, n // 2) == sum(n // 3 <= a < n // 2 for a in at)
    assert all(w.access(i) == ids[i] for i in range(0, n, 97))
    with pytest.raises(IndexError):
        w.access(n)


def test_round_trip(spark, edge, none):
    docs, path = edge.select("doc_id", "text").union(documents(spark, "/root/testdata/sf0.001").selectExpr("doc_id + 100", "text")), scratch(spark)
    token_index.write(docs, path, shard_tokens=5000)
    got = sorted(token_index.read(spark, path).collect(), key=lambda r: r.start)
    encode, at, places = reference(BYTE_BPE), 0, []
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (i, t), r in zip(want, got, strict=True):
        ids = np.array([*encode.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        places += (np.flatnonzero(ids == 2) + at).tolist()
        at += len(ids)
    assert len({(r.part, r.shard) for r in got}) > 3
    assert sorted(r.place for r in token_index.token_places(spark, path, 2).collect()) == places
    assert sum(r.n for r in token_index.token_counts(spark, path, 2).collect()) == len(places)
    empty = scratch(spark)
    token_index.write(none, empty)
    assert token_index.read(spark, empty).count() == 0


def test_rows_of_one_id(spark, monkeypatch):
    """Rows without id, many alike and some that differ far in: in the order of their texts, over several tasks."""
    monkeypatch.setattr(token_index, "RANGE_CHARS", 4)
    text = "case when id % 3 = 0 then null when id % 3 = 1 then 'abcd' when id % 9 = 2 then 'abc' else concat('abcd', id % 50) end"
    docs, path = spark.range(3000, numPartitions=6).selectExpr("cast(null as long) doc_id", f"{text} text"), scratch(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one task
    token_index.write(docs, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(token_index.read(spark, path).collect(), key=lambda r: r.start)
    encode = reference(BYTE_BPE)
    want = [np.array([*encode.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in sorted(r.text or "" for r in docs.collect())]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(w), zlib.crc32(w.tobytes())) for w in want]
    assert [r.start for r in got] == np.cumsum([0, *map(len, want[:-1])]).tolist()
    assert len({r.part for r in got}) > 2
