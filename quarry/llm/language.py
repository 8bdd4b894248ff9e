"""Language identification: averaged hashed subword embeddings, a linear softmax, and a calibrated rejection.

A text is read as UTF-8, A-Z lower-cased; everything in ASCII but letters separates words. Subwords are the runs of 2 to 5
bytes of a word with a mark at its beginning and end. Each is hashed to a bucket that has an embedding; a text is the mean of
the embeddings of all its subwords, and a softmax over a linear map of it names the language.

Embeddings and map are trained by stochastic gradient descent in numpy on a bounded sample of passages, about as many of each
language. A part of the passages is kept back: on it a temperature makes the probabilities match the share of right answers,
and the smallest probability is found from which on answers are right as often as asked for. Buckets never seen in training
count as zero; how few seen ones a text may have is read off the kept-back passages too. Answers below either bound are marked
as not accepted.

Only the text enters a prediction. A text that is NULL or has no letter is ``und`` with score 0 and is not accepted, and so is
every text where nothing could be learned from. Rows whose text, lang or doc_id is NULL are not learned from; repeated
passages are learned from once. Every row gives a row, repeated ones too. Very long texts are read whole, in blocks that end
between words. Other columns are not read; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, byte_blocks, slices

#: Passages that are learned from, at most, and bytes (characters of the text) of each.
SAMPLE_ROWS = 6000
PASSAGE = 240
#: Languages that are learned, the most frequent ones.
LANGUAGES = 1000
BITS = 17
DIM = 16
SIZES = (2, 3, 4, 5)
EPOCHS = 5
#: Steps of the descent, at least (small samples are gone through more often).
STEPS = 1000
RATE = 0.5
#: Length of a hidden layer at the beginning.
SPREAD = 0.5
BATCH = 32
#: Share of right answers wanted among accepted ones, and share of passages kept back to calibrate on.
PRECISION = 0.99
KEPT_BACK = 5
#: Share of kept-back passages that may have fewer known subwords than is asked of an accepted text.
STRANGE = 0.005

_LETTERS = np.zeros(256, np.uint8)
for _c in range(256):
    _LETTERS[_c] = (_c | 0x20 if _c < 128 else _c) if _c >= 128 or chr(_c).isalpha() else 0
_BREAKS = _LETTERS == 0


def subwords(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every subword of the rows of a buffer, one pair of arrays for each size."""
    codes = np.append(np.insert(_LETTERS[data], offsets[:-1], 0), np.uint8(0))
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets) + 1)
    row = np.append(row, row[-1:])
    keep = np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))  # one mark between words
    codes, row = codes[keep].astype(np.uint32), row[keep]
    row[:-1] = np.where(codes[:-1] == 0, row[1:], row[:-1])  # where a mark stands for two rows, what begins there is the second's
    marks = np.append(0, np.cumsum(codes == 0, dtype=np.int32))
    h = codes + np.uint32(1)
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(1)
        if n in SIZES:
            whole = marks[n - 1 : len(codes)] == marks[1 : len(codes) - n + 2]  # no mark inside
            x = h[whole]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield (x >> np.uint32(32 - bits)).astype(np.int32), row[: len(whole)][whole]


class Model:
    """``languages``, and what each bucket adds to the hidden layer (or, where there are fewer languages, to their logits)."""

    def __init__(self, languages: list[str], embeddings: np.ndarray, weights: np.ndarray, temperature: float = 1.0, threshold: float = 0.0, least_known: float = 0.0):
        self.languages, self.temperature, self.threshold, self.least_known = languages, temperature, threshold, least_known
        self.bits, self.seen = int(len(embeddings)).bit_length() - 1, embeddings.any(1)
        short = weights.shape[1] <= weights.shape[0]
        self.table = np.ascontiguousarray((embeddings @ weights if short else embeddings).T, np.float32)  # a mean of sums is the sum of means
        self.weights = np.eye(weights.shape[1]) if short else weights

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row of calibrated probabilities for each text, and the share of its subwords that were seen in training."""
        data, offsets = as_bytes(texts)
        sums, count = np.zeros((len(self.table), len(texts))), np.zeros(len(texts))
        known = np.zeros(len(texts))
        for first, part, own in byte_blocks(data, offsets, _BREAKS):
            rows, to = len(own) - 1, slice(first, first + len(own) - 1)
            for bucket, row in subwords(part, own, self.bits):
                count[to] += np.bincount(row, minlength=rows)
                known[to] += np.bincount(row[self.seen[bucket]], minlength=rows)
                for j, column in enumerate(self.table):
                    sums[j, to] += np.bincount(row, column[bucket], rows)
        count = np.maximum(count, 1)
        return softmax((sums / count).T @ self.weights / self.temperature), known / count


def softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits - logits.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def train(buckets: list[np.ndarray], target: np.ndarray, languages: int, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, batch: int = BATCH, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings (buckets x dim) and weights (dim x languages) by minibatch gradient descent on the cross entropy; the rate falls
    to zero. ``buckets`` holds those of each passage."""
    rng = np.random.default_rng(seed)
    # A mean of so many members is short: embeddings begin long enough that a hidden layer has length SPREAD, and their steps are
    # scaled alike, so that a step moves the hidden layer as far as it would without averaging.
    short = np.mean([1 / max(1, len(b)) for b in buckets])
    embeddings, weights = rng.normal(0, SPREAD / np.sqrt(dim * short), (1 << bits, dim)), np.zeros((dim, languages))
    seen = np.zeros(1 << bits, bool)
    epochs = max(epochs, -(-STEPS * batch // max(1, len(buckets))))
    steps, step = epochs * -(-len(buckets) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(buckets))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            size = np.array([len(buckets[i]) for i in own])
            ids, back = np.unique(np.concatenate([buckets[i] for i in own]), return_inverse=True)
            row = np.repeat(np.arange(len(own)), size)
            mean = np.bincount(row * len(ids) + back, minlength=len(own) * len(ids)).reshape(len(own), -1) / np.maximum(size, 1)[:, None]
            hidden = mean @ embeddings[ids]
            error = softmax(hidden @ weights)
            error[np.arange(len(own)), target[own]] -= 1
            lr = rate * (1 - step / steps)
            change = mean.T @ (error @ weights.T)
            weights -= lr / len(own) * hidden.T @ error
            embeddings[ids] -= lr / len(own) / max(short, (mean * mean).sum() / len(own)) * change
            seen[ids] = True
            step += 1
    embeddings[~seen] = 0
    return embeddings, weights


def calibrate(logits: np.ndarray, target: np.ndarray, precision: float = PRECISION) -> tuple[float, float]:
    """The temperature of the smallest cross entropy (golden section on its logarithm), and the smallest probability of the best
    language from which on answers are right with at least ``precision``; 1 if there is none, 0 without rows."""
    if not len(target):
        return 1.0, 0.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(target)), target], 1e-300)).mean()

    a, b, g = -4.0, 4.0, (5**0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    temperature = float(np.exp((a + b) / 2))
    p = softmax(logits / temperature)
    best, right = p.max(1), p.argmax(1) == target
    order = np.argsort(-best, kind="stable")
    ends = np.append(best[order][1:] != best[order][:-1], True)  # equal probabilities are accepted together
    good = np.flatnonzero(ends & (np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1)))
    return temperature, float(best[order][good[-1]]) if len(good) else 1.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def passages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, languages: int = LANGUAGES, passage: int = PASSAGE) -> DataFrame:
    """(lang, passage, part): at most ``sample_rows`` different passages, about as many of each language, drawn by a hash of
    doc_id from the rows that may be learned from; each is cut from its text at a place given by a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    shares = [(r.lang, min(1.0, 2.0 * sample_rows / len(counts) / r.n)) for r in counts]
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    places = F.greatest(F.length("text") - passage, F.lit(0)) + 1
    place = F.pmod(F.xxhash64("text"), places.cast("long")).cast("int") + 1
    found = rows.join(share, "lang").where(drawn).select("lang", F.substring("text", place, F.lit(passage)).alias("passage")).distinct()
    found = found.select("lang", "passage", F.xxhash64("lang", "passage").alias("h")).orderBy("h", "lang", "passage").limit(sample_rows)
    return found.select("lang", "passage", F.pmod(F.xxhash64("passage", F.lit(1)), F.lit(KEPT_BACK)).cast("int").alias("part"))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS) -> Model | None:
    """Learns from at most ``sample_rows`` passages outside the held-out quarter; None without any."""
    found = passages(docs, sample_rows).toPandas().sort_values(["lang", "passage"])
    languages = sorted(set(found["lang"]))
    if not languages:
        return None
    data, offsets = as_bytes(pa.array(found["passage"], pa.string()))
    pairs = list(subwords(data, offsets, bits))
    row = np.concatenate([r for _, r in pairs])
    order = np.argsort(row, kind="stable")
    buckets = np.split(np.concatenate([b for b, _ in pairs])[order], np.searchsorted(row[order], np.arange(1, len(found))))
    target, rest = np.searchsorted(languages, found["lang"]), found["part"].to_numpy() > 0
    if not rest.any():
        rest[:] = True
    embeddings, weights = train([b for b, r in zip(buckets, rest) if r], target[rest], len(languages), bits, dim, epochs)
    back = np.flatnonzero(~rest)
    logits = np.array([embeddings[buckets[i]].mean(0) @ weights if len(buckets[i]) else np.zeros(len(languages)) for i in back]).reshape(-1, len(languages))
    known = [embeddings[buckets[i]].any(1).mean() for i in back if len(buckets[i])]
    return Model(languages, embeddings, weights, *calibrate(logits, target[back], precision), float(np.quantile(known, STRANGE)) if known else 0.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted), one row per row of ``docs``."""
    text = F.col("text").cast("string")
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.when(known, text).alias("text"))
    names = ["doc_id", "held_out", "lang_pred", "score", "accepted"]
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                known = np.asarray(pa.compute.is_valid(part.column("text")))
                p, seen = model.probabilities(part.column("text"))
                best, score = p.argmax(1), np.where(known, p.max(1), 0.0)
                named = [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(named, pa.string()), pa.array(score), pa.array(known & (score >= model.threshold) & (seen >= model.least_known))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
