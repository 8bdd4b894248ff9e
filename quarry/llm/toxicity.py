"""Toxicity scores from gradient-boosted trees over dense features of a text, with isotonic calibration.

Trees and calibration are fitted in numpy on a bounded sample of labelled rows; every text is then scored in the tasks.
Only the text enters a score. NULL text counts as empty; an empty text gets the score of its (zero) features. Without
labelled rows of both classes every score is the share of toxic labels (0 without labels). Of repeated labels of one
document the highest counts; labels whose toxic value is NULL, and rows without doc_id, are not learned from. Repeated rows
give repeated results, copies and near copies count once in learning words; very long texts are scored whole, one at a time;
an empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_BYTES, id_and_text, slices
from quarry.llm.near import shingle_sets
from quarry.session import cut

#: Labelled rows that are learned from, at most.
SAMPLE_ROWS = 8000
#: Word lists of the lexicon densities.
INSULTS = """idiot idiots idiotic moron morons moronic imbecile cretin fool fools foolish dumb dumbass stupid stupidity loser losers
clown clowns jerk jerks creep creeps freak freaks pig pigs rat rats coward cowards liar liars hypocrite bastard bitch
asshole dickhead scumbag douchebag retard retarded nitwit halfwit dimwit dunce buffoon ignoramus""".split()
CONTEMPT = """pathetic worthless disgusting trash garbage scum filth filthy vermin useless hopeless disgrace shameful despicable
contemptible repulsive vile nasty ugly crap bullshit shit fuck fucking fucked damn hate hated hates despise loathe sickening""".split()
THREATS = "kill killed strangle stab shoot murder beat punch hurt destroy crush burn threaten suffer".split()
SECOND_PERSON = "you your yours yourself yourselves youre ur u thou thee".split()
#: Signs that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: A pronoun so near to a hit (in characters) counts as addressed.
NEAR = 40

FEATURES = [
    "insults", "contempt", "threats", "distinct", "hits", "stems", "distinct_stems", "stem_hits", "disguised_hits", "addressed",
    "second_person", "capitals", "shouted", "exclamation", "question", "punctuation", "sign_in_word", "stretched", "digits", "log_words",
]
#: Learned stems: beginnings of words, of so many letters, found in so many different labelled texts, mostly toxic ones.
STEM_LETTERS = range(4, 10)
STEM_TEXTS = 5
STEM_SHARE = 0.8
FOLDS = 4


def _finder(stems: list[str]) -> Callable[[str], list[float]]:
    import ahocorasick

    group = {w: g for g, ws in enumerate((INSULTS, CONTEMPT, THREATS)) for w in ws}
    finder = ahocorasick.Automaton()
    for stem in stems:
        finder.add_word(f" {stem}", (3, stem, len(stem)))
    for word, g in group.items():
        finder.add_word(f" {word}", (g, word, len(word)))
    finder.make_automaton()
    person = re.compile(r"\b(?:" + "|".join(SECOND_PERSON) + r")\b")
    shouted = re.compile(r"\b[A-Z]{4,}\b")
    inside = re.compile(r"[A-Za-z][@$*!0-9]+[A-Za-z]")
    stretched = re.compile(r"([a-z])\1{3,}")
    spaced = re.compile(r"\b(?:[a-z][-._*]){3,}[a-z]\b")
    odd = re.compile(r"[A-Za-z0-9@$!]*[A-Za-z][@$!013457]+[A-Za-z][A-Za-z0-9@$!]*")
    plain = str.maketrans(DISGUISE)

    def features(text: str) -> list[float]:
        low = f" {text.lower()} "
        for sign in "\n\t\r\"'([{-/*_":
            low = low.replace(sign, " ")
        n, counts, kinds, learned, addressed = max(1, low.count(" ") - 1), [0, 0, 0, 0], set(), set(), 0
        for end, (g, word, size) in finder.iter(low):
            if g < 3 and low[end + 1].isalnum():
                continue
            counts[g] += 1
            (learned if g == 3 else kinds).add(word)
            addressed += person.search(low, max(0, end - size - NEAR), end + NEAR) is not None
        hidden, signs, c = 0, len(inside.findall(text)), len(text) or 1
        if signs:
            hidden += sum(w.translate(plain) in group for w in odd.findall(text.lower()))
        runs = sum(1 for _ in stretched.finditer(low))
        if runs:
            hidden += sum(w in group for w in stretched.sub(r"\1", low).split() if w) - sum(counts[:3])
        hidden += sum(re.sub(r"[-._*]", "", w) in group for w in spaced.findall(text.lower()))
        hits = sum(counts[:3])
        upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        marks = sum(map(text.count, "!?.,;:*#%$&@"))
        return [
            1e3 * counts[0] / n, 1e3 * counts[1] / n, 1e3 * counts[2] / n, len(kinds), hits, 1e3 * counts[3] / n, len(learned), counts[3],
            max(0, hidden), addressed, 1e3 * len(person.findall(low)) / n if hits or hidden or learned else 0.0, upper / c,
            len(shouted.findall(text)) / n, text.count("!") / n, text.count("?") / n, marks / c, signs / n, runs / n,
            sum(map(text.count, "0123456789")) / c, float(np.log1p(n)) if text else 0.0,
        ]

    return features


def feature_matrix(texts: pd.Series, stems: list[str]) -> np.ndarray:
    features = _finder(stems)
    return np.array([features(t or "") for t in texts], np.float64).reshape(-1, len(FEATURES))


def _beginnings(text: str) -> set[str]:
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return {w[:n] for w in words for n in STEM_LETTERS if len(w) >= n}


def choose_stems(toxic: dict[str, int], clean: dict[str, int]) -> list[str]:
    """Beginnings of words in enough toxic texts and few clean ones; of nested ones the shortest."""
    found: set[str] = set()
    for stem in sorted(toxic, key=lambda w: (len(w), w)):
        n = toxic[stem]
        if n >= STEM_TEXTS and n >= STEM_SHARE * (n + clean.get(stem, 0)) and not any(stem[:k] in found for k in STEM_LETTERS if k < len(stem)):
            found.add(stem)
    return sorted(found)


def _kind_of(texts: pd.Series) -> list[int]:
    """A hash that near copies mostly share and other texts do not, whatever they begin with: the smallest one of all runs of three
    words; 0 without words."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    return [int(s[:1].view(np.int64)[0]) if len(s) else 0 for rows in slices(batch, limit=SLICE_BYTES // 4) for s in shingle_sets(rows.column("text"), 3)]


def _stem_counts(rows: DataFrame) -> tuple[dict, dict]:
    """How many different texts of each fold have a beginning of a word, toxic and clean ones, near copies counted once for both.
    Only beginnings in enough toxic texts are counted; ``rows`` is the bounded sample."""

    def counted(label: int, wanted: frozenset | None) -> DataFrame:
        def found(batches):
            for pdf in batches:
                out = []
                for text, fold, kind in zip(pdf["text"], pdf["fold"], _kind_of(pdf["text"])):
                    own = _beginnings(text)
                    out += [(stem, fold, kind) for stem in (own if wanted is None else own & wanted)]
                yield pd.DataFrame(out, columns=["stem", "fold", "kind"])

        own = rows.where(F.col("toxic") == label).select("text", "fold").mapInPandas(found, "stem string, fold int, kind long")
        return own.distinct().groupBy("stem", "fold").agg(F.count(F.lit(1)).alias("n"))

    enough = counted(1, None).groupBy("stem").agg(F.sum("n").alias("all"), F.collect_list(F.struct("fold", "n")).alias("folds")).where(F.col("all") >= STEM_TEXTS)
    counts = {r.stem: {f.fold: f.n for f in r.folds} for r in enough.select("stem", "folds").collect()}
    others: dict[str, dict[int, int]] = {}
    for r in counted(0, frozenset(counts)).collect():
        others.setdefault(r.stem, {})[r.fold] = r.n
    return counts, others


def _without(counts: dict[str, dict[int, int]], fold: int | None) -> dict[str, int]:
    return {s: sum(n for f, n in by.items() if f != fold) for s, by in counts.items()}


class Boosted:
    """Newton-boosted trees of fixed depth for a 0/1 label, splits at quantiles of the training values."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                nodes, size = 1 << level, max(len(e) for e in edges) + 1
                best = np.full(nodes, 1e-9)
                split = [(-1, np.inf)] * nodes
                total_g, total_h = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
                for j, e in enumerate(edges):
                    at = node * size + codes[:, j]
                    left_g = np.bincount(at, g, nodes * size).reshape(nodes, size).cumsum(1)[:, : len(e)]
                    left_h = np.bincount(at, h, nodes * size).reshape(nodes, size).cumsum(1)[:, : len(e)]
                    if not len(e):
                        continue
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.penalty) + right_g**2 / (right_h + self.penalty) - (total_g**2 / (total_h + self.penalty))[:, None]
                    k = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(nodes), k] > best):
                        best[i], split[i] = gain[i, k[i]], (j, float(e[k[i]]))
                tree.append(split)
                feature, cut = np.array([s[0] for s in split]), np.array([s[1] for s in split])
                node = 2 * node + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.penalty)
            margin += value[node]
            self.trees.append((tree, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for split in tree:
                feature, cut = np.array([s[0] for s in split]), np.array([s[1] for s in split])
                node = 2 * node + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit of y by margin (pool adjacent violators)."""
    at, back = np.unique(margin, return_inverse=True)
    weight, mean = np.bincount(back).astype(float), np.bincount(back, y) / np.bincount(back)
    blocks: list[list[float]] = []  # mean, weight, first, last
    for x, m, w in zip(at, mean, weight):
        blocks.append([m, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last]
    return np.array([v for b in blocks for v in b[2:]]), np.array([v for b in blocks for v in (b[0], b[0])])


class Model:
    """``score(texts)`` in [0, 1]."""

    def __init__(self, share: float, stems: list[str] = (), trees: Boosted | None = None, knots: tuple[np.ndarray, np.ndarray] | None = None):
        self.share, self.stems, self.trees, self.knots = share, list(stems), trees, knots

    def score(self, texts: pd.Series) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        margin = self.trees.margin(feature_matrix(texts, self.stems))
        # The calibrated value has steps; a thousandth of the uncalibrated one keeps the order within a step.
        return np.clip(0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin)), 0, 1)


def fit_rows(x: np.ndarray, y: np.ndarray, fold: np.ndarray, stems: list[str]) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.0)
    out = np.zeros(len(y))
    for k in range(FOLDS):  # calibrated on margins of rows that the trees have not seen
        rest = fold != k
        if rest.any() and not rest.all():
            out[~rest] = Boosted().fit(x[rest], y[rest]).margin(x[~rest])
    return Model(float(y.mean()), stems, Boosted().fit(x, y), isotonic(out, y))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``sample_rows`` labelled rows outside the held-out fifth, drawn by a hash of doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = id_and_text(docs).join(F.broadcast(sample), "doc_id").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    rows = cut(rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "fold")).alias("row")).select("doc_id", "toxic", "row.fold", "row.text"))
    toxic, clean = _stem_counts(rows)
    stems = {k: choose_stems(_without(toxic, k), _without(clean, k)) for k in [None, *range(FOLDS)]}

    def features(batches):
        for pdf in batches:
            for k, own in pdf.groupby("fold"):  # a row's stems are learned without its fold
                yield pd.DataFrame({"doc_id": own["doc_id"], "toxic": own["toxic"], "fold": own["fold"], "x": list(feature_matrix(own["text"], stems[k]))})

    learned = rows.mapInPandas(features, "doc_id long, toxic int, fold int, x array<double>").orderBy("doc_id").toPandas()
    x = np.array(learned["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit_rows(x, learned["toxic"].to_numpy(np.float64), learned["fold"].to_numpy(), stems[None])


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        return pd.Series(np.concatenate([model.score(rows.column("text").to_pandas()) for rows in slices(batch)] or [np.zeros(0)]))

    return score(text.cast("string"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    rows = id_and_text(docs)
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_rows(docs: DataFrame, model: Model) -> DataFrame:
    """Rows whose text is not predicted toxic, with all their columns."""
    return docs.where(score_column(model, F.col("text")) < 0.5)
