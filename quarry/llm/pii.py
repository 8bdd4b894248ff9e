"""Personal data in texts: fixed patterns, and spans added by a character-level BiLSTM-CRF.

The tagger is trained in numpy on windows around the signs that such data is made of, labelled by the spans of the
patterns, from a bounded sample of the corpus. Each window with a span is learned twice, as it is and disguised: signs in
brackets or in words, spaced or unusual separators, numbers without their plus. Every text is searched whole for signs, digits,
@ and their words, one of which any accepted span holds; each stretch of signs is covered by overlapping windows, their scores are averaged, weighted by the
distance from a window's edge, and one best path is decoded over the whole stretch. A decoded span is added when it is well-formed
for its kind once the disguise is undone (the pattern of an address, parts up to 255, Luhn, 8 to 15 digits after a plus, a
bracket or a zero) and overlaps no other span. Spans of the patterns always stay.

NULL and empty texts have no spans; repeated rows give repeated results. Without any pattern span in the sample there is no
tagger and nothing is added. Of very long texts all stretches are decoded, in batches of windows. Positions are code points,
ends exclusive. Other columns are not read; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text
from quarry.llm.tagger import Tagger
from quarry.session import cut

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match ends with its digits, so the next one cannot begin inside a run of digits; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Windows, their step, and how many characters around a sign are looked at.
WINDOW, STEP, AROUND = 64, 32, 32
#: Training windows, at most, for each kind and for windows without any span.
SAMPLE_WINDOWS = 400
#: Steps of the training.
STEPS = 420
#: Whatever :func:`well_formed` accepts holds a digit, an @ or one of these words.
_SIGN = re.compile(r"[0-9@]|[\[({<]\s*(?:at|dot|\.)\s*[\])}>]|\b(?:at|dot)\b", re.IGNORECASE)
#: What a span with a sign can go on over: the rest of a word, the next one, and words between which only punctuation stands.
_ON = re.compile(r"\S*+(?:\s++\S++)?+(?:\s++[^\s\w]++\s++\S++)*+")
#: Ways to write a sign that a disguise takes from, and separators of digits.
AT, DOT = (" [at] ", " (at) ", " at ", "[at]", " @ ", "(at)"), (" [dot] ", " dot ", " . ", ".", "[dot]", " (dot) ")
SEPARATORS = (".", "/", " . ", "  ", "_", "-", " - ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


_UNDO_AT = re.compile(r"\s*(?:@|[\[({<]\s*at\s*[\])}>]|\bat\b)\s*", re.IGNORECASE)
_UNDO_DOT = re.compile(r"\s*(?:[\[({<]\s*(?:dot|\.)\s*[\])}>]|\bdot\b|\.)\s*", re.IGNORECASE)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def well_formed(kind: str, s: str) -> bool:
    """Whether a span is data of its kind once signs in words, in brackets or between spaces are plain again."""
    if kind == "email":
        return _ADDRESS.fullmatch(_UNDO_DOT.sub(".", _UNDO_AT.sub("@", s))) is not None
    if kind == "ip":
        plain = _UNDO_DOT.sub(".", s)
        return re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", plain) is not None and all(int(p) <= 255 for p in plain.split("."))
    n = _digits(s)
    if kind == "card":
        return re.fullmatch(r"[0-9](?:[\s./_-]{0,3}[0-9])+", s) is not None and 16 <= len(n) <= 19 and luhn(n)
    return re.fullmatch(r"[+(0][0-9\s().\-/_]*[0-9]", s) is not None and 8 <= len(n) <= 15


def disguise(kind: int, s: str, rng: np.random.Generator) -> str:
    """A span of a pattern, written otherwise."""
    pick = lambda ways: ways[int(rng.integers(len(ways)))]
    if kind == 0:
        local, _, domain = s.partition("@")
        dot = pick(DOT)
        return (local.replace(".", dot) if rng.random() < 0.5 else local) + pick(AT) + domain.replace(".", dot)
    if kind == 1:
        return s.replace(".", pick((" . ", ". ", "[.]", " dot ", " [dot] ")))
    digits, by = _digits(s), pick(SEPARATORS)
    if kind == 2:
        return by.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area = 2 + int(rng.integers(3))
    head = pick((f"({digits[:area]}) ", f"(0{digits[:area]}) ", f"00{digits[:area]}{by}", f"0{digits[:area]}{by}"))
    rest = digits[area:]
    return head + pick((rest, by.join((rest[: len(rest) // 2], rest[len(rest) // 2 :]))) )


def _disguised(text: str, tags: list[int], rng: np.random.Generator) -> tuple[str, list[int]] | None:
    """A window whose whole spans are disguised, cut to the length of a window; None without one."""
    out, marks, at, changed = "", [], 0, False
    for m in re.finditer("|".join(f"{chr(65 + 2 * k)}{chr(66 + 2 * k)}*" for k in range(len(KINDS))), "".join(chr(64 + t) for t in tags)):
        a, b, kind = m.start(), m.end(), (tags[m.start()] - 1) // 2
        new = disguise(kind, text[a:b], rng) if b < len(text) and well_formed(KINDS[kind], text[a:b]) else text[a:b]
        changed |= new != text[a:b]
        out += text[at:a] + new
        marks += tags[at:a] + [1 + 2 * kind] + [2 + 2 * kind] * (len(new) - 1)
        at = b
    out, marks = out + text[at:], marks + tags[at:]
    first = max(0, min(len(out) - WINDOW, next((i for i, t in enumerate(marks) if t), 0) - 12))
    return (out[first : first + WINDOW], marks[first : first + WINDOW]) if changed else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the patterns, leftmost and non-overlapping per kind; matches that fail a check are dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(n := _digits(m[0])) <= 19 and luhn(n):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Where signs lie, with their surroundings and all words that a span with the sign can take in; stretches that meet are one. A
    span that is accepted holds a sign, so none lies outside."""
    out: list[list[int]] = []
    back = text[::-1]
    for m in _SIGN.finditer(text):
        if out and m.end() + AROUND <= out[-1][1]:
            continue
        a, b = m.start(), m.end()
        a = a if out and a <= out[-1][1] else min(max(0, a - AROUND), len(text) - _ON.match(back, len(text) - a).end())
        b = max(min(len(text), b + AROUND), _ON.match(text, b).end())
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(a: int, b: int) -> list[int]:
    """Starts of overlapping windows over a stretch."""
    return list(range(a, max(a + 1, b - WINDOW + STEP), STEP))


_CODES = {c: i for i, c in enumerate("@.+-_%() \n,;:/0123456789[]{}<>atdo", start=4)}
_CODES |= {c.upper(): _CODES[c] for c in "atdo"}  # the letters of signs in words


def encode(text: str) -> np.ndarray:
    """Codes of characters: 0 is padding, 1 a small letter, 2 a capital one, 3 any other sign."""
    return np.array([_CODES.get(c) or (1 if c.islower() else 2 if c.isupper() else 3) for c in text], np.int64)


SYMBOLS = 4 + max(_CODES.values())


def tags_of(spans: list[tuple[int, int, int]], start: int, end: int) -> np.ndarray:
    """0 outside, 1 + 2 * kind at a span's first character, 2 + 2 * kind inside; on overlaps the first kind listed counts."""
    out = np.zeros(end - start, np.int64)
    for kind, a, b in sorted(spans):
        lo, hi = max(a, start), min(b, end)
        if lo < hi and not out[lo - start : hi - start].any():
            out[lo - start : hi - start] = 2 + 2 * kind
            if a >= start:
                out[a - start] = 1 + 2 * kind
    return out


def _padded(codes: np.ndarray, start: int) -> np.ndarray:
    own = codes[start : start + WINDOW]
    return np.pad(own, (0, WINDOW - len(own)))


def fit(docs: DataFrame, sample_windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """Trains on at most ``sample_windows`` windows of each kind and as many without a span, drawn by a hash of their text."""

    def scan(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                spans = None
                for a, b in stretches(text):
                    spans = base_spans(text) if spans is None else spans
                    for start in windows(a, b):
                        end = min(len(text), start + WINDOW)
                        tags = tags_of(spans, start, end)
                        kinds = sorted({(t - 1) // 2 for t in tags.tolist() if t})
                        out.append((kinds[0] if kinds else -1, text[start:end], tags.tolist()))
            yield pd.DataFrame(out, columns=["kind", "text", "tags"])

    found = cut(id_and_text(docs).mapInPandas(scan, "kind int, text string, tags array<int>"))
    rows = [r for kind in range(-1, len(KINDS)) for r in found.where(F.col("kind") == kind).orderBy(F.xxhash64("text"), "text").limit(sample_windows).collect()]
    if not any(r.kind >= 0 for r in rows):
        return None
    rng = np.random.default_rng(5)
    pairs = [(r.text, list(r.tags)) for r in rows]
    pairs += [p for _ in range(3) for text, own in pairs[:] if (p := _disguised(text, own, rng))]
    codes = np.stack([_padded(encode(text), 0) for text, _ in pairs])
    tags = np.stack([np.pad(np.array(own, np.int64), (0, WINDOW - len(own))) for _, own in pairs])
    return Tagger(SYMBOLS, 1 + 2 * len(KINDS)).fit(codes, tags, steps=STEPS)


_WEIGHT = (1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]], batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the tagger adds."""
    jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(jobs):
        own, codes, of = [], [], []
        while at < len(jobs) and (not codes or len(codes) < batch):
            i, a, b = jobs[at]
            chars = encode(texts[i][a : min(len(texts[i]), b + WINDOW)])
            for start in windows(0, b - a):
                codes.append(_padded(chars, start))
                of.append((len(own), start))
            own.append((i, a, b))
            at += 1
        scores = np.concatenate([tagger.emissions(np.stack(codes[k : k + batch])) for k in range(0, len(codes), batch)])
        merged = [np.zeros((b - a + WINDOW, scores.shape[2]), np.float32) for _, a, b in own]
        weight = [np.zeros(b - a + WINDOW, np.float32) for _, a, b in own]
        for s, (j, start) in zip(scores, of):
            merged[j][start : start + WINDOW] += s * _WEIGHT[:, None]
            weight[j][start : start + WINDOW] += _WEIGHT
        for (i, a, b), m, w in zip(own, merged, weight):
            path = tagger.decode(m[: b - a] / np.maximum(w[: b - a], 1e-9)[:, None]).tolist()
            t = 0
            while t < len(path):
                if not path[t]:
                    t += 1
                    continue
                kind, u = (path[t] - 1) // 2, t + 1
                while u < len(path) and path[u] == 2 + 2 * kind:
                    u += 1
                start, end = a + t, a + u
                while start < end and texts[i][start].isspace():
                    start += 1
                while end > start and (texts[i][end - 1].isspace() or texts[i][end - 1] in ".,;:"):
                    end -= 1
                if well_formed(KINDS[kind], texts[i][start:end]) and not any(s < end and start < e for _, s, e in base[i] + out[i]):
                    out[i].append((kind, start, end))
                t = u
    return out


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); counts and digest are of the patterns' spans, ``spans``
    has the added ones too."""

    def scan(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            base = [base_spans(t) for t in texts]
            more = added_spans(tagger, texts, base) if tagger else [[] for _ in texts]
            out = {"doc_id": pdf["doc_id"]}
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(s[0] == k for s in spans) for spans in base]
            out["base_sha256"] = [hashlib.sha256(_text_of(spans).encode()).hexdigest() for spans in base]
            out["spans"] = [_text_of(a + b) for a, b in zip(base, more)]
            yield pd.DataFrame(out)

    return id_and_text(docs).mapInPandas(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
