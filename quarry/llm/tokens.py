"""Token ids of whole texts with the public vocabularies.

Words are parted where a vocabulary's own pre-tokenizer always parts them, each distinct word is encoded by
``tokenizers`` once per worker, and its ids are looked up by the word's 64-bit hash. Texts in which those places are
not plain (double white space, apostrophes, characters beyond U+024F or unusual signs) go to ``tokenizers`` whole.
"""
from __future__ import annotations

import gc
import os
import sys
import types
from array import array

import numpy as np
import pyarrow as pa

from quarry.llm.common import as_bytes, span_hashes

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Slots of a worker's table of known words; it starts anew when half of them are taken.
SLOTS = 1 << 22
_OTHER, _LETTER, _DIGIT, _SPACE, _BREAK, _STRANGE = range(6)


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    kind[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
    kind[48:58] = _DIGIT
    kind[32] = _SPACE
    kind[[9, 10, 11, 12, 13]] = _BREAK
    kind[[39, 0xC0, 0xC1, 0xC2, *range(0xCA, 256)]] = _STRANGE
    return kind


_KIND = _classes()


class Encoder:
    """``Encoder.of(name)`` gives the worker's own encoder, which outlives a task where workers are reused."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.byte_level = name == BYTE_BPE
        self._forget()

    @staticmethod
    def of(name: str) -> "Encoder":
        shelf = sys.modules.setdefault("_quarry_encoders", types.ModuleType("_quarry_encoders"))
        if not hasattr(shelf, name):
            setattr(shelf, name, Encoder(name))
        return getattr(shelf, name)

    def _forget(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.starts = np.zeros(SLOTS, np.int32)
        self.lengths = np.zeros(SLOTS, np.int32)
        self.pool = np.zeros(1 << 20, np.uint16)
        self.pooled = self.taken = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of every hash, or the empty slot at which the search for it ended."""
        mask = np.uint64(SLOTS - 1)
        slot = (hashes & mask).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != hashes) & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
            found = self.keys[slot[open_]]
            open_ = open_[(found != hashes[open_]) & (found != 0)]
        return slot

    def _learn(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Adds distinct new hashes with their ids."""
        sizes = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
        flat = np.frombuffer(b"".join(ids), "<u2")
        while self.pooled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        starts = self.pooled + np.cumsum(sizes) - sizes
        self.pooled += len(flat)
        self.taken += len(hashes)
        left = np.arange(len(hashes))
        while len(left):
            slot = self._find(hashes[left])
            self.keys[slot] = hashes[left]  # of several that meet in a slot one stays
            won = self.keys[slot] == hashes[left]
            self.starts[slot[won]], self.lengths[slot[won]] = starts[left[won]], sizes[left[won]]
            left = left[~won]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[bytes]:
        """Words of letters only are encoded many at a time, as the pre-tokenizer parts them again."""
        skip = 1 if self.byte_level else 0
        out: list[bytes] = [b""] * len(words)
        joined = [i for i, w in enumerate(words) if w[skip:].isalpha() and (not skip or w[0] == " ")]
        rest = set(range(len(words))).difference(joined)
        for at in range(0, len(joined), 4096):
            part = joined[at : at + 4096]
            e = self.tokenizer.encode(("" if self.byte_level else " ").join([words[i] for i in part]), add_special_tokens=False)
            ids, of = array("H", e.ids).tobytes(), np.array(e.word_ids)
            ends = (np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1) * 2
            if len(ends) != len(part):
                rest.update(part)
                continue
            before = 0
            for i, end in zip(part, ends.tolist()):
                out[i] = ids[before:end]
                before = end
        left = sorted(rest)
        for i, ids in zip(left, self.whole([words[i] for i in left]) if left else ()):
            out[i] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after another, and the offsets of the rows (one more than rows)."""
        data, offsets = as_bytes(texts)
        n = len(offsets) - 1
        kind = _KIND[data]
        plain = self._plain(data, kind, offsets)
        of_row = np.repeat(np.arange(n), np.diff(offsets))
        # A word ends where the kind changes and at a text's end. White space is no word; for the byte vocabulary the space
        # before a word belongs to it.
        cut = np.ones(len(data) + 1, bool)
        if len(data):
            a, b = kind[:-1], kind[1:]
            cut[1:-1] = (a != b) & (a != _SPACE) if self.byte_level else (a != b) | (a == _DIGIT)
            cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keep = plain[of_row[starts]] if len(starts) else np.zeros(0, bool)
        if not self.byte_level and len(starts):
            keep &= (kind[starts] != _SPACE) & (kind[starts] != _BREAK)
        starts, ends = starts[keep], ends[keep]
        rows = of_row[starts] if len(starts) else np.zeros(0, np.int64)
        del of_row, cut, kind
        hashes = span_hashes(data, starts, ends)
        hashes[hashes == 0] = 1
        sizes, flat = self._ids_of(data, starts, ends, hashes)
        per_row = np.bincount(rows, weights=sizes, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
        strange = np.flatnonzero(~plain)
        special = self.whole(texts.take(pa.array(strange)).fill_null("").to_pylist()) if len(strange) else []
        for i, ids in zip(strange.tolist(), special):
            per_row[i] = len(ids) // 2
        out_offsets = np.concatenate([[0], np.cumsum(per_row)])
        ids = np.empty(int(out_offsets[-1]), np.uint16)
        if len(sizes):
            inside = np.cumsum(sizes) - sizes  # place among the ids of plain rows
            before = np.where(plain, 0, per_row)
            shift = (np.cumsum(before) - before)[rows]
            total = int(sizes.sum())
            step = np.arange(total) - np.repeat(inside, sizes)
            ids[np.arange(total) + np.repeat(shift, sizes)] = flat
        for i, x in zip(strange.tolist(), special):
            ids[out_offsets[i] : out_offsets[i + 1]] = np.frombuffer(x, "<u2")
        return ids, out_offsets

    def _ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them. Words are worked on in parts that an empty table can hold, even if all
        words of a part are new; all but very long texts are one part."""
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
        for at in range(0, len(hashes), SLOTS // 2):
            part = slice(at, at + SLOTS // 2)
            slot = self._known(data, starts[part], ends[part], hashes[part])
            n = self.lengths[slot].astype(np.int64)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            sizes.append(n)
            flat.append(self.pool[np.repeat(self.starts[slot].astype(np.int64), n) + step])
        return (sizes[1], flat[1]) if len(sizes) == 2 else (np.concatenate(sizes), np.concatenate(flat))

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slots of at most SLOTS / 2 words, of which new ones are encoded first."""
        slot = self._find(hashes)
        missing = np.flatnonzero(self.keys[slot] == 0)
        if not len(missing):
            return slot
        new, first = np.unique(hashes[missing], return_index=True)
        if 2 * (self.taken + len(new)) > SLOTS and self.taken:
            self._forget()
            new, first = np.unique(hashes, return_index=True)
            missing = np.arange(len(hashes))
        raw, at = data.tobytes(), missing[first]
        gc.disable()  # the lists below hold no cycles
        try:
            words = [raw[s:e].decode("utf-8") for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            self._learn(new, self._new(words))
        finally:
            gc.enable()
        return self._find(hashes)

    def _plain(self, data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows for which the places between words are sure."""
        n = len(offsets) - 1
        bad = kind == _STRANGE
        if len(data) > 1:
            bad[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
            if self.byte_level:
                blank = (kind == _SPACE) | (kind == _BREAK)
                bad[1:] |= blank[1:] & blank[:-1]
        rows = np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1
        out = np.ones(n, bool)
        out[rows] = False
        return out
