"""License notices in texts by patience alignment with templates.

Tokens are lower-cased (A-Z) runs of letters and digits. Where two neighbouring tokens of a template stand in a text, the
stretch of the text in which the template would lie is aligned with it: words that are unique in both are anchors, the longest
increasing subsequence of anchors is kept, equal neighbours of anchors join them, and the gaps between anchors are aligned
the same way. The share of the template's tokens that are aligned is its coverage. Of overlapping notices the one with more
aligned tokens counts, of equal ones the shorter stretch.

NULL and empty texts hold no notice, repeated rows give repeated results, and a notice that stands several times is counted
each time. Other columns are not read.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import id_and_text, slices
from quarry.llm.tiling import token_hashes

COVERAGE = 0.85
#: Fixed texts: how licenses are named or granted.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "Licensed under the BSD 3-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["released under CC0 1.0 Universal.", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"],
}


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before[i] = piles[at - 1] if at else -1
        tops[at : at + 1] = [v]
        piles[at : at + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned places (text, template), both increasing."""
    out, work = [], [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {text[i]: i for i in range(a, b) if here[text[i]] == 1}
        anchors = [(place[template[j]], j) for j in range(c, d) if there[template[j]] == 1 and template[j] in place]
        if not anchors:
            continue
        kept = [anchors[i] for i in increasing([p for p, _ in anchors])]
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        work += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:]) if q > p + 1 and s > r + 1]
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, list[str]]):
        self.names = [name for name, own in texts.items() for _ in own]
        hashes, offsets = token_hashes(pa.array([t for own in texts.values() for t in own], pa.string()))
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes)
        self.tokens = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        size = len(self.vocabulary)
        for t, own in enumerate(self.tokens):
            for j in range(len(own) - 1):
                self.pairs.setdefault(own[j] * size + own[j + 1], []).append((t, j))
        self.pair_codes = np.array(sorted(self.pairs), np.int64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def coded(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers, -1 for words of no template."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.sieve[(hashes >> np.uint64(48)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[near] == hashes[at]
        out[at[same]] = near[same]
        return out

    def notices(self, tokens: np.ndarray, seeds: np.ndarray, coverage: float) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, aligned tokens, first token, end token) of a text; ``seeds`` are places of template pairs."""
        size, starts = len(self.vocabulary), {}
        for i in seeds.tolist():
            for t, j in self.pairs[int(tokens[i]) * size + int(tokens[i + 1])]:
                starts.setdefault(t, set()).add(i - j)
        found = set()
        for t, own in starts.items():
            template = self.tokens[t]
            n, slack, groups = len(template), len(template) // 4 + 2, []
            need, counts = coverage * n, Counter(template)
            for start in sorted(own):
                if groups and start - groups[-1][0] <= slack // 2:
                    groups[-1].append(start)
                else:
                    groups.append([start])
            for group in groups:
                # The wide window finds edited copies; where it reaches into copies before and after, the narrow ones do.
                windows = {(group[0] - slack, group[0] + n + slack), (group[0], group[-1] + n), *((start, start + n) for start in group)}
                for a, b in windows:
                    a, b = max(0, a), min(len(tokens), b)
                    here = tokens[a:b].tolist()
                    if sum(min(c, counts[w]) for w, c in Counter(here).items() if w in counts) < need:
                        continue  # no alignment can reach the coverage
                    pairs = align(here, template)
                    if len(pairs) >= need:
                        found.add((len(pairs), len(pairs) / n, a + pairs[0][0], a + pairs[-1][0] + 1, self.names[t]))
        out, taken = [], []
        for matched, share, a, b, name in sorted(found, key=lambda f: (-f[0], -f[1], f[3] - f[2], f[2], f[4])):
            if all(b <= s or e <= a for s, e in taken):
                taken.append((a, b))
                out.append((name, share, matched, a, b))
        return sorted(out, key=lambda f: f[3])


_ROW = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int32()), ("first_token", pa.int32()), ("end_token", pa.int32())])


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, n_matched, first_token, end_token), one row per notice."""

    def notices(batches):
        known = Templates(templates)
        size = len(known.vocabulary)
        for batch in batches:
            for rows in slices(batch):
                hashes, offsets = token_hashes(rows.column("text"))
                tokens = known.coded(hashes)
                pair = np.where((tokens[:-1] >= 0) & (tokens[1:] >= 0), tokens[:-1] * size + tokens[1:], -1)
                at = np.flatnonzero(np.isin(pair, known.pair_codes))
                row = np.searchsorted(offsets, at, side="right") - 1
                keep = at + 1 < offsets[row + 1]
                at, row = at[keep], row[keep]
                ids, out = rows.column("doc_id").to_pylist(), []
                edges = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
                for a, b in zip(edges, np.append(edges[1:], len(row))):
                    r = int(row[a])
                    own = tokens[offsets[r] : offsets[r + 1]]
                    out += [(ids[r], *n) for n in known.notices(own, at[a:b] - offsets[r], coverage)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROW)], schema=_ROW)

    return id_and_text(docs).mapInArrow(notices, "doc_id long, license string, coverage double, n_matched int, first_token int, end_token int")
