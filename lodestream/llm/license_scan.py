"""Licence scans: lines against licence templates, by the Dice coefficient over word bigrams.

A line is normalised (A-Z lowered; every other character than a-z, 0-9 is a space) to words
and compared to each template by 2 |A n B| / (|A| + |B|) over the sets of adjacent word
pairs. As |A n B| is at most the smaller set, a template is a candidate only if its size is
between t / (2 - t) and (2 - t) / t times the line's, for a threshold t; most lines have no
candidate left, or share no pair with any, before a coefficient is computed. Templates are
fixed and few, so they go out with the code; documents are read once and not shuffled.

A notice that is wrapped over lines or shares its line, and a whole licence, are found by windows
over the words of the whole text, line breaks ignored: as long as a template, from a pair that the
template has to the last such pair. Windows with too few such pairs, repeats included, are skipped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from pkgutil import get_data

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, map_texts

#: Notices by which public licences are named in documents.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Unauthorized copying of this work is prohibited."],
}
#: Standard headers; with the whole licences they are templates of windows only.
HEADERS: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
#: Licences whose whole text is a file in the folder licences.
WHOLE = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-3.0", "LGPL-3.0", "MIT", "MPL-2.0"]
_WORD = re.compile(r"[A-Za-z0-9]+")


def bigrams(line: str) -> frozenset[str]:
    words = " ".join(_WORD.findall(line)).lower().split()
    return frozenset(map(" ".join, zip(words, words[1:], strict=False)))


def words(text: str) -> list[str]:
    return " ".join(_WORD.findall(text)).lower().split()


def window_templates(templates: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(name, text) of what windows are compared to: given templates, or all that are known."""
    out = [(name, t) for name, texts in (templates or TEMPLATES).items() for t in texts]
    if templates is None:
        out += [(name, t) for name, texts in HEADERS.items() for t in texts]
        out += [(name, get_data(__package__, f"licences/{name}.txt").decode()) for name in WHOLE]
    return sorted(out)


def template_sets(templates: dict[str, list[str]] | None = None) -> list[tuple[str, frozenset[str]]]:
    return [(name, bigrams(t)) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts]


class Matcher:
    def __init__(self, templates: dict[str, list[str]] | None, threshold: float):
        self.sets = template_sets(templates)
        self.threshold = threshold
        self.holders: dict[str, list[int]] = {}
        for k, (_, pairs) in enumerate(self.sets):
            for pair in pairs:
                self.holders.setdefault(pair, []).append(k)
        sizes = [len(s) for _, s in self.sets]
        self.least, self.most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold

    def best(self, line: str) -> tuple[float, str] | None:
        """The template with the greatest coefficient that reaches the threshold; ties by name."""
        pairs = bigrams(line)
        n, t = len(pairs), self.threshold
        if not self.least <= n <= self.most:
            return None
        shared = Counter(k for pair in pairs.intersection(self.holders) for k in self.holders[pair])
        found = None
        for k, both in shared.items():
            name, other = self.sets[k]
            m = len(other)
            if t * m <= (2 - t) * n and t * n <= (2 - t) * m and 2 * both >= t * (n + m):
                one = (-2 * both / (n + m), name)
                found = one if found is None else min(found, one)
        return found and (-found[0], found[1])


class Windows:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold, split = threshold, [(name, words(t)) for name, t in templates]
        self.ids = {w: i for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        codes = [self.codes(ws) for _, ws in split]
        self.known = np.unique(np.concatenate(codes))
        self.templates = [(name, len(c), np.unique(c)) for (name, _), c in zip(split, codes, strict=True) if len(c)]

    def codes(self, ws: list[str]) -> np.ndarray:
        """A number for each adjacent pair, -1 for one with a word that no template has."""
        at = np.fromiter(map(self.ids.get, ws, repeat(-1)), np.int64, len(ws))
        return np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1] * len(self.ids) + at[1:], -1)

    def matches(self, ws: list[str]) -> list[tuple[int, float, str, int, int]]:
        """(shared pairs, coefficient, name, first word, word after the last) of all windows that reach the threshold."""
        codes, t, out = self.codes(ws), self.threshold, []
        at = np.flatnonzero(codes >= 0)
        at = at[self.known[np.minimum(np.searchsorted(self.known, codes[at]), len(self.known) - 1)] == codes[at]]
        if not len(at):
            return out
        for name, length, pairs in self.templates:
            m = len(pairs)
            if (2 - t) * len(at) < t * m:
                continue
            hits = at[pairs[np.minimum(np.searchsorted(pairs, codes[at]), m - 1)] == codes[at]]
            ends = np.searchsorted(hits, hits + length)
            for i in np.flatnonzero((2 - t) * (ends - np.arange(len(hits))) >= t * m).tolist():
                a, b = int(hits[i]), int(hits[ends[i] - 1]) + 1
                both = len(np.unique(codes[hits[i : ends[i]]]))
                if (2 - t) * both >= t * m:
                    n = len(set(zip(ws[a:b], ws[a + 1 : b + 1], strict=True)))
                    if 2 * both >= t * (n + m):
                        out.append((both, 2 * both / (n + m), name, a, b + 1))
        return out


def found_in(text: str, matcher: Matcher, windows: Windows) -> tuple[int, list[tuple[float, str]]]:
    """How many lines match or share a word with a matching window, and the matches. Of overlapping
    matches the one with more shared pairs stays, a line before a window; lines always stay."""
    lines = text.split("\n")
    split = [words(line) for line in lines]
    flat = [w for ws in split for w in ws]
    ahead = windows.matches(flat)
    alone = {i: m for i, line in enumerate(lines) if line and (m := matcher.best(line))}
    if not ahead:
        return len(alone), list(alone.values())
    edge = np.cumsum([0, *map(len, split)])
    rows = [(-both, 1, -dice, name, a, b) for both, dice, name, a, b in ahead]
    pairs = {i: set(zip(split[i], split[i][1:], strict=False)) for i in alone}
    rows += [(-max(len(pairs[i]), 1), 0, -dice, name, int(edge[i]), int(edge[i + 1])) for i, (dice, name) in alone.items()]
    taken, hit, out = np.zeros(len(flat), bool), set(alone), list(alone.values())
    for _, window, dice, name, a, b in sorted(rows):
        if not window:
            taken[a:b] = True
        elif not taken[a:b].any():
            taken[a:b] = True
            out.append((-dice, name))
            touched = np.searchsorted(edge, np.arange(a, b), side="right") - 1
            hit.update(touched.tolist())
    return len(hit), out


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_license_lines, licenses (distinct names in order, joined
    by a comma; empty if none), best_license and best_dice (of the best line or window; null if
    none). A line counts if it matches alone or has words of a window that does.

    Ties go to the name that sorts first. Null and empty texts have no lines. A document is
    scanned whole, line by line, so very long ones only take longer; rows repeated with one
    doc_id each get their row."""
    against = window_templates(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, windows = Matcher(templates, threshold), Windows(against, threshold)
        for batch in batches:
            n, names, best, dice = [], [], [], []
            for text in batch.column(1).to_pylist():
                lines, found = found_in(text or "", matcher, windows)
                n.append(lines)
                names.append(",".join(sorted({name for _, name in found})))
                top = min(((-d, name) for d, name in found), default=(None, None))
                best.append(top[1])
                dice.append(None if top[0] is None else -top[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(best, pa.string()), pa.array(dice, pa.float64())], ["doc_id", "n_license_lines", "licenses", "best_license", "best_dice"])

    return map_texts(columns(docs, "doc_id", "text"), run, "doc_id long, n_license_lines long, licenses string, best_license string, best_dice double")
