"""License scan: a paragraph classifier over word n-grams, with templates to confirm what it says.

A paragraph ends at a blank line, so that a notice which is wrapped over lines stands in one. It is covered by overlapping windows of a
bounded number of words, and each of its short lines is a window too. A sparse logistic regression over hashed words
and word pairs gives each window a probability per licence family and for "no licence". A window that is
probably a licence is given a family if the calibrated probability is high enough and a template of that
family shares enough word pairs with it; what is probably a licence and is given none is ``unknown``.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import map_texts

DIMS = 1 << 15
NONE, UNKNOWN = "none", "unknown"
#: Paragraphs of documents from which "no licence" is learned: at most so many documents, with up to so many characters.
SAMPLE, SAMPLE_CHARS = 300, 20_000
#: Share of a template's word pairs that a paragraph must have.
CONFIRM = 0.6
MEMORY = 400_000
#: Words of a window and from one window to the next: any WINDOW - STEP + 1 words (the longest template) stand in one.
WINDOW, STEP = 24, 8

#: Sentences and parts of them that state each licence family, of up to WINDOW - STEP + 1 words.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")",
                   "you may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted",
            "Redistributions of source code must retain the above copyright notice, this list of conditions",
            "Neither the name of the copyright holder nor the names of its contributors may be used",
            "Released under the BSD License.", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License",
            "This program is free software: you can redistribute it and/or modify",
            "it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-only"],
    "lgpl": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-3.0-only"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions",
            "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one", "SPDX-License-Identifier: MPL-2.0"],
    "public-domain": ["This work is released into the public domain.", "No rights reserved. CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
}
#: Licence notices of no family above, from which "unknown" is calibrated.
OTHER_NOTICES = ["All rights reserved. Unauthorised copying is prohibited.", "Licensed under the terms of the accompanying agreement.",
                 "This work is licensed under the Example Vendor License, version 7.", "Released under a custom license, see the file named above.",
                 "This software is proprietary and confidential."]

#: Everyday sentences, so that common words speak for no licence also where the sample is small.
PLAIN = ["The children ran home and nobody knew why.", "In the morning she read the paper and went to work with her friends.",
         "You may not have seen it, but this form of the file was there for years.", "He did not use the source of the river as it was too far away.",
         "We were permitted to leave at noon under the terms that they gave us.", "This is the second version of the story and it is free of mistakes.",
         "It was published by the foundation in the year of the flood.", "All of the software was on the public shelf in the general store.",
         "Any person with a copy of the book can be sure of the state of the world.", "The project of the city is subject to change and to the rights of others.",
         "Sie ging mit dem Hund in die Stadt und kam nicht vor dem Abend nach Hause.", "Das ist ein Werk von vielen und es ist nicht das letzte in der Reihe.",
         "Elle est dans la maison avec les enfants et le chien de la voisine.", "Il y a une version de cette histoire que tout le monde conna\u00eet.",
         "El trabajo de la semana es para los dos y no para uno solo.", "La obra se public\u00f3 en la ciudad y todos la vieron por la noche."]

_TABLE = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() or c == 10 else c + 32 if chr(c).isupper() else 32 for c in range(256))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return got


@dataclass
class Paragraph:
    words: list[bytes]
    lines: list[int]    # the first word of each line, and the number of words

    def windows(self) -> list[tuple[int, int]]:
        """Start and end of the windows: those that cover the paragraph, and its lines that are no longer than one."""
        own = [(a, b) for a, b in zip(self.lines, self.lines[1:]) if b - a <= WINDOW]
        return sorted({*spans(len(self.words)), *own})


def paragraphs(text: bytes | None) -> list[Paragraph]:
    """The paragraphs of the text that have a word; a line without one ends a paragraph."""
    out: list[Paragraph] = []
    words: list[bytes] = []
    lines = [0]
    for line in [*(text or b"").translate(_TABLE).split(b"\n"), b""]:
        own = line.split()
        if own:
            words += own
            lines.append(len(words))
        elif words:
            out.append(Paragraph(words, lines))
            words, lines = [], [0]
    return out


def spans(n: int) -> list[tuple[int, int]]:
    """Start and end of the windows that cover ``n`` words."""
    return [(0, n)] if n <= WINDOW else [*((at, at + WINDOW) for at in range(0, n - WINDOW, STEP)), (n - WINDOW, n)]


def hashed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimension of each word and of each pair of neighbours."""
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - DIMS.bit_length() + 1)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> shift, pair >> shift


@dataclass
class Sparse:
    """Rows of features (CSR): borders of the rows, dimensions, values."""

    borders: np.ndarray
    dims: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rows: list[list[bytes]], words: _Words) -> Sparse:
        """Hashed words and word pairs of each row, of which none is empty; counts over the root of their number."""
        dims, values = [], []
        for r in rows:
            at, n = np.unique(np.concatenate(hashed(np.array([words[w] for w in r], np.int64).view(np.uint64))).astype(np.int64), return_counts=True)
            dims.append(at)
            values.append(n / np.sqrt(n.sum()))
        return cls(np.cumsum([0, *map(len, dims)]), np.concatenate([np.empty(0, np.int64), *dims]), np.concatenate([np.empty(0), *values]))

    def rows(self, on: np.ndarray) -> Sparse:
        many = np.diff(self.borders)
        keep = np.repeat(on, many)
        return Sparse(np.concatenate(([0], np.cumsum(many[on]))), self.dims[keep], self.values[keep])

    def times(self, w: np.ndarray) -> np.ndarray:
        if len(self.borders) == 1:
            return np.zeros((0, w.shape[1]))
        return np.add.reduceat(self.values[:, None] * w[self.dims], self.borders[:-1])

    def transposed(self):
        """A function of a matrix with a row per row: the product of the transposed features with it, of DIMS rows."""
        order = np.argsort(self.dims, kind="stable")
        own, first = np.unique(self.dims[order], return_index=True)
        row = np.repeat(np.arange(len(self.borders) - 1), np.diff(self.borders))[order]
        values = self.values[order][:, None]

        def product(d: np.ndarray) -> np.ndarray:
            out = np.zeros((DIMS, d.shape[1]))
            if len(own):
                out[own] = np.add.reduceat(values * d[row], first)
            return out

        return product


@dataclass
class Classifier:
    names: list[str]        # NONE first
    weights: np.ndarray     # DIMS x names
    bias: np.ndarray
    temperature: float
    least: float            # smallest calibrated probability of a family
    doubt: float = 0.5      # a window is probably a licence below this probability of none

    def log_odds(self, parts: list[Paragraph], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of every window, its paragraph, first and last word (exclusive) in it."""
        h = np.array([words[w] for x in parts for w in x.words], np.int64).view(np.uint64)
        one, two = hashed(h)
        base = np.concatenate([[0], np.cumsum([len(x.words) for x in parts])]).astype(np.int64)
        at = [(i, a, b) for i, x in enumerate(parts) for a, b in x.windows()]
        of, start, end = np.array(at, np.int64).reshape(-1, 3).T
        a, b = base[of] + start, base[of] + end
        size = np.sqrt(2 * (b - a) - 1)
        z = np.empty((len(of), len(self.names)))
        for k in range(len(self.names)):
            w = self.weights[:, k]
            of_one, of_two = np.concatenate([[0], np.cumsum(w[one])]), np.concatenate([[0], np.cumsum(w[two])])
            z[:, k] = (of_one[b] - of_one[a] + of_two[b - 1] - of_two[a]) / size + self.bias[k]
        return z, of, start, end

    def probabilities(self, parts: list[Paragraph], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        z, of, start, end = self.log_odds(parts, words)
        return softmax(z / self.temperature), of, start, end


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _pairs(words: list[bytes]) -> set:
    return set(zip(words, words[1:])) or {(w,) for w in words}


def _matches(words: list[bytes], templates: list[tuple[int, set]], at: int) -> list[tuple[int, int, int]]:
    """(pairs found, start, end) of the best place in ``words`` (the first is number ``at``) of each template that is confirmed."""
    out, pairs = [], list(zip(words, words[1:])) or [(words[0],)]
    own = set(pairs)
    for size, known in templates:
        if len(own & known) >= CONFIRM * len(known):
            hit = np.concatenate([[0], np.cumsum([x in known for x in pairs])])
            reach = max(1, min(size - 1, len(pairs)))
            inside = hit[reach:] - hit[:-reach]
            s = int(inside.argmax())
            out.append((int(inside[s]), at + s, at + s + reach + 1))
    return out


def _apart(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, family) of the matches of a paragraph, in order; of those that overlap the one with the most pairs counts, so that a
    notice that one window cuts off is known by the window that has it whole."""
    kept: list[tuple[int, int, str]] = []
    for _, a, b, family in sorted(found, key=lambda x: (-x[0], x[1:])):
        if all(b <= c or d <= a for c, d, _ in kept):
            kept.append((a, b, family))
    return sorted(kept)


def _variants(rng: random.Random, notice: str, filler: list[list[bytes]], n: int) -> list[list[bytes]]:
    """The notice inside up to a window of other words, with a word left out now and then."""
    base = notice.encode().translate(_TABLE).split()
    out = [base]
    for _ in range(n):
        w = [x for x in base if rng.random() > 0.08] or base
        around = [x for _ in range(4) for x in rng.choice(filler)] if filler else []
        around = around[:rng.randrange(0, max(9, WINDOW - len(w) + 1))]
        cut = rng.choice((0, len(around), rng.randrange(0, len(around) + 1)))
        out.append(around[:cut] + w + around[cut:])
    return out


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Classifier:
    """Train on the templates and on windows of a bounded sample of ``docs`` without the words licence and license.

    The temperature comes from templates that a model of the other templates has not seen. An empty table is learned from as
    well: only the templates and a fixed filler count then.
    """
    n = max(1, docs.count())
    share = int(min(1.0, sample / n) * (1 << 20))
    usable = docs.filter((F.length(text) <= SAMPLE_CHARS) & F.col(key).isNotNull())
    # by the smallest hashes of key and text, so that the sample does not depend on the tasks
    got = usable.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share).select(F.col(text).alias("t"), F.xxhash64(key, text).alias("h")) \
        .orderBy("h", "t").limit(2 * sample).collect()
    cut = sorted(x.words[a:b] for r in got for x in paragraphs(r["t"].encode()) for a, b in x.windows())
    plain = [x for x in cut if not any(b"licen" in w or w in (b"reserved", b"copyright", b"spdx") for w in x)]
    rng = random.Random(5)
    plain = rng.sample(plain, min(len(plain), 2_000)) + [x.words for t in PLAIN for x in paragraphs(t.encode())]
    filler = list(plain)
    # also short lines and words said over and over, which windows of the sample seldom are
    for x in rng.sample(plain, min(len(plain), 400)):
        at = rng.randrange(len(x))
        plain += [x[at:at + rng.randrange(1, 5)], [x[at]] * rng.randrange(2, WINDOW + 1)]
    names = [NONE, *TEMPLATES]
    rows, labels, part = list(plain), [0] * len(plain), [i % 2 for i in range(len(plain))]
    for k, family in enumerate(TEMPLATES, 1):
        for i, notice in enumerate(TEMPLATES[family]):
            v = _variants(rng, notice, filler, 40)
            rows += v
            labels += [k] * len(v)
            part += [i % 2] * len(v)
    y, half = np.array(labels), np.array(part)
    held = np.array([rng.random() < 0.2 for _ in rows])
    words = _Words()
    x = Sparse.of(rows, words)
    w, b = _regress(x.rows(half == 0), y[half == 0], len(names))
    z = x.rows(half == 1).times(w) + b
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=lambda t: _loss(z / t, y[half == 1])) if (half == 1).any() else 1.0
    w, b = _regress(x.rows(~held), y[~held], len(names))
    model = Classifier(names, w, b, temperature, 0.0)
    # a family must be surer than 99 of 100 notices of no family, but no surer than 98 of 100 of its own
    other = Sparse.of([v for notice in OTHER_NOTICES for v in _variants(rng, notice, filler, 40)], words)
    strangers, own = (softmax((r.times(w) + b) / temperature)[:, 1:].max(1) for r in (other, x.rows(held & (y > 0))))
    model.least = float(min(np.quantile(strangers, 0.99), np.quantile(own, 0.02))) if len(own) else 0.5
    # of 200 held-out windows without a licence one may look like one
    calm = softmax((x.rows(held & (y == 0)).times(w) + b) / temperature)[:, 0]
    model.doubt = float(np.clip(np.quantile(calm, 0.005), 0.2, 0.5)) if len(calm) else 0.5
    return model


def _regress(x: Sparse, y: np.ndarray, k: int, steps: int = 150, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by full-batch Adagrad."""
    w, b = np.zeros((DIMS, k)), np.zeros(k)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    one, back = np.eye(k)[y], x.transposed()
    # the words around a notice stand in all families, so "none" (0) weighs as much as these together
    weight = (1 / np.bincount(y, minlength=k).clip(min=1) * np.where(np.arange(k) == 0, k - 1, 1))[y][:, None]
    weight /= weight.sum()
    for _ in range(steps):
        d = (softmax(x.times(w) + b) - one) * weight
        g, h = back(d) + l2 * w, d.sum(0)
        gw += g ** 2
        gb += h ** 2
        w -= rate * g / np.sqrt(gw)
        b -= rate * h / np.sqrt(gb)
    return w, b


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(1, keepdims=True)
    return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())


def scan(docs: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``license`` (the family of its first confirmed notice; ``unknown`` if it only has notices of no
    known family; null without any), ``licenses`` (all its families, sorted) with ``license_counts`` (notices of each), ``n_licensed`` and
    ``n_unknown`` (notices) and ``score`` (the largest calibrated probability of a licence over the windows).

    Every window of the whole text is scored. A null text and one without words have none: null, empty lists, 0, 0, 0.0. An input column
    named like an output is replaced; repeated rows are scanned each.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias, model.temperature, model.least, model.doubt, TEMPLATES))

    def make():
        names, weights, bias, temperature, least, doubt, templates = shared.value
        m, words = Classifier(names, weights, bias, temperature, least, doubt), _Words()
        known = {f: [(len(w), _pairs(w)) for w in (t.encode().translate(_TABLE).split() for t in ts)] for f, ts in templates.items()}

        def judge(t):
            parts = paragraphs(t)
            if not parts:
                return None, [], [], 0, 0, 0.0
            p, of, start, end = m.probabilities(parts, words)
            likely = np.flatnonzero(p[:, 0] < doubt)
            found: dict[int, list[tuple[int, int, int, str]]] = {}
            for i in likely.tolist():
                best = 1 + int(p[i, 1:].argmax())
                if p[i, best] >= least:
                    window = parts[of[i]].words[start[i]:end[i]]
                    found.setdefault(int(of[i]), []).extend((*x, names[best]) for x in _matches(window, known[names[best]], int(start[i])))
            sure = {q: _apart(x) for q, x in sorted(found.items()) if x}
            # windows without a confirmed notice; those that touch are one
            unsure, reach = 0, (-1, -1)
            for i in likely.tolist():
                q, a, b = int(of[i]), int(start[i]), int(end[i])
                if all(b <= c or d <= a for c, d, _ in sure.get(q, ())):
                    unsure += (q, a) > reach
                    reach = max(reach, (q, b))
            families = [f for x in sure.values() for _, _, f in x]
            distinct = sorted(set(families))
            return (families[0] if families else UNKNOWN if unsure else None, distinct, [families.count(f) for f in distinct], len(families), unsure,
                    float(1 - p[:, 0].min()))

        def work(texts, _):
            rows = [judge(t) for t in texts]
            return list(zip(*rows, strict=True)) if rows else [[]] * 6

        return work

    return map_texts(docs, make, {"license": "string", "licenses": "array<string>", "license_counts": "array<bigint>", "n_licensed": "bigint",
                                  "n_unknown": "bigint", "score": "double"}, text, keep)
