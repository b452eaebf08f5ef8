"""Licence scans: a trained paragraph classifier, confirmed against templates.

A text is read by lines and, where lines follow each other without a blank one, by stretches over
several lines, as notices are wrapped; comment signs before a line are no part of it. Lines and
stretches are bags of word 1- to 3-grams. A multinomial logistic regression over the grams that
the licence examples hold names a licence family or "unknown"; probabilities are calibrated by a
temperature on held-back examples, and a family below the calibrated confidence counts as unknown.
A named family stands only if enough of the word pairs of one of its templates are found.

Examples of licences are made from the templates (crops, dropped and changed words, ordinary words
around them); ordinary ones are all paragraphs of a bounded sample of documents.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Usual wordings of well-known licence notices, by family.
TEMPLATES = {
    "apache-2.0": (
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ),
    "mit": (
        "MIT License",
        "The MIT License (MIT)",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This software is available under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "gpl": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "bsd": (
        "BSD 3-Clause License",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "mpl-2.0": (
        "Mozilla Public License Version 2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Dedicated to the public domain under CC0.",
    ),
    "isc": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "No part of this publication may be reproduced without prior written permission.",
    ),
}
UNKNOWN = "unknown"
#: Words of a stretch, the steps in which a long line is read, and the words of an ordinary example.
STRETCH, STEP = 40, 20
#: A template of fewer words is a heading, which stands alone in a line of few words.
HEADING_WORDS, HEADING_LINE = 4, 8
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_LEADER = re.compile(r"^[\s/*#;%!<>\-\"']+|^\s*(?:rem|dnl)\s", re.I)


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def _grams(w: list[str]) -> list[str]:
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] + [f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:], strict=False)]


def _pairs(w: list[str]) -> set[tuple[str, str]]:
    return set(zip(w, w[1:], strict=False))


_TEMPLATE_PAIRS = {f: [(len(w), _pairs(w)) for w in map(words, texts)] for f, texts in TEMPLATES.items()}


@dataclass
class Model:
    families: list[str]
    grams: dict[str, int]
    weights: np.ndarray  # grams + 1 (bias) by families
    temperature: float
    confidence: float


def _features(model_grams: dict[str, int], w: list[str]) -> tuple[np.ndarray, float]:
    """Indices of known grams, and the value of each (all alike: length is scaled out)."""
    idx = [model_grams[g] for g in _grams(w) if g in model_grams]
    return np.array(sorted(set(idx)), np.int64), 1.0 / np.sqrt(max(1, len(w)))


def _examples(ordinary: list[str], rng: random.Random, each: int) -> list[tuple[list[str], str]]:
    pool = [w for p in ordinary for w in words(p)] or ["text"]
    out = []
    for family, texts in TEMPLATES.items():
        for k in range(each):
            w = words(texts[k % len(texts)])
            if k >= len(texts):
                if len(w) > 12 and rng.random() < 0.5:
                    n = rng.randint(8, len(w))
                    at = rng.randint(0, len(w) - n)
                    w = w[at : at + n]
                w = [x for x in w if rng.random() > 0.06] or w
                w = [rng.choice(pool) if rng.random() < 0.04 else x for x in w]
                w = [rng.choice(pool) for _ in range(rng.choice((0, 0, 1, 4)))] + w + [rng.choice(pool) for _ in range(rng.choice((0, 0, 1, 6)))]
            out.append((w, family))
        vocabulary = [x for t in texts for x in words(t)]
        for _ in range(each // 4):  # words of licences in no order are not a licence
            w = [rng.choice(vocabulary if rng.random() < 0.3 else pool) for _ in range(rng.randint(3, 30))]
            out.append((w, UNKNOWN))
    for p in ordinary:
        w = words(p)
        out += [(w[at : at + STRETCH], UNKNOWN) for at in range(0, len(w), STRETCH)]
    rng.shuffle(out)
    return out


class _Rows:
    """Sparse examples; those without a known gram only differ in their number."""

    def __init__(self, data: list[tuple[list[str], str]], grams: dict[str, int], label: dict[str, int]):
        bare: dict[int, int] = {}
        starts, col, val, y, n = [], [], [], [], []
        for w, family in data:
            idx, v = _features(grams, w)
            if not len(idx):
                bare[label[family]] = bare.get(label[family], 0) + 1
                continue
            starts.append(len(col))
            col += [*idx.tolist(), len(grams)]
            val += [v] * len(idx) + [1.0]
            y.append(label[family])
            n.append(1)
        for k, count in bare.items():
            starts.append(len(col))
            col.append(len(grams))
            val.append(1.0)
            y.append(k)
            n.append(count)
        self.starts, self.col, self.val, self.y = np.array(starts), np.array(col), np.array(val), np.array(y)
        self.n = np.array(n, float)
        self.row = np.repeat(np.arange(len(starts)), np.diff([*starts, len(col)]))
        self.by_col = np.argsort(self.col, kind="stable")
        self.cols, self.col_starts = np.unique(self.col[self.by_col], return_index=True)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.col] * self.val[:, None], self.starts)

    def gradient(self, weights: np.ndarray, error: np.ndarray) -> np.ndarray:
        out = np.zeros_like(weights)
        out[self.cols] = np.add.reduceat((error[self.row] * self.val[:, None])[self.by_col], self.col_starts)
        return out


def train(ordinary: list[str], seed: int = 5, each: int = 60, steps: int = 300) -> Model:
    """Gradient descent on sparse rows; a fifth of the examples calibrates."""
    rng = random.Random(seed)
    data = _examples(ordinary, rng, each)
    cut = len(data) // 5
    cal, fit = data[:cut], data[cut:]
    families = [*TEMPLATES, UNKNOWN]
    seen: dict[str, int] = {}
    for w, f in fit:
        if f != UNKNOWN:
            for g in set(_grams(w)):
                seen[g] = seen.get(g, 0) + 1
    grams = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 3))}
    label = {f: i for i, f in enumerate(families)}

    def soft(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    rows, held = _Rows(fit, grams, label), _Rows(cal, grams, label)
    # ordinary examples together count as much as all others, however many the sample has
    unknown = rows.y == label[UNKNOWN]
    share = np.where(unknown, rows.n / max(1.0, rows.n[unknown].sum()), rows.n / max(1.0, rows.n[~unknown].sum()))[:, None] / 2
    weights, speed = np.zeros((len(grams) + 1, len(families))), np.zeros((len(grams) + 1, len(families)))
    one = np.eye(len(families))[rows.y]
    for _ in range(steps):
        error = (soft(rows.logits(weights)) - one) * share
        speed = 0.9 * speed - 12.0 * (rows.gradient(weights, error) + 1e-6 * weights)
        weights += speed
    z, y = held.logits(weights), held.y
    loss = lambda t: -np.average(np.log(soft(z / t)[np.arange(len(y)), y] + 1e-12), weights=held.n)
    temperature = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    p = soft(z / temperature)
    guess, sure = p.argmax(axis=1), p.max(axis=1)
    # the least confidence at which at most 1 % of named families are wrong
    confidence = 0.5
    for c in np.arange(0.5, 0.96, 0.05):
        named = (guess != label[UNKNOWN]) & (sure >= c)
        confidence = float(c)
        if named.any() and np.average(guess[named] != y[named], weights=held.n[named]) <= 0.01:
            break
    return Model(families, grams, weights, float(temperature), confidence)


def template_likeness(w: list[str], family: str) -> float:
    """Best share of a template's word pairs found among the words."""
    have = _pairs(w)
    templates = (t for n, t in _TEMPLATE_PAIRS[family] if n >= HEADING_WORDS or len(w) <= HEADING_LINE)
    return max((len(t & have) / len(t) for t in templates), default=0.0)


Found = tuple[int, str, float, float]  # line, family, probability, likeness


class Scanner:
    def __init__(self, model: Model, likeness: float = 0.6):
        self.model, self.likeness = model, likeness
        self.after: dict[str, set[str]] = {}  # the words that follow a word in a licence
        for g in model.grams:
            if g.count(" ") == 1:
                a, b = g.split(" ")
                self.after.setdefault(a, set()).add(b)

    def text(self, text: str) -> list[Found]:
        """All notices of a text, by line."""
        out: list[Found] = []
        w: list[str] = []
        lines: list[tuple[int, int]] = []  # number and first word of each line of the paragraph
        for number, line in enumerate(text.split("\n")):
            if line.strip():
                lines.append((number, len(w)))
                w += words(_LEADER.sub("", line))
            elif w:
                out += self.paragraph(w, lines)
                w, lines = [], []
        return out + (self.paragraph(w, lines) if w else [])

    def paragraph(self, w: list[str], lines: list[tuple[int, int]]) -> list[Found]:
        """The notices in lines that follow each other; of those that overlap the likest."""
        none: set[str] = set()
        hits = [j for j, (a, b) in enumerate(zip(w, w[1:], strict=False)) if b in self.after.get(a, none)]
        if not hits:
            return []  # no word pair of any licence: the regression only has its bias for unknown
        ends = [start for _, start in lines[1:]] + [len(w)]
        spans = []  # line, from, to
        for (number, start), end in zip(lines, ends, strict=True):
            for at in range(start, max(start + 1, end - STEP), STEP):
                spans.append((number, at, min(at + STRETCH, end)))
            if end - start < STRETCH and end < len(w):  # on over the next lines
                spans.append((number, start, min(start + STRETCH, len(w))))
        found, h = [], 0
        for number, lo, hi in spans:
            while h < len(hits) and hits[h] < lo:
                h += 1
            if h < len(hits) and hits[h] + 1 < hi and (f := self.stretch(w[lo:hi])):
                found.append((f[2], f[1], -(hi - lo), -lo, lo, hi, number, f[0]))
        found.sort(reverse=True)
        taken: list[tuple[int, int]] = []
        out = []
        for like, p, _, _, lo, hi, number, family in found:
            if all(hi <= a or b <= lo for a, b in taken):
                taken.append((lo, hi))
                out.append((number, family, p, like))
        return sorted(out)

    def stretch(self, w: list[str]) -> tuple[str, float, float] | None:
        """Family, probability and template likeness, or None."""
        m = self.model
        idx, v = _features(m.grams, w)
        if not len(idx):
            return None
        z = (m.weights[idx].sum(axis=0) * v + m.weights[-1]) / m.temperature
        e = np.exp(z - z.max())
        p = e / e.sum()
        k = int(p.argmax())
        if m.families[k] == UNKNOWN or p[k] < m.confidence:
            return None
        like = template_likeness(w, m.families[k])
        return (m.families[k], float(p[k]), like) if like >= self.likeness else None


_scanners: dict[bytes, Scanner] = {}


def fit(docs: DataFrame, sample_rows: int = 400, longest_text: int = 1 << 16) -> bytes:
    """A pickled Model, trained in one task on a sample of some sample_rows documents.

    Texts of more than longest_text bytes aren't in the sample, so it is bounded.
    """
    n = docs.count()
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest_text)
    texts = texts.sample(min(1.0, sample_rows / max(n, 1)), seed=7)

    def learn(batches: Iterator[dict]) -> Iterator[dict]:
        ordinary = [p for b in batches for t in b["text"] for p in t.split("\n") if p.strip()]
        # paragraphs like a template are no examples of ordinary text
        plain = [p for p in ordinary if all(template_likeness(words(p), f) < 0.3 for f in TEMPLATES)]
        yield {"model": [pickle.dumps(train(plain))]}

    learned = map_batches(texts.repartition(1).sortWithinPartitions("text"), learn, "model binary").collect()
    return bytes(learned[0].model) if learned else pickle.dumps(train([]))  # no rows, no task


def scan(docs: DataFrame, **sample: int) -> DataFrame:
    """Per row: doc_id, licence (the surest family, 'none' without one), families (sorted),
    paragraphs (the lines where notices begin, from 0), probability and likeness of the surest.

    Trains on the templates and the paragraphs of a sample (see fit); scans all lines of all
    texts. A null or empty text has none; a null doc_id is kept; repeated rows stay repeated; ties
    go to the earlier line; an empty table gives an empty result; other columns are ignored.
    """
    model = fit(docs, **sample)

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        if model not in _scanners:
            _scanners.clear()
            _scanners[model] = Scanner(pickle.loads(model))
        read = _scanners[model].text
        for b in batches:
            out: dict = {k: [] for k in _FIELDS}
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                found = read(text or "")
                _, *top = max(found, key=lambda f: (f[3], f[2]), default=(0, "none", 0.0, 0.0))
                row = (doc, top[0], sorted({f[1] for f in found}), [f[0] for f in found], top[1], top[2])
                for k, v in zip(_FIELDS, row, strict=True):
                    out[k].append(v)
            yield out

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(columns, each, ", ".join(f"{k} {t}" for k, t in _FIELDS.items()))


_FIELDS = {
    "doc_id": "long", "licence": "string", "families": "array<string>", "paragraphs": "array<int>", "probability": "double",
    "likeness": "double",
}
