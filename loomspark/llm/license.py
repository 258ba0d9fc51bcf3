"""Licence scans by a trained paragraph classifier.

A sparse logistic regression over word 1- to 3-grams gives every paragraph (line) of every text a licence family or "none". It is
trained here, on notices drawn from ``NOTICES`` with words changed, dropped and surrounded by prose, and on prose without notices.
Its temperature is calibrated on held-out paragraphs, and a family must reach the probability that kept ``precision`` there; what
falls short of it without being "none" is of the class "unknown". A family that is predicted is confirmed by comparing the paragraph
with the family's notices (share of a notice's 3-grams that the paragraph holds); unconfirmed ones become unknown.

The model is small (its vocabulary is the n-grams of ``NOTICES`` and ``ORDINARY``) and goes to tasks with the function. A paragraph without
any word of the vocabulary has the bias alone to go by, which says "none".

A notice wrapped over lines is found in windows of at most ``WINDOW`` words over neighbouring lines, up to a blank line, judged and confirmed in the
same way; lines inside a found notice are not counted as unknown.

Defined results: a null or empty text has no paragraphs. n_paragraphs counts lines that are not blank; a text of any length is scanned whole.
Repeated rows give repeated rows; empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short public notices of each family.
NOTICES = {
    "Apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license."),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license.", "Licensed under the BSD 3-Clause License."),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released into the public domain under CC0 1.0 Universal.", "This work is dedicated to the public domain."),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GPL version 2 or later."),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the Software without restriction.", "Licensed under the MIT license."),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "Proprietary": ("All rights reserved.", "Copyright 2023 Example Corporation. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher."),
}
#: Longer public notices, as files carry them.
FULL_NOTICES = {
    "Apache": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",),
    "BSD": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "GPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see the licenses page of the GNU project."),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at the site of Mozilla.",),
    "CC0": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",),
}
NOTICES = {family: (*FULL_NOTICES.get(family, ()), *short) for family, short in NOTICES.items()}
#: Sentences with words of notices that are none.
ORDINARY = (
    "The driver showed his license to the officer at the public office.", "The band released a new record under the terms of the deal.", "All members of the union reserved the hall for the work.", "The general public may use the library free of charge.", "The version of events was published without permission.",
    "He was granted permission to copy the source of the poem.", "This work is about the rights of any person in the city.", "The Apache people lived in the south.", "MIT is a university near the river.", "Conditions in the mine were met with strikes.", "A mozilla is not a lizard, and creative people like the commons.",
    "Under the bridge the lesser road is for the public.", "See the notice for related rights and copyright law in the domain of music.", "The restaurant license was renewed in 2019 by the city council.", "You may redistribute the chairs if modification of the plan is permitted.",
)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
NONE, UNKNOWN = "none", "unknown"


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams_of(words: list[str], known: dict[str, int] | None = None) -> Iterator[str]:
    """1- to 3-grams; with ``known``, only those of known words."""
    n = len(words)
    for i in range(n):
        if known is not None and words[i] not in known:
            continue
        yield words[i]
        for k in (2, 3):
            if i + k <= n and (known is None or words[i + k - 1] in known):
                yield " ".join(words[i : i + k])


def _noise(r: random.Random) -> str:
    return "".join(r.choice("aeionrstlhdm") for _ in range(r.randint(2, 9)))


def training_set(seed: int = 3, each: int = 120) -> list[tuple[str, str]]:
    """(paragraph, family) pairs, drawn by rule."""
    r, out = random.Random(seed), []
    common = [w for s in ORDINARY for w in words_of(s)]
    for family, notices in NOTICES.items():
        for i in range(each):
            words = notices[i % len(notices)].split()
            if len(words) > 6 and r.random() < 0.5:
                del words[r.randrange(len(words))]
            if len(words) > 6 and r.random() < 0.3:
                words[r.randrange(len(words))] = _noise(r)
            before = [r.choice(common) if r.random() < 0.5 else _noise(r) for _ in range(r.choice((0, 0, 0, 3, 8)))]
            after = [r.choice(common) if r.random() < 0.5 else _noise(r) for _ in range(r.choice((0, 0, 0, 3, 8)))]
            out.append((" ".join([*before, *words, *after]), family))
    for _ in range(each * 10):
        k = r.random()
        if k < 0.3:
            words = r.choice(ORDINARY).split()
            if r.random() < 0.5:
                del words[r.randrange(len(words))]
        elif k < 0.6:
            words = [r.choice(common) for _ in range(r.randint(1, 30))]
        else:
            words = [r.choice(common) if r.random() < 0.3 else _noise(r) for _ in range(r.randint(1, 40))]
        out.append((" ".join(words), NONE))
    r.shuffle(out)
    return out


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: np.ndarray  # (features, classes)
    bias: np.ndarray
    temperature: float
    threshold: float

    def features(self, paragraph: str) -> np.ndarray:
        words = words_of(paragraph)
        return np.array(sorted({self.vocabulary[g] for g in grams_of(words, self.vocabulary) if g in self.vocabulary}), dtype=np.int64)

    def probabilities(self, at: np.ndarray) -> np.ndarray:
        z = (self.bias + (self.weights[at].sum(axis=0) / np.sqrt(len(at)) if len(at) else 0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def family(self, paragraph: str) -> tuple[str, float]:
        """(family, none or unknown; probability of the best class)."""
        at = self.features(paragraph)
        p = self.probabilities(at)
        best = int(p.argmax())
        name = self.classes[best]
        if name == NONE:
            return NONE, float(p[best])
        if p[best] < self.threshold or not confirmed(paragraph, name):
            return UNKNOWN, float(p[best])
        return name, float(p[best])


@cache
def _notice_grams(family: str) -> tuple[frozenset[str], ...]:
    return tuple(frozenset(" ".join(w[i : i + min(3, len(w))]) for i in range(max(1, len(w) - 2))) for w in map(words_of, NOTICES[family]))


def confirmed(paragraph: str, family: str, share: float = 0.5) -> bool:
    """Whether the paragraph holds at least ``share`` of the 3-grams of one of the family's notices."""
    w = words_of(paragraph)
    own = {" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1)} | set(w)
    return any(len(n & own) >= share * len(n) for n in _notice_grams(family))


def design(model: Model, data: list[tuple[str, str]]) -> np.ndarray:
    x = np.zeros((len(data), len(model.vocabulary)))
    for i, (text, _) in enumerate(data):
        at = model.features(text)
        x[i, at] = 1 / np.sqrt(max(1, len(at)))
    return x


def train(seed: int = 3, rounds: int = 400, rate: float = 2.0, decay: float = 1e-4, precision: float = 0.99) -> Model:
    """A model fitted to three quarters of the drawings; its temperature and threshold come from the rest."""
    data = training_set(seed)
    classes = (*NOTICES, NONE)
    grams = {g for text in (*[n for x in NOTICES.values() for n in x], *ORDINARY) for g in grams_of(words_of(text))}
    vocabulary = {g: i for i, g in enumerate(sorted(grams))}
    blank = Model(classes, vocabulary, np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes)), 1.0, 0.0)
    x, y, cut = design(blank, data), np.array([classes.index(f) for _, f in data]), len(data) * 3 // 4
    w, b, hot = blank.weights, blank.bias, np.eye(len(classes))[y[:cut]]
    for _ in range(rounds):
        z = x[:cut] @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w = w - rate * (x[:cut].T @ (p - hot) / cut * len(classes) / 2 + decay * w)
        b = b - rate * (p - hot).mean(axis=0)
    z, held = x[cut:] @ w + b, y[cut:]

    def soft(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    temperature = min((float(t) for t in np.geomspace(0.1, 4, 40)), key=lambda t: -np.log(soft(t)[np.arange(len(held)), held] + 1e-12).mean())
    p = soft(temperature)
    best, top = p.argmax(axis=1), p.max(axis=1)
    families = best != classes.index(NONE)
    threshold = 0.5
    for t in np.linspace(0.5, 0.95, 10):
        sure = families & (top >= t)
        if sure.any() and (best[sure] == held[sure]).mean() >= precision:
            threshold = float(t)
            break
    model = Model(classes, vocabulary, w, b, temperature, threshold)
    if classes[int(model.probabilities(np.zeros(0, np.int64)).argmax())] != NONE:
        raise ValueError("without any known word the model must say none")
    return model


SCHEMA = "doc_id long, n_paragraphs long, n_licences long, n_unknown long, families string, main_family string"


WINDOW = 64  # words


@cache
def _openings() -> frozenset[str]:
    return frozenset(g for family in NOTICES for n in _notice_grams(family) for g in n)


def share_held(words: list[str], family: str) -> float:
    """The greatest share of the 3-grams of one of the family's notices that the words hold."""
    own = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}
    return max(len(n & own) / len(n) for n in _notice_grams(family))


def notices_in(run: list[str], judged: list[str], model: Model, seen: dict[str, str]) -> tuple[list[str], int]:
    """run: neighbouring lines with words; judged: the family of each. (families of the notices, lines left unknown).

    Candidates are lines with a family, and windows over line ends, from a 3-gram of a notice to another at most WINDOW words on. Of
    candidates that overlap, the one that holds most of its notice stays, then the one over fewer lines, then the first.
    """
    words, line_of = [], []
    for i, line in enumerate(run):
        own = words_of(line)
        words += own
        line_of += [i] * len(own)
    known = _openings()
    hits = [i for i, g in enumerate(map(" ".join, zip(words, words[1:], words[2:], strict=False))) if g in known]
    bounds: dict[int, tuple[int, int]] = {}
    for i, at in enumerate(line_of):
        bounds[at] = (bounds.get(at, (i, i))[0], i + 1)
    found = []
    for at, family in enumerate(judged):
        if family not in (NONE, UNKNOWN):
            own = [h for h in hits if bounds[at][0] <= h and h + 3 <= bounds[at][1]]
            s, e = (own[0], own[-1] + 3) if own else bounds[at]
            found.append((-share_held(words[s:e], family), 0, s, e, family))
    for x, s in enumerate(hits):
        ends: dict[int, int] = {}
        for h in hits[x:]:
            if h + 3 - s > WINDOW:
                break
            if line_of[h + 2] > line_of[s]:
                ends[line_of[h + 2]] = h + 3
        for at, e in ends.items():
            window = " ".join(words[s:e])
            if window not in seen:
                seen[window] = model.family(window)[0]
            if seen[window] not in (NONE, UNKNOWN):
                found.append((-share_held(words[s:e], seen[window]), at - line_of[s], s, e, seen[window]))
    taken: list[tuple[int, int, str]] = []
    for _, _, s, e, family in sorted(found):
        if all(e <= s2 or e2 <= s for s2, e2, _ in taken):
            taken.append((s, e, family))
    inside = {line_of[i] for s, e, _ in taken for i in range(s, e)}
    return [f for _, _, f in taken], sum(f == UNKNOWN and i not in inside for i, f in enumerate(judged))


def scan(text: str, model: Model) -> tuple[int, int, int, str, str | None]:
    found: Counter[str] = Counter()
    paragraphs = unknown = 0
    seen: dict[str, str] = {}
    run: list[str] = []
    judged: list[str] = []
    for line in [*text.split("\n"), ""]:
        if line and not line.isspace():
            paragraphs += 1
            if line not in seen:
                seen[line] = model.family(line)[0] if any(w in model.vocabulary for w in words_of(line)) else NONE
            run.append(line)
            judged.append(seen[line])
        elif run:
            if len(run) == 1:
                families, n = [f for f in judged if f not in (NONE, UNKNOWN)], judged.count(UNKNOWN)
            else:
                families, n = notices_in(run, judged, model, seen)
            found.update(families)
            unknown += n
            run, judged = [], []
    main = min(found, key=lambda f: (-found[f], f)) if found else None
    return paragraphs, sum(found.values()), unknown, ",".join(sorted(found)), main


def licence_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows of SCHEMA, one for each input row."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for b in batches:
            columns = list(zip(*[scan(t.as_py(), model) for t in b.column(1)], strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
