"""License scans: a trained paragraph classifier with an unknown class, confirmed by templates.

A paragraph is a line, or lines of a block without blank ones: up to `WINDOW` of them in a row, or the whole block. Of
paragraphs that share lines, that which shares most with a template counts, less a little for every further line; notices
of one family on lines that follow each other are one. Features are word one- and two-grams out of a vocabulary taken from the training paragraphs,
so a paragraph is a sparse vector. Multinomial logistic regression over the families and `unknown` is trained here, from
wordings of each family varied at random; unknown are notices of other licences, notices with an invented name, sentences
with the same words, and up to `SAMPLE` lines of the corpus. Its scale and the bias of `unknown` are calibrated on wordings
that the fit has not seen. A paragraph is a notice where its family's probability is high enough and a template of the
family, with the licence's name where the template has it, shares enough word pairs with it.

A paragraph without any word of the vocabulary that tells something has no features at all and is unknown by the
model's own constant; it is passed over before any arithmetic, with the same result.

Results for odd input: a null or empty text has no paragraphs and no notices; copies have the same notices; the first of
several equally likely families, by name, is taken; an empty table gives none; columns other than the two named are
ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm import shared, tokens

UNKNOWN = "unknown"
#: Probability of the family, and share of a template's word pairs, from which a paragraph counts as a notice.
LEAST_PROBABILITY, LEAST_SHARED = 0.5, 0.5
#: Lines of a block that may make a paragraph, and what each after the first must add to the share of a template.
WINDOW, PER_LINE = 8, 0.05
#: Paragraphs of the corpus that may be added as unknown ones in training, at most.
SAMPLE = 3000
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|\d+(?:\.\d+)*")
_COMMON = frozenset("a an and are as at be by do for from has have if in is it its may no not of on or other shall so such that the their there these they this to under was were will with you your".split())

#: Notices by family: short forms as they stand in files, and sentences of the licences. Each is one wording.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.", "This program is distributed under the terms of the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
        "You should have received a copy of the GNU Affero General Public License along with this program.", "This software is available under the AGPL v3.", "License: AGPL-3.0", "under the AGPLv3", "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license.", "You may obtain a copy of the Apache License at apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License", "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "License: Apache License 2.0", "The code is available under the terms of the Apache Software License.", "Apache-2.0 licensed.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license.", "License: BSD",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice in the documentation", "Distributed under the terms of the Modified BSD License.", "Licensed under the simplified BSD license.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Available under the Creative Commons Attribution License.", "Content is shared under CC-BY 3.0.", "Creative Commons Attribution", "Published under a Creative Commons Attribution licence, which permits unrestricted use.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Available for noncommercial use under the Creative Commons Attribution-NonCommercial License.", "Shared under CC BY-NC.", "Creative Commons Attribution-NonCommercial",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Content is shared under CC-BY-SA 3.0.", "Creative Commons Attribution-ShareAlike",
    ],
    "cc0": [
        "Released into the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights (CC0).", "SPDX-License-Identifier: CC0-1.0", "Licensed under CC0.", "Dedicated to the public domain by the CC0 1.0 dedication.", "License: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPL, version 2 or later.", "You should have received a copy of the GNU General Public License along with this program.", "Licensed under the GPLv3.", "This file may be distributed under the terms of the GNU GPL.", "License: GPL-3.0", "under the GPL", "under the GNU GPL v2", "Free software under the GNU General Public License.",
    ],
    "isc": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", "Licensed under the ISC license.", "License: ISC", "ISC licensed", "ISC License", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee (ISC)", "Available under the terms of the ISC License."],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.", "Released under the LGPL, version 3 or later.", "License: LGPL", "under the LGPL v2.1",
    ],
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish",
        "The above copyright notice and this permission notice shall be included in all copies", "SPDX-License-Identifier: MIT", "License: MIT", "This project is available under the terms of the MIT License.", "MIT licensed.", "Distributed under the MIT/X11 license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org", "Released under the MPL 2.0.", "under the MPL", "Distributed under the terms of the Mozilla Public License.",
    ],
    "reserved": [
        "Copyright 2020 Example Corporation. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "Proprietary and confidential. Unauthorised copying of this file is prohibited.", "This document contains confidential and proprietary information; do not distribute.", "All rights reserved.", "Confidential and proprietary.", "All rights reserved by the owner. Unauthorized use is prohibited.",
    ],
}

#: A template that has any of these words is shared only by a paragraph that has one of them too.
NAMES = {
    "agpl": {"affero", "agpl", "agplv"}, "apache": {"apache"}, "bsd": {"bsd", "bsd-style"}, "cc-by": {"cc", "cc-by", "commons"}, "cc-by-nc": {"by-nc", "cc-by-nc", "attribution-noncommercial", "noncommercial", "non-commercial"},
    "cc-by-sa": {"by-sa", "cc-by-sa", "attribution-sharealike", "sharealike"}, "cc0": {"cc0", "cc"}, "gpl": {"gpl", "gplv", "gnu"}, "isc": {"isc"}, "lgpl": {"lesser", "lgpl", "lgplv"}, "mit": {"mit"}, "mpl": {"mozilla", "mpl"}, "reserved": set(),
}

#: Notices of other licences: unknown ones.
FOREIGN = [
    "Distributed under the Eclipse Public License 2.0.", "This program is made available under the terms of the Eclipse Public License.", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Boost Software License, Version 1.0.", "Distributed under the Boost Software License.",
    "SPDX-License-Identifier: BSL-1.0", "Released under the zlib License.", "This software is provided as-is, without any express or implied warranty (zlib).", "SPDX-License-Identifier: Zlib", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense",
    "Licensed under the Artistic License 2.0.", "Licensed under the European Union Public Licence.", "Licensed under the Common Development and Distribution License.", "Licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Python Software Foundation License.", "Licensed under the Microsoft Public License.", "Made available under the Open Database License.",
    "Licensed under the Business Source License 1.1.", "Licensed under the Elastic License 2.0.", "Licensed under the Academic Free License version 3.0.", "Released under the Do What You Want Public License.", "Licensed under the Server Side Public License, version 1.", "Use is subject to the licence terms of the vendor.",
]

#: Sentences with the same words that aren't notices.
OTHERS = [
    "His driver license was renewed last week.", "The museum asked for permission to use the source of the photograph.", "The public library is open until six.",
    "Under the terms of the lease the tenant pays for repairs.", "Version 2.0 of the application was released in March.", "The software is distributed on two disks.",
    "An Apache helicopter flew over the public square.", "She was granted a fishing license by the state.", "The commons voted on the general budget.",
    "He studied at MIT and then worked for a software company.", "The author of the work waived the fee.", "Creative work needs time and attribution of credit where due.",
    "The conditions were met with some delay.", "A copy of the report was provided to any person who asked.", "The foundation published a free guide for new readers.",
    "The file is subject to change without notice.", "Licensing fees rose by three percent in 2020.", "They reserved a table for four; all seats were taken.",
    "The compound was released into the water.", "You may not use the lift in case of fire.", "Redistribution of wealth was the subject of the lecture.",
]


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower().replace("licence", "license"))


#: An unknown word before one of these is a feature of its own: the name of a licence that isn't known.
_HEADS = frozenset("license licence public general software".split())
NEW = "<new>"


def grams(found: list[str], known: frozenset | None = None) -> list[str]:
    """One-grams that tell something, and two-grams with at least one such word; with `known`, also a mark for a word that
    isn't known before one that names a licence."""
    out = [w for w in found if w not in _COMMON]
    pairs = list(zip(found, found[1:]))
    out += [f"{a} {b}" for a, b in pairs if a not in _COMMON or b not in _COMMON]
    if known is not None:
        out += [f"{NEW} {b}" for a, b in pairs if b in _HEADS and a not in known]
    return out


def invented(rng: random.Random) -> str:
    """A name that no licence has."""
    return "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))).capitalize()


def renamed(notice: str, family: str, rng: random.Random) -> str | None:
    """The notice with its licence's name replaced by an invented one, where it has a name."""
    names, made, hit = NAMES[family], invented(rng), False
    out = []
    for w in notice.split():
        if any(x in names for x in words(w)):
            hit = True
            w = made
        out.append(w)
    return " ".join(out) if hit and "SPDX" not in notice else None


_ALL_NAMES = frozenset().union(*NAMES.values())


def varied(notice: str, rng: random.Random) -> str:
    """A notice with words dropped, cut, moved into a sentence or set in capitals, as files have them; a licence's name,
    without which it would be no notice of that licence, stays."""
    w = notice.split()
    names = [not _ALL_NAMES.isdisjoint(words(x)) for x in w]
    if len(w) > 5:
        kept = [k for k, named in enumerate(names) if named or rng.random() > 0.08]
        if rng.random() < 0.3:
            a = rng.randrange(0, max(1, len(kept) // 4))
            part = kept[a:] if rng.random() < 0.5 else kept[: len(kept) - a]
            kept = part if sum(names[k] for k in part) == sum(names) else kept
        w = [w[k] for k in kept]
    if rng.random() < 0.25:
        w = ["#", *w] if rng.random() < 0.5 else ["*", *w, "*"]
    if rng.random() < 0.2:
        w = [*"Copyright 2021 The Authors.".split(), *w]
    text = " ".join(w)
    return text.upper() if rng.random() < 0.1 else text.lower() if rng.random() < 0.2 else text


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    known: frozenset
    telling: frozenset
    weights: np.ndarray  # (features, families)
    bias: np.ndarray
    scale: float
    templates: dict[str, list[tuple[frozenset, frozenset]]]  # (word pairs and words, name words)

    def probabilities(self, found: list[str]) -> np.ndarray:
        index = [self.vocabulary[g] for g in dict.fromkeys(grams(found, self.known)) if g in self.vocabulary]
        z = self.bias.copy()
        if index:
            z = z + self.weights[index].sum(axis=0) / np.sqrt(len(index))
        z = z * self.scale
        e = np.exp(z - z.max())
        return e / e.sum()

    def shared(self, family: str, found: list[str]) -> float:
        """The largest share of a template's word pairs and words that the paragraph has."""
        own, here = _pairs(found), set(found)
        return max((len(own & t) / len(t) for t, names in self.templates.get(family, ()) if t and (not names or names & here)), default=0.0)

    def notice(self, paragraph: str, shortcut: bool = True) -> tuple[str, float, float] | None:
        """(family, probability, shared) of a paragraph that is a notice."""
        return self.judged(words(paragraph), shortcut)

    def judged(self, found: list[str], shortcut: bool = True) -> tuple[str, float, float] | None:
        """As `notice`, of the paragraph's words."""
        if shortcut and self.telling.isdisjoint(found):
            return None
        p = self.probabilities(found)
        k = int(p.argmax())
        family = self.families[k]
        if family == UNKNOWN or p[k] < LEAST_PROBABILITY:
            return None
        shared_ = self.shared(family, found)
        return (family, float(p[k]), shared_) if shared_ >= LEAST_SHARED else None


def _pairs(found: list[str]) -> frozenset:
    return frozenset(zip(found, found[1:])) | frozenset((w,) for w in found if w not in _COMMON)


def _templates() -> dict[str, list[tuple[frozenset, frozenset]]]:
    return {f: [(_pairs(words(t)), frozenset(NAMES[f] & set(words(t)))) for t in ts] for f, ts in TEMPLATES.items()}


def is_like_a_template(paragraph: str) -> bool:
    """Whether half of any template is in the paragraph: such a one isn't taken as an example of an unknown paragraph."""
    own = _pairs(words(paragraph))
    return any(len(own & t) / len(t) >= LEAST_SHARED for ts in _templates().values() for t, _ in ts)


def _fit(x: np.ndarray, y: np.ndarray, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression, every class weighing the same, by gradient steps with momentum."""
    target = np.eye(n, dtype=np.float32)[y]
    weight = np.float32(1) / np.maximum(np.bincount(y, minlength=n), 1)[y].astype(np.float32)
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((x.shape[1], n), dtype=np.float32), np.zeros(n, dtype=np.float32)
    velocity_w, velocity_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = weight * (p - target)
        velocity_w = 0.9 * velocity_w - 8 * (x.T @ g + 1e-5 * w)
        velocity_b = 0.9 * velocity_b - 8 * g.sum(axis=0)
        w, b = w + velocity_w, b + velocity_b
    return w, b


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(y)), y]).mean())


def trained(others: list[str] = (), seed: int = 4, copies: int = 14, rounds: int = 200, folds: int = 3) -> Model:
    """Fit and calibrate. `others`: further paragraphs that aren't notices, at most `SAMPLE` of them.

    Wordings are dealt to `folds`; each fold's are judged by a model that has seen none of them, and the scale and the
    unknown class's bias that suit those judgements best are the final model's, which is fitted to all.
    """
    rng = random.Random(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    rows: list[tuple[str, int, int]] = []  # text, class, fold
    last = len(families) - 1
    for k, family in enumerate(families[:-1]):
        for i, notice in enumerate(TEMPLATES[family]):
            for c in range(copies):
                rows.append((notice if not c else varied(notice, rng), k, i % folds))
            for _ in range(3):
                if made := renamed(notice, family, rng):
                    rows.append((made, last, i % folds))
    for i, sentence in enumerate([*OTHERS, *FOREIGN]):
        for c in range(4):
            rows.append((sentence if not c else varied(sentence, rng), last, i % folds))
        rows.append(("", last, i % folds))  # nothing that tells is unknown too
    for i, sentence in enumerate(sorted(others)[:SAMPLE]):
        rows.append((sentence, last, i % folds))
    found = [words(t) for t, _, _ in rows]
    known = frozenset(w for s in [*OTHERS, *FOREIGN, *(t for ts in TEMPLATES.values() for t in ts)] for w in words(s))
    names = sorted({g for s in [*OTHERS, *FOREIGN, *(t for ts in TEMPLATES.values() for t in ts)] for g in grams(words(s))} | {f"{NEW} {h}" for h in _HEADS})
    vocabulary = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), dtype=np.float32)
    for i, f in enumerate(found):
        index = [vocabulary[g] for g in dict.fromkeys(grams(f, known)) if g in vocabulary]
        if index:
            x[i, index] = 1 / np.sqrt(len(index))
    y, fold = np.array([k for _, k, _ in rows]), np.array([f for _, _, f in rows])
    unseen = np.zeros((len(rows), len(families)), dtype=np.float32)
    for k in range(folds):
        w, b = _fit(x[fold != k], y[fold != k], len(families), rounds)
        unseen[fold == k] = x[fold == k] @ w + b
    best = (np.inf, 1.0, 0.0)
    for scale in np.linspace(0.4, 3, 14):
        for more in np.linspace(-2, 4, 13):
            z = unseen.copy()
            z[:, -1] += more
            best = min(best, (_loss(z * scale, y), float(scale), float(more)))
    w, b = _fit(x, y, len(families), rounds)
    b[-1] += best[2]
    telling = frozenset(g for g in names if " " not in g) | frozenset(p for g in names for p in g.split() if p not in _COMMON and p != NEW)
    return Model(families, vocabulary, known, telling, w, b, best[1], _templates())


_models: dict[int, Model] = {}


def default_model() -> Model:
    """The model trained from the notices above alone: the same on every worker."""
    if 0 not in _models:
        _models[0] = trained()
    return _models[0]


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model trained with up to `sample` lines of the corpus that have words of licences and aren't like any template,
    those of least hash; each line counts once, and only lines of up to 400 characters are taken."""
    told = r"(?i)\b(?:licen[cs]e|licensed|copyright|permission|permitted|redistribut|public domain|free software|source code|reserved|warrant)"
    lines = shared.id_text(docs).where(F.col("text").rlike(told)).select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.col("line").rlike(told) & (F.length("line") <= 400))
    rows = lines.distinct().orderBy(F.xxhash64("line"), "line").limit(sample).collect()
    return trained([r.line for r in rows if not is_like_a_template(r.line)])


NOTICE = "struct<paragraph:int,start:int,end:int,family:string,probability:double,shared:double>"


def _paragraphs(found: list[list[str]], told: list[bool]) -> list[tuple[int, int]]:
    """Ranges of a block's lines that may be a notice: they begin and end with a telling line. Marks of comments are no
    words, so they need no removal."""
    at = [k for k, t in enumerate(told) if t]
    out = [(a, b + 1) for k, a in enumerate(at) for b in at[k : k + WINDOW] if b < a + WINDOW]
    return [*out, (at[0], at[-1] + 1)] if at and at[-1] - at[0] >= WINDOW else out


def notices(text: str, model: Model) -> list[dict]:
    lines = text.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    found = [words(line) for line in lines]
    told = [not model.telling.isdisjoint(w) for w in found]
    if not any(told):
        return []
    out, first = [], 0
    for last in [*(k for k, line in enumerate(lines) if not line.strip()), len(lines)]:
        ranked = []
        for a, b in _paragraphs(found[first:last], told[first:last]):
            if got := model.judged([w for f in found[first + a : first + b] for w in f]):
                ranked.append((got[2] - PER_LINE * min(b - a - 1, WINDOW), -(b - a), -a, first + a, first + b, got))
        used: set[int] = set()
        chosen: list[tuple[int, int, tuple[str, float, float]]] = []
        for *_, a, b, got in sorted(ranked, key=lambda r: r[:3], reverse=True):
            if used.isdisjoint(range(a, b)):
                used.update(range(a, b))
                chosen.append((a, b, got))
        joined: list[tuple[int, int, tuple[str, float, float]]] = []
        for a, b, got in sorted(chosen):
            if joined and joined[-1][1] == a and joined[-1][2][0] == got[0]:  # a licence's sentences, one after another
                before = joined.pop()
                a, got = before[0], (got[0], max(got[1], before[2][1]), max(got[2], before[2][2]))
            joined.append((a, b, got))
        for a, b, got in joined:
            out.append({"paragraph": a, "start": starts[a], "end": starts[b - 1] + len(lines[b - 1]), "family": got[0], "probability": round(got[1], 6), "shared": round(got[2], 6)})
        first = last + 1
    return sorted(out, key=lambda n: n["start"])


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and the notices of every row, in order."""
    known = docs.sparkSession.sparkContext.broadcast(model or fitted(docs))

    def rows(batches):
        import pyarrow as pa

        kind = pa.struct([("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("shared", pa.float64())])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in tokens.in_bytes(texts, 1 << 22):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([notices(t, known.value) for t in texts[a:b]], pa.list_(kind))], names=["doc_id", "notices"])

    return shared.id_text(docs).mapInArrow(rows, f"doc_id long, notices array<{NOTICE}>")
