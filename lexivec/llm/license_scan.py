"""Licence scanning with a trained paragraph classifier.

Paragraphs are the non-blank lines of a text. A multinomial logistic regression over sparse hashed word n-grams (one to three
words) tells licence families apart, with a class for what is no licence. It is trained on template sentences of each family,
varied by dropped, swapped and added words, against a bounded sample of the corpus' own lines (``NEGATIVES``), sentences
that speak of licences without granting one, and templates that are denied. Its probabilities are calibrated by a temperature and a lift of the unknown class fitted on templates
and lines that the scored model was not trained on (``FOLDS`` models, each without its part of them). A prediction counts when it is likely
enough and a template of that family confirms it: enough of the template's word pairs occur in the paragraph, and the paragraph has no word
more or less, there, that makes it another licence (``MARKS``, versions) or a denial (``DENIALS``); a bare name must be nearly all the paragraph says.
What no template can confirm is not scored: ``ANCHORS``, words derived from the templates such that
without one of them no template's pairs suffice, are looked for first. The rows are those that scoring everything would give.

Texts are often wrapped, so windows of consecutive non-blank lines, joined by a space, are classified, too: for each template the
least windows that hold enough of its pairs, widened by neighbouring lines that add some. A window counts over
the findings in its lines if it holds more of its template than they do of theirs.

A denial at the end of the line before a finding's first counts like one in its own line.

Defined cases: a null text is empty; a text without paragraphs has no findings; a paragraph that no template confirms is unknown;
very long texts are scanned whole; of equally likely families the first in order is taken, and of windows that hold as many pairs the shorter, then the
first; equal texts and repeated rows get equal findings; a null doc_id stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import full_text, hash_bound, short_batches

NEGATIVES, NEGATIVE_CHARS = 1000, 500_000
BUCKETS, STEPS, RATE, DECAY = 1 << 14, 50, 0.5, 1e-5
#: A prediction's least calibrated probability, and the least share of a template's word pairs.
LEAST_PROBABILITY, LEAST_SHARE = 0.5, 0.6
#: Parts of the templates and lines that are left out, in turn, to calibrate.
FOLDS = 4
UNKNOWN = "unknown"

#: Phrases by which texts name their licence.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "gpl-2.0-or-later": (
        "This work is licensed under the GNU General Public License, version 2 or any later version.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ),
    "lgpl-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
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
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "cc-by-nc-sa": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc-nd": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
    ),
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "Released under the zlib License.",
    ),
    "boost": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "all-rights-reserved": ("Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
}
#: Short identifiers of licences; ``License: id`` and ``SPDX-License-Identifier: id`` are templates.
IDENTIFIERS = {
    "mit": ("MIT",),
    "apache-2.0": ("Apache-2.0",),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "gpl-2.0": ("GPL-2.0-only", "GPL-2.0"),
    "gpl-2.0-or-later": ("GPL-2.0-or-later", "GPL-2.0+"),
    "gpl-3.0": ("GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0", "GPL-3.0+"),
    "agpl-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later"),
    "lgpl-3.0": ("LGPL-3.0-only", "LGPL-3.0-or-later"),
    "mpl-2.0": ("MPL-2.0",),
    "isc": ("ISC",),
    "cc-by": ("CC-BY-4.0",),
    "cc-by-sa": ("CC-BY-SA-4.0",),
    "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc-by-nd": ("CC-BY-ND-4.0",),
    "cc-by-nc-sa": ("CC-BY-NC-SA-4.0",),
    "cc-by-nc-nd": ("CC-BY-NC-ND-4.0",),
    "cc0": ("CC0-1.0",),
    "unlicense": ("Unlicense",),
    "epl-2.0": ("EPL-2.0",),
    "zlib": ("Zlib",),
    "boost": ("BSL-1.0",),
}
#: Names of licences. A paragraph says little more than one if that alone is to count.
NAMES = {
    "mit": ("MIT License",),
    "apache-2.0": ("Apache License 2.0",),
    "bsd": ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License"),
    "gpl-2.0": ("GNU General Public License version 2",),
    "gpl-3.0": ("GNU General Public License version 3",),
    "agpl-3.0": ("GNU Affero General Public License version 3",),
    "lgpl-3.0": ("GNU Lesser General Public License version 3",),
    "mpl-2.0": ("Mozilla Public License 2.0",),
    "isc": ("ISC License",),
    "epl-2.0": ("Eclipse Public License 2.0",),
    "zlib": ("zlib License",),
    "boost": ("Boost Software License 1.0",),
}
#: Words, or parts of words between hyphens, by which a licence differs from one that is named alike.
MARKS = {"affero": "agpl", "agpl": "agpl", "lesser": "lgpl", "lgpl": "lgpl", "later": "later", "noncommercial": "nc", "nc": "nc", "noderivatives": "nd", "noderivs": "nd", "nd": "nd", "sharealike": "sa", "sa": "sa"}
#: Words that deny a grant.
DENIALS = {"not", "no", "never", "cannot", "neither", "nor", "isn", "wasn", "aren", "weren", "longer"}
#: Versions of the GNU licences.
GNU_VERSIONS = {"1", "2", "2.1", "3"}
#: Words that a bare name may have beside it, words looked at before and after a template's place, and words between two of its pairs in one place.
MOST_BESIDE, BEFORE, AFTER, APART = 3, 6, 8, 6
#: Sentences about licences that grant none.
NO_GRANT = (
    "The driver's license was expired when the permission was refused.",
    "She renewed her fishing licence without a warranty of success.",
    "Copyright law differs from country to country.",
    "The manufacturer's warranty covers two years of use.",
    "They asked for permission to enter the building.",
    "He was licensed as a public notary in the state.",
    "The book is dedicated to my parents.",
    "The council redistributed the funds among the schools.",
    "The general public was told of the new version of the law.",
    "A lawyer explained what the words of a software license mean.",
    "The foundation published the terms of the grant in a later version of its report.",
    "Their work shows common attributes of creative people.",
)
TEMPLATES = {
    f: (*texts, *(t for i in IDENTIFIERS.get(f, ()) for t in (f"SPDX-License-Identifier: {i}", f"License: {i}") if t not in texts), *NAMES.get(f, ()))
    for f, texts in TEMPLATES.items()
}
FAMILIES = (UNKNOWN, *TEMPLATES)
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*\+?")
_BREAK = re.compile(r"[.!?;]\s+(?=[A-Z])")
_VERSION = re.compile(r"(?:[a-z]*v)?([0-9]+)((?:\.[0-9]+)*)\+?")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def features(words: list[str]) -> np.ndarray:
    grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return np.unique(np.array([zlib.crc32(g.encode()) % BUCKETS for g in grams], np.int64))


def pairs_of(words: list[str]) -> set[tuple[str, ...]]:
    return {*zip(words, words[1:])} or {tuple(words)}  # noqa: B905


@dataclass
class Model:
    weights: np.ndarray  # (buckets, families)
    bias: np.ndarray
    temperature: float

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        z = (self.bias + self.weights[found].sum(0) / np.sqrt(max(1, len(found)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def confirms(family: str, words: list[str]) -> float:
    """The largest share of a template's word pairs that the paragraph holds."""
    own = pairs_of(words)
    return max(len(own & t) / len(t) for t in _PAIRS[family])


_PAIRS = {f: [pairs_of(words_of(t)) for t in texts] for f, texts in TEMPLATES.items()}
_ALL = [(f, t) for f, own in _PAIRS.items() for t in own]
#: How many pairs of each template are enough, and the templates that hold a pair.
_ENOUGH = [next(n for n in range(1, len(t) + 1) if n / len(t) >= LEAST_SHARE) for _, t in _ALL]
_HOLDERS: dict[tuple[str, ...], list[int]] = {}
for _i, (_, _t) in enumerate(_ALL):
    for _p in _t:
        _HOLDERS.setdefault(_p, []).append(_i)


def _anchors() -> list[str]:
    """Words, long ones first, without any of which every template has too few pairs left."""
    left, chosen = [set(t) for _, t in _ALL], []
    for word in sorted({w for p in _HOLDERS for w in p}, key=lambda w: (-len(w), w)):
        hit = [i for i, t in enumerate(left) if len(t) >= _ENOUGH[i] and any(word in p for p in t)]
        if hit:
            chosen.append(word)
            left = [{p for p in t if word not in p} for t in left]
    return chosen


ANCHORS = _anchors()


def marks_of(words: list[str]) -> set[str]:
    """What of the words tells licences apart: marks, and versions without a last zero."""
    parts = [p for w in words for p in w.split("-")]
    found = {MARKS[p] for p in parts if p in MARKS} | {"later" for w in words if w.endswith("+") and _VERSION.fullmatch(w.split("-")[-1])}
    return found | {v[1] + (v[2] if v[2] != ".0" else "") for p in parts if (v := _VERSION.fullmatch(p))}


def _family_marks(family: str) -> tuple[set[str], set[str]]:
    """Marks that all templates of the family have, and those that none has and that make it another licence. A CC family has all versions."""
    each = [marks_of(words_of(t)) for t in TEMPLATES[family]]
    some, all_have = set.union(*each), set.intersection(*each)
    return all_have & {*MARKS.values()} if family.startswith("cc-by") else all_have, ({*MARKS.values()} | (GNU_VERSIONS if "gpl" in family else set())) - some


_MARKS = {f: _family_marks(f) for f in TEMPLATES}


def _place(words: list[str], template: set[tuple[str, ...]]) -> tuple[int, int]:
    """First and last word of the place that holds most of a template's pairs."""
    best, own, lo, last = (0, 0, 0), set(), 0, -APART
    for i, pair in enumerate(zip(words, words[1:])):  # noqa: B905
        if pair in template:
            if i - last > APART:
                own, lo = set(), i
            own.add(pair)
            last = i
            best = max(best, (len(own), -lo, i + 1))
    return -best[1], best[2]


def agrees(family: str, paragraph: str, before: str = "") -> bool:
    """Whether a template of the family that the paragraph holds isn't turned into another licence or denied by what stands with it.
    ``before`` ends where the paragraph begins."""
    sentences = [words_of(x) for x in _BREAK.split(f"{before} {paragraph}")]
    words = [w for own in sentences for w in own]
    number = [k for k, own in enumerate(sentences) for _ in own]
    skip = len(words_of(before))
    own = pairs_of(words[skip:])
    needed, refused = _MARKS[family]
    for text, template in zip(TEMPLATES[family], _PAIRS[family], strict=True):
        if len(own & template) < LEAST_SHARE * len(template):
            continue
        said = words_of(text)
        if text in NAMES.get(family, ()) and len(words) - skip > len(said) + MOST_BESIDE:
            continue
        lo, hi = _place(words[skip:], template)
        lo, hi = lo + skip, hi + skip
        near = [i for i in range(max(0, lo - BEFORE), min(len(words), hi + AFTER)) if number[lo] <= number[i] <= number[hi]]
        found = marks_of([words[i] for i in near if i >= skip])
        denied = {words[i] for i in near if i <= hi} & DENIALS - {*said}
        if needed <= found and not found & refused and not denied:
            return True
    return False


def classify(model: Model, paragraph: str, before: str = "") -> tuple[str, float]:
    """(family, calibrated probability); unknown unless likely and confirmed by a template. ``before`` is text that ends where the paragraph begins."""
    words = words_of(paragraph)
    p = model.probabilities(features(words))
    best = int(p.argmax())
    if best and p[best] >= LEAST_PROBABILITY and agrees(FAMILIES[best], paragraph, before):
        return FAMILIES[best], float(p[best])
    return UNKNOWN, float(p[0])


def _varied(text: str, filler: list[str], rng: np.random.Generator) -> list[str]:
    words = words_of(text)
    keep = [w for w in words if len(words) < 5 or marks_of([w]) or w in DENIALS or rng.random() > 0.06]
    if len(keep) > 3 and rng.random() < 0.2:
        i = int(rng.integers(len(keep) - 1))
        keep[i], keep[i + 1] = keep[i + 1], keep[i]
    pad = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, 8)))]
    return [*pad[: len(pad) // 2], *keep, *pad[len(pad) // 2 :]]


def _denied(text: str) -> str:
    return f"this is not {text}"


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(f) for f, _ in rows])
    return np.repeat(np.arange(len(rows)), sizes), np.concatenate([f for f, _ in rows]), np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes).astype(np.float32), np.array([k for _, k in rows])


def _logits(m: tuple, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    row, col, value, label = m
    starts = np.searchsorted(row, np.arange(len(label)))
    sums = np.add.reduceat(np.vstack([w[col] * value[:, None], np.zeros((1, w.shape[1]), np.float32)]), np.minimum(starts, len(row)))
    sums[np.bincount(row, minlength=len(label)) == 0] = 0
    return sums + b


def _regression(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; each family has the same weight in the loss, and what is no licence that of all families."""
    m, k = _matrix(rows), len(FAMILIES)
    used, inverse = np.unique(m[1], return_inverse=True)
    small = (m[0], inverse, m[2], m[3])
    w, b = np.zeros((len(used), k), np.float32), np.zeros(k, np.float32)
    g1, g2 = np.zeros_like(w), np.zeros_like(w)
    share = 1 / np.bincount(m[3], minlength=k).clip(1)
    share[0] *= k - 1
    weight = (share[m[3]] / share[m[3]].sum()).astype(np.float32)
    order = np.argsort(inverse, kind="stable")
    first = np.searchsorted(inverse[order], np.arange(len(used)))
    for step in range(1, STEPS + 1):
        d = _softmax(_logits(small, w, b))
        d[np.arange(len(d)), m[3]] -= 1
        d *= weight[:, None]
        g = np.add.reduceat((d[m[0]] * m[2][:, None])[order], first) + DECAY * w
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
        w -= RATE * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-8)
        b -= RATE * d.sum(0)
    full = np.zeros((BUCKETS, k), np.float32)
    full[used] = w
    return full, b


def train(lines: list[str], seed: int = 5) -> Model:
    """Fit on varied templates against denied ones and corpus lines without an anchor or a confirmed template; calibrate on what FOLDS further models didn't see."""
    rng = np.random.default_rng(seed)
    plain = [w for x in lines if (w := words_of(x)) and not any(confirms(f, w) >= LEAST_SHARE for f in TEMPLATES)]
    filler = [w for words in plain[:300] for w in words[:20]] or ["the", "of", "file", "see", "readme"]
    texts = [(t, k) for k, f in enumerate(FAMILIES) if k for t in TEMPLATES[f]] + [(t, 0) for t in NO_GRANT]

    def examples(own: list[tuple[str, int]], n: int, denied: int) -> list[tuple[np.ndarray, int]]:
        out = [(features(_varied(t, filler, rng)), k) for t, k in own for _ in range(n)]
        return out + [(features(_varied(_denied(t), filler, rng)), 0) for t, k in own if k for _ in range(denied)]

    negative = [(features(w), 0) for w in plain]
    w, b = _regression(examples(texts, 8, 2) + negative)
    unseen, labels = [], []
    for fold in range(FOLDS):
        seen = [x for i, x in enumerate(texts) if i % FOLDS != fold]
        held = examples([x for i, x in enumerate(texts) if i % FOLDS == fold], 2, 1) + negative[fold::FOLDS]
        part = _regression(examples(seen, 4, 1) + [x for i, x in enumerate(negative) if i % FOLDS != fold])
        m = _matrix(held)
        unseen.append(_logits(m, *part))
        labels.append(m[3])
    z, k = np.concatenate(unseen), np.concatenate(labels)
    best = (np.inf, 1.0, 0.0)
    for lift in np.arange(-2, 8.1, 0.5):
        raised = z + lift * (np.arange(len(FAMILIES)) == 0)
        for t in np.geomspace(0.05, 20, 41):
            loss = -np.log(_softmax(raised / t)[np.arange(len(z)), k].clip(1e-12)).mean()
            best = min(best, (float(loss), float(t), float(lift)))
    b[0] += best[2]
    return Model(w, b, best[1])


def fit(docs: DataFrame) -> Model:
    """Train against at most ``NEGATIVES`` different lines (their first NEGATIVE_CHARS // NEGATIVES characters) of a fixed random choice of as many documents."""
    drawn = docs.where(F.xxhash64("doc_id") <= hash_bound(NEGATIVES, docs.count()))
    line = F.explode(F.split(full_text(), "\n")).alias("line")
    lines = drawn.select(line).where(F.trim("line") != "").select(F.substring("line", 1, NEGATIVE_CHARS // NEGATIVES).alias("line")).distinct()
    rows = lines.orderBy(F.xxhash64("line"), "line").limit(NEGATIVES).collect()
    return train([r["line"] for r in rows])


def paragraphs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, paragraph) of every non-blank line, in code points."""
    at = 0
    for line in text.split("\n"):
        if line.strip():
            yield at, at + len(line), line
        at += len(line) + 1


def blocks(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """The paragraphs between blank lines."""
    block: list[tuple[int, int, str]] = []
    for p in paragraphs(text):
        if block and p[0] != block[-1][1] + 1:
            yield block
            block = []
        block.append(p)
    if block:
        yield block


def _windows(found: list[tuple[int, int, tuple]], enough: int) -> Iterator[tuple[int, int]]:
    """(first, last) lines of the least windows that hold ``enough`` different pairs of a template, each widened by
    neighbouring lines that add some. ``found`` has its pairs as (first line, last line, pair) in order."""
    held: dict[tuple, int] = {}
    lo, least = 0, []
    for hi, (_, last, pair) in enumerate(found):
        held[pair] = held.get(pair, 0) + 1
        while len(held) >= enough:
            first, _, old = found[lo]
            if least and least[-1][1] == last:
                least.pop()
            if not least or first > least[-1][0]:
                least.append((first, last))
            held[old] -= 1
            if not held[old]:
                del held[old]
            lo += 1
    at = [x[0] for x in found]
    for first, last in least:
        own = {p for a, b, p in found[bisect_left(at, first) : bisect_right(at, last)] if b <= last}
        while True:
            ahead = {p for a, b, p in found[bisect_left(at, last) : bisect_right(at, last + 1)] if b == last + 1} - own
            behind = {p for a, b, p in found[bisect_left(at, first - 1) : bisect_left(at, first)] if b <= last} - own
            if not ahead and not behind:
                break
            own |= ahead | behind
            last += bool(ahead)
            first -= bool(behind)
        yield first, last


def scan_block(model: Model, block: list[tuple[int, int, str]], known: dict[tuple[str, str], tuple[str, float]]) -> list[tuple[str, int, int, float]]:
    """(family, start, end, probability) of what is found in consecutive lines, by start."""
    words, line_of, ends = [], [], [0]
    for k, (_, _, line) in enumerate(block):
        own = words_of(line)
        words += own
        line_of += [k] * len(own)
        ends.append(len(words))
    seen: dict[int, list[tuple[int, int, tuple]]] = {}
    for i, pair in enumerate(zip(words, words[1:])):  # noqa: B905
        for t in _HOLDERS.get(pair, ()):
            seen.setdefault(t, []).append((line_of[i], line_of[i + 1], pair))
    spans = {w for t, x in seen.items() if len({p for _, _, p in x}) >= _ENOUGH[t] for w in _windows(x, _ENOUGH[t])}
    spans |= {(k, k) for a, b in spans for k in range(a, b + 1)}

    def said(a: int, b: int) -> tuple[str, float, int]:
        text = " ".join(line for _, _, line in block[a : b + 1])
        before = block[a - 1][2] if a and not DENIALS.isdisjoint(words[max(ends[a - 1], ends[a] - BEFORE) : ends[a]]) else ""
        if len(known) > 50_000:
            known.clear()
        if (text, before) not in known:
            known[text, before] = classify(model, text, before)
        family, p = known[text, before]
        own = pairs_of(words[ends[a] : ends[b + 1]])
        return family, p, max((len(own & t) for t in _PAIRS.get(family, ())), default=0)

    best = [(n, a, b, f, p) for a, b in spans for f, p, n in [said(a, b)] if f != UNKNOWN]
    taken, out = set(), []
    for _, a, b, family, p in sorted(best, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        lines = range(a, b + 1)
        if taken.isdisjoint(lines):
            taken.update(lines)
            out.append((family, block[a][0], block[b][1], p))
    return sorted(out, key=lambda x: x[1])


def scan_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_paragraphs, n_found, families, findings, probabilities): ``family:start:end`` of each found paragraph or window of lines,
    by start, and how likely each is (thousandths)."""
    short_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], tuple[str, float]] = {}
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                n, own = 0, []
                low = text.lower()
                live = [x for x in ANCHORS if x in low]
                for block in blocks(text) if live else ():
                    n += len(block)
                    low = "\n".join(line for _, _, line in block).lower()
                    if any(x in low for x in live):
                        own += scan_block(model, block, known)
                if not live:
                    n = sum(1 for _ in paragraphs(text))
                counts.append(n)
                found.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([",".join(sorted({f for f, *_ in x})) for x in found], pa.string()),
                    pa.array([",".join(f"{f}:{a}:{b}" for f, a, b, _ in x) for x in found], pa.string()),
                    pa.array([",".join(f"{p:.3f}" for *_, p in x) for x in found], pa.string()),
                ],
                names=["doc_id", "n_paragraphs", "n_found", "families", "findings", "probabilities"],
            )

    schema = "doc_id bigint, n_paragraphs bigint, n_found bigint, families string, findings string, probabilities string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), full_text().alias("text")).mapInArrow(scan, schema)
