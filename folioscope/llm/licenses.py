"""Licence scans: a trained paragraph classifier, an unknown class, and confirmation by templates.

A paragraph is a line of a text, or neighbouring lines without a blank one between them, up to the line that reaches
RUN_WORDS words, since notices are often wrapped, however short their lines; of overlapping ones the one nearest to a
template counts. A multinomial logistic regression over sparse word 1- and 2-grams tells the licence families, licences
of no listed family ("unknown") and "none" apart. It is trained here: on the templates and the unlisted notices below with words
dropped, replaced and put in other text; on at most PARAGRAPHS different lines of the corpus, chosen by hash, that share
no word with a licence; and on short pieces of the notices put in such text, as where prose speaks of licences, which are
"none" too. Held-back examples calibrate the least probability that a family needs, and the least probability of any
licence that an unknown one needs. The classifier sees every paragraph with a sign of a licence: a long word or a word pair of
any notice it was trained with. Templates only confirm: a predicted family stands if the paragraph has at least OVERLAP of the
word pairs of one of its templates, or SHORT_OVERLAP where a template has fewer than SHORT_PAIRS, and at least half of the
template's pairs that no other family has. What is likelier a licence than none but is below its family's threshold,
not confirmed, or of no listed family is "unknown". A licence none of whose words stands in a notice here is not seen.

Defined results: null, empty and licence-free texts have family null, 0 paragraphs, confidence and overlap 0;
a document's family is that of its most confident confirmed paragraph, the earlier at ties; without one it is
that of its most probable unknown paragraph, whose probability is that of any licence; very long texts are
scanned whole; repeated rows each get a result; null doc_ids are passed through; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import load
from folioscope.llm.decontaminate import words_of

#: Corpus lines that training takes at most, and the longest that it takes.
PARAGRAPHS = 6000
LONGEST = 2000
EXAMPLES = 60
OVERLAP = 0.6
SHORT_OVERLAP, SHORT_PAIRS = 0.8, 8
RUN_WORDS = 90
MARK = 6
#: Shares of held-back examples of other classes that may reach a family's threshold, and that of "unknown".
FALSE_RATE = 0.002
UNKNOWN_RATE = 0.12
SEED = 11
EPOCHS = 60

#: Notices by which licences are commonly declared.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["Copyright. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher."],
}
#: Notices of licences that are of no family above, and how licences of any name are declared ({} stands for the
#: name); they are what the unknown class is trained with.
UNLISTED = [
    "Licensed under the {} License.",
    "Licensed under the {} Public License, version 2.0.",
    "This software is released under the {} license.",
    "This work is distributed under the terms of the {} License as published by {}.",
    "You may use this file under the terms of the {} licence.",
    "Use of this source code is governed by a {} license that can be found in the LICENSE file.",
    "SPDX-License-Identifier: {}",
    "Permission is granted to copy, distribute and modify this document under the terms of the {} License.",
    "Redistribution and use are permitted under the {} terms.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "Licensed under the Artistic License 2.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Licensed under the EUPL, Version 1.2.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This license governs use of the accompanying software. If you use the software, you accept this license.",
]
NONE = "none"
UNKNOWN = "unknown"


def notices() -> list[list[bytes]]:
    return [words_of(t.replace("{}", "")) for t in [x for ts in TEMPLATES.values() for x in ts] + UNLISTED]


def named(notice: str, filler: list[bytes], rng: random.Random) -> list[bytes]:
    """The words of a notice, with a few words for each name that it leaves open."""
    parts = [words_of(x) for x in notice.split("{}")]
    return [w for i, p in enumerate(parts) for w in ([*rng.choices(filler, k=rng.randrange(1, 4)), *p] if i else p)]


def marks() -> frozenset[bytes]:
    """The long words of the notices."""
    return frozenset(w for t in notices() for w in t if len(w) >= MARK)


def grams(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [(w,) for w in words] + list(zip(words, words[1:], strict=False))


def variants(words: list[bytes], filler: list[bytes], rng: random.Random, n: int) -> list[list[bytes]]:
    """The words as they are, and with some dropped or replaced, and filler around them."""
    out = [words]
    while len(out) < n:
        kept = [rng.choice(filler) if (r := rng.random()) < 0.04 else w for w in words if (rng.random() > 0.04) or not filler] if filler else words
        before, after = rng.randrange(8), rng.randrange(8)
        out.append([*rng.choices(filler, k=before), *kept, *rng.choices(filler, k=after)] if filler else kept)
    return out


def mentions(words: list[bytes], other: list[bytes], filler: list[bytes], rng: random.Random, n: int) -> list[list[bytes]]:
    """Text with a piece of each of two notices, at most a third of their words: prose that speaks of licences."""
    out = []
    for _ in range(n):
        text = rng.choices(filler, k=rng.randrange(1, 6))
        for notice in (words, other):
            size = rng.randrange(1, max(2, len(notice) // 3) + 1)
            at = rng.randrange(max(1, len(notice) - size + 1))
            text += notice[at : at + size] + rng.choices(filler, k=rng.randrange(1, 6))
        out.append(text)
    return out


class LicenceModel:
    """Weights of grams by family, the least probability of each family, and the templates' word pairs."""

    def __init__(self, weights: dict, families: list[str], least: np.ndarray):
        self.weights, self.families, self.least = weights, families, least
        self.pairs = {f: [frozenset(zip(w, w[1:], strict=False)) for w in map(words_of, TEMPLATES[f])] for f in families if f in TEMPLATES}
        self.listed = list(self.pairs)
        self.signs = marks() | frozenset(p for w in notices() for p in zip(w, w[1:], strict=False))
        self.all_pairs = frozenset().union(*[p for ps in self.pairs.values() for p in ps])
        shared = {f: frozenset().union(*[p for g, ps in self.pairs.items() if g != f for p in ps]) for f in self.pairs}
        self.own_pairs = {f: [t - shared[f] for t in ts] for f, ts in self.pairs.items()}

    def __reduce__(self):
        return LicenceModel, (self.weights, self.families, self.least)

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        z = np.zeros(len(self.families)) + self.weights[()]
        for g in set(grams(words)):
            if g in self.weights:
                z = z + self.weights[g]
        z = np.exp(z - z.max())
        return z / z.sum()

    def overlap(self, hits: set, families: list[str]) -> float:
        """The largest share of a template's word pairs that is among the pairs, over the families' templates."""
        return max(len(hits & t) / len(t) for f in families for t in self.pairs[f])

    def confirms(self, hits: set, families: list[str]) -> bool:
        """Whether the pairs hold enough of a template of one of the families, and of what sets it apart."""
        return any(
            len(hits & t) >= (OVERLAP if len(t) >= SHORT_PAIRS else SHORT_OVERLAP) * len(t) and 2 * len(hits & own) >= len(own)
            for f in families
            for t, own in zip(self.pairs[f], self.own_pairs[f], strict=True)
        )

    def paragraph(self, words: list[bytes]) -> tuple[str, float, float] | None:
        """(family, probability, overlap) of a confirmed paragraph."""
        own = self.all_pairs.intersection(zip(words, words[1:], strict=False))
        if not own:
            return None
        p = self.probabilities(words)
        k = int(p.argmax())
        family = self.families[k]
        if family not in self.pairs or p[k] < self.least[k]:
            return None
        return (family, float(p[k]), self.overlap(own, [family])) if self.confirms(own, [family]) else None

    def confirmed(self, lines: list[list[bytes]], hits: list[set]) -> list[tuple[int, int, tuple]]:
        """(first line, last line, result) of confirmed paragraphs that share no line.

        hits has the template pairs that start in each line, those across to the next line too. A run goes before
        others that it overlaps if its templates' overlap is larger, or equal and the run shorter, or earlier.
        """
        runs = []
        for i in range(len(lines)):
            own, joined = set(), []
            for j in range(i, len(lines) if hits[i] else i):
                if not lines[j] or len(joined) >= RUN_WORDS:
                    break
                own |= hits[j]
                joined += lines[j]
                new = hits[j] or (j > i and hits[j - 1])
                if new and self.confirms(own, self.listed) and (r := self.paragraph(joined)):
                    runs.append((-r[2], j - i, i, r))
        found, taken = [], set()
        for _, more, i, r in sorted(runs):
            if taken.isdisjoint(range(i, i + more + 1)):
                taken.update(range(i, i + more + 1))
                found.append((i, i + more, r))
        return found

    def signed(self, words: list[bytes]) -> bool:
        """Whether the paragraph has a sign of any licence."""
        return not (self.signs.isdisjoint(words) and self.signs.isdisjoint(zip(words, words[1:], strict=False)))

    def unknown(self, words: list[bytes]) -> tuple[str, float, float] | None:
        """(UNKNOWN, probability of any licence, largest overlap) of a paragraph that is likelier a licence than none."""
        p = 1 - float(self.probabilities(words)[0]) if self.signed(words) else 0.0
        own = self.all_pairs.intersection(zip(words, words[1:], strict=False))
        return (UNKNOWN, p, self.overlap(own, self.listed)) if p > self.least[0] else None

    def unconfirmed(self, lines: list[list[bytes]], signs: list[bool], taken: set[int]) -> list[tuple[int, tuple]]:
        """(line, result) of unknown paragraphs: neighbouring lines outside ``taken`` with signs of a licence, RUN_WORDS
        words at most before the last, of which one or all together are likelier a licence than none."""
        found, i = [], 0
        while i < len(lines):
            j, size = i, 0
            while j < len(lines) and size < RUN_WORDS and j not in taken and lines[j] and (signs[j] or (j > i and signs[j - 1])):
                size += len(lines[j])
                j += 1
            each = [(i, self.unknown([w for line in lines[i:j] for w in line]))] if j > i + 1 else []
            each += [(k, self.unknown(lines[k])) for k in range(i, j)]
            if some := [(-r[1], k, r) for k, r in each if r]:
                found.append(min(some)[1:])
            i = max(j, i + 1)
        return found

    def text(self, text: str | None) -> tuple[str | None, int, float, float, int | None, int]:
        """(family, confirmed paragraphs, probability, overlap, line number, unknown paragraphs) of a text."""
        lines = [words_of(line) for line in (text or "").split("\n")]
        hits = [self.all_pairs.intersection(zip(a, [*a[1:], *b[:1]], strict=False)) for a, b in zip(lines, [*lines[1:], []], strict=True)]
        signs = [self.signed(a + b[:1]) for a, b in zip(lines, [*lines[1:], []], strict=True)]
        if not any(signs):
            return None, 0, 0.0, 0.0, None, 0
        found = self.confirmed(lines, hits)
        rest = self.unconfirmed(lines, signs, {k for i, j, _ in found for k in range(i, j + 1)})
        best = [(i, r) for i, _, r in found] or rest
        if not best:
            return None, 0, 0.0, 0.0, None, 0
        _, i, (family, p, overlap) = min((-round(r[1], 6), i, r) for i, r in best)
        return family, len(found), round(p, 6), round(overlap, 6), i, len(rest)


def fit(paragraphs: list[list[bytes]], seed: int = SEED, examples: int = EXAMPLES, epochs: int = EPOCHS) -> LicenceModel:
    """Trains on the templates and on paragraphs (word lists) without licences."""
    rng = random.Random(seed)
    families = [NONE, *TEMPLATES, UNKNOWN]
    licence_words = marks()
    none = [p for p in paragraphs if p and licence_words.isdisjoint(p)]
    filler = [w for p in none for w in p] or [b"text"]
    rows = [(0, p) for p in none]
    texts = notices()
    for k, f in enumerate(families[1:], 1):
        for t in TEMPLATES.get(f, UNLISTED):
            for _ in range(6 if "{}" in t else 1):
                rows += [(k, v) for v in variants(named(t, filler, rng), filler, rng, examples // 6 if "{}" in t else examples)]
            rows += [(0, v) for v in mentions(words_of(t.replace("{}", "")), rng.choice(texts), filler, rng, examples // 2)]
    rng.shuffle(rows)
    cut = len(rows) * 3 // 4
    train, held = rows[:cut], rows[cut:]
    known = sorted({g for k, w in train if k for g in grams(w)} & {g for t in texts for g in grams(t)})
    ids = {g: i for i, g in enumerate(known)}
    y = np.array([k for k, _ in train])
    r, c = zip(*[(i, ids[g]) for i, (_, w) in enumerate(train) for g in set(grams(w)) if g in ids], strict=True)
    r, c = np.array(r), np.array(c)
    n, m, kk = len(train), len(ids), len(families)
    weight, bias = np.zeros((m, kk)), np.zeros(kk)
    share = 1 / np.bincount(y, minlength=kk).clip(1)[y] / kk
    v, vb = np.full((m, kk), 1e-8), np.full(kk, 1e-8)
    target = np.eye(kk)[y]
    for _ in range(epochs):
        z = np.stack([np.bincount(r, weight[c, k], n) for k in range(kk)], axis=1) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - target) * share[:, None]
        g = np.stack([np.bincount(c, d[r, k], m) for k in range(kk)], axis=1) + 1e-5 * weight
        v, vb = v + g * g, vb + d.sum(axis=0) ** 2
        weight -= 0.5 * g / np.sqrt(v)
        bias -= 0.5 * d.sum(axis=0) / np.sqrt(vb)
    model = LicenceModel({gm: weight[i] for gm, i in ids.items()} | {(): bias}, families, np.zeros(kk))
    # unknown: a family's probability on held-back paragraphs of another class must not reach its threshold
    least = np.full(kk, 0.5)
    scores = [(k, model.probabilities(w)) for k, w in held]
    for k in range(1, kk):
        other = sorted(p[k] for j, p in scores if j != k)
        if other:
            least[k] = max(0.5, min(0.95, other[min(len(other) - 1, int(len(other) * (1 - FALSE_RATE)))]))
    # and the probability of any licence on held-back paragraphs without one must not reach that of unknown;
    # neighbouring lines are scored together too, so joined paragraphs count
    free = [w for k, w in held if k == 0]
    free += [[w for p in free[i : i + 8] for w in p] for i in range(0, len(free), 8)]
    other = sorted(1 - model.probabilities(w)[0] for w in free if model.signed(w))
    if other:
        least[0] = max(0.5, other[min(len(other) - 1, int(len(other) * (1 - UNKNOWN_RATE)))])
    model.least = least
    return model


def train(docs: DataFrame, paragraphs: int = PARAGRAPHS, longest: int = LONGEST) -> LicenceModel:
    """Fits on the templates and on at most ``paragraphs`` different lines of all documents, chosen by hash, of
    ``longest`` characters or fewer (the bounds are these parameters)."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter((F.trim("line") != "") & (F.length("line") <= longest))
    n = docs.agg(F.coalesce(F.sum(F.size(F.split("text", "\n"))), F.lit(0)).alias("n")).first()["n"]
    hashed = lines.withColumn("h", F.xxhash64("line"))
    share = 2 * paragraphs / max(n, 1)
    if share < 1:  # about twice the lines that are wanted, before equal ones are brought together
        hashed = hashed.filter(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))
    chosen = hashed.distinct().orderBy("h", "line").limit(paragraphs).collect()
    return fit([w for w in (words_of(r["line"]) for r in chosen) if w])


FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("family", T.StringType()),
        T.StructField("n_paragraphs", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("overlap", T.DoubleType()),
        T.StructField("line", T.LongType()),
        T.StructField("n_unknown", T.LongType()),
    ]
)


def scan_licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """One row per document, in one pass without a shuffle; whole texts are scanned."""

    def run(batches):
        for batch in batches:
            rows = [model.text(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, columns, kinds)], FOUND.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def op10_license_scan(spark, sf_dir):
    """doc_id, family (null: none), n_paragraphs, confidence, overlap, line, n_unknown of all documents."""
    docs = load(spark, sf_dir, "documents")
    return scan_licences(docs, train(docs))
