"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of a text with the lines that go on with it: a line goes on if the next begins with a small letter
or a digit, or it ends with a comma, as wrapped notices do. It is a sparse set of word n-grams. A multinomial logistic regression, trained here on
notices built from the licence names and sentences below and on paragraphs of the corpus as the unknown class, gives
each licence family's probability. Predictions above one half are compared with the families' templates: a name stands in
the paragraph, or the paragraph holds half of the word pairs of a sentence. The unknown class is calibrated: what no
template confirms is only reported if its probability is above what all but a thousandth of the corpus's distinct
unknown paragraphs held out of the training reach. Paragraphs that a template confirms are no unknown ones, neither in
the training nor in the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textbytes as tb
from tabulon.llm.tables import small_batches

#: Longest n-gram; distinct corpus paragraphs of the sample that the unknown class is fitted on; steps of the calibrated probability.
GRAM, SAMPLE, STEPS = 3, 4000, 10_000

# Names of licence families, and sentences of their texts.
NAMES = {
    "agpl": ["GNU Affero General Public License", "AGPL", "AGPLv3", "AGPL-3.0"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC-BY-4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial License", "CC-BY-NC-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike License", "CC-BY-SA-4.0"],
    "cc0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "LGPL", "LGPLv3", "LGPL-2.1", "LGPL-3.0"],
    "mit": ["MIT License", "MIT license", "The MIT License", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0"],
    "proprietary": ["All rights reserved", "proprietary license", "proprietary and confidential"],
    "unlicense": ["The Unlicense", "Unlicense"],
}
SENTENCES = {
    "apache-2.0": ["you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
NOTICES = ["{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}", "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is distributed under the terms of the {}.", "License: {}", "Copyright 2020 the authors. {}.", "SPDX-License-Identifier: {}", "The code is available under the {}, see the file LICENSE.", "This page and its text are under the {}."]
OTHERS = ["Licensed under our own terms.", "This work is licensed.", "The license of the driver was renewed.", "Released under the bridge in version 2.0.", "A general public meeting about the license.", "All rights and duties of members.", "Permission to enter is granted at the gate.", "The software is included in all copies of the book.", "Creative work and common goods.", "Version 3 of the text, released in 2020.", "See the file for terms.", "Copyright law is old."]


def _words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, _, _, _, at, words in tb.word_slices(pa.array(texts, pa.string()), tb.ALNUM):
        out += [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n if len(out) else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
        return tb.mix(out + np.uint64(n << 50))


#: Paragraphs: bytes between line ends.
_LINE = tb.byte_class([(10, 10)], inside=False)


#: Bytes that begin a line which goes on with the one before.
_GOES_ON = tb.byte_class([(48, 57), (97, 122)])


def _soft(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of line ends inside a paragraph."""
    at = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, at, "right")
    after = _GOES_ON[data[np.minimum(at + 1, len(data) - 1)]] & (np.searchsorted(offsets, at + 1, "right") == text)
    before = (data[np.maximum(at - 1, 0)] == 44) & (np.searchsorted(offsets, at - 1, "right") == text)
    return at[after | before]


def _paragraph_slices(column: pa.Array):
    """For each slice: first text, last text, lower-cased bytes with blanks for the line ends inside paragraphs, offsets
    of its texts, starts and ends of its paragraphs, each text's first paragraph and end."""
    data, offsets = tb.buffers(column)
    for first, last in tb.slices(offsets):
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        soft, part = _soft(part, own), tb.LOWER[part]
        part[soft] = 32
        yield first, last, part, own, *tb.spans(part, own, _LINE)


class Model:
    """n-grams of the notices with a row of weights each; class 0 is unknown."""

    def __init__(self, unknown: list[str]):
        self.families = sorted(NAMES)
        texts, labels = [], []
        for k, f in enumerate(self.families, 1):
            own = [t.format(n) for n in NAMES[f] for t in NOTICES] + 3 * SENTENCES.get(f, [])
            texts += own
            labels += [k] * len(own)
        positive = [g for w in _words(texts) for n in range(1, GRAM + 1) for g in [_grams(w, n)]]
        self.keys = np.unique(np.concatenate(positive))
        self.there = np.zeros(1 << 20, bool)
        self.there[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        # by length in words: the names' grams, and whose they are
        self.names: dict[int, dict[int, set[int]]] = {}
        for k, f in enumerate(self.families):
            for w in filter(len, _words(NAMES[f])):
                self.names.setdefault(len(w), {}).setdefault(int(_grams(w, len(w))[0]), set()).add(k)
        self.pairs = [(k, p) for k, f in enumerate(self.families) for w in _words(SENTENCES.get(f, [])) if (p := set(_grams(w, 2).tolist()))]
        self.any_pair = set().union(*(p for _, p in self.pairs))
        unknown = [t for t, w in zip(unknown, _words(unknown), strict=True) if not self.confirmations(w)]
        self.trained = line_hashes(unknown)
        train = OTHERS + unknown
        texts += train
        labels += [0] * len(train)
        rows = [self.features(w) for w in _words(texts)]
        x = np.zeros((len(rows), len(self.keys) + 1), np.float32)
        for i, r in enumerate(rows):
            x[i, r] = 1
        x[:, -1] = 1
        y, w = np.array(labels), np.zeros((x.shape[1], len(self.families) + 1), np.float32)
        weight = (1 / np.bincount(y, minlength=w.shape[1]))[y][:, None] * len(self.families)
        weight[y == 0] *= 3
        one = np.eye(w.shape[1], dtype=np.float32)[y]
        square = np.full(w.shape, 1e-3, np.float32)
        for _ in range(300):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ ((p - one) * weight).astype(np.float32) + 1e-3 * w
            square += g * g
            w -= 0.5 * g / np.sqrt(square)
        self.weights = w
        self.least = 0.5

    def calibrate(self, counts: dict[int, int]) -> None:
        """Set the threshold, given how many unknown paragraphs have a probability of each of STEPS steps."""
        steps = np.array(sorted(counts))
        if len(steps):
            below = np.cumsum([counts[k] for k in steps])
            at = steps[np.searchsorted(below, 0.999 * below[-1])]
            self.least = float(max(0.5, (at + 1) / STEPS))

    def features(self, words: np.ndarray) -> np.ndarray:
        own = np.unique(np.concatenate([_grams(words, n) for n in range(1, GRAM + 1)]))
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return at[self.keys[at] == own]

    def confirmations(self, words: np.ndarray) -> list[int]:
        """The families whose templates confirm the paragraph: a name stands in it, or half of the word pairs of a sentence."""
        found: set[int] = set()
        for n, names in self.names.items():
            for g in names.keys() & set(_grams(words, n).tolist()):
                found |= names[g]
        own = self.any_pair & set(_grams(words, 2).tolist())
        found.update(k for k, p in self.pairs if 2 * len(p & own) >= len(p))
        return sorted(found)

    def paragraphs(self, column: pa.Array):
        """For each slice: first text, last text, bytes, starts and ends of its paragraphs, each text's first paragraph and end, words and their
        paragraphs, the paragraphs that share an n-gram with a notice, and their classes' probabilities."""
        for first, last, part, own, starts, ends, at in _paragraph_slices(column):
            ws, we, _ = tb.spans(part, own, tb.ALNUM)
            words = tb.hashes(part, ws, we)
            paragraph = np.searchsorted(starts, ws, "right") - 1
            hits, rows = [], []
            for n in range(1, GRAM + 1):
                g = _grams(words, n)
                pos = np.flatnonzero(self.there[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
                where = np.minimum(np.searchsorted(self.keys, g[pos]), len(self.keys) - 1)
                fine = (self.keys[where] == g[pos]) & (paragraph[pos] == paragraph[pos + n - 1])
                hits.append(paragraph[pos[fine]])
                rows.append(where[fine])
            pair = np.unique(np.concatenate(hits) * np.int64(len(self.keys)) + np.concatenate(rows))
            p, r = pair // len(self.keys), pair % len(self.keys)
            begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
            z = (np.add.reduceat(self.weights[r], begin, axis=0) if len(p) else np.zeros((0, self.weights.shape[1]))) + self.weights[-1]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            yield first, last, part, starts, ends, at, words, paragraph, p[begin], z


def line_hashes(lines: list[str]) -> np.ndarray:
    data, offsets = tb.buffers(pa.array(lines, pa.string()))
    return np.sort(tb.hashes(tb.LOWER[data], offsets[:-1], offsets[1:]))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model, with about sample distinct paragraphs of docs (text), at most about half of them, as the unknown class, calibrated on all others."""
    small_batches(docs.sparkSession)
    texts = docs.select("text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part, _, starts, ends, _ in _paragraph_slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(tb.hashes(part, starts, ends)).view(np.int64))], ["h"])

    n = texts.mapInArrow(hashed, "h long").agg(F.approx_count_distinct("h")).first()[0]
    every = max(2, n // sample)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part, _, starts, ends, _ in _paragraph_slices(batch.column(0)):
                h, one = np.unique(tb.hashes(part, starts, ends), return_index=True)
                mine = h % np.uint64(every) == 0
                lines = [part[starts[i] : ends[i]].tobytes().decode() for i in one[mine]]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(h[mine].view(np.int64))], ["line", "h"])

    chosen = texts.mapInArrow(sampled, "line string, h long").distinct().orderBy("h", "line").limit(sample)
    model = Model([r["line"] for r in chosen.collect()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        none = np.exp(m.weights[-1] - m.weights[-1].max())
        for batch in batches:
            for _, _, part, starts, ends, _, words, paragraph, hit, z in m.paragraphs(batch.column(0)):
                h, best = tb.hashes(part, starts, ends), np.full(len(starts), 1 - none[0] / none.sum())
                best[hit] = 1 - z[:, 0]
                keep = ~np.isin(h, m.trained)
                for k in hit[1 - z[:, 0] > 0.5]:
                    a, b = np.searchsorted(paragraph, [k, k + 1])
                    keep[k] &= not m.confirmations(words[a:b])
                h, one = np.unique(h[keep], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(best[keep][one] * STEPS, STEPS - 1).astype(np.int32))], ["h", "step"])

    steps = texts.mapInArrow(unknown, "h long, step int").groupBy("h").agg(F.max("step").alias("step")).groupBy("step").count()
    model.calibrate({r["step"]: r["count"] for r in steps.collect()})
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_paragraphs, families and notices, which replace columns of these names.

    n_paragraphs: paragraphs that aren't empty. notices: for every paragraph with a predicted family, in order, its number
    (from 1), every family that a template confirms, or else the likeliest one, with its probability and whether it is confirmed. families: the distinct confirmed families, sorted.
    Null and empty texts have none. Whole texts are scanned, whatever their length; repeated rows give the same result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("n_paragraphs", "families", "notices")
    small_batches(docs.sparkSession)
    schema = docs.selectExpr("*", "0L as n_paragraphs", "cast(array() as array<string>) as families", "cast(array() as array<struct<paragraph:bigint,family:string,probability:double,confirmed:boolean>>) as notices").schema
    at_text = docs.columns.index("text")
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, last, _, _, _, at, words, paragraph, hit, z in m.paragraphs(batch.column(at_text)):
                notices: list[list[dict]] = [[] for _ in range(last - first)]
                for i in np.flatnonzero(1 - z[:, 0] > 0.5):
                    k = int(hit[i])
                    text = int(np.searchsorted(at, k, "right") - 1)
                    a, b = np.searchsorted(paragraph, [k, k + 1])
                    sure = m.confirmations(words[a:b])
                    if not sure and 1 - z[i, 0] <= m.least:
                        continue
                    notices[text] += [{"paragraph": k - int(at[text]) + 1, "family": m.families[f], "probability": float(z[i, 1 + f]), "confirmed": bool(sure)} for f in sure or [int(z[i, 1:].argmax())]]
                families = [sorted({x["family"] for x in n if x["confirmed"]}) for n in notices]
                new = [pa.array(np.diff(at).astype(np.int64)), pa.array(families, pa.list_(pa.string())), pa.array(notices, kind)]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns), *new], names=schema.names)

    return docs.mapInArrow(run, schema)
