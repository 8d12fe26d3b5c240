"""Licence scan by a trained paragraph classifier.

Sparse logistic regression over hashed word unigrams and bigrams names the licence family
of each paragraph (a line) or calls it unknown; its temperature is calibrated on held-out
examples. The family's templates then confirm a prediction by shared word trigrams.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import picked

# Usual notices of each family, as their stewards recommend them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1 or later.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License."),
    "BSD": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "all-rights-reserved": ("All rights reserved.", "No part of this publication may be reproduced or distributed without the prior written permission of the publisher. All rights reserved."),
}
# Sentences with words of licences that grant none.
DECOYS = (
    "A driving licence must be carried at all times.",
    "The software was released in the spring under a new name.",
    "Permission to enter the building is granted by the office.",
    "All rights of way are reserved for pedestrians.",
    "The general public may visit version 2 of the exhibition.",
    "The restaurant is licensed to sell beer and wine.",
    "He reserved a table and all seats on the right.",
    "The work is free and the foundation is general.",
)
UNKNOWN = "unknown"
BUCKETS = 1 << 17
NEGATIVE_DOCS = 300
NEGATIVE_LINES = 3000
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6


class Lines:
    """The lines of a piece and, as texts of their own, their words in lower case."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        breaks = np.flatnonzero(data == 0x0A)
        self.start = np.unique(np.concatenate([offs[:-1], breaks + 1]))
        self.start = self.start[self.start < len(data)]
        self.bounds = np.append(self.start, len(data))
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.number = np.arange(len(self.start)) - np.searchsorted(self.start, offs)[self.doc]
        self.words = words.Words(words.LOWER[data], self.bounds, words.ALNUM)


def features(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, bucket, size of the line) of each word and each pair of neighbours."""
    at, pair = w.windows(2)
    line = np.concatenate([w.text, w.text[at]])
    bucket = np.concatenate([w.hash, pair]) % words.U64(BUCKETS)
    return line, bucket.astype(np.int64), np.bincount(line, minlength=len(w.count))


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray  # a row of the families' weights for each bucket
    bias: np.ndarray
    temperature: float
    templates: list[list[set[int]]]

    def logits(self, w: words.Words) -> np.ndarray:
        out = np.zeros((len(w.count), len(self.families)), dtype=np.float64)
        line, bucket, size = features(w)
        for k in range(len(self.families)):
            out[:, k] = np.bincount(line, weights=self.weights[k][bucket], minlength=len(out))
        return out / np.sqrt(np.maximum(size, 1))[:, None] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def as_words(texts: list[str]) -> words.Words:
    data, offs = words.text_bytes(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()))
    return words.Words(words.LOWER[data], offs, words.ALNUM)


def trigrams(w: words.Words, text: int) -> set[int]:
    """Hashes of the word trigrams of one text, or of all its words if they are fewer."""
    h = w.hash[w.first[text] : w.first[text + 1]]
    return set(words.chained(h, min(3, len(h))).tolist()) if len(h) else set()


def examples(seed: int = 7, each: int = 60) -> list[tuple[str, str]]:
    """(family, paragraph) by varying the templates: other frames, dropped words, cut ends, joined notices."""
    dice, out = random.Random(seed), []
    frames = ("{}", "# {}", "// {}", " * {}", "Copyright 2021 the authors. {}", "(c) 2019 Example Ltd. {}", "{} See the file for details.", "<p>{}</p>")
    for family, texts in TEMPLATES.items():
        for text in texts:
            for _ in range(each):
                parts = text.split()
                if len(parts) > 6 and dice.random() < 0.5:
                    parts = [p for p in parts if dice.random() > 0.06]
                if len(parts) > 14 and dice.random() < 0.3:
                    parts = parts[: dice.randint(10, len(parts))]
                out.append((family, dice.choice(frames).format(" ".join(parts))))
    return out


def train(negatives: list[str], buckets: int = BUCKETS, steps: int = 150, seed: int = 7) -> Model:
    """Multinomial regression by adaptive gradient steps; every fifth example sets the temperature."""
    families = [UNKNOWN, *TEMPLATES]
    known = as_words([t for texts in TEMPLATES.values() for t in texts])
    shared = set().union(*(trigrams(known, i) for i in range(len(known.count))))
    plain = as_words(negatives)
    clean = [t for i, t in enumerate(negatives) if not trigrams(plain, i) & shared]
    alone = sorted({word for texts in TEMPLATES.values() for t in texts for word in t.split()})  # a word of a notice isn't one
    rows = examples(seed) + [(UNKNOWN, t) for t in clean] + [(UNKNOWN, t) for t in [*DECOYS, *alone] for _ in range(20)]
    random.Random(seed).shuffle(rows)
    w = as_words([t for _, t in rows])
    y = np.array([families.index(f) for f, _ in rows])
    held = np.arange(len(rows)) % 5 == 0
    line, bucket, size = features(w)
    value = 1 / np.sqrt(np.maximum(size, 1))[line]
    model = Model(families, np.zeros((len(families), buckets), np.float32), np.zeros(len(families)), 1.0, [])
    used, place = np.unique(bucket, return_inverse=True)
    small, speed = np.zeros((len(families), len(used))), np.full((len(families), len(used)), 1e-8)
    target = np.eye(len(families))[y]
    for _ in range(steps):
        z = np.stack([np.bincount(line, weights=small[k][place] * value, minlength=len(rows)) for k in range(len(families))], 1) + model.bias
        gap = (softmax(z) - target) * ~held[:, None] / max(1, (~held).sum())
        for k in range(len(families)):
            g = np.bincount(place, weights=gap[line, k] * value, minlength=len(used)) + 1e-6 * small[k]
            speed[k] += g * g
            small[k] -= 0.5 * g / np.sqrt(speed[k])
        model.bias -= 0.5 * gap.sum(0)
    model.weights[:, used] = small
    z = model.logits(w)[held]
    losses = [(-np.log(softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean(), t) for t in np.geomspace(0.25, 8, 41)]
    model.temperature = float(min(losses)[1])
    at = 0
    model.templates = [[]]
    for texts in TEMPLATES.values():
        model.templates.append([trigrams(known, at + i) for i in range(len(texts))])
        at += len(texts)
    return model


def negative_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = NEGATIVE_DOCS, most_lines: int = NEGATIVE_LINES) -> list[str]:
    """Lines of at most ``most_docs`` documents, picked by a hash of their ids, as examples of no licence."""
    ids = picked(docs, doc_id=id_col).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    rows = picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(ids), "doc_id").filter(F.col("text").isNotNull())
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") > 0).distinct()
    return [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(most_lines).collect()]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, min_probability: float = MIN_PROBABILITY, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """A row per paragraph of a licence: ``doc_id``, ``paragraph`` (line from 0), ``family``, ``probability``,
    ``template`` (number in its family), ``similarity``, ``confirmed`` and ``text``.

    Similarity is the share of the template's trigrams in the paragraph, or of the paragraph's in the
    template, whichever is larger. Null and empty texts have no paragraphs, repeated rows give
    repeated findings, and equal templates' ties go to the first. Extra columns are ignored.
    """
    model = model or train(negative_lines(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each family

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = ["doc_id", "paragraph", "family", "probability", "template", "similarity", "confirmed", "text"]
        for batch in batches:
            for low, high, data, offs in words.pieces(batch.column(1), 1 << 20):
                lines = Lines(data, offs)
                if not len(lines.start):
                    continue
                p = softmax(m.logits(lines.words) / m.temperature)
                best = p[:, 1:].argmax(1) + 1
                sure = p[np.arange(len(p)), best]
                hits = np.flatnonzero((sure >= min_probability) & (lines.words.count > 0))
                rows = []
                for i in hits.tolist():
                    own = trigrams(lines.words, i)
                    alike = [len(own & t) / max(1, min(len(own), len(t))) for t in m.templates[best[i]]]
                    top = int(np.argmax(alike))
                    raw = data[lines.bounds[i] : lines.bounds[i + 1]].tobytes().decode().rstrip("\n")
                    rows.append((int(lines.number[i]), m.families[best[i]], float(sure[i]), top, alike[top], alike[top] >= min_similarity, raw))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.bool_(), pa.string())
                ids = batch.column(0).slice(low, high - low).take(pa.array(lines.doc[hits]))
                yield pa.RecordBatch.from_arrays([ids] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, paragraph int, family string, probability double, template int, similarity double, confirmed boolean, text string")
