"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text that have a word. A logistic regression over sparse word
n-grams (1 to 3 words, those of the templates) gives each licence family a probability, and one to
`unknown`. Its scale is calibrated on paragraphs held out of training. A family counts only if one
of its templates is found in the paragraph, word by word and in order, to a high share. Wrapped
notices are looked for in the lines around those that share several n-grams with templates, up to the
next line without a word, and judged as one paragraph.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableprofile.llm.common import pick
from tableprofile.llm.text_arrays import row_windows, slices, words_of

#: Usual short notices of licence families.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "Licensed under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "This work is in the public domain."],
    "proprietary": ["All rights reserved.", "Copyright (c) the authors. All rights reserved.", "Unauthorized copying of this file is strictly prohibited."],
}
UNKNOWN = "unknown"
SAMPLE_ROWS = 500          # rows whose paragraphs stand for `unknown` in training, at most
SAMPLE_PARAGRAPHS = 2000   # paragraphs of these rows taken for it, at most
NEAR_LINES = 8             # lines before and after in which the rest of a wrapped notice is looked for
SEED_NGRAMS = 2            # n-grams of several words, shared with templates, that make a line worth it
NGRAM = 3
MIN_PROBABILITY = 0.5
MIN_MATCH = 0.85
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    families: list[str]     # unknown is the last
    vocabulary: np.ndarray  # sorted n-gram hashes
    weights: np.ndarray     # n-gram, family
    bias: np.ndarray
    scale: float            # calibration: logits are multiplied by it
    single: np.ndarray      # numbers of the single words in the vocabulary


def _features(data: np.ndarray, at: np.ndarray, vocabulary: np.ndarray | None = None):
    """(paragraph, n-gram hash or its number in the vocabulary, value) and the words."""
    words = words_of(data, at, lower=True, separators=_SEPARATORS)
    rows, values = [words.row], [words.hash]
    for n in range(2, NGRAM + 1):
        row, value = row_windows(words, n)
        rows.append(row)
        values.append(value)
    if vocabulary is None:
        return np.concatenate(rows), np.concatenate(values), words
    kept = []
    for i, value in enumerate(values):
        place = np.searchsorted(vocabulary, value)
        place[place == len(vocabulary)] = 0
        hit = np.flatnonzero(vocabulary[place] == value)
        kept.append((rows[i][hit], place[hit]))
    row, place = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
    return row, place, 1 / np.sqrt(np.maximum(1, words.per_row))[row], words


def _pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _variants(text: str, rng: np.random.Generator, prose: list[str], n: int) -> list[str]:
    """The notice as found in the wild: with a holder before it, words after it, some words lost."""
    out = [text]
    for _ in range(n):
        words = text.split(" ")
        if len(words) > 6 and rng.random() < 0.5:
            words.pop(rng.integers(len(words)))
        around = prose[rng.integers(len(prose))].split(" ") if prose else []
        extra = around[:rng.integers(0, 6)]
        out.append(" ".join([*extra, *words] if rng.random() < 0.5 else [*words, *extra]))
    return out


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES,
        rows: int = SAMPLE_ROWS, seed: int = 1, paragraphs: int = SAMPLE_PARAGRAPHS) -> Model:
    """Train on variants of the templates, and on the paragraphs of the `rows` rows with the smallest
    hashes of their ids as `unknown`, except those that hold a template: of these a random `paragraphs`
    at most, chosen by `seed`. Every fourth is held out for the calibration."""
    sample = pick(df, id=id, text=text).where("text IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(rows).select("text").toArrow()["text"].to_pylist()
    known = {" ".join(_plain(t)) for all_ in templates.values() for t in all_}
    prose = sorted({p for t in sample for p in t.split("\n") if p.strip() and not any(k in " ".join(_plain(p)) for k in known)})
    rng = np.random.default_rng(seed)
    families = [*templates, UNKNOWN]
    texts, labels = [], []
    for i, family in enumerate(templates):
        for t in templates[family]:
            v = _variants(t, rng, prose, 24)
            texts += v
            labels += [i] * len(v)
    notices = [t for all_ in templates.values() for t in all_]
    for t in notices * 2:       # the same words without their order say nothing
        words = t.split(" ")
        rng.shuffle(words)
        texts.append(" ".join(words[:max(1, len(words) // 2)]))
        labels.append(len(templates))
    picked = rng.permutation(len(prose))[:paragraphs]
    texts += [prose[i] for i in picked]
    labels += [len(templates)] * len(picked)
    y = np.array(labels)
    vocabulary = np.unique(_features(*_pack(notices))[1])
    row, place, value, _ = _features(*_pack(texts), vocabulary)
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    np.add.at(x, (row, place), value)
    held = np.arange(len(texts)) % 4 == 3
    target = np.eye(len(families), dtype=np.float32)[y]
    weight = (1 / np.bincount(y, minlength=len(families)).clip(1))[y]
    weight = (weight / weight[~held].sum()).astype(np.float32)
    w, b = np.zeros((x.shape[1], len(families)), np.float32), np.zeros(len(families), np.float32)
    xt, tt, wt = x[~held], target[~held], weight[~held][:, None]
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(200):        # gradient descent with momentum
        error = (_probabilities(xt @ w + b) - tt) * wt
        speed_w = 0.9 * speed_w - 20 * (xt.T @ error + 1e-5 * w)
        speed_b = 0.9 * speed_b - 20 * error.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    logits = x[held] @ w + b
    loss = [-(np.log(_probabilities(logits * s)[np.arange(held.sum()), y[held]].clip(1e-12)) * weight[held]).sum() for s in _SCALES]
    return Model(families, vocabulary, w.astype(np.float64), b.astype(np.float64), float(_SCALES[int(np.argmin(loss))]),
                 np.flatnonzero(np.isin(vocabulary, words_of(*_pack(notices), lower=True, separators=_SEPARATORS).hash)))


_SCALES = np.geomspace(0.1, 4, 25)


def _plain(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def confirmed(paragraph: str, templates: list[str]) -> float:
    """Largest share of a template's words found in the paragraph in order, in runs of two or more
    (or the whole template)."""
    words, best = _plain(paragraph), 0.0
    for t in templates:
        wanted = _plain(t)
        blocks = SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks()
        best = max(best, sum(k for _, _, k in blocks if k >= min(2, len(wanted))) / len(wanted))
    return best


def wrapped(lines: list[list[str]], templates: list[str], min_match: float) -> set[tuple[int, int]]:
    """(first, last line) of the templates found over several lines, given as words: to the share
    min_match, in runs of two or more words, and with no more between the runs than that share allows
    and a word a line, as comment marks may be words."""
    words = [w for line in lines for w in line]
    of = [i for i, line in enumerate(lines) for _ in line]
    have, found = Counter(words), set()
    for t in templates:
        wanted = _plain(t)
        if (Counter(wanted) & have).total() < min_match * len(wanted):
            continue
        blocks = [b for b in SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks() if b.size >= 2]
        if not blocks or sum(b.size for b in blocks) < min_match * len(wanted):
            continue
        first, end = blocks[0].b, blocks[-1].b + blocks[-1].size
        low, high = of[first], of[end - 1]
        if low < high and end - first <= len(wanted) / min_match + high - low:
            found.add((low, high))
    return found


def scan(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES,
         min_probability: float = MIN_PROBABILITY, min_match: float = MIN_MATCH) -> DataFrame:
    """Per row: id, n_paragraphs, n_licence (confirmed paragraphs), n_doubtful (predicted, but not
    confirmed), licences (families found, sorted, comma-joined), probability (largest of a confirmed
    paragraph, else null).

    A notice over several lines is one confirmed paragraph, unless one of its lines is already one of
    the same family; its lines are not doubtful, and stay single in n_paragraphs.
    Null and empty texts have no paragraph. Repeated rows each give a row; other columns are not read.
    One scan of whole texts, no shuffle; only predicted paragraphs, and
    lines around those that share n-grams with templates, are compared with templates.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    unknown = len(model.families) - 1

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, end, data, at in slices(batch.column("text")):
                rows = end - first
                cuts = np.flatnonzero(data == 10) + 1
                edges = np.unique(np.concatenate([at, cuts]))       # lines; a line's \n is a separator
                row, place, value, words = _features(data, edges, m.vocabulary)
                of = np.searchsorted(at, edges[:-1], "right") - 1   # text of each line
                filled = words.per_row > 0
                touched, where = np.unique(row, return_inverse=True)
                logits = np.stack([np.bincount(where, value * m.weights[place, k], len(touched)) for k in range(unknown + 1)], axis=1) + m.bias
                p = _probabilities(logits * m.scale)
                family, chance = p.argmax(axis=1), p.max(axis=1)
                found: dict[int, dict[str, float]] = {}
                doubtful = np.zeros(rows, np.int64)
                n_licence = np.zeros(rows, np.int64)
                sure: dict[int, str] = {}           # line: family
                unsure: set[int] = set()
                for i in np.flatnonzero((family != unknown) & (chance >= min_probability)):
                    line, name = touched[i], m.families[family[i]]
                    paragraph = data[edges[line]:edges[line + 1]].tobytes().decode()
                    if confirmed(paragraph, templates[name]) >= min_match:
                        n_licence[of[line]] += 1
                        sure[int(line)] = name
                        best = found.setdefault(int(of[line]), {})
                        best[name] = max(best.get(name, 0.0), float(chance[i]))
                    else:
                        unsure.add(int(line))
                several = np.bincount(row[~np.isin(place, m.single)], minlength=len(edges) - 1)
                plain: dict[int, list[str]] = {}

                def words_in(line: int) -> list[str]:
                    if line not in plain:
                        plain[line] = _plain(data[edges[line]:edges[line + 1]].tobytes().decode())
                    return plain[line]

                spans: dict[tuple[int, int], set[str]] = {}
                for seed in np.flatnonzero(several >= SEED_NGRAMS).tolist():
                    low = high = seed
                    while low > max(0, seed - NEAR_LINES) and of[low - 1] == of[seed] and filled[low - 1]:
                        low -= 1
                    while high < min(len(of) - 1, seed + NEAR_LINES) and of[high + 1] == of[seed] and filled[high + 1]:
                        high += 1
                    if low < high:
                        near = [words_in(i) for i in range(low, high + 1)]
                        for name, all_ in templates.items():
                            for a, b in wrapped(near, all_, min_match):
                                spans.setdefault((low + a, low + b), set()).add(name)
                for (low, high), names in sorted(spans.items(), key=lambda x: (x[0][1] - x[0][0], x[0])):     # shortest first
                    joined = np.frombuffer(" ".join(w for i in range(low, high + 1) for w in words_in(i)).encode(), np.uint8)
                    _, at_, value_, _ = _features(joined, np.array([0, len(joined)]), m.vocabulary)
                    p_ = _probabilities((value_ @ m.weights[at_] + m.bias)[None, :] * m.scale)[0]
                    name, inside = m.families[int(p_.argmax())], range(low, high + 1)
                    if name not in names or p_.max() < min_probability:
                        continue
                    unsure.difference_update(inside)
                    if any(sure.get(i) == name for i in inside):
                        continue
                    sure.update((i, name) for i in inside)
                    n_licence[of[low]] += 1
                    best = found.setdefault(int(of[low]), {})
                    best[name] = max(best.get(name, 0.0), float(p_.max()))
                for line in unsure:
                    doubtful[of[line]] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, rows), pa.array(np.bincount(of[filled], minlength=rows)), pa.array(n_licence), pa.array(doubtful),
                     pa.array([",".join(sorted(found.get(i, ()))) for i in range(rows)]),
                     pa.array([max(found[i].values()) if i in found else None for i in range(rows)], pa.float64())],
                    names=["id", "n_paragraphs", "n_licence", "n_doubtful", "licences", "probability"])

    return pick(df, id=id, text=text).mapInArrow(
        judge, f"id {df.schema[id].dataType.simpleString()}, n_paragraphs long, n_licence long, n_doubtful long, licences string, probability double").withColumnRenamed("id", id)
