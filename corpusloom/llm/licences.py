"""Licence scan: paragraphs classified by sparse word n-gram logistic regression, confirmed by templates.

A paragraph is a line of a text. Its distinct word n-grams (one to three words) are looked up in the model:
the weights of a multinomial logistic regression over licence families and an unknown class, fitted on the
driver on variants of the templates, on other sentences, and on a bounded sample of the corpus's paragraphs
with words of the templates strewn in. Only n-grams with a key word have a weight: a word of a
template that isn't common (COMMON). So a paragraph without a key word is unknown, whatever else it says, and
only paragraphs with one, the candidates, are scored; that leaves out no licence that the model would find.

The unknown class is calibrated on templates that the fit has not seen: each is scored by a model without it,
and a family counts from the probability on that separates those variants from held-out other paragraphs
best, and only where it is likelier than unknown. A family is confirmed when one of its templates shares
enough n-grams with the paragraph.

The main path is DataFrame functions only: one scan, a broadcast join with the model (its size is fixed by
the templates and the sample's bound) and sums by paragraph and document.

Cases: null and empty texts have no paragraphs; blank lines are none; a tie between families goes to the
first by name; rows that repeat a doc_id are taken each for itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Families and short public notices of each: fixed values.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "Distributed under the GNU AGPL v3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Content available under CC BY 3.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Content available under CC BY-NC 3.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Content available under CC BY-SA 3.0."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work under the Creative Commons CC0 public domain dedication.", "Released as CC0 1.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under the GNU GPL v3."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Distributed under the GNU LGPL v2.1."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT", "Licensed under MIT."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the MPL 2.0."],
}
#: Prose that names a licence's words without a licence.
OTHERS = ["All rights reserved, copyright of the publisher.", "Copyright by the author, no part may be copied without permission.", "He lost his driving licence and asked for permission to appeal.", "The licence plate was stolen under the bridge.", "The warranty is void if the seal is broken.", "She was licensed to practise medicine in the state.", "You may ask for permission to use the public domain name.", "Please read the licence terms of your software before you install it.", "The book is under copyright and the version is out of print.", "A general public meeting on the new licensing act.", "The foundation published its terms of service.", "Fishing licences are released under the new rules.", "The program is on the public channel under the name of the general.", "The Apache nation and the Mozilla team share a free library.", "Creative work in the commons is open to the general public.", "The software was granted a patent by a court of law.", "Er kam mit dem Hund und ging mit der Katze.", "Mit freundlichen Grüßen, mit Dank und mit Freude.", "La fondation publique garde les droits.", "El dominio del software es universal."]
#: Words of the templates that any text may have, so that they are no key words: fixed values.
COMMON = frozenset("1 1.0 2 2.0 2.1 3 3.0 4 4.0 a all and any are as associated at author available be by can charge code compliance conditions content copy deal distributed either except extent file files following form forms found free general has http in international is it later law library may met not obtain obtaining of or person possible program provided published related released rights source subject terms that the this to under use v version with without work you mit".split())
WORD = "[a-z0-9]+(?:[.'+-][a-z0-9]+)*"
#: Documents in the training sample (one paragraph of each, of at most LONGEST characters), n-gram lengths, folds of the calibration, and the least share of a template's or paragraph's n-grams that confirms.
SAMPLE, LONGEST, GRAMS, FOLDS, CONFIRM = 2000, 4000, 3, 4, 0.5
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
ALL_TEMPLATES = [(f, t) for f in FAMILIES for t in TEMPLATES[f]]
KEYS = sorted({w for _, t in ALL_TEMPLATES for w in re.findall(WORD, t.lower())} - COMMON)
KEY_SET = frozenset(KEYS)


def grams_of(text: str) -> list[str]:
    """Distinct n-grams of one to GRAMS words, in order; the DataFrame form is grams()."""
    words = re.findall(WORD, text.lower())
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)))


def variants(rng: random.Random, text: str, prose: list[str], n: int) -> list[str]:
    """The text itself, with words left out, within other words, in parts, and from its second key word on, which names the licence."""
    words, out = text.split(), [text]
    keys = [k for k, w in enumerate(words) if not KEY_SET.isdisjoint(re.findall(WORD, w.lower()))]
    named = words[keys[1] :] if len(keys) > 1 else words
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.1] or words
        around = rng.choice(prose).split() if prose else []
        cut = rng.randrange(len(around) + 1) if around else 0
        kind = rng.randrange(4)
        out.append(" ".join(around[:cut][-6:] + named + around[cut:][:6]) if kind == 3 else " ".join(around[:cut][-12:] + kept + around[cut:][:12]) if kind == 0 else " ".join(kept) if kind == 1 or len(kept) < 12 else " ".join(kept[: len(kept) * 3 // 4]))
    return out


def strewn(rng: random.Random, prose: list[str], n: int) -> list[str]:
    """Paragraphs with one or two words of the templates strewn in."""
    own, out = [w for _, t in ALL_TEMPLATES for w in t.split()], []
    for _ in range(n if prose else 0):
        words = rng.choice(prose).split()
        for _ in range(rng.randrange(1, 3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(own))
        out.append(" ".join(words))
    return out


class Model:
    """Weights of each n-gram for each family and unknown, biases, and the least probability of a family."""

    def __init__(self, prose: list[str], seed: int = 5, steps: int = 300):
        rng = random.Random(seed)
        rows, y, part = [], [], []
        seen: dict[str, int] = {}
        for family, text in ALL_TEMPLATES:
            k = seen[family] = seen.get(family, -1) + 1  # a family's templates go to different folds
            for v in variants(rng, text, prose, 24):
                rows.append(v)
                y.append(FAMILIES.index(family))
                part.append(k % FOLDS)
        for k, t in enumerate(OTHERS):
            for v in variants(rng, t, prose, 16):
                rows.append(v)
                y.append(UNKNOWN)
                part.append(k % FOLDS)
        for k, t in enumerate(strewn(rng, prose, 600)):  # prose alone has no key word and is never scored
            rows.append(t)
            y.append(UNKNOWN)
            part.append(k % FOLDS)
        has_key = lambda g: not KEY_SET.isdisjoint(g.split())
        wanted = dict.fromkeys(g for t in [*(t for _, t in ALL_TEMPLATES), *OTHERS] for g in grams_of(t) if has_key(g))
        self.grams = {g: k for k, g in enumerate(wanted)}
        x = np.zeros((len(rows), len(self.grams)), np.float32)
        for k, text in enumerate(rows):
            x[k, [self.grams[g] for g in grams_of(text) if g in self.grams]] = 1
        y, part = np.array(y), np.array(part)
        p = np.zeros((len(rows), UNKNOWN + 1))
        for k in range(FOLDS):
            self.weights, self.bias = self.fit(x[part != k], y[part != k], steps)
            p[part == k] = self.probabilities(x[part == k])
        self.least = self.limit(p, y)
        self.weights, self.bias = self.fit(x, y, steps)
        # a paragraph without a weighted n-gram must be unknown: that is what lets only candidates be scored
        if self.bias.argmax() != UNKNOWN:
            self.bias[UNKNOWN] = self.bias.max() + 1e-3

    def limit(self, p: np.ndarray, y: np.ndarray) -> float:
        """The probability from which a family counts that gives the best F1 over paragraphs of unseen templates and others; `precision` and `recall` are what it gives there."""
        top, likelier = p[:, :UNKNOWN].max(1), p[:, :UNKNOWN].max(1) > p[:, UNKNOWN]
        right, family = (p[:, :UNKNOWN].argmax(1) == y) & (y < UNKNOWN), (y < UNKNOWN).sum()
        order = np.sort(top[likelier])
        cuts = (order[1:] + order[:-1]) / 2 if len(order) > 1 else np.array([0.5])
        taken = [likelier & (top >= c) for c in cuts]
        f1 = np.array([2 * (right & t).sum() / (t.sum() + family) for t in taken])
        best = np.flatnonzero(f1 == f1.max())
        at = best[len(best) // 2]
        self.precision, self.recall = float((right & taken[at]).sum() / max(1, taken[at].sum())), float((right & taken[at]).sum() / max(1, family))
        return float(cuts[at])

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, steps: int, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
        target = np.eye(UNKNOWN + 1, dtype=np.float32)[y]
        w, b = np.zeros((x.shape[1], UNKNOWN + 1), np.float32), np.zeros(UNKNOWN + 1, np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (p - target) / len(x) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            b -= 0.3 * (p - target).mean(0)
        return w, b

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        p = np.exp((z - z.max(1, keepdims=True)).astype(np.float64))
        return p / p.sum(1, keepdims=True)

    def table(self, spark: SparkSession) -> DataFrame:
        """(gram, w0.., t0..): weights by class, none for n-grams without a key word, and 1 for each template that has the gram."""
        has = [set(grams_of(t)) for _, t in ALL_TEMPLATES]
        every = dict.fromkeys([*self.grams, *(g for _, t in ALL_TEMPLATES for g in grams_of(t))])
        weight = lambda g: self.weights[self.grams[g]] if g in self.grams else np.zeros(UNKNOWN + 1)
        names = [f"w{k}" for k in range(UNKNOWN + 1)] + [f"t{k}" for k in range(len(has))]
        rows = [{"gram": g} | dict(zip(names, [*map(float, weight(g)), *(int(g in h) for h in has)], strict=True)) for g in every]
        schema = "array<struct<gram:string," + ",".join(f"{n}:{'double' if n[0] == 'w' else 'int'}" for n in names) + ">>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def key_pattern() -> str:
    """Any key word, as a whole word, sorted out by its first letter."""
    first = {c: [re.escape(w[1:]) for w in KEYS if w[0] == c] for c in sorted({w[0] for w in KEYS})}
    inner = "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in first.items())
    return f"(?<![a-z0-9])(?:{inner})(?![a-z0-9])"


def is_candidate(column):
    """Whether a text has a key word: as part of a longer word with a hyphen or a dot as well, which costs a lookup only."""
    return F.lower(column).rlike(key_pattern())


def paragraphs(text):
    """Lines of a text that aren't blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def grams(paragraph):
    """Distinct n-grams of one to GRAMS words."""
    words = F.regexp_extract_all(F.lower(paragraph), F.lit(f"({WORD})"), F.lit(1))
    runs = [words]
    joined = lambda n: lambda i: F.array_join(F.slice(words, i, n), " ")
    for n in range(2, GRAMS + 1):
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(at, joined(n)))
    return F.array_distinct(F.concat(*runs))


def train(docs: DataFrame, size: int = SAMPLE, longest: int = LONGEST) -> Model:
    """The model, with other paragraphs from the `size` documents whose doc_id hashes lowest: of each the first without a key word and of at most `longest` characters."""
    # the sample is drawn by number first, so that only its own texts travel
    drawn = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    plain = F.filter(paragraphs(F.col("text")), lambda x: ~is_candidate(x) & (F.length(x) <= longest))
    rows = rows.select(F.try_element_at(plain, F.lit(1)).alias("p"))
    return Model(sorted(r[0] for r in rows.filter(F.col("p").isNotNull()).collect()))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Every candidate paragraph with its family, and a row of nulls for each document without one.

    Columns: row, doc_id, n_paragraphs, position, family (null: unknown), probability, similarity, confirmed.
    """
    spark = docs.sparkSession
    lines = paragraphs(F.col("text"))
    # each line knows its place; only documents with a key word are cut further
    found = F.when(is_candidate(F.col("text")), F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("position"), x.alias("text"))), lambda s: is_candidate(s["text"])))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.size(lines).cast("bigint").alias("n_paragraphs"), F.explode_outer(found).alias("line"))
    rows = rows.select("row", "doc_id", "n_paragraphs", "line.position", grams(F.col("line.text")).alias("grams"))
    keys = ["row", "doc_id", "n_paragraphs", "position"]
    single = rows.select(*keys, F.size("grams").alias("n"), F.explode_outer("grams").alias("gram"))
    joined = single.join(F.broadcast(model.table(spark)), "gram", "left")
    sums = joined.groupBy(*keys, "n").agg(*(F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"w{k}") for k in range(UNKNOWN + 1)), *(F.coalesce(F.sum(f"t{k}"), F.lit(0)).alias(f"t{k}") for k in range(len(ALL_TEMPLATES))))
    scores = F.array(*(F.col(f"w{k}") + float(model.bias[k]) for k in range(UNKNOWN + 1)))
    sums = sums.withColumn("z", scores).withColumn("top", F.array_max("z"))
    weights = F.transform("z", lambda x: F.exp(x - F.col("top")))
    sums = sums.withColumn("e", weights).withColumn("all", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    known = F.slice("e", 1, UNKNOWN)
    sums = sums.withColumn("best", F.array_max(known)).withColumn("at", F.array_position(known, F.col("best")))
    size = [len(grams_of(t)) for _, t in ALL_TEMPLATES]
    likeness = F.greatest(*(F.when(F.col("at") == FAMILIES.index(f) + 1, F.col(f"t{k}") / F.least(F.col("n"), F.lit(size[k]))).otherwise(0.0) for k, (f, _) in enumerate(ALL_TEMPLATES)))
    p = F.col("best") / F.col("all")
    unknown = F.element_at("e", UNKNOWN + 1)
    sure = F.col("position").isNotNull() & (F.col("n") > 0) & (p >= model.least) & (F.col("best") > unknown)
    similarity = F.when(sure, likeness)
    name = F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("at").cast("int"))
    return sums.select(*keys, F.when(sure, name).alias("family"), F.when(F.col("position").isNotNull(), p).alias("probability"), similarity.alias("similarity"), F.coalesce(similarity >= CONFIRM, F.lit(False)).alias("confirmed"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: paragraphs, candidates, confirmed licences, their families, and the surest one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    sure = F.when(F.col("confirmed"), F.struct("probability", "family", "similarity"))
    rows = found.groupBy("row", "doc_id", "n_paragraphs").agg(
        F.count("position").alias("n_candidates"),
        F.count(F.when(F.col("confirmed"), 1)).alias("n_licences"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.max(sure).alias("best"),
    )
    return rows.select("doc_id", "n_paragraphs", "n_candidates", "n_licences", "families", F.col("best.family").alias("best_family"), F.col("best.probability").alias("best_probability"), F.col("best.similarity").alias("best_similarity"))
