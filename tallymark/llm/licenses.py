"""Licence scan: a trained paragraph classifier, scored with DataFrame operations only.

Paragraphs (lines of text) become sets of word 1-grams and 2-grams. A sparse softmax regression over the n-grams of
known notices names a licence family or the class ``unknown``, which paragraphs of the corpus train; a
paragraph's features are scaled by the root of the number of its n-grams, so a few chance words in long prose say
little. A temperature and a bar, both from held-out paragraphs and held-out variants of notices, calibrate the
probabilities; below the bar, and without a pair of words known from a notice, the answer is unknown. A family counts as confirmed only
if the paragraph also resembles one of that family's templates.

The model is fitted from the templates and a bounded sample of paragraphs of the corpus. The sample is not labelled, so
paragraphs that resemble a template are left out of it. Scoring covers every paragraph of every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNKNOWN = "unknown"
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: Notices by which works commonly state their licence.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "Distributed under the terms of the MIT License"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license", "This work is distributed under the Apache License version 2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL version 2", "Licensed under the GNU General Public License version 2"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the GNU Lesser General Public License version 3", "This library is distributed under the LGPL"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License", "Licensed under the BSD license", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License version 2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0", "Text available under the Creative Commons Attribution License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0", "Released under the CC BY-NC 3.0 license"],
    "CC0": ["This work is dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "Released under CC0"],
    "Proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"],
}
#: Sentences that share words with notices but state no licence.
DISTRACTORS = ["She lost her driving licence on the public road", "the general version of the story was published by the foundation", "a public license plate was found on the car", "they gave permission to copy the file by hand", "the apache people lived in the hills", "the source of the river was free of charge", "commons of the parliament", "all terms and conditions of the work were met", "version 2 of the draft", "the software was released in may"]


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


_TEMPLATE_GRAMS = [grams(tokens(t)) for notices in TEMPLATES.values() for t in notices]


@dataclass
class Model:
    """Weights by n-gram and class, the classes (the last is unknown) and the bar; divided by the temperature already."""

    classes: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    bar: float
    temperature: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _windows(text: str, width: int) -> list[str]:
    words = text.split()
    return [text] + ([" ".join(words[i : i + width]) for i in range(0, len(words) - width, 4)] if len(words) > 2 * width else [])


def resembles(text: str, agreement: float = 0.5) -> bool:
    """Whether a paragraph agrees with a template as :func:`scan` confirms it, in a pair of words at least."""
    own = grams(tokens(text))
    for g in _TEMPLATE_GRAMS:
        shared = own & g
        if any(" " in f for f in shared) and len(shared) >= agreement * min(len(own), len(g)):
            return True
    return False


def fit(negatives: list[str], rounds: int = 400, l1: float = 5e-4, step: float = 8.0) -> Model:
    """Fit on the templates and on paragraphs ``negatives``.

    Every fourth negative is held out, and so are variants of each notice that lack every fourth word; the temperature
    is the one under which these are most likely (all families together weigh as much as the negatives), the bar lies between the
    probabilities of the two kinds. Training is by gradient steps with soft thresholding, so weights that do little are exactly 0.
    """
    classes = [*TEMPLATES, UNKNOWN]
    clean = [n for n in negatives if not resembles(n)]
    held = [n for i, n in enumerate(clean) if i % 4 == 0]
    seen = [n for i, n in enumerate(clean) if i % 4] + DISTRACTORS
    cue = [" ".join(n.split()[:8]) for n in seen] or [""]
    notices = [(part, k) for k, family in enumerate(TEMPLATES) for t in TEMPLATES[family] for part in _windows(t, 10)]
    # a notice also stands within a paragraph that says other things
    notices += [(f"{cue[7 * i % len(cue)]} {text}", k) for i, (text, k) in enumerate(notices)]
    variants = [(" ".join(w for j, w in enumerate(t.split()) if j % 4 != r or len(t.split()) < 4), k) for k, family in enumerate(TEMPLATES) for t in TEMPLATES[family] for r in (0, 3)]
    names = sorted(set().union(*_TEMPLATE_GRAMS))
    at = {f: i for i, f in enumerate(names)}

    def matrix(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(names)))
        for i, t in enumerate(texts):
            g = grams(tokens(t))
            x[i, [at[f] for f in g if f in at]] = 1 / np.sqrt(max(len(g), 1))
        return x

    x = matrix([t for t, _ in notices] + seen)
    y = np.eye(len(classes))[[k for _, k in notices] + [len(TEMPLATES)] * len(seen)]
    cost = (y * (1 / np.maximum(y.sum(axis=0), 1) * np.array([1.0] * len(TEMPLATES) + [float(len(TEMPLATES))]))).sum(axis=1, keepdims=True) / (2 * len(TEMPLATES))
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    for _ in range(rounds):
        g = (_softmax(x @ w + b) - y) * cost
        w -= step * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= step * g.sum(axis=0)
    z, v = matrix([*held, *DISTRACTORS]) @ w + b, matrix([t for t, _ in variants]) @ w + b
    of = np.array([k for _, k in variants])

    def loss(t: float) -> float:
        return -np.log(_softmax(z / t)[:, -1] + 1e-12).mean() - np.log(_softmax(v / t)[np.arange(len(of)), of] + 1e-12).mean()

    temperature = float(min(2.0 ** np.arange(-4, 4.25, 0.25), key=loss))
    w, b = w / temperature, b / temperature
    no, yes = _softmax(z / temperature)[:, :-1].max(axis=1), _softmax(v / temperature)[np.arange(len(of)), of]
    bar = float(np.clip((np.quantile(no, 0.999) + np.quantile(yes, 0.05)) / 2, 0.3, 0.9))
    return Model(classes, b.tolist(), {f: row.tolist() for f, row in zip(names, w, strict=True)}, bar, temperature)


def sample_paragraphs(docs: DataFrame, documents: int, paragraphs: int) -> list[str]:
    """At most ``paragraphs`` lines from the ``documents`` first documents by a hash of the doc_id."""
    some = docs.filter("text is not null").select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(documents)
    lines = some.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''").select("line").distinct().orderBy(F.xxhash64("line"), "line").limit(paragraphs)
    return [r["line"] for r in lines.select(F.substring("line", 1, 2000).alias("line")).collect()]


def scan(docs: DataFrame, model: Model, agreement: float = 0.5) -> DataFrame:
    """``doc_id, family, probability, confirmed, n_notices, suspected``: one row for each row of ``docs(doc_id, text)``.

    A paragraph is found if a family's probability reaches the bar and it holds a pair of words of some template; it is
    confirmed if a template of that family agrees: the share of the
    template's n-grams found in the paragraph, or of the paragraph's in the template, is at least
    ``agreement``. ``n_notices`` counts confirmed paragraphs; ``family`` and ``probability`` are those of the best of them, by
    probability, then place; ``unknown`` and 0 where there is none. ``suspected`` is then the family of the best paragraph found but
    not confirmed (null: none). Null and empty texts have none; repeated rows are rows of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    k = len(model.classes) - 1
    weights = spark.createDataFrame([(g, w) for g, w in model.weights.items()], "gram string, w array<double>")
    words = F.transform(F.split("text", "\n"), lambda line: F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})")))
    later = lambda t: F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    earlier = lambda t: F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))
    sets = F.transform("words", lambda t: F.array_distinct(F.concat(t, F.zip_with(earlier(t), later(t), lambda a, b: F.concat_ws(" ", a, b)))))
    known = F.transform("sets", lambda g, i: F.struct(i.alias("place"), F.size(g).alias("n"), F.filter(g, lambda x: x.isin(list(model.weights))).alias("known")))
    # a paragraph without a known pair of words is unknown whatever its score
    found = F.filter("paragraphs", lambda p: F.exists(p["known"], lambda x: F.contains(x, F.lit(" "))))
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("words"))
    base = base.select("doc_id", "row", sets.alias("sets")).select("doc_id", "row", known.alias("paragraphs")).select("doc_id", "row", F.explode_outer(found).alias("p"))
    para = base.select("doc_id", "row", "p.place", "p.n", "p.known")
    # which families' templates agree, as bits
    agrees = F.lit(0).cast("long")
    for i, family in enumerate(model.classes[:-1]):
        alike = F.lit(False)
        for t in TEMPLATES[family]:
            g = sorted(grams(tokens(t)))
            shared = F.size(F.array_intersect("known", F.array(*[F.lit(x) for x in g])))
            alike = alike | (F.greatest(shared / F.lit(len(g)), shared / F.greatest(F.col("n"), F.lit(1))) >= agreement)
        agrees = agrees + F.when(alike, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    para = para.withColumn("agrees", F.when(F.col("known").isNotNull(), agrees))
    flat = para.select("doc_id", "row", "place", "n", "agrees", F.explode_outer("known").alias("gram"))
    # the model is bounded by the templates
    scored = flat.join(F.broadcast(weights), "gram", "left").groupBy("doc_id", "row", "place").agg(
        F.max("n").alias("n"), F.max("agrees").alias("agrees"), *[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k + 1)]
    )
    logits = F.array(*[F.col(f"s{i}") / F.sqrt(F.greatest(F.col("n"), F.lit(1))) + F.lit(model.bias[i]) for i in range(k + 1)])
    scored = scored.withColumn("e", F.transform(logits, lambda x: F.exp(x))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    best = F.array_max(F.slice("e", 1, k))
    names = F.array(*[F.lit(c) for c in model.classes])
    scored = scored.withColumn("probability", best / F.col("total")).withColumn("at", F.array_position("e", best).cast("int")).withColumn("family", F.element_at(names, F.col("at")))
    found = F.col("n").isNotNull() & (F.col("probability") >= model.bar)
    confirmed = found & (F.expr("(agrees >> (at - 1)) & 1") == 1)
    scored = scored.select("doc_id", "row", "place", "family", "probability", found.alias("found"), confirmed.alias("confirmed"))
    best = F.struct("probability", (-F.col("place")).alias("place"), "family")
    out = scored.groupBy("doc_id", "row").agg(F.max(F.when(F.col("confirmed"), best)).alias("top"), F.max(F.when(F.col("found"), best)).alias("other"), F.sum(F.col("confirmed").cast("long")).alias("n_notices"))
    return out.select(
        "doc_id",
        F.coalesce("top.family", F.lit(UNKNOWN)).alias("family"),
        F.round(F.coalesce("top.probability", F.lit(0.0)), 6).alias("probability"),
        F.col("top").isNotNull().alias("confirmed"),
        F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"),
        F.when(F.col("top").isNull(), F.col("other.family")).alias("suspected"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str, documents: int = 400, paragraphs: int = 3000) -> DataFrame:
    """The licence of every document; the classifier's sample of the corpus is bounded by ``documents`` and ``paragraphs``."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(sample_paragraphs(docs, documents, paragraphs)))
