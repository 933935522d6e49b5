"""Licence scan of paragraphs: a trained n-gram classifier, confirmed by templates.

Paragraphs are told apart by multinomial logistic regression over sparse word
n-grams. The classes are licence families and unknown. Half of the corpus's paragraphs
stand for unknown in the fit, the threshold of that class is calibrated on the other half. A
prediction counts when most word pairs of the paragraph and one of the family's
templates agree. Everything but the fit (`pyspark.ml`) is a DataFrame expression.

A paragraph is a line, with those it runs into: a line that ends in a letter, digit or
comma goes on in the next one. Most paragraphs hold so little of the vocabulary that their
likeliest class must be unknown whatever else they say; the model's weights prove
that for every paragraph without one of the words of `gate`, which are looked for first.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .quality_rules import let

# Usual notices by licence family, and sentences that only look like one.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license.", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "SPDX-License-Identifier: Apache-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "Licensed under the GNU GPL version 2.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "You should have received a copy of the GNU General Public License along with this program.", "Released under the GPL v3 license.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under the CC BY license."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under CC BY-NC-SA 4.0."],
    "Public-Domain": ["This work is dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "All-Rights-Reserved": ["Copyright 2020 Example Inc. All rights reserved.", "All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the copyright holder.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
}
UNKNOWN = "unknown"
NEGATIVES = ["He lost his driving license last year.", "The driver showed a license and a permit.", "They asked for permission to leave the room.", "The warranty covers two years.", "The license plate was yellow.", "Copyright law is taught in this course.", "She holds a public office.", "The apache helicopter landed.", "An MIT professor gave the talk.", "The terms of the contract are secret.", "Under the terms of the agreement they work at night.", "A creative mind is common here.", "Software engineers license their tools.", "The rights of the people are reserved for later.", "Poetic license is a general matter of style.", "The restaurant has a license to sell wine.", "Planning permission was granted to the public school.", "Version 2.0 of the work is out."]
# What a notice may stand between, in training.
BEFORE = ["", "Note: ", "Copyright 2019 The Authors. ", "This text is ours. "]
BEHIND = ["", " See the file for details.", " as of 2021."]
VARIANTS = 8  # of each notice and look-alike, for training
VARIANT_WEIGHT = 20.0  # of one of them against one paragraph of the corpus
TRAIN_ITERATIONS = 80
USUAL_WEIGHT = 2000.0  # of all paragraphs of the corpus together in the fit, at most: each counts, however many there are
FIT_ROWS = 50_000  # rows of the fit in a partition
FALSE_RATE = 0.001  # of the paragraphs that the fit has not seen, above the threshold
MIN_PROBABILITY = 0.5
MIN_TEMPLATE = 0.6
MIN_PAIRS = 2  # word pairs of a paragraph, for its own share of them to confirm
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def grams(text: Column) -> Column:
    """Different n-grams of one to three lower-case words (letters, digits, dots and hyphens inside)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    runs = lambda w, n: F.filter(F.transform(w, lambda x, i: F.when(i + n <= F.size(w), F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))), lambda x: x.isNotNull())
    return let(words, lambda w: F.array_distinct(F.concat(w, runs(w, 2), runs(w, 3))))


def _parts(text: Column, gate: list[str]) -> Column:
    """Whether a text holds a word, or a part of a word with dots or hyphens, of the gate."""
    return F.exists(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w.isin(gate)) if gate else F.lit(True)


def _paragraphs(docs: DataFrame, id_col: str, text_col: str, gate: list[str]) -> DataFrame:
    """(doc_id, paragraph, text): the paragraphs of whole texts that pass the gate, by the number of their first line.

    Lines get their numbers in front, line ends behind a letter, digit or comma become spaces, and what is left is cut at line ends."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("whole")).where(F.col("whole").isNotNull() & _parts(F.col("whole"), gate))
    lines = F.transform(F.split("whole", "\n"), lambda x, i: F.concat(i.cast("string"), F.lit("\x01"), x))
    runs = F.regexp_replace(F.array_join(lines, "\n"), "(?<=[\\p{L}\\p{N},])[ \\t\\r]*\\n[0-9]+\\x01(?=[^\\S\\n]*\\S)", " ")
    each = rows.select("doc_id", F.explode(F.split(runs, "\n")).alias("run"))
    number = F.substring_index("run", "\x01", 1)
    each = each.select("doc_id", number.cast("int").alias("paragraph"), F.expr("substring(run, length(substring_index(run, '\\u0001', 1)) + 2)").alias("text"))
    return each.where((F.length(F.trim("text")) > 0) & _parts(F.col("text"), gate))


def variants(text: str, n: int = VARIANTS) -> list[str]:
    """The text and n - 1 others made of it: other case, numbers, surroundings; longer ones also in part. They follow from the text alone."""
    rng, out = random.Random(text), [text]
    words = text.split(" ")
    while len(out) < n:
        some = words
        if len(words) >= 8 and rng.random() < 0.5:
            size = rng.randint(len(words) // 2, len(words) - 1)
            at = rng.choice([0, len(words) - size])
            some = words[at : at + size]
        one = " ".join(some)
        if rng.random() < 0.3:
            one = re.sub(r"(?<=\b20)\d\d\b", lambda m: f"{rng.randint(0, 29):02d}", one)
        one = rng.choice([str, str, str.lower, str.upper])(one)
        out.append(rng.choice(BEFORE) + one + rng.choice(BEHIND))
    return out


def _usual(vocabulary: list[str], notices: dict[str, list[str]], most: int = 100_000):
    """`_counted` in plain Python, for tests to hold it against; no query runs it."""
    known = frozenset(vocabulary)
    first = frozenset(g.split(" ")[0] for g in vocabulary if " " in g)
    templates = [frozenset(_pairs(t)) for ts in notices.values() for t in ts]
    of: dict[str, list[int]] = {}
    for k, t in enumerate(templates):
        for g in t:
            of.setdefault(g, []).append(k)
    find = re.compile(_WORD).findall

    def batch(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        columns = [pa.array([list(g) for g, _ in keys], pa.list_(pa.string())), pa.array([f for _, f in keys], pa.bool_()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["grams", "fit", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for rows in batches:
            for text, fit in zip(rows.column(0), rows.column(1)):
                words = find(text.as_py().lower())
                held = known.intersection(words)
                if held:
                    starts = [i for i, w in enumerate(words) if w in first]
                    held |= known.intersection(" ".join(words[i : i + n]) for i in starts for n in (2, 3))
                    hits = Counter(k for g in held for k in of.get(g, ()))
                    if hits and max(n / len(templates[k]) for k, n in hits.items()) >= MIN_TEMPLATE:
                        continue
                    pairs = [g for g in held if g.count(" ") == 1 and g in of]
                    if pairs and (size := len(set(zip(words, words[1:])))) >= MIN_PAIRS:
                        if max(Counter(k for g in pairs for k in of[g]).values()) / size >= MIN_TEMPLATE:
                            continue
                counts[tuple(sorted(held)), fit.as_py()] += 1
            if len(counts) > most:
                yield batch(counts)
                counts = Counter()
        yield batch(counts)

    return run


def _counted(each: DataFrame, vocabulary: list[str], notices: dict[str, list[str]]) -> DataFrame:
    """(grams, fit, n): the paragraphs (text, fit) counted by which n-grams of the vocabulary they hold, but those that hold most of a template's word pairs (`_agreement`).

    How much of a template is held follows from the n-grams, so that is looked at once they are counted. For the
    paragraph's own share its different pairs are counted where the template's are most of them."""
    single, more = [g for g in vocabulary if " " not in g], [g for g in vocabulary if " " in g]
    begin = sorted({g.split(" ")[0] for g in more})
    double = sorted({" ".join(g.split(" ")[:2]) for g in more})
    templates = [_pairs(t) for ts in notices.values() for t in ts]
    near = sorted({g for t in templates for g in t} & set(vocabulary))
    own = [g for g in near if g.count(" ") == 1]
    pair = lambda w, x, i: F.concat_ws(" ", x, F.get(w, i + 1))
    # a null where no longer n-gram begins
    twos = lambda w: F.transform(w, lambda x, i: F.when(x.isin(begin) & pair(w, x, i).isin(double), pair(w, x, i)))
    threes = lambda w, p: F.transform(p, lambda x, i: F.when(x.isNotNull(), F.concat_ws(" ", x, F.get(w, i + 2))))

    def held(w: Column) -> Column:
        longer = let(twos(w), lambda p: F.filter(F.concat(p, threes(w, p)), lambda g: g.isin(more)))
        return F.array_sort(F.array_distinct(F.concat(F.filter(w, lambda x: x.isin(single)), longer)))

    def pairs(w: Column, g: Column) -> Column:
        """How many different pairs the words have, if MIN_TEMPLATE of them can be a template's, else null. There is at most one word more than pairs."""
        may = lambda n: F.size(F.filter(g, lambda x: x.isin(own))) >= n * MIN_TEMPLATE
        size = let(F.size(F.array_distinct(F.filter(F.transform(w, lambda x, i: F.when(i + 1 < F.size(w), pair(w, x, i))), lambda x: x.isNotNull()))), lambda n: F.when((n >= MIN_PAIRS) & may(n), n))
        return F.when(F.exists(g, lambda x: x.isin(own)) & may(F.size(F.array_distinct(w)) - 1), size)

    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    rows = each.select("fit", let(words, lambda w: let(held(w), lambda g: F.struct(g.alias("grams"), pairs(w, g).alias("pairs")))).alias("key"))
    # cut, as the comparison with templates would otherwise be moved to each paragraph
    rows = cut(rows.groupBy("key", "fit").agg(F.count("*").alias("n")).select("key.*", "fit", "n"))
    table = F.array(*[F.array(*map(F.lit, t)) for t in templates])
    # a word pair in common is among the template's n-grams too
    share = let(F.filter("grams", lambda g: g.isin(own)), lambda p: F.array_max(F.transform(table, lambda t: F.greatest(F.size(F.array_intersect(t, F.col("grams"))) / F.size(t), F.coalesce(F.size(F.array_intersect(t, p)) / F.col("pairs"), F.lit(0.0))))))
    rows = rows.where(~F.exists("grams", lambda g: g.isin(near)) | (share < MIN_TEMPLATE))
    return rows.groupBy("grams", "fit").agg(F.sum("n").alias("n"))


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] = NOTICES) -> dict:
    """Weights by n-gram, intercepts, classes, the gate's words and the calibrated threshold.

    Fitted on variants of the notices and look-alikes and on half of all paragraphs of
    the corpus (those that hold most of a template's word pairs are left out). To the
    model a paragraph is the n-grams of the notices that it holds, so paragraphs are
    counted by these; USUAL_WEIGHT bounds the weight of all, not their number. The
    threshold is the licence probability that one in a thousand of the other half
    reaches, 0.5 at least."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    classes = [UNKNOWN, *sorted(notices)]
    told = [(v, float(classes.index(k))) for k, ts in notices.items() for t in ts for v in variants(t)] + [(v, 0.0) for t in NEGATIVES for v in variants(t)]
    told = cut(spark.createDataFrame(told, "text string, label double").select("label", grams(F.col("text")).alias("grams"), F.lit(VARIANT_WEIGHT).alias("weight")))
    vocabulary = [r[0] for r in told.where("label > 0").select(F.explode("grams").alias("g")).distinct().orderBy("g").collect()]
    order = F.xxhash64("doc_id", "paragraph", "text")
    each = _paragraphs(docs, id_col, text_col, []).select("text", (F.pmod(order, F.lit(2)) == 0).alias("fit"))
    usual = cut(_counted(each, vocabulary, notices))
    kinds, total = usual.where("fit").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = (F.col("n") * F.lit(min(1.0, USUAL_WEIGHT / max(1, total)))).alias("weight")
    count = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    count.setBinary(True)
    rows = count.transform(told.unionByName(usual.where("fit").select(F.lit(0.0).alias("label"), "grams", weight))).select("label", "weight", "features")
    rows = rows.coalesce(1 + kinds // FIT_ROWS).persist()
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.001, maxIter=TRAIN_ITERATIONS).fit(rows)
    rows.unpersist()
    weights, intercepts = fitted.coefficientMatrix.toArray().T, fitted.interceptVector.toArray()
    seen = usual.select(F.explode("grams").alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n")).collect()  # a row for each of the vocabulary, at most
    model = {"classes": classes, "weights": dict(zip(vocabulary, weights.tolist())), "intercepts": intercepts.tolist(), "notices": notices, "threshold": MIN_PROBABILITY}
    model["gate"] = gate_words(vocabulary, weights, intercepts, {r["g"]: r["n"] for r in seen})
    licence = F.array_max(F.slice(_probabilities(F.col("grams"), model), 2, len(classes) - 1))
    # all below the least threshold is one value to the aggregate
    above = usual.where("not fit").select(F.greatest(licence, F.lit(MIN_PROBABILITY)).alias("p"), "n").agg(F.percentile("p", F.lit(1 - FALSE_RATE), F.col("n"))).first()[0]
    model["threshold"] = above or MIN_PROBABILITY
    return model


def gate_words(vocabulary: list[str], weights: np.ndarray, intercepts: np.ndarray, seen: dict[str, int]) -> list[str]:
    """Words without which a paragraph's likeliest class is unknown, parted at dots and hyphens; common ones of the corpus are left out while that holds.

    The n-grams free of those words are finitely many, each counts once, and all of
    their weights for a licence class together don't lift it above unknown."""
    lift = np.maximum(weights[:, 1:] - weights[:, :1], 0.0)
    base = intercepts[1:] - intercepts[0]
    if base.max(initial=-np.inf) >= 0:
        return []
    grams_of: dict[str, list[int]] = {}
    open_ = np.zeros(len(vocabulary), int)  # gate words in each n-gram
    for i, g in enumerate(vocabulary):
        for w in set(g.split(" ")):
            grams_of.setdefault(w, []).append(i)
            open_[i] += 1
    gate, total = set(grams_of), base.copy()
    for w in sorted(grams_of, key=lambda w: (-seen.get(w, 0), w)):
        freed = [i for i in grams_of[w] if open_[i] == 1]
        more = total + lift[freed].sum(axis=0)
        if more.max() < 0:
            total = more
            open_[grams_of[w]] -= 1
            gate.discard(w)
    return sorted({part for w in gate for part in re.split("[.-]", w)})


def _agreement(templates: Column, found: Column) -> Column:
    """The largest share of a template's word pairs that the paragraph holds, or of the paragraph's that a template holds if it has some."""
    pairs = F.filter(found, lambda g: F.size(F.split(g, " ")) == 2)

    def share(p: Column) -> Column:
        return F.array_max(F.transform(templates, lambda t: let(F.size(F.array_intersect(t, found)), lambda n: F.greatest(n / F.size(t), F.when(F.size(p) >= MIN_PAIRS, F.size(F.array_intersect(t, p)) / F.size(p)).otherwise(0.0)))))

    # without templates (unknown) the pairs are not looked for
    return F.coalesce(F.when(templates.isNotNull(), let(pairs, share)), F.lit(0.0))


def _numbers(xs: list[float]) -> str:
    return "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"


def _probabilities(found: Column, model: dict) -> Column:
    """Class probabilities of a paragraph from its n-grams: softmax of the intercepts plus the weights of those in the vocabulary."""
    table = F.expr("map(" + ", ".join(f"'{g}', {_numbers(w)}" for g, w in model["weights"].items()) + ")")
    hits = F.filter(found, lambda g: g.isin(list(model["weights"])))
    logits = F.aggregate(hits, F.expr(_numbers(model["intercepts"])), lambda a, g: F.zip_with(a, F.element_at(table, g), lambda x, y: x + y))
    powers = let(logits, lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z))))
    return let(powers, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", min_template: float = MIN_TEMPLATE) -> DataFrame:
    """(doc_id, paragraph, family, predicted, probability, similarity, confirmed, text): every paragraph that may be a licence's by the model's weights.

    paragraph is the number of its first line, from 0. predicted is the likeliest
    class (of equal ones the first in the model's order), or unknown below the
    calibrated threshold; similarity is the largest share of word pairs that
    paragraph and a template of the predicted family have in common; confirmed where
    that reaches min_template; family is predicted if confirmed, else unknown.
    Paragraphs not returned are unknown. Null and empty texts give no row, very long
    ones are read whole, repeated rows give theirs again, empty tables none; other
    columns are not read."""
    rows = _paragraphs(docs, id_col, text_col, model["gate"]).withColumn("grams", grams(F.col("text")))
    classes = F.array(*map(F.lit, model["classes"]))
    p = rows.withColumn("p", _probabilities(F.col("grams"), model))
    best = F.array_max("p")
    likeliest = F.element_at(classes, F.array_position("p", best).cast("int"))
    p = p.withColumn("predicted", F.when(best >= model["threshold"], likeliest).otherwise(UNKNOWN)).withColumn("probability", best)
    held = F.create_map(*[c for k, ts in model["notices"].items() for c in (F.lit(k), F.array(*[F.array(*map(F.lit, _pairs(t))) for t in ts]))])
    p = p.withColumn("similarity", _agreement(F.try_element_at(held, "predicted"), F.col("grams")))
    confirmed = (F.col("predicted") != UNKNOWN) & (F.col("similarity") >= min_template)
    return p.select("doc_id", "paragraph", F.when(confirmed, F.col("predicted")).otherwise(UNKNOWN).alias("family"), "predicted", "probability", "similarity", confirmed.alias("confirmed"), "text")


def _pairs(text: str) -> list[str]:
    words = re.findall(_WORD, text.lower())
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:]))) or words
