"""Licence scan: a trained paragraph classifier in DataFrame operations only.

A paragraph is a line of the text or a run of lines without a blank one between them, as far as the longest
notice may be wrapped; it starts and ends at a line that has to do with a word pair of a notice. A multinomial
logistic regression over its words and word pairs knows one class for each licence family and one for anything
else. It is trained here, on variants of the notices below and on sentences that only sound like them; its
temperature is set on the notices and sentences of CALIBRATION, which are worded in other ways. A prediction counts if its
calibrated chance is at least LEAST and a notice of that family confirms it: at least CONFIRM of the notice's word
pairs stand in the paragraph.

What no notice can confirm is left out early, which changes no result: texts without any of CUES and CUE_PAIRS lack too
many pairs of every notice, and so do blocks of lines that hold less than CONFIRM of the pairs of each.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, join_skewed

# fixed values: notices by licence family
NOTICES = {
    "agpl-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL license, version 3.", "GNU Affero General Public License version 3", "SPDX License Identifier AGPL 3.0"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license.", "SPDX License Identifier Apache 2.0", "Apache License Version 2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3 Clause License.", "Licensed under the BSD 2 Clause License.", "SPDX License Identifier BSD 3 Clause", "BSD 3 Clause License", "BSD 2 Clause License", "under the BSD license"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "under CC BY 4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    "cc0": ("Licensed under CC0 1.0 Universal, a public domain dedication.", "This work is dedicated to the public domain under the CC0 license.", "CC0 1.0 Universal"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Released under the GPL license, version 2.", "SPDX License Identifier GPL 2.0", "Licensed under the GNU GPL v2.", "GNU General Public License version 2"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GPL license, version 3.", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX License Identifier GPL 3.0", "Licensed under the GNU GPL v3.", "GNU General Public License version 3"),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify and distribute this software for any purpose with or without fee is hereby granted.", "ISC License"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL license, version 2.1.", "GNU Lesser General Public License version 3", "SPDX License Identifier LGPL 3.0"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX License Identifier MIT", "MIT License", "MIT licensed"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0.", "Mozilla Public License version 2.0"),
    "proprietary": ("Copyright, all rights reserved. No part of this work may be reproduced without written permission of the copyright owner.", "This software is proprietary and licensed under a commercial license only.", "All rights reserved.", "Copyright, all rights reserved."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense license.", "under the Unlicense"),
}
UNKNOWN = "unknown"
#: Sentences of the class for anything else.
OTHERS = (
    "You need a valid driver license to rent the car.", "The license plate was found under the bridge.", "She is a licensed engineer with ten years of work.", "The city renewed the business license of the shop.", "Please read the license agreement before you install the program.",
    "The museum is open to the public on Sunday.", "A version of the story was released in spring.", "The apache helicopter landed near the base.", "Students at the university use the library for free.", "The fishing license is valid for one year.",
    "The permission of the owner is needed to enter the field.", "He wrote the copy and the source of the text is unknown.", "The general met the public in the town hall.", "The terms of the contract are the following.", "Copyright law is a hard subject.", "This file is part of the report.", "The new creative team works in common rooms.", "Software is written by people and used by others.",
)
#: Other wordings, by which the temperature is set: (family, text).
CALIBRATION = (
    ("mit", "The code is available under MIT License"), ("mit", "Distributed under the terms of the MIT License, see the file LICENSE for details"), ("mit", "this package is MIT licensed"), ("mit", "Released under the MIT"),
    ("apache-2.0", "The project is made available under the Apache License Version 2.0 by its authors"), ("apache-2.0", "Apache License, Version 2.0, January 2004"), ("bsd", "You can use it under the BSD license of the university"), ("bsd", "This module has a BSD 3 Clause License"),
    ("gpl-3.0", "Licensed under the GNU GPL v3 or later"), ("gpl-3.0", "you may copy it under the terms of the GNU General Public License version 3 or any later version"), ("gpl-2.0", "The kernel is under the GNU General Public License version 2 only"), ("agpl-3.0", "The server is covered by the GNU Affero General Public License version 3"),
    ("lgpl", "linked as allowed by the GNU Lesser General Public License version 3"), ("mpl-2.0", "If a copy of the Mozilla Public License version 2.0 was not distributed you can obtain one"), ("isc", "The tool is given away under the ISC License"), ("cc-by", "This work is released under CC BY 4.0"), ("cc-by", "Text and pictures are available under CC BY 4.0 unless noted"),
    ("cc-by-sa", "Content is available under CC BY SA 4.0 unless otherwise noted"), ("cc-by-nc", "photos may be shared under CC BY NC 4.0"), ("cc-by-nc-sa", "slides under CC BY NC SA 4.0"), ("cc-by-nc-nd", "the film is under CC BY NC ND 4.0"), ("cc0", "the data set is published under CC0 1.0 Universal"),
    ("proprietary", "Copyright 2024 Acme Inc. All rights reserved."), ("proprietary", "Unauthorised copying is forbidden, all rights reserved"), ("unlicense", "given to the world under the Unlicense"),
    ("unknown", "The dog license must be renewed in the town hall"), ("unknown", "He studied at MIT and lives in Boston"), ("unknown", "The apache tribe lived in the south west"), ("unknown", "A version of the license was shown to the public"), ("unknown", "She holds a license to teach and a commercial license to fly"), ("unknown", "The software was released in May, version 2.0 in June"),
    ("unknown", "You may not use the pool without permission"), ("unknown", "the general public is free to enter the park"), ("unknown", "All seats are reserved for members"), ("unknown", "The rights of the authors are discussed in the next part"), ("unknown", "The foundation published a report on free software"), ("unknown", "Terms and conditions apply to the use of this card"), ("unknown", "The weather was warm and the streets were empty"),
)
#: What is tried as temperature, from a twentieth to twenty.
TEMPERATURES = tuple(20.0 ** (i / 40) for i in range(-40, 41))
LEAST = 0.5
CONFIRM = 0.7
_WORD = "[a-z0-9]+"


def grams(text: str) -> set[str]:
    words = re.findall(_WORD, text.lower())
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def pairs(text: str) -> set[str]:
    return {g for g in grams(text) if " " in g}


CUES = ("licen", "copyright", "permi", "redistrib", "spdx", "public", "software", "reserved", "gnu", "mozilla", "commons", "unencumbered")


def _cue_pairs() -> tuple[tuple[str, str], ...]:
    """Word pairs of notices that CUES take besides them, so that whatever CONFIRM accepts holds one: a text
    without any lacks more of each notice's pairs than may be missing."""
    out = []
    for own in (pairs(n) for ns in NOTICES.values() for n in ns):
        spare = len(own) - next(k for k in range(len(own) + 1) if k / len(own) >= CONFIRM)
        held = {p for p in own if any(c in w for c in CUES for w in p.split()) or tuple(p.split()) in out}
        rest = sorted(own - held, key=lambda p: (-len(p), p))
        out += [tuple(p.split()) for p in rest[: max(0, spare + 1 - len(held))]]
    return tuple(out)


CUE_PAIRS = _cue_pairs()


@dataclass
class Model:
    classes: list[str]  # UNKNOWN is the last
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float

    def chances(self, text: str) -> np.ndarray:
        logits = (self.bias + sum((self.weights[g] for g in sorted(grams(text)) if g in self.weights), np.zeros(len(self.bias)))) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()


def _variants(rng: random.Random, n: int) -> list[tuple[str, int]]:
    """Notices with words lost, put before or after, or cut off; other sentences likewise; and words out of order."""
    names = list(NOTICES)
    filler = sorted({w for s in OTHERS for w in re.findall(_WORD, s.lower())})
    common = sorted({w for ns in NOTICES.values() for s in ns for w in re.findall(_WORD, s.lower())})
    out = []
    for _ in range(n):
        for k, name in enumerate(names):
            words = re.findall(_WORD, rng.choice(NOTICES[name]).lower())
            if rng.random() < 0.4 and len(words) > 8:
                del words[rng.randrange(len(words))]
            out.append((" ".join([*rng.choices(filler, k=rng.choice((0, 0, 3, 8))), *words, *rng.choices(filler, k=rng.choice((0, 0, 3, 8)))]), k))
        for _ in range(6):
            words = re.findall(_WORD, rng.choice(OTHERS).lower())
            out.append((" ".join([*words, *rng.choices(filler, k=rng.choice((0, 4, 12)))]), len(names)))
            out.append((" ".join(rng.choices(common, k=rng.choice((3, 8, 15)))), len(names)))
            out.append((" ".join(rng.choices(filler, k=rng.choice((3, 8, 15)))), len(names)))
    return out


@lru_cache(maxsize=1)
def model() -> Model:
    rng = random.Random(5)
    rows = _variants(rng, 60)
    vocabulary = {g: i for i, g in enumerate(sorted({g for ns in NOTICES.values() for s in ns for g in grams(s)}))}
    classes = [*NOTICES, UNKNOWN]

    def matrix(data: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(data), len(vocabulary) + 1))
        x[:, -1] = 1
        for i, (text, _) in enumerate(data):
            x[i, [vocabulary[g] for g in grams(text) if g in vocabulary]] = 1
        return x, np.array([k for _, k in data])

    x, y = matrix(rows)
    target = np.eye(len(classes))[y]
    w, speed = np.zeros((x.shape[1], len(classes))), np.zeros((x.shape[1], len(classes)))
    for _ in range(250):  # gradient descent with momentum and a small L2 penalty
        logits = x @ w
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 0.3 * (x.T @ (p - target) / len(x) + 1e-4 * w)
        w = w + speed
    hx, hy = matrix([(text, classes.index(family)) for family, text in CALIBRATION])

    def loss(t: float) -> float:
        logits = hx @ w / t
        logits -= logits.max(axis=1, keepdims=True)
        return float(-(logits[np.arange(len(hy)), hy] - np.log(np.exp(logits).sum(axis=1))).mean())

    temperature = min(TEMPERATURES, key=loss)
    return Model(classes, {g: w[i] for g, i in vocabulary.items()}, w[-1], temperature)


#: Words of the longest notice, twice: what may stand between the first and the last line of a run.
REACH = 2 * max(len(re.findall(_WORD, n.lower())) for ns in NOTICES.values() for n in ns)


def _once(x: F.Column, f) -> F.Column:
    """f(x), with `x` worked out once however often f looks at it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _enough() -> F.Column:
    """For each notice its word pairs, as " a b ", and how many of them CONFIRM asks for."""
    notices = [sorted(pairs(n)) for ns in NOTICES.values() for n in ns]
    need = [next(k for k in range(len(p) + 1) if k / len(p) >= CONFIRM) for p in notices]
    return F.array(*[F.struct(F.array(*[F.lit(f" {x} ") for x in p]).alias("pairs"), F.lit(k).alias("need")) for p, k in zip(notices, need, strict=True)])


def _present(words, among: F.Column) -> F.Column:
    """The pairs of `among` that stand in `words`, whose words are between single spaces."""
    return _once(words, lambda w: F.filter(among, lambda p: F.contains(w, p)))


def _confirmable(present) -> F.Column:
    """Whether a notice has enough of its pairs among those that are present."""
    return F.exists(_enough(), lambda n: F.size(F.array_intersect(n["pairs"], present)) >= n["need"])


def _runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, paragraph, last, words) of each paragraph, from the line `paragraph` to `last`, that a notice can confirm."""
    low = F.lower(F.col(text_col))
    own = docs.where(_once(low, _has_cue)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.split(F.regexp_replace(low, r"[^a-z0-9\n]+", " "), "\n").alias("lines"))
    # lines bear their number, so that blocks between blank lines can be taken apart
    numbered = F.transform("lines", lambda x, i: F.when(F.trim(x) == "", "").otherwise(F.concat(i.cast("string"), F.lit(":"), F.trim(x))))
    every = F.array(*[F.lit(f" {p} ") for p in sorted({p for ns in NOTICES.values() for n in ns for p in pairs(n)})])
    whole = lambda block: F.concat(F.regexp_replace(block, r"(?:^|\n)(?:[0-9]+:)?", " "), F.lit(" "))
    blocks = F.transform(F.split(F.array_join(numbered, "\n"), "\n\n+"), lambda x: F.struct(x.alias("block"), _present(whole(x), every).alias("present")))
    blocks = own.select("row", "id", F.explode(F.filter(blocks, lambda x: _confirmable(x["present"]))).alias("b"))
    line = F.transform(F.filter(F.split("b.block", "\n"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("no"), F.substring_index(x, ":", -1).alias("words")))
    lines = blocks.select("row", "id", "b.present", F.explode(F.array(line)).alias("l")).select("row", "id", "present", F.col("l.no").alias("no"), F.col("l.words").alias("w"))
    # a paragraph starts and ends where a pair stands, maybe with a word of the next line or the one before
    edge = lambda at, count: F.coalesce(F.substring_index(F.get("w", at), " ", count), F.lit(""))
    touches = lambda words: _once(words, lambda w: F.exists("present", lambda p: F.contains(w, p)))
    starts = F.transform("w", lambda x, i: touches(F.concat(F.lit(" "), x, F.lit(" "), edge(i + 1, 1), F.lit(" "))))
    ends = F.transform("w", lambda x, i: touches(F.concat(F.lit(" "), edge(i - 1, -1), F.lit(" "), x, F.lit(" "))))
    lines = lines.select("*", F.explode(F.array(F.struct(starts.alias("starts"), ends.alias("ends")))).alias("at"))
    lines = lines.select("row", "id", "present", "no", "w", F.col("at.ends").alias("ends"), F.explode(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("at.starts", i))).alias("i"))
    # a line between others has a word at least, so no run has more than REACH of them
    joined = lambda j: F.array_join(F.slice("w", F.col("i") + 1, j - F.col("i") + 1), " ")
    between = lambda j: F.array_join(F.slice("w", F.col("i") + 2, F.greatest(j - F.col("i") - 1, F.lit(0))), " ")
    enough = lambda j: _confirmable(_present(F.concat(F.lit(" "), joined(j), F.lit(" ")), F.col("present")))
    last = F.filter(F.sequence("i", F.least(F.size("w") - 1, F.col("i") + REACH)), lambda j: F.get("ends", j) & (F.size(F.split(between(j), " ")) < REACH) & enough(j))
    runs = lines.select("*", F.explode(last).alias("j"))
    return runs.select("row", "id", F.get("no", F.col("i")).alias("paragraph"), F.get("no", F.col("j")).alias("last"), joined(F.col("j")).alias("words"))


def _has_cue(text: F.Column) -> F.Column:
    cond = F.lit(False)
    for cue in CUES:
        cond = cond | F.contains(text, F.lit(cue))
    for a, b in CUE_PAIRS:
        cond = cond | (F.contains(text, F.lit(a)) & F.contains(text, F.lit(b)) & text.rlike(rf"(?<![a-z0-9]){a}[^a-z0-9]+{b}(?![a-z0-9])"))
    return cond


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, chance, similarity) for each paragraph (its first line, counted from 0) that
    holds a confirmed licence notice, and no shorter one of the family does; runs that overlap are one. Ties between
    families go to the one that NOTICES has first. Repeated rows give repeated rows; null and empty texts and an empty
    table give none; other columns are not looked at."""
    m = model()
    spark = docs.sparkSession
    lines = cut(_runs(docs, id_col, text_col))
    # each different paragraph is judged once
    counts = cut(lines.groupBy("words").agg(F.count("*").alias("n")))
    texts = counts.select("words", F.split("words", " ").alias("w"))
    two = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    texts = texts.select("words", F.array_distinct(F.concat("w", F.when(F.size("w") > 1, two).otherwise(F.array().cast("array<string>")))).alias("grams"))
    # the tables of weights and notices are as small as the constants above
    weights = F.broadcast(spark.createDataFrame([(g, [float(v) for v in w]) for g, w in m.weights.items()], "gram string, weight array<double>"))
    sums = [F.sum(F.col("weight")[i]).alias(f"s{i}") for i in range(len(m.classes))]
    logits = texts.select("words", F.explode("grams").alias("gram")).join(weights, "gram").groupBy("words").agg(*sums)
    logits = logits.select("words", F.array(*[(F.col(f"s{i}") + float(b)) / m.temperature for i, b in enumerate(m.bias)]).alias("z"))
    e = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
    logits = logits.select("words", e.alias("e")).select("words", F.array_position("e", F.lit(1.0)).cast("int").alias("at"), (F.lit(1.0) / F.aggregate("e", F.lit(0.0), lambda a, v: a + v)).alias("chance"))
    names = F.array(*[F.lit(c) for c in m.classes])
    judged = logits.select("words", F.element_at(names, F.col("at")).alias("family"), "chance").where((F.col("family") != UNKNOWN) & (F.col("chance") >= LEAST))
    notices = F.broadcast(spark.createDataFrame([(f, sorted(pairs(s))) for f, ns in NOTICES.items() for s in ns], "family string, pairs array<string>"))
    judged = judged.join(texts, "words").join(notices, "family").select("words", "family", "chance", (F.size(F.array_intersect("pairs", "grams")) / F.size("pairs")).alias("similarity"))
    judged = judged.groupBy("words").agg(F.first("family").alias("family"), F.first("chance").alias("chance"), F.max("similarity").alias("similarity")).where(F.col("similarity") >= CONFIRM)
    # one notice may stand in a large part of all documents that have any
    judged = cut(judged.join(counts, "words"))
    found = join_skewed(lines, judged, "words", "n").drop("n")
    of = Window.partitionBy("row", "family")
    inner = F.min("last").over(of.orderBy(F.desc("paragraph"), "last").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("inner", inner).where("inner IS NULL OR inner > last")
    found = found.withColumn("new", (F.col("paragraph") > F.coalesce(F.lag("last").over(of.orderBy("paragraph")), F.lit(-1))).cast("int"))
    found = found.withColumn("nth", F.sum("new").over(of.orderBy("paragraph")))
    found = found.groupBy("row", "id", "family", "nth").agg(F.min("paragraph").alias("paragraph"), F.max("chance").alias("chance"), F.max("similarity").alias("similarity"))
    return found.select(F.col("id").alias(id_col), "paragraph", "family", "chance", "similarity")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id and licence family found: paragraphs (how many), first_paragraph, chance and
    similarity (the highest). Rows that repeat an id are counted together."""
    found = paragraphs(docs, id_col, text_col)
    return found.groupBy(id_col, "family").agg(F.count("*").alias("paragraphs"), F.min("paragraph").alias("first_paragraph"), F.max("chance").alias("chance"), F.max("similarity").alias("similarity"))
