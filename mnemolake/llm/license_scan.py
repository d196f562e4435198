"""License scans: a trained paragraph classifier over sparse word n-grams, confirmed by templates.

A multinomial logistic regression over the presence of word n-grams (one to three words) is fitted on windows of
the templates below and on sentences that only sound like licences. Its weights are whole thousandths, so sums
are exact. A paragraph whose best family stays below a calibrated probability is unknown; otherwise a template of
that family must share enough n-grams with it. On the data all of it is DataFrame operations.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

UNKNOWN = "unknown"
#: Notices of well-known licences, as their publishers word them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "Licensed under GPLv2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "https://creativecommons.org/licenses/by/4.0/"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "https://creativecommons.org/licenses/by-sa/4.0/"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "https://creativecommons.org/licenses/by-nc/4.0/"),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain.", "This is free and unencumbered software released into the public domain."),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
}
#: Sentences with the words of licences that grant none.
SOUND_ALIKE = (
    "the driver lost his license last year and had to apply for a new one",
    "a copyright dispute between the two authors went to court",
    "she asked for permission to leave the room early",
    "the warranty of the car covers repairs for three years",
    "the apache helicopter landed near the village",
    "mit is a university in cambridge with many students",
    "version 2 of the game was released in the spring",
    "the public was free to use the park at any time",
    "the software crashed without any kind of notice",
    "all rights of way were closed by the general",
    "licensed plumbers charge more than others",
    "the foundation published its report under a new name",
    "terms of trade between the two countries improved",
    "this work took three years and is now complete",
    "the creative team shares a common room on the second floor",
    "the mozilla office moved to another building",
    "a fishing licence is required under the law of the land",
    "software license sales grew by ten percent this quarter",
    "public domain names are registered by the commission",
    "redistribution of income was the topic of the debate",
)
#: Words by which licence paragraphs are told from others at first; gate() adds what makes this lossless.
ANCHORS = ("licens", "licenc", "copyright", "permission", "warrant", "redistribut", "public domain", "rights reserved", "spdx", "creative commons", "creativecommons", "gpl", "cc by", "cc-by", "cc0", "proprietary")
STOP = frozenset("a an and any are as at be by for from in is it of on or that the this to with you may not".split())
FAMILIES = (*TEMPLATES, UNKNOWN)
MAX_N = 3
#: Share of held-out unknown windows that may pass for a family, and of a template's n-grams that must be found.
FALSE_RATE, CONFIRM = 0.01, 0.5


def grams(text: str) -> list[str]:
    """Word n-grams of lower-case a-z0-9 runs, once each, without single stop words."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, MAX_N + 1) for i in range(len(words) - n + 1) if n > 1 or words[i] not in STOP))


@lru_cache
def gate_words() -> tuple[str, ...]:
    """Whole words, so that no paragraph without one of them or of ANCHORS can be confirmed.

    Of each template, the n-grams without any of these are fewer than the share that must be found; words are
    added until that is so, longer words first and of those the one in most of the other n-grams.
    """
    words: list[str] = []
    notes = [[g.split() for g in grams(note) if not any(a in g for a in ANCHORS)] for own in TEMPLATES.values() for note in own]
    least = [CONFIRM * len(grams(note)) for own in TEMPLATES.values() for note in own]
    while True:
        weak = [g for own, n in zip(notes, least) if len(free := [g for g in own if not set(g) & set(words)]) >= n for g in free]
        if not weak:
            break
        count = Counter(w for g in weak for w in set(g) - STOP)
        words.append(min(count, key=lambda w: (len(w) < 4 or not w.isalpha(), -count[w], w)))
    return tuple(words)


def gate() -> str:
    """A pattern, for texts in lower case, of ANCHORS and gate_words()."""
    return "|".join(map(re.escape, ANCHORS)) + f"|(^|[^a-z0-9])({'|'.join(gate_words())})([^a-z0-9]|$)"


class Model:
    """vocabulary: n-gram -> whole weights by family; bias; threshold: least probability of a known family."""

    def __init__(self, seed: int = 11, steps: int = 300, decay: float = 2e-4):
        rng = np.random.default_rng(seed)
        texts: list[str] = []
        y: list[int] = []
        filler = [w for s in SOUND_ALIKE for w in s.split()]

        def windows(text: str, label: int, least: float, copies: int) -> None:
            words = text.split()
            for _ in range(copies):
                n = max(min(3, len(words)), int(len(words) * rng.uniform(least, 1)))
                i = int(rng.integers(0, len(words) - n + 1))
                around = [list(rng.choice(filler, int(rng.integers(0, 5)))) for _ in range(2)]
                texts.append(" ".join([*around[0], *words[i : i + n], *around[1]]))
                y.append(label)

        for k, notes in enumerate(TEMPLATES.values()):
            for note in notes:
                texts.append(note)
                y.append(k)
                windows(note, k, 0.75, 12)
        unknown = len(FAMILIES) - 1
        for s in SOUND_ALIKE:
            windows(s, unknown, 0.3, 30)
        for _ in range(200):
            texts.append(" ".join(rng.choice(filler, 12)))
            y.append(unknown)
        for notes in TEMPLATES.values():  # single words of templates are no licence
            for note in notes:
                for w in note.split():
                    texts.append(" ".join([w, *rng.choice(filler, 6)]))
                    y.append(unknown)
        known = sorted({g for notes in TEMPLATES.values() for note in notes for g in grams(note)})
        at = {g: i for i, g in enumerate(known)}
        x = np.zeros((len(texts), len(known)), np.float32)
        for i, t in enumerate(texts):
            x[i, [at[g] for g in grams(t) if g in at]] = 1
        label = np.array(y)
        held = np.arange(len(y)) % 5 == 4
        w, b = np.zeros((len(known), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        one = np.eye(len(FAMILIES), dtype=np.float32)[label]
        mw = vw = mb = vb = 0.0
        for step in range(1, steps + 1):
            z = x[~held] @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - one[~held]) / (~held).sum()
            gw, gb = x[~held].T @ g + decay * w, g.sum(0)
            mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.99**step
            w = w - 0.05 * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
            b = b - 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        weights, self.bias = np.rint(w * 1000).astype(int), np.rint(b * 1000).astype(int).tolist()
        self.vocabulary = {g: weights[i].tolist() for g, i in at.items()}
        p = np.array([self.probabilities(t) for t, h in zip(texts, held) if h])
        real = label[held]
        top = np.sort(p[real == unknown, :unknown].max(1))
        self.threshold = float(max(0.5, top[int(len(top) * (1 - FALSE_RATE))]))
        best = p.argmax(1)
        self.held_out_accuracy = float(np.mean(np.where(p.max(1) >= self.threshold, best, unknown) == real))
        self.templates = [(k, grams(note)) for k, notes in enumerate(TEMPLATES.values()) for note in notes]

    def scores(self, text: str) -> list[int]:
        return np.sum([self.bias, *(self.vocabulary[g] for g in grams(text) if g in self.vocabulary)], 0).tolist()

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.scores(text)) / 1000
        p = np.exp(z - z.max())
        return p / p.sum()


@lru_cache
def model() -> Model:
    """Fitted on the constants above, alike everywhere."""
    return Model()


def _words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.regexp_replace(low, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _runs_of(n: int) -> Column:
    return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.array().cast("array<string>"))


def _trie(words) -> str:
    """A pattern of the words that looks at their first letter once."""
    heads = {w[0]: [] for w in words}
    for w in words:
        heads[w[0]].append(re.escape(w[1:]))
    return "(?:" + "|".join(f"{re.escape(head)}(?:{'|'.join(rest)})" for head, rest in heads.items()) + ")"


@lru_cache
def quick(*more: str) -> str:
    """gate() and the parts of words `more` as a pattern that finds the same in less time; Java and Python read it, RE2 does not."""
    anywhere = (*ANCHORS, *more)
    return f"(?=[{''.join(sorted({w[0] for w in anywhere}))}]){_trie(anywhere)}|(?<![a-z0-9]){_trie(gate_words())}(?![a-z0-9])"


def _anchored(text: Column) -> Column:
    return F.lower(text).rlike(quick())


def _inline(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _judged(spark: SparkSession, words: DataFrame, key: list[str]) -> DataFrame:
    """key, family, probability, coverage, found (n-grams of the best template) of rows (key, words) that share an n-gram with the model.

    The family is unknown where the best one is not probable enough or no template of it confirms. The n-grams of the
    model come from the constants of this module, under 2,000 rows, and are broadcast. Scores and the n-grams found of
    each template are sums of one aggregation, so that the rows are read once.
    """
    m = model()
    k, n = len(FAMILIES), len(m.templates)
    vocabulary = F.broadcast(_inline(spark, [{"gram": g, "w": w + [int(g in own) for _, own in m.templates]} for g, w in m.vocabulary.items()], "gram:string,w:array<int>"))
    stop = F.array(*map(F.lit, sorted(STOP)))
    some = [F.filter("words", lambda w: ~F.array_contains(stop, w))]
    some += [_runs_of(n) for n in range(2, MAX_N + 1)]
    found = words.select(*key, F.explode_outer(F.array_distinct(F.concat(*some))).alias("gram")).join(vocabulary, "gram").drop_duplicates([*key, "gram"])
    sums = found.groupBy(*key).agg(F.array(*(F.sum(F.col("w")[i]) for i in range(k + n))).alias("s"))
    z = F.array(*((F.col("s")[i] + m.bias[i]) / 1000.0 for i in range(k)))
    scored = sums.select(*key, "s", z.alias("z"))
    top = F.array_max("z")
    share = 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    none = F.struct(F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("count"))
    cover = [none] * k
    for f in range(k - 1):
        own = [F.struct((F.col("s")[k + j] / len(grams)).alias("coverage"), F.col("s")[k + j].alias("count")) for j, (fam, grams) in enumerate(m.templates) if fam == f]
        cover[f] = F.array_max(F.array(*own))
    scored = scored.select(*key, "s", (F.array_position("z", top) - 1).cast("int").alias("best"), share.alias("probability"))
    scored = scored.select(*key, "best", "probability", F.array(*cover)[F.col("best")].alias("top"))
    sure = (F.col("probability") >= m.threshold) & (F.col("top.coverage") >= CONFIRM) & (F.col("best") < k - 1)
    names = F.array(*map(F.lit, FAMILIES))
    return scored.select(*key, F.when(sure, names[F.col("best")]).otherwise(UNKNOWN).alias("family"), "probability", F.col("top.coverage").alias("coverage"), F.col("top.count").alias("found"))


#: Words of the longest template: between its first and last line, a wrapped notice has fewer.
LONGEST = max(len(t.split()) for notes in TEMPLATES.values() for t in notes)


def _lines(text: Column) -> Column:
    """Whether a line may hold an anchor or the last word of one that is cut by a line end."""
    return F.lower(text).rlike(quick("domain", "reserved"))


def scan_spans(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), first, last (lines), family, probability, coverage, found of lines and runs of lines.

    A line is a paragraph of its own where it has a word of gate(). A run of lines may be a wrapped notice: it has no
    blank line, an anchor, and fewer words between its first and last line than the longest template; of these two
    lines only as many words count, so that the prose around a notice does not drown it. Runs are returned if they
    hold a notice. A run comes from its first line with an anchor alone. The texts are read once; generators are outer
    ones, since Spark would compute what an inner one takes a second time, for a filter before it.
    """
    key = ["doc_id", "h", "first", "last"]
    n = LONGEST
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(_lines(F.col("text"))).select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("lines"))
    marked = docs.select("*", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _lines(F.col("lines")[i])).alias("marks"))

    def around(at: Column, nth: Column) -> Column:
        low = F.greatest(F.lit(0), at - n)
        before = F.when(nth > 0, F.col("marks")[nth - 1]).otherwise(-1)
        return F.struct(at.alias("at"), before.alias("before"), low.alias("low"), _anchored(F.col("lines")[at]).alias("own"), F.slice("lines", low + 1, F.lit(2 * n + 1)).alias("near"))

    near = marked.select("doc_id", "h", F.explode_outer(F.transform("marks", around)).alias("m")).where("m is not null").select("doc_id", "h", "m.at", "m.before", "m.low", "m.own", F.transform("m.near", _words).alias("near"))
    sized = near.select("*", F.transform("near", lambda w: F.size(w)).alias("sizes"))

    def joined(first: Column, last: Column) -> Column:  # no blank line, and few words between
        own = F.slice("sizes", first - F.col("low") + 1, last - first + 1)
        inner = F.slice("sizes", first - F.col("low") + 2, F.greatest(last - first - 1, F.lit(0)))
        return ~F.array_contains(own, 0) & (F.aggregate(inner, F.lit(0), lambda x, y: x + y) < n)

    span = lambda i, j: F.struct(i.alias("first"), j.alias("last"))
    reach = sized.select("*", F.filter(F.sequence("low", "at"), lambda i: (i > F.col("before")) & joined(i, F.col("at"))).alias("starts"), F.filter(F.sequence(F.col("at"), F.col("low") + F.size("near") - 1), lambda i: joined(F.col("at"), i)).alias("ends"))
    runs = F.flatten(F.transform("starts", lambda i: F.transform(F.filter("ends", lambda j: (j > i) & joined(i, j)), lambda j: span(i, j))))
    line = F.when(F.col("own"), F.array(span(F.col("at"), F.col("at")))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))
    spans = reach.select("doc_id", "h", "low", "near", F.explode_outer(F.concat(line, runs)).alias("span")).where("span is not null")
    run = spans.select("doc_id", "h", "span.*", F.expr("slice(near, span.first - low + 1, span.last - span.first + 1)").alias("run"))
    tail = F.expr(f"slice(run[0], greatest(1, size(run[0]) - {n - 1}), {n})")
    whole = F.concat(tail, F.flatten(F.expr("slice(run, 2, greatest(size(run) - 2, 0))")), F.expr(f"slice(run[size(run) - 1], 1, {n})"))
    words = run.select(*key, F.when(F.size("run") > 1, whole).otherwise(F.col("run")[0]).alias("words"))
    return _judged(spark, words, key).where((F.col("family") != UNKNOWN) | (F.col("first") == F.col("last")))


def _notices(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, h, family of every line and wrapped notice.

    A run of lines counts if it holds more of a template than any line of it alone and any run that overlaps it
    (of equals the shorter, then the first); the lines with anchors in it do not count on their own. All windows are
    of one text each, so the rows are dealt by it once.
    """
    known = F.when(F.col("family") != UNKNOWN, F.col("found")).otherwise(-1)
    spans = scan_spans(spark, documents).select("doc_id", "h", "first", "last", "family", known.alias("found"), (F.col("last") > F.col("first")).alias("run"))
    at = spans.repartition("doc_id", "h").select("*", F.explode_outer(F.sequence("first", "last")).alias("line"))
    line = W.partitionBy("doc_id", "h", "line")
    ranked = at.withColumn("rank", F.row_number().over(line.orderBy(F.desc("found"), F.expr("last - first"), "first")))
    judged = ranked.withColumn("wins", F.max("rank").over(W.partitionBy("doc_id", "h", "first", "last")) == 1)
    taken = judged.withColumn("taken", F.max(F.col("wins") & F.col("run")).over(line))
    return taken.where((F.col("run") & F.col("wins") & (F.col("line") == F.col("first"))) | (~F.col("run") & ~F.col("taken"))).select("doc_id", "h", "family")


def scan_licenses(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Per document: doc_id, licenses (families in order, comma-joined, empty if none), n_licensed and n_unknown (lines and wrapped notices).

    Null and empty texts have none; rows that repeat are each returned. Only lines with an anchor, and those near them, move
    beyond their own task, so hot sources or long documents gather nowhere.
    """
    found = _notices(spark, documents).groupBy("doc_id", "h").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))), ",").alias("licenses"),
        F.sum((F.col("family") != UNKNOWN).cast("long")).alias("n_licensed"),
        F.sum((F.col("family") == UNKNOWN).cast("long")).alias("n_unknown"),
    )
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return docs.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.h = f.h"), "left").select("d.doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), zero("n_licensed"), zero("n_unknown"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, table(spark, sf_dir, "documents"))


def sql() -> str:
    m, k = model(), len(FAMILIES)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    vocabulary = ", ".join(f"({quote(g)}, {w})" for g, w in m.vocabulary.items())
    members = ", ".join(f"({quote(g)}, {i}, {f}, {len(own)})" for i, (f, own) in enumerate(m.templates) for g in own)
    anchored = lambda c: f"regexp_matches(lower({c}), {quote(gate())})"
    low = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    stop = "[" + ", ".join(map(quote, sorted(STOP))) + "]"
    z = ", ".join(f"(sum(w[{i + 1}]) + {m.bias[i]}) / 1000.0::DOUBLE" for i in range(k))
    parts = " || ".join([f"list_filter(w, lambda x: NOT list_contains({stop}, x))", *(f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))" for n in range(2, MAX_N + 1))])
    names = "[" + ", ".join(map(quote, FAMILIES)) + "]"
    return f"""
WITH v(gram, w) AS (VALUES {vocabulary}), t(gram, tmpl, fam, size) AS (VALUES {members}),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (SELECT rid, unnest(range(1, len(x) + 1)) AS p, unnest(x) AS line FROM (SELECT rid, split(text, chr(10)) AS x FROM d WHERE {anchored("text")})),
w AS (SELECT rid, p, list_filter(split(regexp_replace({low}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM l WHERE {anchored("line")}),
g AS MATERIALIZED (SELECT DISTINCT rid, p, gram FROM (SELECT rid, p, unnest({parts}) AS gram FROM w) SEMI JOIN v USING (gram)),
s AS (SELECT rid, p, [{z}] AS z FROM g JOIN v USING (gram) GROUP BY rid, p),
b AS (SELECT rid, p, list_position(z, list_max(z)) - 1 AS best, 1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS prob FROM s),
c AS (SELECT rid, p, fam, max(n / size) AS coverage FROM (SELECT rid, p, tmpl, fam, size, count(*) AS n FROM g JOIN t USING (gram) GROUP BY ALL) GROUP BY ALL),
f AS (SELECT b.rid, CASE WHEN prob >= {m.threshold!r} AND coalesce(coverage, 0) >= {CONFIRM} AND best < {k - 1} THEN {names}[best + 1] END AS family FROM b LEFT JOIN c ON b.rid = c.rid AND b.p = c.p AND b.best = c.fam),
a AS (SELECT rid, coalesce(string_agg(DISTINCT family, ',' ORDER BY family), '') AS licenses, count(family) AS n_licensed, count(*) - count(family) AS n_unknown FROM f GROUP BY rid)
SELECT d.doc_id, coalesce(a.licenses, '') AS licenses, CAST(coalesce(n_licensed, 0) AS BIGINT) AS n_licensed, CAST(coalesce(n_unknown, 0) AS BIGINT) AS n_unknown FROM d LEFT JOIN a USING (rid)
"""


QUERIES = {"op1_license_scan": op1_license_scan}
SQL = {"op1_license_scan": sql}
