"""Licence notices in documents, paragraph by paragraph.

A sparse logistic regression over hashed word n-grams, trained here on licence notices, on notices of made-up licences and on other
text, scores every paragraph. It names a family, says ``unknown`` (a licence, but none it knows) or ``none``; a family below a
calibrated threshold is ``unknown`` as well. A prediction is confirmed if the paragraph shares enough word triples with one of the
family's notices. The weights become two constant arrays, so scanning is one narrow pass with one lookup for each n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.base import bind, stored, text_of
from repolens.llm.pii import scan

# Notices of each family as they are commonly written.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    ("mit", "Lizenziert unter der MIT-Lizenz."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", "Released under the ISC License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("gpl-3.0", "Distributed under the GNU GPL v3."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation"),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd-2-clause", "Released under the BSD 2-Clause License."),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or later."),
    ("eupl-1.2", "This work is licensed under the European Union Public Licence, EUPL v1.2."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("epl-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright to this work. CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited. "
                    "Proprietary and confidential."),
)
# Sentences that mention licensing and grant nothing.
OTHER = (
    "You need a driving license to rent a car in this country.",
    "The committee discussed copyright law and the terms of the treaty.",
    "He obtained permission to publish the general results of the work.",
    "The warranty of this machine is limited to two years of use.",
    "The public library published version 3 of its catalogue under new terms.",
    "Fishing licenses are issued by the local office free of charge.",
    "Her poetic license with the facts was noted by the apache tribe.",
    "The software was redistributed to all branches in binary form.",
    "Rights of way are reserved for the public by common law.",
    "A marriage license was granted to the couple in version of the old form.",
)
# Notices of licences that do not exist: a made-up name stands for the braces.
MADE_UP = (
    "Licensed under the {} License, Version 2.0.", "Released under the {} License.", "Released under the {} license.", "Distributed under the {}.",
    "This work is licensed under the {} Public License, version 3.", "SPDX-License-Identifier: {}",
    "This program is made available under the terms of the {} License.", "Lizenziert unter der {}-Lizenz.", "Lizenziert unter der {}.",
    "Distribué sous la licence {}.", "Publicado bajo la licencia {}.", "Use of this software is governed by the {} Licence v1.1.",
    "Permission to use this work is granted under the terms of the {} agreement.", "Licensed under {} 4.0.",
)
NONE, UNKNOWN = "none", "unknown"
#: Variants made of each notice, with words left out or added; and background paragraphs taken at most.
VARIANTS, BACKGROUND = 40, 2_000
#: Places that n-grams are hashed to.
PLACES = 1 << 15
#: Share of a fourth of the variants that must be right above the threshold.
PRECISION = 0.99
#: Share of the smaller side's word triples that must agree with a notice of the family.
CONFIRMING = 0.5
FOUND = "licenses"


#: Letters and digits, and dots between two digits. Words are matched, as splitting at a negated class of these took most of the scan's time, the
#: more so the more threads of a JVM did it. Nothing is given back on a mismatch, so that long numbers with dots need no stack.
WORD = r"[a-z0-9]++(?:(?<=[0-9])\.(?=[0-9])[a-z0-9]++)*+"


def line_words(line: Column) -> Column:
    """Lower-case words, numbers with their dots."""
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def grams(words: Column) -> Column:
    """Words and word pairs, repeats included."""
    return bind(words, lambda w: F.concat(w, F.transform(F.slice(
        w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))))


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PLACES)).cast("int")


def triples(words: Column) -> Column:
    """Distinct word triples, or all the words of a shorter line."""
    return bind(words, lambda w: F.when(F.size(w) >= 3, F.array_distinct(F.transform(F.slice(
        w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2))))).otherwise(
        F.array(F.array_join(w, " "))))


def places(words: Column) -> Column:
    """The distinct places of a paragraph's n-grams."""
    return F.array_distinct(F.transform(grams(words), _place))


def _constant(values, kind: str) -> Column:
    """A constant array from one literal, which the optimizer folds."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class LicenseModel:
    families: tuple[str, ...]
    biases: tuple[float, ...]
    weights: tuple[tuple[int, tuple[float, ...]], ...]  # place of n-grams and its weight for each family
    threshold: float

    def probabilities(self, words: Column) -> Column:
        """The probability of each family, in order."""
        n = len(self.families)
        row_of = [-1] * PLACES
        for row, (place, _) in enumerate(self.weights):
            row_of[place] = row
        rows, biases = _constant(row_of, "int"), _constant(self.biases, "double")
        flat = _constant([w for _, ws in self.weights for w in ws] or [0.0], "double")
        # Each place has its own row, so repeats may go after the few known ones are left.
        known = F.array_distinct(F.filter(F.transform(grams(words), lambda g: F.get(rows, _place(g))), lambda r: r >= 0))
        sums = F.aggregate(known, biases, lambda acc, r: F.zip_with(acc, F.slice(flat, r * n + 1, F.lit(n)), lambda a, b: a + b))
        powers = bind(sums, lambda s: bind(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))
        return bind(powers, lambda p: bind(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(p, lambda x: x / total)))


#: A paragraph ends at blank lines, or where a line ends a sentence.
PARAGRAPH_END = r"(?:(?<=[.!?:;])[\x20\t\r]*+\n|\n[\x20\t\r]*+\n)(?:[\x20\t\r]*+\n)*+"


def paragraphs(text: Column) -> Column:
    """``array<struct<line, text>>``: the paragraphs of a text, wrapped lines joined, with the number (from 0) of their first line."""
    def newlines(part: Column) -> Column:
        return F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))

    cut = F.struct(F.split(text, PARAGRAPH_END, -1).alias("parts"), F.regexp_extract_all(text, F.lit(PARAGRAPH_END), F.lit(0)).alias("ends"))
    return bind(cut, lambda c: bind(
        F.zip_with(c["parts"], c["ends"], lambda part, end: F.struct(part.alias("part"), (newlines(part) + F.coalesce(newlines(end), F.lit(0))).alias("n"))),
        lambda rows: F.zip_with(
            rows, scan(F.transform(rows, lambda r: r["n"]), F.lit(0), lambda a, b: a + b),
            lambda r, before: F.struct(before.alias("line"), r["part"].alias("text")))))


def _agreeing(found: Column, given: Column) -> Column:
    """Whether enough triples of the smaller of two sets are in both."""
    return F.size(F.array_intersect(found, given)) >= CONFIRMING * F.least(F.size(found), F.size(given))


def _notices() -> Column:
    return F.array(*[F.struct(F.lit(f).alias("family"), triples(line_words(F.lit(text))).alias("triples")) for f, text in NOTICES])


def training_lines(docs: DataFrame, variants: int = VARIANTS, background: int = BACKGROUND) -> DataFrame:
    """``(family, words, fold)``: variants of the notices, of :data:`MADE_UP` ones and of :data:`OTHER`, and paragraphs of the documents.

    At most ``background`` paragraphs, of about as many documents, are taken by hashes, whole and of any kind but those that
    agree with a notice. They are the only rows from the corpus, and the bound makes their share of the training alike at every size.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame(
        [*NOTICES, *[(UNKNOWN, line) for line in MADE_UP], *[(NONE, line) for line in OTHER]], "family STRING, line STRING")
    made = given.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    letters = F.substring(F.sha2(F.concat("line", F.col("id").cast("string")), 256), 1, 8)
    name = F.translate(letters, "0123456789", "aeiouklmnr")
    named = F.when(F.col("family") == UNKNOWN, F.replace(F.col("line"), F.lit("{}"), F.initcap(name))).otherwise(F.col("line"))
    words = bind(line_words(named), lambda w: F.filter(w, lambda x, i: F.pmod(
        F.xxhash64("id", "line", i), F.lit(100)) >= F.when(F.col("id") == 0, 0).otherwise(F.when(F.size(w) > 6, F.col("id") % 4 * 5).otherwise(0))))
    extra = F.slice(F.array(*[F.lit(x) for x in "the of in and to for this that is with".split()]),
                    (F.col("id") % 7 + 1).cast("int"), (F.col("id") % 3).cast("int"))
    notices = made.select("family", F.concat(words, extra).alias("words"), F.pmod(F.xxhash64("id", "line"), F.lit(4)).alias("fold"))
    # About as many documents as paragraphs are wanted, so that no other text is looked at.
    share = min(1.0, background / max(1, docs.count()))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("l")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    cut = picked.select(F.explode(paragraphs(text_of())).alias("p")).select(line_words(F.col("p.text")).alias("words")).filter(F.size("words") > 0)
    unlike = cut.filter(bind(triples(F.col("words")), lambda t: ~F.exists(_notices(), lambda n: _agreeing(n["triples"], t))))
    some = unlike.select(F.xxhash64("words").alias("h"), "words").orderBy("h", "words").limit(background)
    # Text in words that nothing is known of is no licence, in whatever language.
    strange = spark.range(0, background // 2, 1, 1).select(F.lit(NONE).alias("family"), F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("id") % 12 + 1), lambda k: F.translate(F.substring(F.sha2(F.concat(
            F.lit("w"), k.cast("string"), F.lit("-"), F.col("id").cast("string")), 256), 1, 7), "0123456789", "aeiouklmnr")).alias("words"),
        F.pmod("id", F.lit(4)).alias("fold"))
    return notices.unionByName(strange).unionByName(some.select(F.lit(NONE).alias("family"), "words", F.pmod(F.col("h"), F.lit(4)).alias("fold")))


def train(docs: DataFrame, variants: int = VARIANTS, background: int = BACKGROUND) -> LicenseModel:
    """Fit the regression on three fourths of the training paragraphs and calibrate the threshold on the rest.

    The rest has made-up licences whose names the fit has not seen: the threshold is the least probability from which a named family is right
    in a share of :data:`PRECISION`, made-up and other text counted as mistakes.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    lines = training_lines(docs, variants, background)
    rows = stored(lines.withColumn("grams", F.transform(places(F.col("words")), lambda p: p.cast("string"))), "license-lines").coalesce(4)
    families = tuple(sorted({f for f, _ in NOTICES})) + (NONE, UNKNOWN)
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    rows = rows.withColumn("label", number)
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=3.0, vocabSize=8192).fit(rows)
    fitted = LogisticRegression(
        family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=80, standardization=False).fit(
        counter.transform(rows.filter("fold > 0")))
    matrix = fitted.coefficientMatrix.toArray()
    weights = tuple(
        (int(place), tuple(float(x) for x in matrix[:, k])) for k, place in enumerate(counter.vocabulary) if abs(matrix[:, k]).max() > 1e-6)
    biases = [0.0] * len(families)
    biases[: len(fitted.interceptVector)] = [float(x) for x in fitted.interceptVector]
    model = LicenseModel(families, tuple(biases), weights, 0.5)
    scored = rows.filter("fold = 0").select(
        "label", model.probabilities(F.col("words")).alias("p")).select(
        "label", F.array_max("p").alias("top"), (F.expr("array_position(p, array_max(p))") - 1).alias("guess")).collect()
    ranked = sorted(((r["top"], r["guess"] == r["label"]) for r in scored if families[int(r["guess"])] not in (NONE, UNKNOWN)), reverse=True)
    right, threshold = 0, 1.0
    for n, (top, good) in enumerate(ranked, 1):
        right += good
        if right / n >= PRECISION:
            threshold = top
    return LicenseModel(families, tuple(biases), weights, threshold)


def with_licenses(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """The rows with ``licenses``: ``array<struct<line, family, probability, confirmed>>`` (replaces such a column).

    Every paragraph is scored; ``line`` is its first line, from 0. Those that the model doesn't take for other text are listed, as ``unknown`` where
    it knows no such licence or is not sure enough; these are never confirmed. Ties go to the first family by name. Null text is empty;
    repeated rows and null ids stay.
    """
    names = F.array(*[F.lit(f) for f in model.families])

    def judged(line: Column, paragraph: Column) -> Column:
        def of(words: Column) -> Column:
            def best(p: Column) -> Column:
                top = F.array_max(p)
                name = F.get(names, (F.array_position(p, top) - 1).cast("int"))
                family = F.when(name.isin(NONE, UNKNOWN) | (top >= model.threshold), name).otherwise(UNKNOWN)
                return F.struct(line.alias("line"), family.alias("family"), top.alias("probability"), words.alias("words"))

            return bind(model.probabilities(words), best)

        return bind(line_words(paragraph), of)

    def compared(found: Column) -> Column:
        agrees = bind(triples(found["words"]), lambda t: F.exists(
            _notices(), lambda n: (n["family"] == found["family"]) & _agreeing(n["triples"], t)))
        return F.struct(
            found["line"].alias("line"), found["family"].alias("family"), found["probability"].alias("probability"), agrees.alias("confirmed"))

    worded = F.filter(paragraphs(text_of()), lambda p: p["text"].rlike("[A-Za-z0-9]"))
    listed = F.filter(F.transform(worded, lambda p: judged(p["line"], p["text"])), lambda f: f["family"] != NONE)
    return docs.drop(FOUND).withColumn(FOUND, F.transform(listed, compared))
