import math
import random
import re
import time

import pytest

from pyspark.sql import functions as F

from repolens.llm.licenses import NOTICES, line_words, paragraphs, places, train, with_licenses


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, f"some words number {k} stand here\nand a second line of {k * k} things\nthe end") for k in range(300)]
    return train(spark.createDataFrame(rows, "doc_id LONG, text STRING"))


def licenses(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    found = {r["doc_id"]: r["licenses"] for r in with_licenses(rows, model).collect()}
    return [found[k] for k in range(len(texts))]


def test_each_notice_is_found_and_confirmed(spark, model):
    found = licenses(spark, model, [f"Intro line.\n{text}\n\nMore." for _, text in NOTICES])
    for k, (family, _) in enumerate(NOTICES):
        assert [(f["line"], f["family"], f["confirmed"]) for f in found[k]] == [(1, family, True)], (k, found[k])


# Notices as they come, and the families that are right.
AS_THEY_COME = {
    "Distributed under the GNU GPL v3.": {"gpl-3.0"},
    "Lizenziert unter der MIT-Lizenz": {"mit"},
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND': {"mit"},
    "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files (the \"Software\"),": {"mit"},
    "Released under the ISC license.": {"isc"},
    "SPDX-License-Identifier: BSD-2-Clause": {"bsd-2-clause"},
    "Licensed under the EUPL, Version 1.2": {"eupl-1.2"},
    "All rights reserved.": {"proprietary"},
    "Released under the Frobnitz license.": {"unknown"},
    "Lizenziert unter der Quux-Lizenz.": {"unknown"},
    "Licensed under the Zebra License, Version 2.0.": {"unknown", "apache-2.0"},
}


@pytest.mark.parametrize("text", AS_THEY_COME)
def test_notices_as_they_come(spark, model, text):
    (found,) = licenses(spark, model, [f"a first line of plain words.\n\n{text}\n\nand a last one"])
    assert len(found) == 1 and found[0]["line"] == 2 and found[0]["family"] in AS_THEY_COME[text], found
    assert found[0]["family"] != "unknown" or not found[0]["confirmed"]


def test_paragraphs(spark):
    texts = {"": [(0, "")], "a\nb": [(0, "a\nb")], "a.\nb\n\n \nc": [(0, "a."), (1, "b"), (4, "c")], "\n\nx": [(0, ""), (2, "x")],
             "a: \r\nb\n": [(0, "a:"), (1, "b\n")]}
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING").select("text", paragraphs(F.col("text")).alias("p")).collect()
    for r in rows:
        assert [tuple(p) for p in r["p"]] == texts[r["text"]], r["text"]


def test_scores_equal_plain_arithmetic(spark, model):
    texts = [t for _, t in NOTICES[:12]] + ["plain words of no kind", "license", "", "x " * 3000 + "released under the mit license"]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING").select(
        "text", places(line_words(F.col("text"))).alias("at"), model.probabilities(line_words(F.col("text"))).alias("p")).collect()
    weights = dict(model.weights)
    for r in rows:
        sums = list(model.biases)
        for place in r["at"]:
            sums = [a + b for a, b in zip(sums, weights.get(place, [0.0] * len(sums)), strict=True)]
        powers = [math.exp(s - max(sums)) for s in sums]
        assert all(abs(a - b / sum(powers)) < 1e-9 for a, b in zip(r["p"], powers, strict=True))


def test_threshold_is_calibrated(model):
    assert 1 / len(model.families) < model.threshold < 1.0


def test_other_texts_have_none(spark, model):
    texts = [None, "", "He lost his driving license on the way home.", "The old permission slip was lost by the teacher.",
             "words " * 50_000, "no notice"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, None, "y")],
                                 "doc_id LONG, text STRING, licenses STRING")
    found = with_licenses(docs, model)
    assert not any(f["confirmed"] for r in found.collect() for f in r["licenses"])
    assert with_licenses(docs.limit(0), model).count() == 0
    assert not re.search("Python|ArrowEval|Exchange", found._jdf.queryExecution().executedPlan().toString())


def test_words_are_letters_digits_and_dots_between_digits(spark):
    dealt = random.Random(3)
    texts = ["".join(dealt.choice("abZ0129...  -_\n\u00e9\u0130\u212a\u0663\U0001f600'") for _ in range(dealt.randint(0, 40))) for _ in range(3000)]
    texts += ["", ".", "v1.2.3.", "GPL-3.0-or-later", "1..2 .5 a.5 5.a 1.a2.3b", "1." * 100_000, "." * 100_000, "3.1" * 100_000]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "text STRING").select(
        "text", F.lower("text").alias("lower"), line_words(F.col("text")).alias("words")).collect()
    for r in rows:
        cut = None if r["lower"] is None else re.split(r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9])\.", r["lower"])
        assert r["words"] == (cut and [w for w in cut if w]), (r["text"] or "")[:60]


def test_words_cost_little_more_than_finding_them(spark):
    """Splitting at a negated class took several times as long as finding runs of letters, the more so the more threads did it."""
    text = F.concat(F.lit("\u00e9"), F.col("id").cast("string"), F.repeat(F.lit(" Plain words of some length, and version 2.0 of others."), F.lit(40)))
    docs = spark.range(0, 16_000, 1, 4).select(text.alias("text"))

    def seconds(column):
        best = math.inf
        for _ in range(4):
            start = time.perf_counter()
            docs.select(F.sum(F.size(column))).collect()
            best = min(best, time.perf_counter() - start)
        return best

    found = seconds(F.regexp_extract_all(F.lower(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)))
    taken = seconds(line_words(F.col("text")))
    assert taken < 5 * found, (taken, found)
