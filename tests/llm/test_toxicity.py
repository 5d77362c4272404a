import random

import pytest
from pyspark.sql import functions as F

from repolens.llm.toxicity import (
    held_out,
    held_out_recall,
    maximal_segments,
    token_column,
    tokens,
    train,
    training_rows,
    with_toxicity,
)


def plain_segments(scores):
    found = []

    def search(first, end):
        best = None
        for i in range(first, end):
            total = 0.0
            for j in range(i, end):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-9):
                    best = total, i, j + 1
        if best:
            search(first, best[1])
            found.append((best[1], best[2]))
            search(best[2], end)

    search(0, len(scores))
    return found


@pytest.mark.parametrize("seed", range(40))
def test_all_maximal_segments(seed):
    rnd = random.Random(seed)
    for _ in range(30):
        scores = [rnd.uniform(0.1, 3) if rnd.random() < 0.4 else -0.9371 for _ in range(rnd.randint(0, 14))]
        found = maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], -0.9371)
        assert [(a, b) for a, b, _ in found] == plain_segments(scores)
        for a, b, s in found:
            assert s == pytest.approx(sum(scores[a:b]))


def test_segments_of_a_long_text_are_linear():
    found = maximal_segments([(2 * i, 1.0) for i in range(200_000)], -1.5)
    assert len(found) == 200_000


def test_tokens_agree(spark):
    texts = ["A-b É_c 9", "", "x\n\ty", "--"]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING").select("text", token_column(F.col("text")).alias("t"))
    for r in rows.collect():
        assert [t.encode() for t in r["t"]] == tokens(r["text"])


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(600):
        toxic = k % 5 == 0
        words = [f"w{rnd.randint(0, 200)}" for _ in range(80)]
        if toxic:
            at = rnd.randint(0, 60)
            words[at : at + 6] = [rnd.choice(["vile", "nasty"]) for _ in range(6)]
        rows.append((k, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id LONG, text STRING, toxic INT")
    return table.select("doc_id", "text"), table.select("doc_id", "toxic")


def test_held_out_documents_are_told_apart(spark, labelled):
    docs, labels = labelled
    model = train(docs, training_rows(labels))
    assert {b"vile", b"nasty"} == set(model.scores)
    scored = with_toxicity(docs, model).join(labels, "doc_id").filter(held_out()).collect()
    assert len(scored) > 80 and all((r["toxic_score"] >= 0.5) == (r["toxic"] == 1) for r in scored)
    for r in scored:
        for s in r["toxic_segments"]:
            passage = r["text"].split()[s["start"] : s["end"]]
            assert passage and set(passage) == {"vile", "nasty"} or len(set(passage)) == 1


def test_nulls_repeats_and_clashing_names(spark, labelled):
    model = train(*labelled)
    rows = [(None, None, "p"), (1, "", "q"), (1, "", "q"), (2, "x " * 300_000 + "vile nasty vile nasty vile", "r")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, toxic_score STRING")
    found = with_toxicity(docs, model).collect()
    assert len(found) == 4 and all(0 <= r["toxic_score"] <= 1 for r in found)
    assert sum(r["toxic_score"] >= 0.5 for r in found) == 1


def test_without_labels_and_rows(spark, labelled):
    docs, labels = labelled
    model = train(docs, labels.limit(0))
    assert [r["toxic_score"] for r in with_toxicity(docs.limit(1), model).collect()] == [0.5]
    assert with_toxicity(docs.limit(0), model).count() == 0
    known = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0)], "doc_id LONG, toxic INT")
    assert all(r["toxic_score"] < 0.5 for r in with_toxicity(docs.limit(3), train(docs, known)).collect())


@pytest.mark.parametrize("seed", range(5))
def test_segments_with_scores_of_their_own_below_zero(seed):
    rnd = random.Random(seed)
    for _ in range(30):
        scores = [rnd.choice([rnd.uniform(0.1, 3), -rnd.uniform(0.1, 2), -0.9371]) for _ in range(rnd.randint(0, 14))]
        found = maximal_segments([(i, s) for i, s in enumerate(scores) if s != -0.9371], -0.9371)
        assert [(a, b) for a, b, _ in found] == plain_segments(scores)


def test_a_language_with_few_labels_has_its_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = held_out_recall(with_toxicity(docs, train(docs, training_rows(labels))), labels, "lang").collect()
    assert {r["lang"] for r in found} == {"en", "de", "fr", "es"}
    for r in found:
        assert r["n_caught"] >= 0.85 * r["n_toxic"] and r["n_false"] <= 0.02 * r["n_clean"], r
