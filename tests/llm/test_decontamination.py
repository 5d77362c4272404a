import re

import pytest

from repolens.llm.decontamination import contamination, remove_spans, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "one two three four five six seven eight nine ten eleven Twelve"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(text, benchmark):
    found, hit, items = plain_words(text), set(), set()
    for item_id, item in benchmark:
        w = plain_words(item)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for k in range(len(found) - size + 1):
                if found[k : k + size] == w[i : i + size]:
                    hit |= set(range(k, k + size))
                    items.add(item_id)
    return len(found), len(hit), sorted(i for i in items if i is not None)


@pytest.mark.parametrize("text", [None, "", "A-b_c9", "É x É", "\x00a\x7fb"])
def test_words(text):
    assert [w.decode() for w in words(text)] == plain_words(text)


@pytest.mark.parametrize("block_items", [1000, 2])
def test_hits(spark, block_items):
    benchmark = [(1, ITEM), (2, "short item"), (3, None), (4, "..."), (None, "no id"), (1, ITEM), (10, ITEM + " more"), (5, "x")]
    texts = [
        None, "", ITEM, "before " + ITEM.upper() + ", after", ITEM.replace("six", "6"), "a Short, item. no id", "short items",
        "x x\nx", ("y " * 50 + ITEM + " ") * 3, " ".join(ITEM.split()[1:11]), "short item " * 2000]
    docs = spark.createDataFrame(
        [(k, t, 1.5) for k, t in enumerate(texts)] + [(2, ITEM, 2.5)], "doc_id LONG, text STRING, n_hit DOUBLE")
    table = spark.createDataFrame(benchmark, "item_id LONG, text STRING")
    for r in contamination(docs, table, block_items=block_items).collect():
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == plain(r["text"], benchmark), r["text"]
        hit = "".join(" " + r["text"][h["start"] : h["end"]] for h in r["hits"])
        assert len(plain_words(hit)) == r["n_hit"]


def test_passages_are_cut_out(spark):
    rows = [(1, "é clean words here " * 5 + ITEM + "! the end"), (2, ITEM), (3, None), (4, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    table = spark.createDataFrame([(1, ITEM)], "item_id LONG, text STRING")
    kept = {r["doc_id"]: r["text"] for r in remove_spans(contamination(docs, table)).collect()}
    assert kept == {1: "é clean words here " * 5 + "! the end", 3: None, 4: "nothing"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id LONG, text STRING")
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    assert [r["n_hit"] for r in contamination(docs, none).collect()] == [0]
    assert contamination(docs.limit(0), none).count() == 0
