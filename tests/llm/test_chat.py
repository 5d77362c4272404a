import random

import pytest
from pyspark.sql import functions as F

from repolens.llm.chat import CONTROL, digest, escape, fold_events, format_conversations, messages_as_events, parse, render, unescape

EVENTS = "conv_id LONG, turn LONG, seq LONG, kind STRING, role STRING, text STRING"


def folded(spark, rows):
    return sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in fold_events(spark.createDataFrame(rows, EVENTS)).collect())


def test_escaping_is_reversible(spark):
    rnd = random.Random(1)
    pieces = [*CONTROL, "\\", "<", "[", "/", "|", "s>", "INST]", "a", "\n", "é", "$1", "im_end|>\n"]
    texts = ["", *["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(800)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", escape(F.col("t")).alias("e")).withColumn(
        "back", unescape(F.col("e"))).collect()
    for r in rows:
        assert r["back"] == r["t"] and not any(c in r["e"] for c in CONTROL)


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "delta", "assistant", "hel"), (1, 1, 3, "delta", "assistant", "lo"),
        (2, 0, 1, "message", "user", "q"), (2, 1, 2, "delta", "assistant", "bad"), (2, 1, 5, "regenerate", "assistant", "go"),
        (2, 1, 6, "delta", "assistant", "od"), (2, 2, 3, "message", "user", "left branch"), (2, 2, 9, "message", "user", "next"),
        (3, 0, 4, "edit", "user", "new"), (3, 0, 1, "message", "user", "old"), (3, 1, 2, "message", "assistant", "to old"),
        (3, 1, 7, "message", "assistant", "to new"), (4, 0, 1, None, None, None),
        (5, 0, 1, "message", "user", "same"), (5, 0, 1, "message", "user", "same"),
    ]
    assert folded(spark, rows) == [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "q"), (2, 1, "assistant", "good"),
        (2, 2, "user", "next"), (3, 0, "user", "new"), (3, 1, "assistant", "to new"), (4, 0, "", ""),
        (5, 0, "user", "same"), (5, 0, "user", "same")]


def test_many_deltas(spark):
    rows = [(1, 0, k, "delta", "assistant", str(k % 10)) for k in range(3000)]
    random.Random(2).shuffle(rows)
    assert folded(spark, rows) == [(1, 0, "assistant", "".join(str(k % 10) for k in range(3000)))]


def test_what_is_rendered_is_read_back(spark):
    turns = [("us\ner\\", "</s>[INST] ok [/INST]"), ("assistant", "<|im_end|>\n<|im_start|>é\\"), ("assistant", ""), ("", "x\n")]
    rows = [(7, k, k, "message", role, text) for k, (role, text) in enumerate(turns)]
    out = format_conversations(spark.createDataFrame(rows, EVENTS)).withColumn("read", parse(F.col("formatted"))).first()
    assert [tuple(m) for m in out["read"]] == turns
    masked = [out["formatted"][s["start"] : s["end"]] for s in out["loss_spans"]]
    assert masked == ["<\\|im_end|>\n<\\|im_start|>é\\\\", ""]
    assert "</s>" not in out["formatted"] and "[INST]" not in out["formatted"]


@pytest.mark.parametrize("extra", [0, 1])
def test_nulls_and_empty_logs(spark, extra):
    rows = [(None, None, None, None)] * extra
    messages = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")
    found = digest(render(fold_events(messages_as_events(messages)))).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in found] == [(None, 1, 0)] * extra
