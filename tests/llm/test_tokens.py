import io
import random

import numpy as np
import pytest

from repolens.llm.token_files import PlaneWriter, from_planes, read_planes, read_token_files, to_planes, write_token_files
from repolens.llm.tokens import Encoder, tokenizer_path, with_ids

PIECES = [
    "a", "the", "Word", " ", "  ", "\n", " \n", "\t", ".", ",", "'s", "'", "!", "é", "ß", "中", "12", "<|endoftext|>", "\x85",
    "\x1c", "###", "don't", "​", "🙂", "²", "_", "-", "x" * 70, " ", "<|", "|>", "\r\n",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_same_ids_as_whole_texts(library):
    rnd, encoder = random.Random(1), Encoder(tokenizer_path())
    for _ in range(300):
        texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(10)]
        for text, raw in zip(texts, encoder.encode(texts), strict=True):
            assert ids(raw) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_kept_parts_are_bounded(library, monkeypatch):
    monkeypatch.setattr("repolens.llm.tokens.KEPT_PARTS", 5)
    encoder = Encoder(tokenizer_path())
    for k in range(5):
        texts = [" ".join(f"w{k}{i} w{k}{i}," for i in range(10)) + "\nnext line"] * 2
        for text, raw in zip(texts, encoder.encode(texts), strict=True):
            assert ids(raw) == library.encode(text, add_special_tokens=False).ids


def test_words_in_use_are_encoded_once(library, monkeypatch):
    """A word seen once is known in later calls, and one that is met again and again outlives the bound."""
    encoder, asked = Encoder(tokenizer_path()), []
    together = encoder._together
    monkeypatch.setattr(encoder, "_together", lambda words, before: asked.extend(w.strip() for w in words) or together(words, before))
    encoder.encode(["one rare word"])
    encoder.encode(["any rare word"])
    assert sorted(asked) == ["rare", "word"]
    monkeypatch.setattr("repolens.llm.tokens.KEPT_PARTS", 6)
    for k in range(9):
        text = " ".join(["any", "rare", *(f"w{k}{i}" for i in range(3))])
        assert ids(encoder.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids
    assert asked.count("rare") == 1 and len(encoder._kept) + len(encoder._older) <= 14


def test_words_met_again_stay_known(library, monkeypatch):
    """A word of several calls outlives any number of words met once, within the same bound."""
    monkeypatch.setattr("repolens.llm.tokens.KEPT_PARTS", 40)
    encoder, asked = Encoder(tokenizer_path()), []
    together = encoder._together
    monkeypatch.setattr(encoder, "_together", lambda words, before: asked.extend(w.strip() for w in words) or together(words, before))
    encoder.encode(["a rare"])
    encoder.encode(["a rare"])
    for k in range(12):
        encoder.encode([" ".join(f"w{k}{chr(97 + i)}" for i in range(12))])
    assert ids(encoder.encode(["a rare"])[0]) == library.encode("a rare", add_special_tokens=False).ids
    assert asked.count("rare") == 1
    assert len(encoder._often) + len(encoder._kept) + len(encoder._older) <= 40 + 2 * 12


def test_words_of_other_texts_replace_those_kept_for_good(monkeypatch):
    monkeypatch.setattr("repolens.llm.tokens.KEPT_PARTS", 40)
    encoder = Encoder(tokenizer_path())
    for alphabet in "ab", "ab", "xy", "xy", "xy":
        encoder.encode(["- " + " ".join(x + chr(97 + i) for x in alphabet for i in range(15))])
    assert " xa" in encoder._often and " aa" not in encoder._often


@pytest.mark.parametrize("added", [[], ["foo"], ["a.b"], ["é,", ".x"], ["<foo>"], [("bar", {"single_word": True})]])
def test_cuts_before_marks_keep_the_ids(library, tmp_path, added):
    from tokenizers import AddedToken, Tokenizer

    own = Tokenizer.from_str(library.to_str())
    own.add_tokens([AddedToken(x) if isinstance(x, str) else AddedToken(x[0], **x[1]) for x in added])
    own.save(str(tmp_path / "own.json"))
    rnd, encoder = random.Random(3), Encoder(str(tmp_path / "own.json"))
    some = ["foo", "bar", "a", "b", "x", "é", "×", "÷", "ſ", "ė", "’", ".", ",", "_", "'s", "'", "<", ">", "1", " ", " ", " ", "\n", "Ġ", "\x01"]
    for _ in range(200):
        texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 20))) for _ in range(10)]
        for text, raw in zip(texts, encoder.encode(texts), strict=True):
            assert ids(raw) == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_null_and_empty_have_the_end_id(spark):
    rows = spark.createDataFrame([(1, None), (None, ""), (1, "a"), (1, "a")], "doc_id LONG, text STRING")
    found = sorted((str(r["doc_id"]), ids(r["ids"])) for r in with_ids(rows, end_id=0).collect())
    assert found == [("1", [0]), ("1", [64, 0]), ("1", [64, 0]), ("None", [0])]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        block = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (from_planes(to_planes(block, bits), n, bits) == block).all()


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("sizes", [[], [0], [5, 0, 3], [64, 64], [200, 1, 63, 129]])
def test_file_round_trip(bits, sizes):
    rng, out = np.random.default_rng(2), io.BytesIO()
    docs = [(None if k == 0 else k, rng.integers(0, 50257, n, dtype=np.uint32).tobytes()) for k, n in enumerate(sizes)]
    writer = PlaneWriter(out, bits, block=64)
    for doc in docs:
        writer.add(*doc)
    assert writer.close() == (len(sizes), sum(sizes))
    assert list(read_planes(out)) == docs


def test_files_hold_all_documents_in_order(spark, tmp_path, library):
    texts = {k: " ".join(f"word{j}" for j in range(k % 50)) for k in range(200)}
    rows = [(k, t) for k, t in texts.items()] + [(7, texts[7]), (None, "x"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumnRenamed("unused", "x").repartition(5)
    manifest = write_token_files(docs, str(tmp_path / "ids"), block=256).collect()
    assert sum(r["n_docs"] for r in manifest) == len(rows)
    read = sorted(read_token_files(spark, str(tmp_path / "ids")).collect(), key=lambda r: r["start"])
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in read]
    assert order == sorted(order) and len(read) == len(rows)
    at = 0
    for r in read:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    whole = {r["doc_id"]: ids(r["ids"]) for r in read if r["doc_id"] not in (8,)}
    assert all(whole[k] == [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items() if k != 8)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id LONG, text STRING")
    write_token_files(docs, str(tmp_path / "ids"))
    assert read_token_files(spark, str(tmp_path / "ids")).count() == 0
