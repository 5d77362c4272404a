"""Token ids of texts by a byte-level BPE file of the tokenizers library.

Every id comes from the library. Words repeat far more often than texts do, so texts are cut at
places where the library's pre-tokenizer always cuts as well, unknown parts of many texts are
encoded in one call, and the ids of each part are kept for later texts.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.base import in_parts, text_of

#: Closes each document.
END_ID = 0
#: Parts that one Python worker keeps, about 200 bytes each, and those of one call; beyond that the older half goes.
KEPT_PARTS = 300_000
#: A longer part is encoded anew each time, so that what is kept stays small.
KEPT_LENGTH = 64
#: Texts encoded together hold about this many characters, one long text aside.
CHARS_AT_ONCE = 2_000_000

#: Letters that the pre-tokenizer's pattern and this module tell from other characters by bytes.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ſ]+")
#: Kinds of bytes: a letter of its own, the first and the second byte of a letter, a mark, a space or newline.
_LETTER, _LEAD, _FOLLOWS, _MARK, _BREAK = range(1, 6)
_TWO_SPACES = re.compile(r"\s\s")
_SPACE = re.compile(r"\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to bytes of ids, the same as encoding each whole text with the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._begins = {x: np.zeros(max(vocabulary.values()) + 1, bool) for x in " \n"}
        for before, mark in (" ", "Ġ"), ("\n", "Ċ"):  # the marks of these bytes in the vocabulary
            self._begins[before][[i for token, i in vocabulary.items() if token.startswith(mark)]] = True
        self._plain: dict[str, Tokenizer] = {}  # by what stands before: for words of letters, which need no pre-tokenizer's pattern
        self._kinds = np.zeros(256, np.uint8)
        self._kinds[[32, 10]] = _BREAK
        if self._splits_letters():
            added = [x.content for x in self._tokenizer.get_added_tokens_decoder().values()]
            inside = {b for x in added for a, b in itertools.pairwise(x) if a.isalpha()}  # no added token may be cut
            self._kinds[[ord(x) for x in string.ascii_letters]] = _LETTER
            self._kinds[0xC3:0xC6] = _LEAD
            self._kinds[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = _FOLLOWS  # × and ÷ are no letters
            self._kinds[[ord(x) for x in string.punctuation if x not in inside]] = _MARK
            if not any(_LETTERS.fullmatch(x.strip()) for x in added):
                self._plain = {" ": self._words_at("Ġ", "merged_with_next"), "\n": self._words_at("Ċ", "isolated")}
        self._often: dict[str, bytes] = {}  # by the part and what stands before it: parts met in several calls
        self._kept: dict[str, bytes] = {}  # met lately
        self._older: dict[str, bytes] = {}  # kept before those; what is met again moves over, the rest goes
        self._tails: dict[str, bytes] = {}

    def _splits_letters(self) -> bool:
        """Whether a run of letters, with a space before it or none, is always a pre-token by itself."""
        given = json.loads(self._tokenizer.to_str())
        found = given["pre_tokenizer"] or {}
        return (given["normalizer"] is None and found.get("type") == "ByteLevel"
                and found.get("use_regex", True) and not found["add_prefix_space"]
                and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in given["added_tokens"]))

    def _words_at(self, mark: str, behavior: str):
        """The same model behind a split at ``mark`` alone."""
        from tokenizers import Tokenizer, pre_tokenizers

        found = Tokenizer(self._tokenizer.model)
        found.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), pre_tokenizers.Split(mark, behavior)])
        return found

    def _ids(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words that begin with ``before`` and have no other white space; a few hundred words a call are quickest."""
        found: list[bytes] = []
        for i in range(0, len(words), 200):
            some = words[i : i + 200]
            text = "".join(some)
            letters = self._plain and _LETTERS.fullmatch(text.replace(before, ""))
            tokenizer = self._plain[before] if letters else self._tokenizer
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self._begins[before][ids])
            if len(cuts) != len(some):  # a vocabulary whose tokens go over the cut
                found += map(self._ids, some)
                continue
            raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            found += [raw[a:b] for a, b in itertools.pairwise(ends)]
        return found

    def _known(self, word: str) -> bytes | None:
        return self._often.get(word) or self._kept.get(word) or self._older.get(word)

    def _keep(self, word: str, ids: bytes) -> None:
        if len(word) <= KEPT_LENGTH:
            self._kept[word] = ids

    def _learn(self, words: list[str], before: str) -> list[bytes]:
        """Ids of unknown words, which begin with ``before`` and are not of letters alone."""
        tails = self._tails
        ended: dict[str, str] = {}  # words that end in a run of punctuation after letters: different pre-tokens
        alone: set[str] = set()
        for word in words:
            if word[1:].isalnum():
                alone.add(word)
                continue
            stem = word.rstrip(string.punctuation)
            if stem != word and stem[-1].isalpha() and "<" not in word and self._kinds[ord(word[len(stem)])] == _MARK:
                ended[word] = stem
                word = stem
            part = word[1:]
            if part and self._known(word) is None and (part.isalnum() or _SPACE.search(part) is None):
                alone.add(word)
        some = list(alone)
        found = dict(zip(some, self._together(some, before), strict=True))
        for word, stem in ended.items():
            tail = word[len(stem):]
            begin = found.get(stem) or self._known(stem)
            if begin is not None:
                if tail not in tails:
                    tails[tail] = self._ids(tail)
                found[word] = begin + tails[tail]
        if len(tails) > KEPT_PARTS:
            tails.clear()
        return [found[x] if x in found else self._ids(x) for x in words]

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The parts of texts without two white spaces in a row, each with the space or newline before it, and each text's first one.

        Marks after a letter begin a part as well: a word is the same part before a comma and before a space.
        """
        whole = pa.array(texts, pa.large_string())
        ends = np.frombuffer(whole.buffers()[1], "<i8")[: len(texts) + 1]
        kinds = self._kinds[np.frombuffer(whole.buffers()[2], np.uint8)[: ends[-1]]]
        letter = kinds == _LETTER
        letter[1:] |= (kinds[1:] == _FOLLOWS) & (kinds[:-1] == _LEAD)
        begins = kinds == _BREAK
        begins[1:] |= (kinds[1:] == _MARK) & letter[:-1]
        begins[ends[:-1]] = True
        starts = np.flatnonzero(begins)
        bounds = pa.py_buffer(np.append(starts, ends[-1]).astype("<i8"))
        return pa.LargeStringArray.from_buffers(len(starts), bounds, whole.buffers()[2]), np.searchsorted(starts, ends)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null and empty have none."""
        texts = list(texts)
        out = [b""] * len(texts)
        plain, spaced = [], []
        for i, text in enumerate(texts):
            if text:
                (spaced if _TWO_SPACES.search(text) else plain).append(i)
        if plain:
            self._fill(out, plain, *self._cut([texts[i] for i in plain]))
        divided = [_SINGLE_SPACE.split(texts[i]) for i in spaced]
        flat = pa.array([" " * (k > 0) + part for x in divided for k, part in enumerate(x)], pa.large_string())
        self._fill(out, spaced, flat, np.cumsum([0, *map(len, divided)]), first_may_be_spaced=True)
        return out

    def _fill(self, out: list[bytes], places: list[int], parts: pa.Array, offsets: np.ndarray, first_may_be_spaced: bool = False) -> None:
        """The ids of each text, whose parts are ``offsets[i]:offsets[i + 1]``, at its place. Python sees each distinct part once."""
        if not places:
            return
        coded = parts.dictionary_encode()
        codes = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # ``to_pylist`` makes a scalar of each
        ids: list[bytes | None] = list(map(self._often.get, words))
        new = [k for k, found in enumerate(ids) if found is None]
        if len(self._often) >= KEPT_PARTS // 2 and len(new) > max(3 * len(words) // 4, KEPT_PARTS // 10):
            self._often = {}  # texts of other words; what is in use comes back
        if len(self._kept) > KEPT_PARTS // 4:
            self._older, self._kept = self._kept, {}
        often, kept, older = self._often, self._kept, self._older
        room = KEPT_PARTS // 2 - len(often)
        letters: dict[str, list[int]] = {" ": [], "\n": []}
        others: dict[str, list[int]] = {" ": [], "\n": []}
        for k in new:
            word = words[k]
            if (found := kept.get(word)) is not None:
                ids[k] = found
                if room > 0:
                    often[word] = kept.pop(word)
                    room -= 1
            elif (found := older.pop(word, None)) is not None:
                ids[k] = (often if room > 0 else kept)[word] = found
                room -= 1
            elif word[:1] in letters:
                (letters if _LETTERS.fullmatch(word, 1) else others)[word[0]].append(k)
            else:
                ids[k] = self._ids(word)
                self._keep(word, ids[k])
        for kind, learn in (letters, self._together), (others, self._learn):
            for before, at in kind.items():
                for k, found in zip(at, learn([words[k] for k in at], before), strict=True):
                    ids[k] = found
                    self._keep(words[k], found)
        firsts: dict[int, bytes] = {}
        if first_may_be_spaced:  # a space that begins a text has nothing before it
            firsts = {k: self._ids(words[k]) for k in set(codes[offsets[:-1]].tolist()) if words[k][:1] in letters}
        # One copy of bytes for each part: an index for each id would cost more than the lookup.
        taken = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], "<i8")[taken.offset : taken.offset + len(taken) + 1]
        flat = taken.buffers()[2] or pa.py_buffer(b"")
        bounds = ends[offsets].tolist()
        for i, at, a, b in zip(places, offsets.tolist(), bounds, bounds[1:], strict=False):
            if first_may_be_spaced and codes[at] in firsts:
                out[i] = firsts[codes[at]] + flat[int(ends[at + 1]) : b].to_pybytes()
            else:
                out[i] = flat[a:b].to_pybytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; it lives as long as the worker does."""
    return Encoder(path)


def encoded(texts: Iterable[str | None], path: str) -> Iterator[bytes]:
    """Ids of the texts, a bounded number of characters at a time."""
    for some in in_parts(texts, CHARS_AT_ONCE):
        yield from encoder(path).encode(some)
        pa.default_memory_pool().release_unused()  # the worker lives on, and other stages run beside it


def with_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID, key: Column | None = None) -> DataFrame:
    """``(doc_id, ids)`` of each row of ``(doc_id, text)``: its ids and the end id as bytes.

    One narrow pass. Null text is empty: the end id alone. Repeated rows stay; other columns go.
    """
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x + end for x in encoded((x.as_py() for x in batch.column(1)), path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select((F.col("doc_id") if key is None else key).cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id LONG, ids BINARY")
