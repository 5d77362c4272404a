"""Benchmark passages in training documents.

The benchmark's windows of words are put in hash sets that go to every task as files, in blocks of
a fixed size; each task slides over its documents once for each block and verifies each hash hit by its words.
"""

from __future__ import annotations

import functools
import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.base import in_parts, scratch, text_of, with_fields
from repolens.llm.token_files import filesystem

WINDOW = 10
#: Benchmark items in one block; a task holds one block of windows at a time.
BLOCK_ITEMS = 20_000
#: Texts whose words are held together have about this many characters, one long text aside.
CHARS_AT_ONCE = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

# A-Z in lower case; digits, letters and bytes beyond ASCII stay, all else divides words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
RESULT = "n_words LONG, n_hit LONG, item_ids ARRAY<LONG>, hits ARRAY<STRUCT<start: INT, end: INT>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Block:
    """Windows of some items: word numbers, hashes by window length, and the items of each window."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.items: dict[tuple[bytes, ...], set[int | None]] = {}
        for item_id, text in items:
            found = words(text)
            size = min(window, len(found))
            for i in range(len(found) - size + 1 if size else 0):
                self.items.setdefault(tuple(found[i : i + size]), set()).add(item_id)
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for key in self.items for w in key), 1)}
        self.hashes = {}
        for size in sorted({len(key) for key in self.items}):
            rows = np.array([[self.number[w] for w in key] for key in self.items if len(key) == size], np.uint64)
            self.hashes[size] = np.unique(_rolling(rows.ravel(), size)[::size])

    def occurrences(self, found: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """``(position, window)`` of each verified window of a document."""
        numbers = np.fromiter(map(self.number.get, found, _ZEROS), np.uint64, len(found))
        known = numbers != 0
        for size, hashes in self.hashes.items():
            if len(found) < size:
                continue
            # only where all words occur in the block
            runs = np.cumsum(np.concatenate([[0], known]))
            at = np.flatnonzero(runs[size:] - runs[:-size] == size)
            if not len(at):
                continue
            values = _rolling(numbers, size)[at]
            place = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
            for i in at[hashes[place] == values].tolist():
                key = tuple(found[i : i + size])
                if key in self.items:
                    yield i, key


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self) -> int:
        return 0


_ZEROS = _Zeros()


def _rolling(numbers: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of so many numbers."""
    total = np.zeros(len(numbers) - size + 1, np.uint64)
    for k in range(size):
        total = total * _BASE + numbers[k : len(numbers) - size + 1 + k]
    return total


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_items: int = BLOCK_ITEMS) -> tuple[str, list[str]]:
    """Write the windows as files, about ``block_items`` items each: the folder and the files' names.

    Spark deals the items out; each block is built in a task of its own. Only names come to the driver.
    """
    folder = scratch(benchmark.sparkSession, "benchmark-windows")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    n_blocks = max(1, -(-rows.count() // block_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        block = Block(items, window)
        if block.items:
            store, base = filesystem(folder)
            store.create_dir(base, recursive=True)
            name = f"/windows-{uuid.uuid4().hex}"
            with store.open_output_stream(base + name) as out:
                out.write(pickle.dumps(block, protocol=5))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    dealt = rows.repartition(n_blocks, F.xxhash64("item_id", "text"))
    return folder, sorted(r["name"] for r in dealt.mapInArrow(run, "name STRING").collect())


@functools.lru_cache(maxsize=1)
def _block(folder: str, name: str) -> Block:
    """The block that a Python worker used last."""
    store, base = filesystem(folder)
    with store.open_input_file(base + name) as file:
        return pickle.loads(file.read())


def _character_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as spans of code points."""
    raw = text.encode()
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    places = [m.span() for m in _WORD.finditer(raw)]
    spans, at, n = [], 0, 0
    for first, end in edges.reshape(-1, 2).tolist():
        cut = []
        for b in (places[first][0], places[end - 1][1]):
            n += len(raw[at:b].decode())
            at = b
            cut.append(n)
        spans.append({"start": cut[0], "end": cut[1]})
    return spans


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_hit``, ``item_ids`` and ``hits`` (columns of these names are replaced).

    ``benchmark`` has ``item_id`` and ``text``. A window is ``window`` consecutive words of an item; an
    item of fewer words, but not none, is one window. Each word of a document inside an occurrence of a
    window is hit; ``hits`` are the spans of hit words in code points. ``item_ids`` are distinct and ascending;
    an item without id marks words but isn't listed. Null text has no words. Repeated rows stay. Empty
    tables on either side give no hits. One narrow pass over the documents.
    """
    folder, names = benchmark_blocks(benchmark, window, block_items)
    kept = docs.drop("n_words", "n_hit", "item_ids", "hits")
    text_at = kept.columns.index("text")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def judged(texts: list[str | None]) -> Iterator[tuple[int, int, list[int], list[dict[str, int]]]]:
        found = [words(t) for t in texts]
        items: list[set[int | None]] = [set() for _ in texts]
        hit: list[np.ndarray | None] = [None] * len(texts)
        for name in names:
            block = _block(folder, name)
            for row, document in enumerate(found):
                for i, key in block.occurrences(document):
                    if hit[row] is None:
                        hit[row] = np.zeros(len(document), bool)
                    hit[row][i : i + len(key)] = True
                    items[row] |= block.items[key]
        for text, document, ids, mask in zip(texts, found, items, hit, strict=True):
            listed = sorted(i for i in ids if i is not None)
            yield (len(document), 0, listed, []) if mask is None else (
                len(document), int(mask.sum()), listed, _character_spans(text, mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            rows = [row for some in in_parts(texts, CHARS_AT_ONCE) for row in judged(some)]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), spans)
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                [*batch.schema.names, "n_words", "n_hit", "item_ids", "hits"])

    return kept.mapInArrow(run, with_fields(kept.schema, RESULT))


def items_digest(item_ids: str = "item_ids"):
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(item_ids, lambda i: i.cast("string"))), ","), 256)


def remove_spans(docs: DataFrame, max_share: float = 0.5) -> DataFrame:
    """Cut the hit spans out of the texts; documents with more than ``max_share`` of their words hit go.

    Takes and removes the columns that :func:`contamination` adds.
    """
    kept = docs.filter(F.col("n_hit") <= F.lit(max_share) * F.col("n_words"))
    starts = F.concat(F.array(F.lit(0)), F.col("hits.end"))
    ends = F.concat(F.col("hits.start"), F.array(F.length("text")))
    parts = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    cut = F.when(F.size("hits") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    return kept.withColumn("text", cut).drop("n_words", "n_hit", "item_ids", "hits")
