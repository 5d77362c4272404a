"""Best-fit decreasing packing of documents into windows of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from repolens.llm.base import stored, text_of
from repolens.llm.tokens import END_ID, encoded, tokenizer_path

WINDOW = 1024
#: Rests that one task packs together; the share of padding falls as its root.
GROUP = 20_000
#: Sequence ids of windows of rests are above those of full windows.
RESTS_FROM = 1 << 62
#: Bytes of ids in one Arrow batch of pieces, one long document aside.
BATCH_BYTES = 8_000_000

PIECES = "doc_id LONG, start LONG, length INT, doc_tokens LONG, piece_id LONG, ids BINARY"
LAYOUT = "doc_id LONG, start LONG, length INT, doc_tokens LONG, piece_id LONG, ids_crc32 LONG, sequence_id LONG, offset INT"


class OpenWindows:
    """Windows by the tokens still free in them, in a segment tree over 0..window.

    A node tells whether any window below it is open, so the tightest window with room for ``n``
    tokens is found in a walk up and down the tree.
    """

    def __init__(self, window: int):
        self._leaves = 1
        while self._leaves <= window:
            self._leaves *= 2
        self._open = [0] * (2 * self._leaves)
        self._windows: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, free: int, number: int) -> None:
        self._windows[free].append(number)
        node = free + self._leaves
        while node:
            self._open[node] += 1
            node //= 2

    def take(self, n: int) -> tuple[int, int] | None:
        """``(free, number)`` of the tightest open window with at least ``n`` free tokens."""
        node = n + self._leaves
        if not self._open[node]:
            while node > 1 and (node % 2 or not self._open[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node + (not self._open[2 * node])
        free = node - self._leaves
        while node:
            self._open[node] -= 1
            node //= 2
        return free, self._windows[free].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """``(window number, offset)`` of each length, longest first, equal ones in the given order."""
    tree, n = OpenWindows(window), 0
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        free, number = tree.take(lengths[i]) or (window, n)
        n += number == n
        places[i] = number, window - free
        if free > lengths[i]:
            tree.put(free - lengths[i], number)
    return places


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Documents as ids and the end id, cut into full windows and a rest, written to the shared folder."""
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33  # the same again if the task runs again
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            texts = encoded((x.as_py() for x in batch.column(1)), path)
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, total, number, part))
                    number += 1
                    size += len(part)
                    if size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return stored(rows.mapInArrow(run, PIECES), "pieces")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = ("doc_id", "start", "length", "doc_tokens", "piece_id", "ids")
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def layout(cut: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The place of each piece: ``LAYOUT``.

    A full piece is a sequence by itself. Rests are dealt by hash into groups of about ``group`` rows,
    and each group is packed by itself, so that a task's share doesn't grow with the table. Only
    a row's numbers and its checksum move.
    """
    small = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    full = small.filter(F.col("length") == window).withColumns({"sequence_id": F.col("piece_id"), "offset": F.lit(0)})
    rests = small.filter(F.col("length") < window)
    groups = max(1, round(rests.count() / group))

    def pack_group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece_id")
        places = best_fit_decreasing(rows["length"].to_pylist(), window)
        first = RESTS_FROM + (rows["in_group"][0].as_py() << 32)
        return rows.drop_columns("in_group").append_column(
            "sequence_id", pa.array([first + n for n, _ in places], pa.int64())).append_column(
            "offset", pa.array([at for _, at in places], pa.int32()))

    dealt = rests.withColumn("in_group", F.pmod(F.xxhash64("piece_id"), F.lit(groups)))
    packed = dealt.groupBy("in_group").applyInArrow(pack_group, LAYOUT)
    return full.unionByName(packed)


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, group: int = GROUP) -> DataFrame:
    """Pack ``(doc_id, text)`` rows: one row a piece with its document, place and checksum (``LAYOUT``).

    Null text is a document of the end id alone. Null and repeated document ids stay as they are: each
    row is packed by itself. Other columns are not read. An empty table gives no rows.
    """
    return layout(pieces(docs, window, path), window, group)


def sequences(cut: DataFrame, places: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, n_tokens, ids, doc_ids)``: the ids of each sequence, padded to the window.

    A sequence of a power of two tokens has no padding.
    """
    joined = places.drop("ids_crc32").join(cut.select("piece_id", "ids"), "piece_id")
    grouped = joined.groupBy("sequence_id").agg(
        F.sum("length").cast("int").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))
    pad = F.lit(int(pad_id).to_bytes(4, "little"))
    exact = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    hexed = F.aggregate("parts", F.lit(""), lambda acc, p: F.concat(acc, F.hex(p["ids"])))
    return grouped.select(
        "sequence_id", "n_tokens",
        F.unhex(F.concat(hexed, F.when(exact, "").otherwise(
            F.repeat(F.hex(pad), F.lit(window) - F.col("n_tokens"))))).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"))
