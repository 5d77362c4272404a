"""Token ids in files of shuffled planes.

A file holds the documents of one task, ascending by id. The ids of all its documents in a row
are cut into blocks of a fixed number of ids. Each block is transposed, so that the first bytes
(or bits) of all its ids stand together, then the second ones and so on, and each of these planes is
compressed by itself: planes of high bytes are nearly constant and all but vanish.

Layout: ``MAGIC``; the planes of block after block; the documents' ids and lengths; the chunk
index, one row of numbers for each block (offset, number of ids, compressed length of each plane); a
footer with the place of the last three and the kind of planes.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from repolens.llm.base import scratch, text_of
from repolens.llm.tokens import END_ID, encoded, tokenizer_path

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
FOOTER = struct.Struct("<QQQQQ8s")  # documents' offset and number, index's offset and blocks, kind, magic
#: Bytes of ids in one Arrow batch of read documents, one long document aside.
BATCH_BYTES = 8_000_000
MANIFEST = "part INT, path STRING, n_docs LONG, n_ids LONG"


def filesystem(uri: str):
    """The file system of a folder and the folder's path on it; a plain path is a local one."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [octets[:, k].tobytes() for k in range(4)]
    single = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(single[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        single = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        octets = np.packbits(single, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class PlaneWriter:
    """Documents one after another into an open file; holds one block and 17 bytes a document."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK_IDS):
        self._out, self._bits, self._block = out, bits, block
        self._compress = zstandard.ZstdCompressor(level=1).compress
        self._pending: list[np.ndarray] = []
        self._n_pending = 0
        self._doc_ids: list[int | None] = []
        self._lengths: list[int] = []
        self._index: list[list[int]] = []
        out.write(MAGIC)
        self._at = len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        array = np.frombuffer(ids, "<u4")
        self._doc_ids.append(doc_id)
        self._lengths.append(len(array))
        self._pending.append(array)
        self._n_pending += len(array)
        if self._n_pending >= self._block:
            whole = np.concatenate(self._pending)
            full = len(whole) // self._block * self._block
            for i in range(0, full, self._block):
                self._flush(whole[i : i + self._block])
            self._pending = [whole[full:].copy()]
            self._n_pending = len(whole) - full

    def _flush(self, ids: np.ndarray) -> None:
        planes = [self._compress(p) for p in to_planes(ids, self._bits)]
        self._index.append([self._at, len(ids), *map(len, planes)])
        for plane in planes:
            self._out.write(plane)
            self._at += len(plane)

    def close(self) -> tuple[int, int]:
        """Writes the tables at the end; the number of documents and of ids."""
        if self._n_pending:
            self._flush(np.concatenate(self._pending))
        ids = np.array([0 if d is None else d for d in self._doc_ids], "<i8").tobytes()
        null = np.array([d is None for d in self._doc_ids], np.uint8).tobytes()
        docs = self._compress(ids + null + np.array(self._lengths, "<i8").tobytes())
        index = np.array(self._index, "<i8").tobytes()
        self._out.write(docs + index)
        self._out.write(FOOTER.pack(
            self._at, len(self._doc_ids), self._at + len(docs), len(self._index), self._bits, MAGIC))
        return len(self._doc_ids), sum(self._lengths)


def read_planes(file) -> Iterator[tuple[int | None, bytes]]:
    """``(doc_id, ids)`` of each document of a seekable file, holding a block and a document at a time."""
    end = file.seek(0, io.SEEK_END)
    file.seek(end - FOOTER.size)
    docs_at, n_docs, index_at, n_blocks, bits, magic = FOOTER.unpack(file.read(FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a file of token planes")
    expand = zstandard.ZstdDecompressor().decompress
    file.seek(docs_at)
    table = expand(file.read(index_at - docs_at))
    doc_ids = np.frombuffer(table[: 8 * n_docs], "<i8")
    null = np.frombuffer(table[8 * n_docs : 9 * n_docs], np.uint8)
    lengths = np.frombuffer(table[9 * n_docs :], "<i8")
    index = np.frombuffer(file.read(end - FOOTER.size - index_at), "<i8").reshape(n_blocks, 34 if bits else 6)
    block, at, k = b"", 0, 0
    for doc_id, is_null, length in zip(doc_ids.tolist(), null.tolist(), lengths.tolist(), strict=True):
        parts, need = [], 4 * length
        while need:
            if at == len(block):
                offset, n, *sizes = index[k].tolist()
                file.seek(offset)
                block = from_planes([expand(file.read(s)) for s in sizes], n, bool(bits)).tobytes()
                at, k = 0, k + 1
            parts.append(block[at : at + need])
            at += len(parts[-1])
            need -= len(parts[-1])
        yield None if is_null else doc_id, b"".join(parts)


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, bits: bool = False, end_id: int = END_ID,
    block: int = BLOCK_IDS,
) -> DataFrame:
    """Write the ids of every whole text, ascending by ``doc_id``; returns the manifest, one row a file.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Rows are dealt into ranges of
    (doc_id, hash of the text), so that an id that many rows have is divided as well. Null ids come first;
    rows of the same id stand by hash and text; repeated rows stay. Null text is the end id alone. An empty
    table gives no file or files without documents. A task that runs again writes a file of another
    name; only the files in the manifest count. Files go to ``folder`` straight from the tasks.
    """
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/ids-{part:06d}-{uuid.uuid4().hex}.idp"
        with store.open_output_stream(name) as out:
            writer = PlaneWriter(out, bits, block)
            for batch in batches:
                texts = encoded((x.as_py() for x in batch.column(1)), path)
                for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                    writer.add(doc_id, ids + end)
            n_docs, n_ids = writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name.removeprefix(base)]), pa.array([n_docs]), pa.array([n_ids])],
            ["part", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text"))
    manifest = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, ids)`` of each document: the number of ids before it in all files, its ids as bytes.

    One task a file; the running total runs over one row a file.
    """
    manifest = read_manifest(spark, folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n_files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)

        def rows() -> Iterator[tuple[int | None, int, bytes]]:
            for batch in batches:
                for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with store.open_input_file(root + name) as file:
                        for doc_id, ids in read_planes(file):
                            yield doc_id, start, ids
                            start += len(ids) // 4

        some, size = [], 0
        for row in rows():
            some.append(row)
            size += len(row[2])
            if size > BATCH_BYTES:
                yield _batch(some)
                some, size = [], 0
        if some:
            yield _batch(some)

    return files.select("path", "base").repartition(n_files).mapInArrow(run, "doc_id LONG, start LONG, ids BINARY")


def _batch(rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "ids"])


def token_files(docs: DataFrame, path: str | None = None, bits: bool = False) -> DataFrame:
    """Write the documents' ids to a new shared folder and read them back: ``(doc_id, start, ids)``."""
    folder = scratch(docs.sparkSession, "token-ids")
    write_token_files(docs, folder, path, bits)
    return read_token_files(docs.sparkSession, folder)
