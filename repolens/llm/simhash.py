"""SimHash fingerprints and their links by the generalised pigeonhole principle.

If the 64 bits are divided into m blocks with thresholds that add up to ``distance - m + 1``, two
fingerprints at most ``distance`` bits apart agree in at least one block up to its threshold; a
threshold of -1 leaves a block out. Blocks hold bits that go together, so that different blocks say
different things, and a dynamic programme chooses the thresholds for which signatures and candidates
are estimated to cost least.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.base import stored, text_of
from repolens.llm.components import components

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
#: What making, moving and sorting a signature costs, in verified candidate pairs.
SIGNATURE_COST = 75.0
#: A signature with more fingerprints is linked by ``_links_of_crowds`` instead of pair by pair.
CROWD = 4096
#: Fingerprints of a smaller signature are compared for many signatures at once.
FEW = 48


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text: lower case A-Z, words between ASCII white space, shingles with repeats.

    Fewer words than a shingle has are one shingle; no words (null, empty): zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        octets = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of each row, written to the shared folder; ``fp`` is a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return stored(rows.mapInArrow(run, "doc_id LONG, text_hash LONG, fp LONG"), "fingerprints")


def _unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, how many have both: 64 x 64 sums over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = _unpacked(batch.column(0).to_numpy()).astype(np.float32)
            for i in range(0, len(bits), 1 << 14):
                both += bits[i : i + (1 << 14)].T @ bits[i : i + (1 << 14)]
            n += len(bits)
        values = pa.array(np.concatenate([[n], both.ravel()]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 + BITS * BITS)), values], ["k", "v"])

    sums = dict(fps.select("fp").mapInArrow(run, "k LONG, v LONG").groupBy("k").agg(F.sum("v")).collect())
    if not sums:
        return 0, np.zeros((BITS, BITS))
    flat = np.array([sums[k] for k in range(1 + BITS * BITS)], float)
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def correlated_blocks(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m blocks of nearly the same size, each grown by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, blocks = list(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        block = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        while len(block) < width:
            rest = [b for b in free if b not in block]
            block.append(max(rest, key=lambda b: (tie[b, block].sum(), -b)))
        free = [b for b in free if b not in block]
        blocks.append(sorted(block))
    return blocks


def estimated_cost(n: int, agree: np.ndarray, threshold: int) -> float:
    """Signatures and candidates of a block; ``agree`` is how often two rows agree in each of its bits."""
    if threshold < 0:
        return 0.0
    within = np.zeros(threshold + 1)
    within[0] = 1.0
    for a in agree:
        within[1:] = within[1:] * a + within[:-1] * (1 - a)
        within[0] *= a
    return SIGNATURE_COST * n * math.comb(len(agree), threshold) + n * n / 2 * within.sum()


def choose_blocks(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of each block used, for the least estimated cost over 1 to distance + 1 blocks."""
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(1, distance + 2):
        blocks = correlated_blocks(n, both, m)
        total = distance - m + 1
        reach: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for block in blocks:  # thresholds of the blocks so far by their sum
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for have, (cost, chosen) in reach.items():
                for t in range(-1, distance + 1):
                    new = cost + estimated_cost(n, agree[block], t)
                    if new < after.get(have + t, (math.inf,))[0]:
                        after[have + t] = new, (*chosen, t)
            reach = after
        cost, chosen = reach[total]
        if cost < best[0]:
            best = cost, [(b, t) for b, t in zip(blocks, chosen, strict=True) if t >= 0]
    return best[1]


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def signature_masks(blocks: list[tuple[list[int], int]]) -> list[int]:
    """For each block and each choice of as many of its bits as its threshold: the block's other bits.

    Fingerprints that agree under a mask agree in the block up to its threshold, and the other way round.
    """
    return [
        _mask(set(bits) - set(out)) for bits, threshold in blocks for out in itertools.combinations(bits, threshold)]


def _bounded_links(signatures: DataFrame, distance: int) -> DataFrame:
    """Edges that connect what is linked within each signature; each task goes through its part once."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate([[True], np.any(keys[1:] != keys[:-1], axis=1)]))
        sizes = np.diff(np.append(starts, len(fps)))
        of = np.repeat(np.arange(len(starts)), sizes)
        few = sizes[of] <= FEW
        v, g = fps[few], of[few]
        for shift in range(1, int(sizes[sizes <= FEW].max(initial=1))):
            near = (g[shift:] == g[:-shift]) & (np.bitwise_count(v[shift:] ^ v[:-shift]) <= distance)
            yield v[:-shift][near], v[shift:][near]
        for start, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
            left = fps[start : start + size]
            while len(left):  # a spanning forest, not all pairs
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    one = queue.pop()
                    near = np.bitwise_count(left ^ one) <= distance
                    found, left = left[near], left[~near]
                    queue.extend(found)
                    yield np.full(len(found), one, np.uint64), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                keys = np.concatenate([keys, np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)])
                fps = np.concatenate([fps, batch.column(2).to_numpy().view(np.uint64)])
            # the last signature may go on in the next batch
            done = len(fps) if batch is None else int(np.flatnonzero(np.any(keys != keys[-1:], axis=1)).max(initial=-1)) + 1
            if done:
                for u, v in links(keys[:done], fps[:done]):
                    if len(u):
                        ends = [pa.array(x.view(np.int64)) for x in (u, v)]
                        yield pa.RecordBatch.from_arrays(ends, ["u", "v"])
            keys, fps = keys[done:], fps[done:]

    dealt = signatures.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return dealt.select("mask", "value", "fp").mapInArrow(run, "u LONG, v LONG")


def _links_of_crowds(fps: DataFrame, distance: int) -> DataFrame:
    """Edges for fingerprints of very common signatures; linear in their number, and exact.

    A point within r of one fingerprint and within ``distance - r`` of another shows that they
    are linked, and linked ones have such a point between them (r: half the distance). So each
    fingerprint is tied, at each point within ``distance - r``, to the smallest one within r of the point.
    """
    near = distance // 2
    flips = [(_mask(c), d) for d in range(distance - near + 1) for c in itertools.combinations(range(BITS), d)]
    masks = F.array(*[F.lit(f) for f, _ in flips])
    close = F.array(*[F.lit(f) for f, d in flips if d <= near])
    around = fps.select("fp", F.explode(masks).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("x"))
    hubs = fps.select("fp", F.explode(close).alias("flip")).groupBy(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("x")).agg(F.min("fp").alias("hub"))
    return around.join(hubs, "x").filter(F.col("fp") != F.col("hub")).select(
        F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """``(u, v)`` edges between the distinct values ``fp`` that connect all those within the distance.

    The edges are true links and have the same components as all links, but are not all of them.
    """
    n, both = bit_statistics(fps)
    masks = F.array(*[F.lit(m) for m in signature_masks(choose_blocks(n, both, distance))])
    signatures = fps.select("fp", F.explode(masks).alias("mask")).withColumn(
        "value", F.col("fp").bitwiseAND(F.col("mask")))
    crowded = stored(
        signatures.groupBy("mask", "value").agg(F.count("fp").alias("n")).filter(F.col("n") > crowd).drop("n"), "crowds")
    if crowded.isEmpty():
        return _bounded_links(signatures, distance)
    usual = signatures.join(crowded, ["mask", "value"], "left_anti")
    crowds = signatures.join(crowded, ["mask", "value"], "left_semi").select("fp").distinct()
    return _bounded_links(usual, distance).unionByName(_links_of_crowds(crowds, distance))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id)`` of each row of ``(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``distance`` differing
    bits. Equal fingerprints are merged before any link is sought, so exact copies cost one row
    a partition. Null and empty texts have fingerprint zero and are linked like any other. Rows without a
    ``doc_id`` link as others do but give no id to their component (null if no row has one). Repeated rows
    stay. Other columns are not read. An empty table gives no rows.
    """
    rows = fingerprints(docs)
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct, distance, crowd))
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(of.join(ids, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near duplicates, columns as they are.

    The row of the smallest ``doc_id`` stays (null last), of equal ids the one of the smallest text hash, of
    equal rows one.
    """
    first = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "text_hash", "doc_id")
    kept = near_duplicates(docs, distance).groupBy("root").agg(F.min(first).alias("first")).select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("hash"))
    same = keyed["id"].eqNullSafe(kept["kept_id"]) & (keyed["hash"] == kept["kept_hash"])
    order = Window.partitionBy("hash", "id").orderBy(F.lit(0))
    return keyed.join(kept, same, "left_semi").withColumn("copy", F.row_number().over(order)).filter("copy = 1").select("row.*")
