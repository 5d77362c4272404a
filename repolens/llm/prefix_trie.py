"""The trie of conversations' beginnings, out of their sorted order.

Conversations become binary values of :data:`WIDTH` bytes a turn, so that Spark's own order sorts them and the longest
common prefix (LCP) of neighbours gives every node: the conversations that begin with a node's turns lie side by side.
Distinct sequences are range-partitioned into blocks. In a block, a sparse table of range minima over the LCPs is built,
and for each candidate prefix the left and the right end of its interval are found by binary search, independently of
each other. Whatever a node needs is a sum, a count or a minimum over its interval. A block knows the last
sequence before it and the first after it, so that sums over the blocks of a node that spans several add up to the node's.

Equal sequences are counted before the sort: a copy in a third of all conversations is one row of it. A
conversation is one value of 24 bytes a turn, the only thing that is held whole; nodes, also the root, are never gathered.

Rows without a conv_id are left out. Null roles and texts are empty. Turns are taken in order, null first, those of
one number in the order of a digest of role and text; repeated rows are turns of their own. An empty table has no nodes,
not even the root. Columns beside those named are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.base import stored

#: Bytes of a turn in a sequence: 16 of its digest, 8 for the bytes of its text.
WIDTH = 24
#: Turns that a block should hold about.
BLOCK_TURNS = 200_000
#: Conversations of one chunk of a node's list have numbers that differ by less.
CHUNK = 4096

NODE = "conv_id LONG, depth LONG, parent_conv_id LONG, n_convs LONG, n_children LONG, n_leaves LONG, saved_tokens LONG, ends_sha256 STRING"
OPEN = "block INT, side STRING, depth LONG, key BINARY, n LONG, least LONG, children LONG, leaves LONG, saved LONG"
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, seq)``: the turns of a conversation in order as one binary value. Texts stay where they are read."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    turn = F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), turn.alias("c")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda t: t["c"]), "")).alias("seq"))


def with_heads(own: DataFrame, base: Column, turns: Column, most: int) -> DataFrame:
    """Each conversation's first ``turns`` (at most ``most``) turns replaced by those of the conversation ``base``, if there is one."""
    heads = own.select(F.col("conv_id").alias("base"), F.expr(f"substring(seq, 1, {WIDTH * most})").alias("head"))
    joined = own.select("conv_id", "seq", base.alias("base"), (turns * WIDTH).cast("int").alias("cut")).join(heads, "base", "left")
    return joined.select("conv_id", F.expr("concat(coalesce(substring(head, 1, cut), x''), substring(seq, cut + 1))").alias("seq"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key out of its chunks, which come in order: only a digest's state is held."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends_sha256", pa.string())])
    key, n, least, state = None, 0, 0, None
    for batch in batches:
        done = []
        for chunk in batch.to_pylist():
            if state is not None and chunk["key"] == key:
                state.update(b"," + chunk["ids"].encode())
                n += chunk["n"]
                continue
            if state is not None:
                done.append({"key": key, "n": n, "least": least, "ends_sha256": state.hexdigest()})
            key, n, least, state = chunk["key"], chunk["n"], chunk["least"], hashlib.sha256(chunk["ids"].encode())
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "n": n, "least": least, "ends_sha256": state.hexdigest()}], schema=schema)


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """``(seq, n, least, ends_sha256)``: each distinct sequence, its conversations' number, smallest id and digest of all ids."""
    keyed = convs.withColumn("key", F.unhex(F.substring(F.sha2("seq", 256), 1, 32)))
    chunks = keyed.groupBy("key", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select(
        "key", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("least"),
        F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    ends = chunks.repartition("key").sortWithinPartitions("key", "least").mapInArrow(
        _digests, "key BINARY, n LONG, least LONG, ends_sha256 STRING")
    return convs.join(ends.drop("key"), F.col("conv_id") == F.col("least")).select("seq", "n", "least", "ends_sha256")


def _common(x: bytes, y: bytes) -> int:
    """Turns at the beginning of both."""
    least = min(len(x), len(y))
    if x[:least] == y[:least]:
        return least // WIDTH
    a, b = np.frombuffer(x, np.uint8, least), np.frombuffer(y, np.uint8, least)
    return int(np.argmax(a != b)) // WIDTH


class _Minima:
    """Range minima of an array in constant time: a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima over ``first..last``, both included."""
        out = np.zeros(len(first), dtype=self.levels[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(self.levels[k][first[some]], self.levels[k][last[some] - (1 << int(k)) + 1])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which all values after ``at`` are ``least`` or more."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            ok = at + 1 < len(level)
            ok &= level[np.minimum(at + 1, len(level) - 1)] >= least
            at[ok] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which on all values after it, up to ``at``, are ``least`` or more."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            first = at - (1 << k) + 1
            ok = first >= 1
            ok &= self.levels[k][np.maximum(first, 0)] >= least
            at[ok] -= 1 << k
        return at


class Block:
    """The sorted distinct sequences of a block, and the sequences next to it (None at either end of all)."""

    def __init__(self, rows: pa.Table, before: bytes | None, after: bytes | None):
        seqs = rows.column("seq").to_pylist()
        order = sorted(range(len(seqs)), key=seqs.__getitem__)
        self.seqs = [seqs[i] for i in order]
        self.n = rows.column("n").to_numpy()[order]
        self.ids = rows.column("least").to_numpy()[order]
        self.digests = np.array(rows.column("ends_sha256").to_pylist(), dtype=object)[order]
        size = len(self.seqs)
        self.lens = np.array([len(s) // WIDTH for s in self.seqs])
        # Turns that a sequence shares with the one before it; -1: there is none, so that it brings the root as well.
        self.lcp = np.array([
            _common(before, self.seqs[0]) if before is not None else -1,
            *[_common(x, y) for x, y in zip(self.seqs, self.seqs[1:], strict=False)]], dtype=np.int64)
        #: Turns of the first and of the last sequence whose nodes go on in other blocks, -1: not even the root.
        self.opens = int(self.lcp[0]), _common(self.seqs[-1], after) if after is not None else -1
        self.minima, self.least_ids = _Minima(self.lcp), _Minima(self.ids)
        # Bytes of texts up to each turn; a sequence of t turns has t + 1 places.
        turns = np.frombuffer(b"".join(self.seqs), np.uint8).reshape(-1, WIDTH)
        sizes = np.ascontiguousarray(turns[:, 16:]).view(">u8").reshape(-1).astype(np.int64)
        ends = np.cumsum(self.lens)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.concatenate([[0], np.cumsum(self.lens + 1)])[:-1]
        i = np.arange(size).repeat(self.lens + 1)
        self.bytes = sums[np.arange(len(i)) - i] - sums[(ends - self.lens)[i]]
        total = self.bytes[self.first + self.lens]
        follows = np.append(self.lcp[1:], self.opens[1])
        self.sum_n = np.concatenate([[0], np.cumsum(self.n)])
        self.sum_all = np.concatenate([[0], np.cumsum(self.n * total)])
        self.sum_new = np.concatenate([[0], np.cumsum(total - self.up_to(np.arange(size), np.maximum(self.lcp, 0)))])
        self.sum_leaves = np.concatenate([[0], np.cumsum(follows < self.lens)])
        self.total = total
        self.branches = np.sort(np.maximum(self.lcp, 0) * size + np.arange(size))

    def up_to(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bytes of the texts of a sequence's first turns."""
        return self.bytes[self.first[i] + depth]

    def stats(self, i: np.ndarray, depth: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
        """What this block adds to the nodes of depth ``depth`` over the sequences ``left..right``, ``i`` among them."""
        n = self.sum_n[right + 1] - self.sum_n[left]
        above = self.up_to(i, np.maximum(depth - 1, 0))
        every = self.sum_all[right + 1] - self.sum_all[left] - n * above
        # Texts of the nodes that begin here: the first sequence's from this depth on, the others' after what they share.
        known = np.maximum(np.maximum(self.lcp[left], depth - 1), 0)
        once = self.total[left] - self.up_to(left, known) + self.sum_new[right + 1] - self.sum_new[left + 1]
        places = depth * len(self.seqs)
        branches = np.searchsorted(self.branches, places + right, "right") - np.searchsorted(self.branches, places + left, "right")
        children = branches + ((self.lcp[left] <= depth) & (self.lens[left] > depth))
        return {
            "n": n, "least": self.least_ids.least(left, right), "children": children,
            "leaves": self.sum_leaves[right + 1] - self.sum_leaves[left], "saved": every - once}


def _open_nodes(block: Block) -> list[dict]:
    """What a block adds to nodes that go on in other blocks: beginnings of its first and last sequence."""
    out = []
    first, last = block.opens
    end = len(block.seqs) - 1
    for side, at, upto in ("first", 0, first), ("last", end, last):
        depth = np.arange(upto + 1)
        i = np.full(len(depth), at)
        left, right = block.minima.left(i, depth), block.minima.right(i, depth)
        values = block.stats(i, depth, left, right)
        for d in depth.tolist():
            both = left[d] == 0 and right[d] == end and d <= min(first, last)
            if side == "last" and left[d] == 0 and d <= first:
                continue  # it is among the first one's
            out.append({
                "side": "both" if both else side, "depth": d,
                "key": hashlib.sha256(block.seqs[at][:d * WIDTH]).digest()[:16], **{k: int(v[d]) for k, v in values.items()}})
    return out


def _partial(rows: pa.Table, halo: pa.Table) -> pa.Table:
    schema = pa.schema([
        ("block", pa.int32()), ("side", pa.string()), ("depth", pa.int64()), ("key", pa.binary()),
        *[(c, pa.int64()) for c in ("n", "least", "children", "leaves", "saved")]])
    if not rows.num_rows:
        return schema.empty_table()
    (beside,) = halo.to_pylist()
    found = _open_nodes(Block(rows, beside["before"], beside["after"]))
    return pa.Table.from_pylist([{"block": beside["block"], **r} for r in found], schema=schema)


def _nodes(rows: pa.Table, beside: pa.Table) -> pa.Table:
    """The nodes that begin in a block. ``beside`` has its neighbours and its open nodes with their values over all blocks."""
    beside = beside.to_pylist()
    (halo,) = [r for r in beside if r["side"] == "halo"]
    block = Block(rows, halo["before"], halo["after"])
    size = len(block.seqs)
    i = np.arange(size).repeat(block.lens + 1)
    depth = np.arange(len(i)) - block.first[i]
    left, right = block.minima.left(i, depth), block.minima.right(i, depth)
    new = (left == i) & (depth > block.lcp[i])  # the first sequence of its node, also over all blocks
    values = block.stats(i, depth, left, right)
    whole = {k: v.copy() for k, v in values.items()}
    for r in beside:
        if r["side"] == "halo":
            continue
        d = r["depth"]
        at = 0 if r["side"] in ("first", "both") else size - 1
        place = block.first[at] + d
        # All candidates of the same interval and depth stand for this node.
        same = (depth == d) & (left == left[place]) & (right == right[place])
        for k in whole:
            whole[k][same] = r[k]
    places = np.flatnonzero(new)
    at, deep = i[places], depth[places]
    parent = np.where(deep > 0, whole["least"][np.maximum(places - 1, 0)], 0)
    digest = np.where(deep == block.lens[at], block.digests[at], NOTHING)
    return pa.table({
        "conv_id": whole["least"][places], "depth": deep.astype(np.int64),
        "parent_conv_id": pa.array(parent, pa.int64(), mask=deep == 0), "n_convs": whole["n"][places],
        "n_children": whole["children"][places].astype(np.int64), "n_leaves": whole["leaves"][places].astype(np.int64),
        "saved_tokens": whole["saved"][places], "ends_sha256": pa.array(digest.tolist(), pa.string())})


def trie(convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``(conv_id, seq)``, as :func:`sequences` makes them.

    ``conv_id`` is the smallest member, ``saved_tokens`` the bytes of text that sharing beginnings would save in the subtree.
    """
    spark = convs.sparkSession
    seqs = stored(distinct_sequences(stored(convs, "trie-conversations")), "trie-distinct")
    turns = seqs.agg(F.sum(F.octet_length("seq") / WIDTH + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / BLOCK_TURNS))
    blocks = stored(seqs.repartitionByRange(parts, "seq").withColumn("block", F.spark_partition_id()), "trie-blocks")

    ends = stored(blocks.groupBy("block").agg(F.min("seq").alias("low"), F.max("seq").alias("high")), "trie-ends")
    filled = sorted(r["block"] for r in ends.select("block").collect())  # a number for each block, nothing of the rows
    beside = spark.createDataFrame(
        list(zip(filled, [None, *filled], [*filled[1:], None], strict=False)), "block INT, previous INT, next INT")
    halo = beside.join(ends.select(F.col("block").alias("previous"), F.col("high").alias("before")), "previous", "left").join(
        ends.select(F.col("block").alias("next"), F.col("low").alias("after")), "next", "left").select("block", "before", "after")

    grouped = blocks.groupBy("block")
    partial = stored(grouped.cogroup(halo.groupBy("block")).applyInArrow(_partial, OPEN), "trie-open")
    sums = partial.groupBy("depth", "key").agg(F.min("least").alias("least"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    found = partial.select("block", "side", "depth", "key").join(sums, ["depth", "key"]).select(
        "block", "side", "depth", "n", "least", "children", "leaves", "saved")
    given = halo.withColumn("side", F.lit("halo")).unionByName(found, allowMissingColumns=True)
    return grouped.cogroup(given.groupBy("block")).applyInArrow(_nodes, NODE)
