import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import prefix_trie
from repolens.llm.prefix_trie import NOTHING, _Minima, sequences, trie, with_heads

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING"


def ordered(rows):
    """``{conv_id: [(role, text)]}``; no two turns of a number in these tests differ."""
    out = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def brute(convs):
    """The nodes of ``{conv_id: turns}``, from sets of members."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    out = set()
    for node, ids in members.items():
        below = {m: i for m, i in members.items() if m[:len(node)] == node}
        parents = {m[:-1] for m in members if m}
        ends = sorted(c for c in ids if len(convs[c]) == len(node))
        out.add((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids),
            sum(len(m) == len(node) + 1 for m in below), sum(m not in parents for m in below),
            sum((len(i) - 1) * len(m[-1][1].encode()) for m, i in below.items() if m),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def found(spark, rows):
    out = [tuple(r) for r in trie(sequences(spark.createDataFrame(rows, SCHEMA))).collect()]
    assert len(out) == len(set(out))
    return set(out)


def random_rows(seed, convs=60):
    rng = random.Random(seed)
    words = ["", "a", "ä", "bb", None]
    return [(c, t, rng.choice(["u", None]), rng.choice(words)) for c in range(convs) for t in range(rng.choice([1, 1, 2, 3, 5, 9]))]


@pytest.mark.parametrize("seed", range(3))
def test_equals_sets_of_members(spark, seed):
    rows = random_rows(seed)
    assert found(spark, rows) == brute(ordered(rows))


def test_nodes_over_many_blocks(spark):
    """One beginning, and one whole conversation, in most rows, over more blocks than there are kinds."""
    rows = random_rows(7, 40) + [r for c in range(100, 160) for r in ((c, 0, "u", "same"), (c, 1, "a", "same"))]
    rows += [r for c in range(200, 240) for r in ((c, 0, "u", "same"), (c, 1, "a", "same"), (c, 2, "u", str(c)), (c, 3, "a", "x" * c))]
    want = brute(ordered(rows))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in "1", "3", "23":
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert found(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_nulls_repeats_and_order(spark):
    rows = [
        (1, 2, "u", "second"), (1, None, "u", "first"), (1, 2, "u", "second"), (2, 0, None, None), (3, 0, "", ""),
        (None, 0, "u", "lost"), (-4, 5, "u", "first")]
    want = brute(ordered([r for r in rows if r[0] is not None]))
    assert found(spark, rows) == want
    assert {r[3] for r in want if r[1] == 1} == {2}  # an empty turn, and the first turn of 1 and -4, are shared


def test_ties_have_one_order(spark):
    rows = [(1, 0, "u", "x"), (1, 0, "a", "y"), (2, 0, "a", "y"), (2, 0, "u", "x")]
    assert {(r[0], r[1], r[3]) for r in found(spark, rows)} == {(1, 0, 2), (1, 1, 2), (1, 2, 2)}


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie(sequences(empty)).collect() == []
    more = spark.createDataFrame([(5, 0, "u", "x")], SCHEMA).withColumn("seq", F.lit(1)).withColumn("n", F.lit("n")).withColumn("block", F.lit(2))
    rows = trie(sequences(more)).collect()
    one = hashlib.sha256(b"5").hexdigest()
    assert {tuple(r) for r in rows} == {(5, 0, None, 1, 1, 1, 0, NOTHING), (5, 1, 5, 1, 0, 1, 0, one)}


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, t, "u", f"{c}-{t}") for c in range(1, 30) for t in range(1 + c % 4)]  # no conversation 0: its group has no heads
    conv = F.col("conv_id")
    own = sequences(spark.createDataFrame(rows, SCHEMA))
    cut = F.crc32(conv.cast("string").cast("binary")) % 9
    out = [tuple(r) for r in trie(with_heads(own, conv - conv % 5, cut, 8)).collect()]
    given = ordered(rows)
    rebuilt = {}
    for c, turns in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = given.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    assert set(out) == brute(rebuilt) and len(out) == len(set(out))


def test_long_texts_and_long_conversations(spark):
    rows = [(1, t, "u", "y") for t in range(700)] + [(2, t, "u", "y") for t in range(701)] + [(3, 0, "u", "z" * 3_000_000)]
    out = found(spark, rows)
    assert len(out) == 1 + 701 + 1
    assert (1, 0, None, 3, 2, 2, 700, NOTHING) in out and (2, 701, 1, 1, 0, 1, 0, hashlib.sha256(b"2").hexdigest()) in out


def test_lists_of_ids_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, 0, "u", "same") for c in range(0, 300, 3)]
    assert found(spark, rows) == brute(ordered(rows))


def test_range_minima():
    rng = np.random.default_rng(0)
    for size in 1, 2, 3, 17, 64:
        values = rng.integers(0, 5, size)
        minima = _Minima(values)
        first, last = (g.ravel() for g in np.meshgrid(np.arange(size), np.arange(size)))
        ok = first <= last
        assert minima.least(first[ok], last[ok]).tolist() == [values[a:b + 1].min() for a, b in zip(first[ok], last[ok], strict=True)]
        at, least = (g.ravel() for g in np.meshgrid(np.arange(size), np.arange(6)))
        right = [next((r - 1 for r in range(a + 1, size) if values[r] < d), size - 1) for a, d in zip(at, least, strict=True)]
        left = [next((x for x in range(a, 0, -1) if values[x] < d), 0) for a, d in zip(at, least, strict=True)]
        assert minima.right(at, least).tolist() == right and minima.left(at, least).tolist() == left
