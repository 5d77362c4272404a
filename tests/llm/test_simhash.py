import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from repolens.llm.components import components
from repolens.llm.simhash import (
    bit_statistics, choose_blocks, fingerprint, keep_one, links, near_duplicates, signature_masks,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, distance=3):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= distance:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "one", "One TWO", "a b c", "a b c d a b c", "É é  x ñ\x0bq\x1cz", "w " * 500,
    " ".join(str(k) for k in range(70_000))])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("n", [10, 10_000, 10_000_000, 10_000_000_000])
def test_blocks_miss_no_pair(n):
    both = np.full((64, 64), n / 4)
    np.fill_diagonal(both, n / 2)
    blocks = choose_blocks(n, both)
    assert sum(t + 1 for _, t in blocks) >= 4  # more than the distance: one block always agrees
    assert len({b for bits, _ in blocks for b in bits}) == sum(len(bits) for bits, _ in blocks)
    masks = [m % (1 << 64) for m in signature_masks(blocks)]
    rnd = random.Random(n)
    for _ in range(300):
        error = sum(1 << b for b in rnd.sample(range(64), 3))
        assert any(error & m == 0 for m in masks)


def clustered(rnd, n):
    values = set()
    while len(values) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 30])):
            values.add(base)
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                base ^= 1 << b
    return sorted(values)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("crowd", [4096, 3])
def test_links_have_the_components_of_all_links(spark, crowd):
    values = clustered(random.Random(crowd), 250)
    table = spark.createDataFrame([(signed(v),) for v in values], "fp LONG").repartition(3)
    edges = links(table, crowd=crowd)
    for r in edges.collect():
        assert ((r["u"] ^ r["v"]) % (1 << 64)).bit_count() <= 3
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(edges).collect()}
    groups = {}
    for v, root in roots(values).items():
        groups.setdefault(root, set()).add(found.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_bit_statistics(spark):
    values = [0, 5, -1, 1 << 40]
    n, both = bit_statistics(spark.createDataFrame([(v,) for v in values], "fp LONG"))
    bits = np.array([[v >> b & 1 for b in range(64)] for v in values])
    assert n == 4 and (both == bits.T @ bits).all()


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(100, 101), (7, 7)], "u LONG, v LONG")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{k: 0 for k in range(60)}, 100: 100, 101: 100}


def test_groups_of_rows(spark):
    text = " ".join(f"word{k}" for k in range(300))
    rows = [(9, text, "a"), (4, text + " more", "b"), (4, text, "c"), (None, text, "d"), (1, None, "e"), (2, "", "f"),
            (3, "other words here", "g"), (3, "other words here", "g")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, component_id STRING")
    found = sorted((str(r["doc_id"]), r["component_id"]) for r in near_duplicates(docs).collect())
    assert found == [("1", 1), ("2", 1), ("3", 3), ("3", 3), ("4", 4), ("4", 4), ("9", 4), ("None", 4)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["component_id"] in "bceg") for r in kept.collect()) == [(1, True), (3, True), (4, True)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert near_duplicates(docs).count() == 0 and keep_one(docs).count() == 0
