import random
import zlib

import numpy as np
import pytest

from repolens.llm.packing import OpenWindows, best_fit_decreasing, layout, pack, pieces, sequences


def naive(lengths, window):
    free, places = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [k for k, f in enumerate(free) if f >= lengths[i]]
        k = min(fits, key=lambda k: free[k]) if fits else len(free)
        if not fits:
            free.append(window)
        places[i] = free[k]
        free[k] -= lengths[i]
    return places, len(free)


@pytest.mark.parametrize("seed", range(20))
def test_tightest_window_is_found(seed):
    rnd = random.Random(seed)
    window = rnd.choice([1, 7, 64, 100])
    lengths = [rnd.randint(1, window) for _ in range(rnd.randint(0, 200))]
    places = best_fit_decreasing(lengths, window)
    free, n = naive(lengths, window)
    assert len({k for k, _ in places}) == n
    assert [window - at for _, at in places] == free  # which of equally tight windows is taken may differ


def test_open_windows():
    tree = OpenWindows(10)
    assert tree.take(1) is None
    for free, number in (3, 0), (7, 1), (10, 2):
        tree.put(free, number)
    assert tree.take(4) == (7, 1)
    assert tree.take(4) == (10, 2)
    assert tree.take(4) is None and tree.take(3) == (3, 0)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k * 7 % 900))) for k in range(150)]
    return spark.createDataFrame([*rows, (3, rows[3][1]), (None, "a"), (5, None)], "doc_id LONG, text STRING").repartition(3)


def test_each_id_lies_in_one_piece(spark, docs):
    cut = pieces(docs, window=256)
    found = layout(cut, 256, group=40).collect()
    assert sum(r["length"] for r in found) == sum(len(r["ids"]) // 4 for r in cut.collect())
    windows = {}
    for r in found:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in found) / (256 * len(windows)) > 0.97
    by_doc = {}
    for r in found:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    copies = {(3, n): 2 for d, n in by_doc if d == 3}
    for (doc, total), parts in by_doc.items():
        assert sum(n for _, n in parts) == total * copies.get((doc, total), 1), doc


def test_sequences_hold_the_ids(spark, docs):
    cut = pieces(docs, window=256)
    places = layout(cut, 256, group=40)
    out = {r["sequence_id"]: r for r in sequences(cut, places, 256, pad_id=7).collect()}
    for r in places.collect():
        whole = out[r["sequence_id"]]
        part = whole["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"]
    for r in out.values():
        ids = np.frombuffer(r["ids"], "<u4")
        n = r["n_tokens"]
        assert len(ids) == (n if n & (n - 1) == 0 else 256) and (ids[n:] == 7).all()


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0
