"""Near-duplicate embeddings by a pivot-permutation index.

A bounded sample gives reference points (pivots). Each vector is described by its nearest pivots in order, and entered
in the inverted lists of the first few. Within a list, vectors that have enough pivots in common are candidates, and the cosine
of every candidate is computed in double precision. A pair is judged in the first list that both are in, so links are counted
once, and what leaves a list is a row for each vector, never a row for each pair.

Crowds need no list. Vectors within half the threshold's angle of one pivot are all linked with one another, which the
angles alone prove: such a ball of any size is a count and a hub. Its members are compared only with those outside
it that are within one and a half times the angle of the pivot, beyond which no link is possible; so the ball's links are found completely.

Lists and balls are dealt into blocks of about :data:`BLOCK` rows, and blocks are compared with blocks.

Vectors are compared where key and length are equal. Those with a null key, and vectors that are null, empty, zero or hold
null or non-finite entries, link with nothing; they are returned all the same. Rows are vectors: a repeated row links with its
copy. A null id stays null and is never the smallest. Columns of the names added are replaced; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.base import stored, with_fields
from repolens.llm.components import components

#: Rows that pivots are chosen from, and pivots at most: what fitting takes to the driver.
SAMPLE, PIVOTS = 8192, 4096
#: Rows for a pivot, as long as there are few.
ROWS_A_PIVOT = 64
#: Nearest pivots of a vector, those whose lists it is entered in, and those that candidates have in common.
NEAREST, LISTS, SHARED = 12, 5, 3
#: Rows of a block, and of what is multiplied at once.
BLOCK, TILE = 2048, 512
#: Cosines that decide whether a vector is in a ball, or out of its reach, are taken this much on the safe side.
SAFE = 1e-9

ADDED = "code ARRAY<INT>, ball INT, reach ARRAY<INT>"


def normalised(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, by way of their largest entry so that no square overflows; zero and non-finite rows become zero."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        most = np.abs(rows).max(axis=1, initial=0)
        good = np.isfinite(most) & (most > 0)
        scaled = np.where(good[:, None], rows / np.where(good, most, 1.0)[:, None], 0.0)
        norm = np.sqrt((scaled * scaled).sum(axis=1))
        return scaled / np.where(norm > 0, norm, 1.0)[:, None]


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    """Normalised rows in double precision of a list column of single or double precision."""
    return normalised(column.flatten().to_numpy().reshape(-1, d).astype(np.float64))


def choose_pivots(sample: np.ndarray, wanted: int, cosine: float) -> np.ndarray:
    """Sampled vectors of which none links to an earlier one, each moved to the middle of all sampled vectors that link to it."""
    chosen: list[int] = []
    free = np.ones(len(sample), dtype=bool)
    centres = []
    for i in range(len(sample)):
        if len(chosen) == wanted:
            break
        if free[i]:
            near = sample @ sample[i] >= cosine
            chosen.append(i)
            centres.append(sample[near].sum(axis=0))
            free &= ~near
    return normalised(np.array(centres)) if chosen else np.zeros((0, sample.shape[1]))


def fit(rows: DataFrame, cosine: float) -> dict[int, np.ndarray]:
    """Pivots for each length of ``(uid, vec)`` rows, of :data:`SAMPLE` rows at most that a hash of the row chooses."""
    n = rows.count()
    if not n:
        return {}
    draw = F.xxhash64("uid")
    # Twice the share that is wanted, so that only a bounded part is ranked.
    share = min(1.0, 2 * SAMPLE / n)
    some = rows.filter(F.abs(draw / 2.0**63) <= share).orderBy(draw, "uid").limit(SAMPLE).select("size", "vec").toArrow()
    wanted = min(PIVOTS, max(64, n // ROWS_A_PIVOT))
    sizes = some.column("size").to_numpy()
    vecs = some.column("vec").to_pylist()
    return {
        int(d): choose_pivots(normalised(np.array([v for v, s in zip(vecs, sizes, strict=True) if s == d])), wanted, cosine)
        for d in np.unique(sizes)}


def _lists(flat: np.ndarray, lens: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(flat))


def indexed(rows: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """The ``(uid, label, size, vec)`` rows with their nearest pivots in order, the ball they are in (-1: none) and the balls within reach.

    Vectors of a length that the sample doesn't have share one list.
    """
    angle = math.acos(cosine)
    inside, within = math.cos(angle / 2) + SAFE, math.cos(min(1.5 * angle, math.pi)) - SAFE

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for d in np.unique(sizes):
                some = batch.filter(pa.array(sizes == d))
                x = _vectors(some.column("vec"), d)
                points = pivots.get(int(d), np.zeros((1, d)))
                near = np.empty((len(x), min(NEAREST, len(points))), dtype=np.int32)
                ball, reach = np.full(len(x), -1, dtype=np.int32), []
                for at in range(0, len(x), TILE):
                    cos = x[at:at + TILE] @ points.T
                    best = np.argpartition(-cos, near.shape[1] - 1, axis=1)[:, :near.shape[1]]
                    order = np.argsort(-np.take_along_axis(cos, best, axis=1), axis=1, kind="stable")
                    near[at:at + TILE] = np.take_along_axis(best, order, axis=1)
                    first = near[at:at + TILE, 0]
                    ball[at:at + TILE] = np.where(cos[np.arange(len(cos)), first] >= inside, first, -1)
                    reach += [np.flatnonzero(r).astype(np.int32) for r in cos >= within]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, _lists(near.reshape(-1), np.full(len(x), near.shape[1])), pa.array(ball),
                     _lists(np.concatenate([np.zeros(0, np.int32), *reach]), [len(r) for r in reach])],
                    ["uid", "label", "size", "vec", "code", "ball", "reach"])

    rows = rows.select("uid", "label", "size", "vec")
    return rows.mapInArrow(describe, with_fields(rows.schema, ADDED))


def roots_of(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a table of links: the first row of each one's component, its own number where a row has no links."""
    size = linked.shape[0]
    row, column = np.arange(size), np.full(linked.shape[1], size)
    while True:
        column = np.where(linked, row[:, None], size).min(axis=0, initial=size)
        new = np.minimum(row, np.where(linked, column[None, :], size).min(axis=1, initial=size))
        new = np.minimum(new, new[new])
        if (new == row).all():
            return row, column
        row = new


def _codes(rows: pa.Table, width: int) -> np.ndarray:
    return rows.column("code").combine_chunks().flatten().to_numpy().reshape(-1, width)


def compare(cell: pa.Table, cosine: float) -> pa.Table:
    """``(uid, n, to)`` for each vector of a cell that has links in it: their number, and another vector of its component.

    A cell of a list has a block on the left and, unless it is compared with itself, one on the right. A cell of a ball has
    members on the left and others on the right.
    """
    schema = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])
    side = cell.column("side").to_numpy()
    left, right = cell.filter(pa.array(side == 0)), cell.filter(pa.array(side == 1))
    itself = cell.column("low")[0].as_py() == cell.column("high")[0].as_py() and not cell.column("ball")[0].as_py()
    if itself:
        right = left
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    d, pivot = cell.column("size")[0].as_py(), cell.column("pivot")[0].as_py()
    x, y = (_vectors(t.column("vec").combine_chunks(), d) for t in (left, right))
    uids = [t.column("uid").to_numpy() for t in (left, right)]
    if not cell.column("ball")[0].as_py():
        width = len(left.column("code")[0])
        codes = [_codes(t, width) for t in (left, right)]
        points = np.unique(np.concatenate([c.ravel() for c in codes]))
        member = [np.zeros((len(c), len(points)), dtype=np.float32) for c in codes]
        # Lists that come before this one: a pair that shares one was judged there.
        earlier = [np.zeros((len(c), len(points)), dtype=np.float32) for c in codes]
        for c, m, e in zip(codes, member, earlier, strict=True):
            at = np.searchsorted(points, c)
            np.put_along_axis(m, at, 1, axis=1)
            listed = c[:, :LISTS]
            np.put_along_axis(e, at[:, :LISTS], (listed < pivot).astype(np.float32), axis=1)
        shared = min(SHARED, width)
    counts = [np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)]
    links = []
    for i in range(0, len(x), TILE):
        for j in range(i if itself else 0, len(y), TILE):
            ok = x[i:i + TILE] @ y[j:j + TILE].T >= cosine
            if not cell.column("ball")[0].as_py():
                ok &= member[0][i:i + TILE] @ member[1][j:j + TILE].T >= shared
                ok &= earlier[0][i:i + TILE] @ earlier[1][j:j + TILE].T == 0
            if itself and i == j:
                ok = np.triu(ok, 1)
            if not ok.any():
                continue
            a, b = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            counts[0][i + a] += ok.sum(axis=1)[a]
            counts[1][j + b] += ok.sum(axis=0)[b]
            roots = roots_of(ok[np.ix_(a, b)])
            hub = uids[0][i + a]
            links += [(hub, hub[roots[0]]), (uids[1][j + b], hub[roots[1]])]
    found = [(u[c > 0], c[c > 0], u[c > 0]) for u, c in zip(uids, counts, strict=True)]
    found += [(u, np.zeros(len(u), np.int64), to) for u, to in links]
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=schema)


def _cells(index: DataFrame) -> DataFrame:
    """The index's rows by the cells in which they are compared: ``key`` and ``pivot`` name a list or ball, ``low`` and ``high`` its blocks."""
    kept = ["uid", "label", "size", "vec", "code"]
    loose = index.filter("ball = -1").select(
        *kept, F.explode(F.slice("code", 1, LISTS)).alias("pivot"), F.lit(False).alias("ball"), F.lit(0).alias("side"))
    members = index.filter("ball >= 0").select(*kept, F.col("ball").alias("pivot"), F.lit(True).alias("ball"), F.lit(0).alias("side"))
    # Of two balls the one with the lower number compares their members.
    near = index.select(*kept, F.col("ball").alias("own"), F.explode("reach").alias("pivot")).filter("own = -1 OR own > pivot").select(
        *kept, "pivot", F.lit(True).alias("ball"), F.lit(1).alias("side"))
    entries = loose.unionByName(members).unionByName(near)
    key = ["label", "size", "pivot", "ball"]
    sizes = entries.groupBy(*key).agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("n0"), F.count(F.when(F.col("side") == 1, 1)).alias("n1"))
    # A ball without vectors near it, and a list of one, have nothing to compare.
    sizes = sizes.filter("(ball AND n0 > 0 AND n1 > 0) OR (NOT ball AND n0 > 1)").select(
        *key, F.ceil(F.col("n0") / BLOCK).cast("int").alias("b0"), F.ceil(F.col("n1") / BLOCK).cast("int").alias("b1"))
    rows = entries.join(sizes, key)
    own = F.when(F.col("side") == 0, F.pmod(F.xxhash64("uid"), "b0")).otherwise(F.pmod(F.xxhash64("uid"), "b1")).cast("int")
    rows = rows.withColumn("own", own)
    other = F.when(F.col("ball") & (F.col("side") == 0), F.col("b1")).otherwise(F.col("b0"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    # Members are on the left, those near them on the right; of a list the lower block is on the left.
    return rows.select(
        *kept, "pivot", "ball",
        F.when(F.col("ball"), F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).otherwise(F.least("own", "other")).alias("low"),
        F.when(F.col("ball"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))).otherwise(F.greatest("own", "other")).alias("high"),
        F.when(F.col("ball"), F.col("side")).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))


def near_duplicates(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", key: str = "label") -> DataFrame:
    """The rows with ``n_links``, the vectors of their key and length that have a cosine of ``cosine`` or more with them,
    ``component_id``, the smallest id that links reach, and ``kept``, whether that is their own. ``cosine`` is above 0.
    """
    added = "n_links", "component_id", "kept"
    rows = df.drop(*added).select(F.struct("*").alias("row"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")  # written: a number stays a row's
    # Single precision is half of what lists move; anything else is taken as double.
    v = F.col(f"row.`{vector}`")
    if df.schema[vector].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = rows.select(
        "uid", F.col(f"row.`{key}`").cast("string").alias("label"), F.size(v).alias("size"), v.alias("vec")).filter(
        F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.col("size") > 0) & finite & F.exists("vec", lambda c: c != 0))
    index = stored(indexed(usable, fit(usable, cosine), cosine), "index")

    def judge(cell: pa.Table) -> pa.Table:
        return compare(cell, cosine)

    cells = _cells(index).groupBy("label", "size", "pivot", "ball", "low", "high")
    parts = stored(cells.applyInArrow(judge, "uid LONG, n LONG, to LONG"), "links")
    crowds = index.filter("ball >= 0").groupBy("label", "size", "ball").agg(F.count("uid").alias("n"), F.min("uid").alias("hub"))
    members = index.filter("ball >= 0").select("uid", "label", "size", "ball").join(crowds.filter("n > 1"), ["label", "size", "ball"])
    parts = parts.unionByName(members.select("uid", (F.col("n") - 1).alias("n"), F.col("hub").alias("to")))

    counts = parts.groupBy("uid").agg(F.sum("n").alias("n_links"))
    roots = components(parts.filter("uid <> to").select(F.col("uid").alias("u"), F.col("to").alias("v")))
    ids = rows.select("uid", F.col(f"row.`{id_col}`").alias("id"))
    rooted = stored(roots.join(ids, F.col("node") == F.col("uid")).select("node", "root", "id"), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("least"))
    found = rooted.join(least, "root").select(F.col("node").alias("uid"), "least")
    own = F.col(f"row.`{id_col}`")
    component = F.coalesce("least", own)
    out = rows.join(counts, "uid", "left").join(found, "uid", "left")
    kept = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in added]
    return out.select(
        *kept, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(own == component, F.lit(False)).alias("kept"))
