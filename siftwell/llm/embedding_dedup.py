"""Near-duplicate vectors: an exact range join in a metric space.

Angles are a metric, so ``cosine >= threshold`` is a range of an angle ``reach``, and nothing here is approximate.

1. Equal vectors are folded to one class by a partial aggregate; a class knows how many vectors it stands for.
2. Pivots are chosen farthest-first among a bounded sample (``SAMPLE_ROWS``; it only decides how the work is cut), moved to
   the middle of what is near them. How many are used, ``MAX_PIVOTS`` at most for each length of vectors, is the number with
   the least estimated cost on the sample. A class belongs to the cell of its nearest pivot.
3. Boundary replication: a class is sent to each further cell that could hold something within reach of it. By the triangle
   inequality its angle to the cell's pivot is then within reach of the least and greatest angle of the cell's own classes,
   and it is within reach of the hyperplane between the two pivots. So a class meets all its partners in its own cell.
4. Cells are joined independently, in blocks of ``BLOCK`` own classes and ``BLOCK`` classes, so that the memory of a task is
   bounded whatever a cell holds. Two classes within half the reach of the same pivot are linked by the triangle inequality:
   such *inner* classes are counted and chained with a partial aggregate and never compared with each other, which is what
   keeps large groups of near copies linear.
5. A block returns how many vectors each own class is linked with, and a star of links for each group that it connects
   (never all pairs); the stars give connected components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
vectors of different lengths with each other; rows without an id link with nothing and are kept, without a component; rows of one id are vectors of their own,
so that the copy of a row counts as one of its links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise
from siftwell.llm.components import connected_components, join_sums

SAMPLE_ROWS = 20_000
MAX_PIVOTS = 2048
#: Numbers of rows in a block, of rows compared at once, and of comparisons that cost as much as sending a class to a cell.
BLOCK, STRIP, SENT = 8192, 256, 2000
#: Bounds of angles are widened by this (the angle of a cosine next to 1 is known to 1e-8), and cosines so near to the
#: threshold are computed again by the plain formula.
MARGIN, TIE = 1e-7, 1e-12


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their size was."""
    wide = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


class Cells:
    """Pivots of one length of vectors, and which cells a vector goes to."""

    def __init__(self, pivots: np.ndarray, reach: float):
        self.pivots, self.reach = pivots, reach
        self.chord = 2 * math.sin(min(reach, math.pi) / 2)
        #: Least and greatest angle of a cell's own classes to its pivot, until they are known.
        self.low, self.high = np.zeros(len(pivots)), np.full(len(pivots), math.pi)
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))

    def home(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = unit @ self.pivots.T
        own = near.argmax(axis=1)
        return own, angles(near[np.arange(len(unit)), own])

    def reached(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and angle to the cell's pivot, of each cell that a row goes to."""
        near = unit @ self.pivots.T
        angle = angles(near)
        wide = self.reach + MARGIN
        ring = (angle <= self.high + wide) & (angle >= self.low - wide)
        beyond = near[np.arange(len(unit)), own][:, None] - near <= self.chord * self.apart[own] + MARGIN
        go = ring & beyond
        go[np.arange(len(unit)), own] = True
        rows, cells = np.nonzero(go)
        return rows, cells, angle[rows, cells]


def choose_cells(sample: np.ndarray, reach: float, total: int) -> Cells:
    """Farthest-first pivots among the unit rows of ``sample``, as many as cost least for ``total`` rows."""
    order = [0]
    nearest = sample @ sample[0]
    while len(order) < min(MAX_PIVOTS, len(sample)):
        far = int(nearest.argmin())
        if nearest[far] > math.cos(reach):  # everything is near a pivot
            break
        order.append(far)
        np.maximum(nearest, sample @ sample[far], out=nearest)

    def middle(pivots: np.ndarray) -> np.ndarray:
        own = (sample @ pivots.T).argmax(axis=1)
        close = (sample * pivots[own]).sum(axis=1) >= math.cos(reach)
        sums = pivots.copy()
        np.add.at(sums, own[close], sample[close])
        return sums / np.linalg.norm(sums, axis=1, keepdims=True)

    best, least = None, math.inf
    some = sample[:: max(1, len(sample) // 2000)]
    for k in sorted({min(len(order), 4**i) for i in range(math.ceil(math.log(MAX_PIVOTS, 4)) + 1)}):
        cells = Cells(middle(sample[order[:k]]), reach)
        own, angle = cells.home(some)
        cells.low, cells.high = np.full(k, math.pi), np.zeros(k)
        np.minimum.at(cells.low, own, angle)
        np.maximum.at(cells.high, own, angle)
        _, to, _ = cells.reached(some, own)
        mine, there = np.bincount(own, minlength=k), np.bincount(to, minlength=k)
        scale = total / len(some)
        cost = scale * (scale * float(mine @ there) + SENT * len(to)) + total * k
        if cost < least:
            best, least = Cells(cells.pivots, reach), cost
    return best


def linked(own: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two blocks have a cosine of ``threshold`` or more."""
    left, right = unit_rows(own), unit_rows(other).T
    out = np.empty((len(own), len(other)), bool)
    for first in range(0, len(own), STRIP):
        cosines = left[first : first + STRIP] @ right
        out[first : first + STRIP] = cosines >= threshold
        i, j = np.nonzero(np.abs(cosines - threshold) < TIE)
        for at in range(0, len(i), STRIP):
            a, b = own[first + i[at : at + STRIP]], other[j[at : at + STRIP]]
            plain = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            out[first + i[at : at + STRIP], j[at : at + STRIP]] = plain >= threshold
    return out


def stars(mask: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``[id, least id]`` of each id that ``mask`` connects with a smaller one: least labels spread until nothing changes."""
    rows, columns = mask.any(axis=1), mask.any(axis=0)
    mask, own, other = mask[rows][:, columns], own[rows], other[columns]
    if not len(own):
        return np.empty((0, 2), np.int64)
    top = np.iinfo(np.int64).max
    left, right = own, other
    while True:
        r = np.minimum(right, np.concatenate([np.where(mask[:, i : i + STRIP], left[:, None], top).min(axis=0) for i in range(0, len(other), STRIP)]))
        now = np.minimum(left, np.concatenate([np.where(mask[i : i + STRIP], r, top).min(axis=1) for i in range(0, len(own), STRIP)]))
        if (now == left).all() and (r == right).all():
            break
        left, right = now, r
    both = np.unique(np.stack((np.concatenate((own, other)), np.concatenate((left, right))), axis=1), axis=0)
    return both[both[:, 0] != both[:, 1]]


def usable(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch with vectors of one length at a time; ``v`` has the vectors."""
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column("v")], np.int64)
        for d in np.unique(sizes):
            yield batch.take(pa.array(np.flatnonzero(sizes == d))) if (sizes != d).any() else batch


def _blocks_of(count: Column) -> Column:
    return F.ceil(F.coalesce(count, F.lit(0)) / BLOCK).cast("int")


def linked_classes(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(id, linked)``: how many vectors of other classes each class is linked with, in parts; ``(a, b)``: links that connect.

    ``classes (id, n, v)``: different usable vectors ``v`` (doubles) that stand for ``n`` vectors each, written.
    """
    spark = classes.sparkSession
    reach = math.acos(threshold)
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = min(1.0, SAMPLE_ROWS / max(1, sum(sizes.values())))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(3), "v"), 11).cast("double") / F.lit(float(2**53))
    sample: dict[int, list] = {}
    for r in classes.filter(unit < rate).orderBy(unit).select("v").collect():  # about SAMPLE_ROWS rows
        sample.setdefault(len(r["v"]), []).append(r["v"])
    cells = {d: choose_cells(unit_rows(np.array(sample[d])), reach, n) if d in sample else Cells(np.eye(1, d), reach) for d, n in sizes.items()}
    shared = spark.sparkContext.broadcast(cells)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches):
            vectors = _vectors(batch.column("v"))
            own, angle = shared.value[vectors.shape[1]].home(unit_rows(vectors))
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "n", "v"]).columns, pa.array(own, pa.int32()), pa.array(angle)], names=["id", "n", "v", "home", "angle"])

    homes = materialise(classes.select("id", "n", "v").mapInArrow(settle, "id long, n long, v array<double>, home int, angle double"), "homes")
    rings = homes.groupBy(F.size("v").alias("d"), "home").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    for c in cells.values():
        c.low, c.high = np.full(len(c.pivots), math.inf), np.full(len(c.pivots), -math.inf)
    for r in rings.collect():  # MAX_PIVOTS rows for each length at most
        cells[r["d"]].low[r["home"]], cells[r["d"]].high[r["home"]] = r["low"], r["high"]
    shared_rings = spark.sparkContext.broadcast(cells)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches):
            for first in range(0, batch.num_rows, STRIP):
                part = batch.slice(first, STRIP)
                vectors, home = _vectors(part.column("v")), part.column("home").to_numpy()
                rows, to, angle = shared_rings.value[vectors.shape[1]].reached(unit_rows(vectors), home)
                sent = part.take(pa.array(rows)).select(["id", "n", "v"])
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(to, pa.int32()), pa.array(home[rows] == to), pa.array(angle <= reach / 2 - MARGIN)], names=["id", "n", "v", "cell", "own", "inner"])

    sent = homes.mapInArrow(send, "id long, n long, v array<double>, cell int, own boolean, inner boolean").withColumn("d", F.size("v"))
    sent = materialise(sent, "cells")
    cell = ["d", "cell"]
    inner = F.col("inner")
    own_inner, own_outer = F.count(F.when(F.col("own") & inner, 1)), F.count(F.when(F.col("own") & ~inner, 1))
    shapes = sent.groupBy(*cell).agg(
        _blocks_of(own_inner).alias("oi"), _blocks_of(own_outer).alias("oo"), _blocks_of(F.count(F.when(inner, 1))).alias("ai"), _blocks_of(F.count(F.when(~inner, 1))).alias("ao"),
        F.sum(F.when(inner, F.col("n"))).alias("all_inner"), F.min(F.when(inner, F.col("id"))).alias("hub"),
    )
    placed = sent.join(F.broadcast(materialise(shapes, "cell-shapes")), cell)  # MAX_PIVOTS rows for each length at most

    def dealt(mine: str, other: str) -> Column:
        """All blocks of the other side; for inner classes those of outer ones only. Inner blocks come first."""
        first, last = F.when(inner, F.col(f"{other}i")).otherwise(0), F.col(f"{other}i") + F.col(f"{other}o")
        return F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))

    def numbered(side: str) -> Column:
        at = lambda c: F.pmod(F.xxhash64("id"), F.greatest(F.col(c), F.lit(1))).cast("int")
        return F.when(inner, at(f"{side}i")).otherwise(F.col(f"{side}i") + at(f"{side}o"))

    keys = [*cell, "ob", "ab"]
    own = placed.filter("own").withColumns({"ob": numbered("o"), "ab": F.explode(dealt("o", "a"))}).select(*keys, "id", "v")
    every = placed.withColumns({"ab": numbered("a"), "ob": F.explode(dealt("a", "o"))}).select(*(F.col(k).alias(f"its_{k}") for k in (*keys, "id", "n", "v")))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"id": pd.Series(dtype="int64"), "linked": pd.Series(dtype="int64"), "to": pd.Series(dtype="Int64")})
        if not (len(left) and len(right)):
            return out
        a, b, n = left["id"].to_numpy(), right["its_id"].to_numpy(), right["its_n"].to_numpy()
        mask = linked(np.stack(left["v"].to_list()), np.stack(right["its_v"].to_list()), threshold)
        mask &= a[:, None] != b
        counts = np.concatenate([mask[i : i + STRIP] @ n for i in range(0, len(a), STRIP)])
        chain = stars(mask, a, b)
        some = counts > 0
        return pd.concat([pd.DataFrame({"id": a[some], "linked": counts[some], "to": pd.array([None] * int(some.sum()), "Int64")}), pd.DataFrame({"id": chain[:, 0], "linked": 0, "to": pd.array(chain[:, 1], "Int64")})], ignore_index=True)

    found = own.groupBy(*keys).cogroup(every.groupBy(*(f"its_{k}" for k in keys))).applyInPandas(compare, "id long, linked long, to long")
    found = materialise(found, "links")
    close = placed.filter(inner)
    counts = found.select("id", "linked").unionByName(close.filter("own").select("id", (F.col("all_inner") - F.col("n")).alias("linked")))
    edges = found.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")).unionByName(close.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    return counts, edges


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row: vectors are linked if their cosine is ``threshold`` (0 to 1, not 0) or more."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    takes_part = F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False))
    key = F.when(takes_part, F.struct(F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), F.col("v")).alias("k2")))
    rows = rows.withColumn("key", key)
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    counts, edges = linked_classes(classes.select("id", "n", "v"), threshold)
    parts = materialise(connected_components(edges), "vector-components")
    named = join_sums(parts, classes.select("id", "least"), "id")
    named = join_sums(named, named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("id", "component_id")
    sums = counts.groupBy("id").agg(F.sum("linked").alias("linked"))
    label = classes.select("id", "key", "least", "n").join(sums, "id", "left").join(named, "id", "left")
    label = label.select("key", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = join_sums(rows.select("vec_id", "key"), materialise(label, "vector-labels"), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
