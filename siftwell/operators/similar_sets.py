"""All pairs of similar sets, exactly: a prefix filter, then parity marks, then the sets of what is left.

1. Terms become 64-bit hashes, once, and the sets are written; equal sets are folded to their least id by hashes alone.
2. Terms have one order, frequent ones last: up to ``FREQUENT_TERMS`` of them by count, all others by hash (any order is
   right, rare terms first only leave fewer candidates). Two similar sets share a term among the first terms of both, so
   only these meet in a join, of rows of four numbers. The larger set needs ``n - ceil(threshold * n) + 1`` of them, the
   smaller one fewer, and where they stand bounds from above what the sets have in common.
3. A set's marks are a bit array in which each term turns one bit over. Two sets' marks differ in no more bits than the
   sets have terms that are not in both, so marks that differ in too many rule a pair out. They are broadcast to the join, and
   only the pairs that they leave are shuffled; where all marks are more than ``BROADCAST_BYTES``, pairs are shuffled to them.
4. The sets of the pairs left are compared in as many rounds as their bytes need: a round broadcasts up to
   ``BROADCAST_BYTES`` of the second sets, so that a first set moves once a round, not once a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.sources.contracts import written

#: Terms whose counts are known to the tasks (16 bytes each); counts below ``LEAST_COUNT`` are never looked at.
FREQUENT_TERMS = 1 << 19
LEAST_COUNT = 16
#: Marks or sets of so many bytes may be broadcast. The driver holds them about twice while it builds the table.
BROADCAST_BYTES = 48_000_000
#: Bits of marks for each term: as many of these as can be broadcast.
MARK_BITS = (4, 2, 1)
LEAST_MARK_BITS = 128
#: Sets of so many are worked on at once in a task.
SLICE = 1000
_EPS = 1e-6


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent terms, sorted, and their places in the order of counts."""
    counts = sets.select(F.explode("hashes").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)
    counts = written(counts, "set-terms")
    steps = counts.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("terms")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for step, terms in steps:
        if (held := held + terms) > FREQUENT_TERMS:
            break
        least = step
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    known = counts.filter(F.floor(F.log2("n")) >= least).toArrow()
    terms, n = known["term"].to_numpy(), known["n"].to_numpy()
    place = np.empty(len(terms), np.int64)
    place[np.lexsort((terms, n))] = np.arange(1, len(terms) + 1)
    order = np.argsort(terms)
    return terms[order], place[order]


def _mark_sizes(n: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the marks of sets of ``n`` terms: powers of two."""
    return np.maximum(LEAST_MARK_BITS, 2 ** np.ceil(np.log2(bits * n)).astype(np.int64))


def _prefixes(sets: DataFrame, threshold: float, bits: int) -> DataFrame:
    """``row, n, keys, marks`` of ``sets (row, n, hashes)``: the first terms in the common order, and the marks."""
    terms, places = _frequent(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                lists = batch.column("hashes")
                n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                own = np.repeat(np.arange(len(n)), n)
                place = np.zeros(len(flat), np.int64)
                if len(terms):
                    found = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
                    place = np.where(terms[found] == flat, places[found], 0)
                order = np.lexsort((flat, place, own))
                start = np.cumsum(n) - n
                most = n - np.ceil(threshold * n - _EPS).astype(np.int64) + 1
                first = np.arange(len(flat)) - np.repeat(start, n) < np.repeat(most, n)
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(most, n))), pa.int32()), pa.array(flat[order][first]))
                size = _mark_sizes(n, bits)
                word = np.append(0, np.cumsum(size // 64))
                bit = flat & (np.repeat(size, n) - 1)
                marks = np.zeros(word[-1], np.uint64)
                np.bitwise_xor.at(marks, np.repeat(word[:-1], n) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
                marks = pa.ListArray.from_arrays(pa.array(word, pa.int32()), pa.array(marks.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), keys, marks], names=["row", "n", "keys", "marks"])

    return written(sets.select("row", "n", "hashes").mapInArrow(run, "row long, n int, keys array<long>, marks array<long>"), "set-prefixes")


def _differing(a: str, b: str, threshold: float) -> Column:
    """Bits that differ between marks ``a`` and ``b``, those of the larger set. Marks twice as long are folded first."""

    def folded(marks: Column) -> Column:
        half = F.shiftright(F.size(marks), 1)
        return F.zip_with(F.slice(marks, F.lit(1), half), F.slice(marks, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    longer = F.col(b)
    for _ in range(math.ceil(math.log2(1 / threshold)) if threshold < 1 else 0):
        longer = F.when(F.size(longer) > F.size(a), folded(longer)).otherwise(longer)
    return F.aggregate(F.zip_with(a, longer, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _candidates(prefixes: DataFrame, threshold: float, small: bool) -> DataFrame:
    """Pairs of rows ``a, b``, ``a`` the smaller set, that prefixes and marks do not rule out; ``small``: marks may be broadcast."""
    firsts = prefixes.select("row", "n", F.posexplode("keys").alias("place", "key"))
    side = lambda s: firsts.select("key", F.col("row").alias(s), F.col("n").alias(f"n_{s}"), F.col("place").alias(f"place_{s}"))
    both = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - _EPS)
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    early = F.col("place_a") <= F.col("n_a") - F.ceil(F.col("n_a") * (2 * threshold / (1 + threshold)) - _EPS)
    near = side("a").filter(early).join(side("b"), "key").filter(ordered & (F.col("n_a") >= F.col("n_b") * threshold - _EPS) & (rest >= both)).select("a", "b")
    marks = lambda s: prefixes.select(F.col("row").alias(s), F.col("n").alias(f"n_{s}"), F.col("marks").alias(f"marks_{s}"))
    hint = F.broadcast if small else lambda df: df
    near = (near if small else near.distinct()).join(hint(marks("a")), "a").join(hint(marks("b")), "b")
    most = (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + _EPS
    near = near.filter(_differing("marks_a", "marks_b", threshold) <= most).select("a", "b")
    return written(near.distinct() if small else near, "set-pairs")


def _confirmed(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` (ids) and ``similarity`` of the ``pairs`` of rows whose sets are similar."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    held = written(sets.join(named, "row", "left_semi").select("row", "id", "hashes"), "set-named")
    terms = held.agg(F.coalesce(F.sum(F.size("hashes") + 4), F.lit(0))).first()[0]
    rounds = max(1, math.ceil(8 * terms / BROADCAST_BYTES))
    side = lambda s: held.select(F.col("row").alias(s), F.col("id").alias(f"id_{s}"), F.col("hashes").alias(f"hashes_{s}"))
    part = F.pmod(F.xxhash64("b"), F.lit(rounds))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    union = F.size("hashes_a") + F.size("hashes_b") - both
    out = []
    for i in range(rounds):
        of_round = pairs.filter(part == i).join(F.broadcast(side("a")) if rounds == 1 else side("a"), "a").join(F.broadcast(side("b").filter(part == i)), "b")
        ids = (F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        similar = of_round.filter((F.col("id_a") != F.col("id_b")) & (both >= union * threshold - 1e-9)).select(*ids, F.round(both / union, 9).alias("similarity"))
        out.append(written(similar, "set-similar") if rounds > 1 else similar)
    return reduce(DataFrame.unionByName, out)


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b, similarity)``, ``a < b``, of rows ``(id, terms)`` with a Jaccard similarity of ``threshold`` or more, exactly,
    up to equal 64-bit hashes of different terms. Equal sets are folded to their least id first; an id may have several
    sets, empty sets and sets without an id are in no pair."""
    hashes = sets.filter(F.size("terms") > 0).select("id", F.sort_array(F.transform("terms", lambda t: F.xxhash64(t))).alias("hashes"))
    prints = [F.xxhash64("hashes").alias("k1"), F.xxhash64(F.lit(1), "hashes").alias("k2")]
    rows = written(hashes.select("id", "hashes", F.size("hashes").alias("n"), *prints, F.monotonically_increasing_id().alias("row")), "set-rows")
    first = rows.filter("id is not null").groupBy("k1", "k2").agg(F.min(F.struct("id", "row")).alias("first"), F.max("n").alias("n"))
    first = written(first.select("first.row", "n"), "set-classes")
    classes, terms = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    kept = F.broadcast(first) if 16 * classes <= BROADCAST_BYTES else first
    folded = rows.join(kept.select("row"), "row", "left_semi")
    # Sizes are rounded up to a power of two, by 1.4 on average, and a row has its key and lengths.
    need = {bits: terms * bits / 8 * 1.4 + classes * (40 + LEAST_MARK_BITS / 8) for bits in MARK_BITS}
    bits = next((b for b in MARK_BITS if need[b] <= BROADCAST_BYTES), MARK_BITS[-1])
    prefixes = _prefixes(folded, threshold, bits)
    return _confirmed(folded, _candidates(prefixes, threshold, need[bits] <= BROADCAST_BYTES), threshold)
