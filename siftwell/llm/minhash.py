"""Near-duplicate documents: one-permutation hashing with optimal densification.

1. One pass over the texts hashes words and shingles with numpy; the sorted shingle hashes are cut into ``BANDS * ROWS``
   ranges and the least hash of each range is a signature value (one permutation). Empty ranges copy the value of the
   first non-empty range on a fixed random walk of their own (optimal densification), so equal ranges keep colliding
   with the probability of the Jaccard similarity. ``ROWS`` values make the key of a band.
2. Copies (equal word sequences) are folded by digest with a partial aggregate; each digest gets a
   number that stands for its copies from here on, so an id with several texts takes part with each of them.
3. Members of a bucket are joined to a few hubs of the bucket (see :func:`link_groups`), so n members give n - 1 pairs a
   round. Members of buckets that still span several components are then joined exactly, by a prefix and positional
   filter on their full sets (:func:`prefix_pairs`).
4. Pairs are confirmed on the full sets of shingle hashes; links give connected components.

With 32 bands of 5 values two sets of similarity 0.8 miss each other in all bands with a probability of 3e-6.

Defined results: a null or blank text has an empty set and is linked with nothing; a text shorter than a shingle is
one shingle; rows of one id count as one document, which is linked with whatever any of its texts is like; rows without
an id are kept and have no component; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import materialise
from siftwell.llm.components import connected_components, join_sums, link_groups, with_hubs
from siftwell.llm.hashing import mixed, sequence_digest, shingle_set, word_hashes

BANDS, ROWS = 32, 5
#: So many ids (16 MB) may be broadcast to prune a scan; beyond, the scan is joined by a shuffle.
BROADCAST_IDS = 2_000_000

_BINS = BANDS * ROWS
_EDGES = np.array([(i << 64) // _BINS for i in range(_BINS)], dtype=np.uint64)
_RNG = np.random.default_rng(7)
_WALK = _RNG.integers(0, _BINS, (_BINS, 2048))
_KEY = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty sorted set."""
    first = np.searchsorted(hashes, _EDGES)
    ends = np.append(first[1:], len(hashes))
    full = first < ends
    value = hashes[np.minimum(first, len(hashes) - 1)]
    empty = np.flatnonzero(~full)
    for low, high in ((0, 16), (16, 256), (256, _WALK.shape[1])):
        if not len(empty):
            return value
        there = full[_WALK[empty, low:high]]
        found = there.any(axis=1)
        step = there.argmax(axis=1)[found] + low
        value[empty[found]] = value[_WALK[empty[found], step]]
        empty = empty[~found]
    # What no walk has reached takes the next full range in order.
    order = np.flatnonzero(full)
    value[empty] = value[order[np.searchsorted(order, empty) % len(order)]]
    return value


def band_keys(hashes: np.ndarray) -> np.ndarray:
    parts = signature(hashes).reshape(BANDS, ROWS) * _KEY
    return mixed(parts.sum(axis=1, dtype=np.uint64) + _SALT).view(np.int64)


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest, bands`` of each row; digest and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, bands = [], [], []
            for text in batch.column(1):
                words = word_hashes(text.as_py())
                hashes = shingle_set(words, width)
                counts.append(len(hashes))
                digests.append(sequence_digest(words) if len(words) else None)
                bands.append(band_keys(hashes) if len(hashes) else None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest, hashes`` (sorted, distinct) of each row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for w in (word_hashes(t.as_py()) for t in batch.column(0)) if len(w)]
            columns = [pa.array(map(sequence_digest, words), pa.binary()), pa.array([shingle_set(w, width).view(np.int64) for w in words], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "hashes"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "digest binary, hashes array<long>")


def semi_join_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids (id)``: a broadcast up to a checked count of ids, else a shuffle."""
    keys = ids.select(F.col("id").alias("_key"))
    if ids.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return docs.join(keys, F.col(id_col) == F.col("_key"), "left_semi")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components, among them all of a similarity of ``percent`` or more.

    ``sets (id, component, hashes)``. In one order of all values, rare ones first, such sets share a value within their
    first ``n - ceil(n * percent / 100) + 1``; the sizes and the places of that value bound what they can share.
    """
    values = sets.select("id", "component", F.size("hashes").alias("n"), F.explode("hashes").alias("value"))
    spread = values.groupBy("value").agg(F.count(F.lit(1)).alias("df"))
    placed = values.join(spread, "value").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("df", "value")))
    placed = materialise(placed.filter(f"df > 1 and at <= n - ({percent} * n + 99) div 100 + 1").drop("df"), "prefixes")
    a = placed.select("value", F.col("id").alias("a"), F.col("component").alias("part_a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    b = placed.select("value", F.col("id").alias("b"), F.col("component").alias("part_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    differ = F.expr("a < b and part_a != part_b")
    able = F.expr(f"{100 + percent} * (1 + least(n_a - at_a, n_b - at_b)) >= {percent} * (n_a + n_b)")
    return a.join(b, "value").filter(differ & able).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``.

    Documents are linked if ``100 * |A and B| >= percent * |A or B|`` of their sets of ``width``-word shingles.
    """
    sketch = materialise(sketches(docs, width, id_col, text_col), "sketches")
    filled = sketch.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = materialise(with_hubs(classes.select(F.explode("bands").alias("key"), "id")), "buckets")
    wanted = materialise(classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "digest", "least"), "bucket-classes")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = shingle_sets(semi_join_ids(slim, wanted.select(F.col("least").alias("id")).distinct(), "doc_id"), width)
    sets = materialise(sets.dropDuplicates(["digest"]).join(wanted.select("digest", "id"), "digest").select("id", "hashes"), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("left"))
        right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("right"))
        both = F.size(F.array_intersect("left", "right"))
        near = 100 * both >= percent * (F.size("left") + F.size("right") - both)
        return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b")

    def rest(left: DataFrame) -> DataFrame:
        return prefix_pairs(sets.join(left.select("id", "component").distinct(), "id"), percent)

    links = link_groups(members, confirm, rest=rest)
    # Texts of one id are one document: each is linked with the id's first one.
    several = filled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    texts = filled.select("doc_id", "digest").join(several, "doc_id").join(classes.select("digest", "id"), "digest").select("doc_id", "id")
    own = texts.join(texts.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    parts = connected_components(links.unionByName(own))

    parts = classes.join(parts, "id", "left").filter("n > 1 or component is not null").select("digest", "least", "component")
    parts = materialise(parts, "parts")
    whole = parts.filter("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    alone = parts.filter("component is null").select("digest", F.col("least").alias("component_id"))
    labels = alone.unionByName(join_sums(parts.filter("component is not null"), whole, "component").select("digest", "component_id"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(materialise(labels, "labels"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))
