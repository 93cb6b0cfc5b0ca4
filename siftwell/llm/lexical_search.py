"""Ranked lexical search with hashed max-sketches, exact whatever the sketches say.

1. One pass over the texts makes a forward index: the 64-bit hashes and counts of a document's different terms, and how
   many terms it has with repeats. It doesn't depend on what is asked, and is written once.
2. Items (queries) are dealt by hash into blocks of about ``BLOCK_TERMS`` terms and ``BLOCK_ITEMS`` items, so that what a
   task holds of them is bounded; for each block the document frequencies of its terms are summed by task, then over tasks.
3. In a task, the impacts of a document's asked terms fold into ``WIDTH`` coordinates by maximum. A block's items are a
   matrix of how many of their terms fall on each coordinate, so one product bounds every document's score for every item.
4. Documents are rescored exactly in descending order of their bound, until it is below the item's k-th best score so far.
   The exact scores of ``1 / SEED`` of the documents, chosen by hash, are searched first and give each item a
   least score to begin with, so that tasks hand on few rows; it is a true k-th score, so no row of the result is lost.

Impacts are below 10**6 times a weight, and their sums are below 2**53, so sums of doubles are exact here.

Defined results: a null or empty text has no term and is never found. A row of ``docs`` is a document, also if its id
occurs again; rows without an id come after others of the same score. Items of one id are one item with the terms of
all; items without terms and items without an id find nothing. Empty tables give empty results. Other columns are ignored. Terms
are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import materialise

WIDTH = 1024
BLOCK_TERMS = 200_000
BLOCK_ITEMS = 1024
#: Documents whose sketches are in memory at once, and documents rescored at once.
SLICE, CHUNK = 1024, 64
SEED = 64

_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_counts(raw: bytes) -> Counter:
    """How often each term stands in a text: maximal runs of ASCII letters, digits and anything else than ASCII, A-Z as a-z."""
    return Counter(raw.translate(_TERM_BYTES).split())


def forward_index(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms, tf``: the terms of each row with repeats, the sorted hashes of the different ones and their counts (little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                counts = term_counts(text.as_py() or b"")
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), "<u8", len(counts))
                order = np.argsort(hashes)
                tf = np.fromiter(counts.values(), "<i8", len(counts))
                n.append(int(tf.sum()))
                terms.append(hashes[order].tobytes())
                tfs.append(tf[order].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["id", "n", "terms", "tf"])

    slim = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "id long, n long, terms binary, tf binary")


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, hash and count of each term of a batch."""
    terms, tf = batch.column("terms").to_pylist(), batch.column("tf").to_pylist()
    rows = np.repeat(np.arange(batch.num_rows), [len(t) // 8 for t in terms])
    return rows, np.frombuffer(b"".join(terms), "<u8"), np.frombuffer(b"".join(tf), "<i8")


class Block:
    """A block of items: their different terms (sorted hashes), the weights of these, and what each item has of them."""

    def __init__(self, items: dict[int, np.ndarray], width: int | None = None):
        width = width or WIDTH
        self.items = sorted(items)
        self.terms = np.unique(np.concatenate([items[i] for i in self.items]))
        self.of_item = [np.searchsorted(self.terms, np.unique(items[i])) for i in self.items]
        self.slot = (self.terms % np.uint64(width)).astype(np.int64)
        self.lookups = np.zeros((width, len(self.items)))
        for j, own in enumerate(self.of_item):
            np.add.at(self.lookups[:, j], self.slot[own], 1)
        self.weights = np.zeros(len(self.terms), np.int64)
        self.n_docs = self.n_terms = 0

    def asked(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are asked for, and the numbers of those."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        there = self.terms[at] == hashes
        return there, at[there]

    def weigh(self, df: dict[int, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.terms))], np.int64)

    def impacts(self, terms: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``n``: the terms with repeats of each term's document."""
        length = 50 + (50 * n * self.n_docs) // max(1, self.n_terms)
        return self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length))


class Best:
    """The k best documents of each item so far: higher scores first, then smaller ids, rows without an id last."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in least]

    def add(self, j: int, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        new = scores >= self.least[j]
        if new.any():
            scores, ids, no_id = (np.concatenate((old, x[new])) for old, x in zip(self.rows[j], (scores, ids, no_id), strict=True))
            top = np.lexsort((ids, no_id, -scores))[: self.k]
            self.rows[j] = scores[top], ids[top], no_id[top]
            if len(top) == self.k:
                self.least[j] = max(self.least[j], scores[top[-1]])


def search_slice(block: Block, best: Best, n: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
    """Bring a slice of documents into ``best``. ``rows, terms, tf``: their asked terms, by row and term; ``n, ids, no_id``: by document."""
    impacts = block.impacts(terms, tf, n[rows])
    sketch = np.zeros((len(n), len(block.lookups)))
    np.maximum.at(sketch, (rows, block.slot[terms]), impacts)
    bounds = sketch @ block.lookups
    keys = rows * len(block.terms) + terms
    for j, own in enumerate(block.of_item):
        bound = bounds[:, j]
        able = np.flatnonzero(bound >= best.least[j])
        able = able[np.argsort(-bound[able], kind="stable")]
        at = 0
        while at < len(able) and bound[able[at]] >= best.least[j]:
            some = able[at : at + CHUNK]
            wanted = some[:, None] * len(block.terms) + own
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            scores = np.where(keys[place] == wanted, impacts[place], 0).sum(axis=1)
            best.add(j, scores, ids[some], no_id[some])
            at += CHUNK


def _search(index: DataFrame, block, least: np.ndarray, k: int) -> DataFrame:
    """``item, id, score`` of the ``k`` best of each task; ``block``: a broadcast one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        best = Best(least, k)
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                rows, hashes, tf = _joined(batch)
                there, terms = own.asked(hashes)
                if there.any():
                    ids = batch.column("id")
                    search_slice(own, best, batch.column("n").to_numpy(), rows[there], terms, tf[there], ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        for j, (scores, ids, no_id) in enumerate(best.rows):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(scores), pa.int32()), pa.array(ids, pa.int64(), mask=no_id), pa.array(scores, pa.int64())], names=["item", "id", "score"])

    return index.mapInArrow(run, "item int, id long, score long")


def _frequencies(index: DataFrame, block) -> dict[int, int]:
    """How many documents hold each asked term, by its number in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(block.value.terms), np.int64)
        for batch in batches:
            _, at = block.value.asked(_joined(batch)[1])
            counts += np.bincount(at, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["term", "df"])

    by_task = index.select("terms", "tf").mapInArrow(run, "term long, df long")
    return dict(by_task.groupBy("term").agg(F.sum("df")).collect())  # a row for each term of a block


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    asked = materialise(forward_index(items.filter(F.col(item_id).isNotNull()), item_id, item_text).filter("n > 0"), "items")
    sizes = asked.agg(F.coalesce(F.sum(F.length("terms") / 8), F.lit(0)), F.countDistinct("id")).first()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not sizes[1]:
        return out
    index = materialise(forward_index(docs, id_col, text_col).filter("n > 0"), "forward-index")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(math.ceil(sizes[0] / BLOCK_TERMS), math.ceil(sizes[1] / BLOCK_ITEMS))
    seeds = index.filter(F.pmod(F.xxhash64(F.lit(5), "id", "n"), F.lit(SEED)) == 0)
    for turn in range(blocks if n_docs else 0):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == turn).select("id", "terms").collect()
        if not rows:
            continue
        own: dict[int, list[np.ndarray]] = {}
        for r in rows:
            own.setdefault(r["id"], []).append(np.frombuffer(r["terms"], "<u8"))
        block = Block({i: np.concatenate(t) for i, t in own.items()})
        block.weigh(_frequencies(index, spark.sparkContext.broadcast(block)), n_docs, n_terms)
        shared = spark.sparkContext.broadcast(block)
        least = np.ones(len(block.items), np.int64)
        seen = _ranked(_search(seeds, shared, least, k), k).filter(F.col("rank") == k)
        for j, score in seen.select("item", "score").collect():  # a row for each item of a block
            least[j] = max(1, score)
        names = spark.createDataFrame([*enumerate(block.items)], "item int, item_id long")
        best = materialise(_ranked(_search(index, shared, least, k), k), "found")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"))
    return out
