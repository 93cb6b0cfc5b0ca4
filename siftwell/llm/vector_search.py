"""Approximate nearest neighbours by cosine: inverted lists with product-quantised residuals and exact reranking.

1. Equal vectors are folded to one class with their ``k + 1`` smallest ids: no more can be among the k nearest of any query.
2. Coarse centroids and the codebooks of the residuals are fitted with k-means on the driver, on a random sample of
   ``SAMPLE_ROWS`` classes at most. Every class is then put in its nearest centroid's list and coded, by a map-only job.
3. The number of lists to probe is fitted as well: ``PROBE_QUERIES`` of the queries asked (all, if fewer) are answered by
   brute force over every class, and so many lists are probed that they hold ``PROBE_RECALL`` of the answers. Lists are
   cut into blocks of about ``BLOCK_ROWS`` classes and the queries of a list into blocks of ``BLOCK_QUERIES``, from the
   counts by list, so that the memory of a task is bounded whatever a list holds.
4. Inside a block, distances come from one table per query and subspace (asymmetric distances). What the codes leave out
   of a vector bounds their error, and every row that can be among the block's best by that bound is compared exactly, on
   the original vectors in double precision: a probed list loses no neighbour. The block's best go on to a top-k by query.

Defined results: vectors that are null, empty, zero, of another length than the most frequent one (the shorter, on a
tie), or that hold null or non-finite components take no part; of rows with the same id and the same vector one counts;
ties go to the smaller id; a query with fewer candidates than k gets all that it found; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import materialise

SAMPLE_ROWS = 20_000
MAX_LISTS = 4096
PROBE_RECALL = 0.98
PROBE_QUERIES = 400
LEAST_PROBES = 8
SUBSPACES = 16
CODES = 256
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
#: What single precision may change of a cosine.
SLACK = 1e-5


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's algorithm; an empty one moves to a random row."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, nearest, x)
        full = counts > 0
        centres[full] = (sums[full] / counts[full, None]).astype(centres.dtype)
        centres[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.width = -(-self.dim // SUBSPACES)
        x = self.unit(sample)
        self.centres = kmeans(x, lists, rng)
        rest = self._split(x - self.centres[_nearest(x, self.centres)])
        self.books = np.stack([self._book(rest[:, m], rng) for m in range(SUBSPACES)])

    @staticmethod
    def _book(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        book = kmeans(rows, CODES, rng, rounds=8)
        return np.concatenate((book, np.repeat(book[:1], CODES - len(book), axis=0)))

    @staticmethod
    def unit(x: np.ndarray, real: type = np.float32) -> np.ndarray:
        wide = x.astype(np.float64)
        wide = wide / np.abs(wide).max(axis=1, keepdims=True)
        return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(real)

    def _split(self, x: np.ndarray) -> np.ndarray:
        full = np.zeros((len(x), self.width * SUBSPACES), np.float32)
        full[:, : self.dim] = x
        return full.reshape(len(x), SUBSPACES, self.width)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list and the codes of each vector, and the length of what these leave out."""
        x = self.unit(vectors)
        lists = _nearest(x, self.centres)
        rest = self._split(x - self.centres[lists])
        codes = np.stack([_nearest(rest[:, m], self.books[m]) for m in range(SUBSPACES)], axis=1)
        left = rest - self.books[np.arange(SUBSPACES), codes]
        return lists, codes.astype(np.uint8), np.sqrt((left * left).sum(axis=(1, 2)))

    def probes(self, vectors: np.ndarray, n: int) -> np.ndarray:
        x = self.unit(vectors)
        half = (self.centres * self.centres).sum(axis=1) / 2
        return np.argsort(half - x @ self.centres.T, axis=1, kind="stable")[:, :n]

    def probes_needed(self, queries: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """How many lists each of ``queries`` has to probe until it meets the list beside it."""
        place = self.probes(queries, len(self.centres)).argsort(axis=1)
        return place[np.arange(len(lists)), lists] + 1

    def approximate(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of unit queries with a list's coded rows: one look-up table per query and subspace."""
        x = self.unit(queries)
        tables = np.einsum("qmw,mcw->qmc", self._split(x), self.books)
        out = np.repeat((x @ self.centres[centre])[:, None], len(codes), axis=1)
        for m in range(SUBSPACES):
            out += tables[:, m, codes[:, m]]
        return out


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def _at_least(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row, the least if there are fewer."""
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else scores.min(axis=1)


def best_rows(near: np.ndarray, error: np.ndarray, queries: np.ndarray, base: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each query the rows of ``base`` that can be among its k nearest, if ``near`` is right up to ``error``."""
    may = near + error >= _at_least(near - error, k)[:, None]
    some = np.flatnonzero(may.any(axis=0))
    scores = np.where(may[:, some], Quantiser.unit(queries, np.float64) @ Quantiser.unit(base[some], np.float64).T, -2.0)
    for row, least in zip(scores, _at_least(scores, k), strict=True):
        yield some[(row >= least - SLACK * 1e-4) & (row > -2)]


def _usable(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def _stacked(cells: pd.Series, real: type) -> np.ndarray:
    return np.stack([np.frombuffer(c, real) for c in cells])


def fitted_probes(indexed: DataFrame, wanted: DataFrame, quantiser: Quantiser, real: type, k: int) -> int:
    """So many lists that they hold ``PROBE_RECALL`` of the k nearest classes of drawn queries, by brute force over all classes."""
    drawn = wanted.orderBy(F.xxhash64(F.lit(5), "qid"), "qid").limit(PROBE_QUERIES).toPandas()
    if not len(drawn):
        return LEAST_PROBES
    qid, queries = drawn["qid"].to_numpy(), _stacked(drawn["vector"], real)
    asked = indexed.sparkSession.sparkContext.broadcast((qid, Quantiser.unit(queries, np.float64)))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = asked.value
        score, at = np.full((len(ids), k), -2.0), np.full((len(ids), k), -1)
        for batch in batches:
            for a in range(0, len(batch), 2048):
                some = batch.iloc[a : a + 2048]
                near = x @ Quantiser.unit(_stacked(some["vector"], real), np.float64).T
                near[ids[:, None] == some["cid"].to_numpy()[None, :]] = -2
                near = np.concatenate((score, near), axis=1)
                lists = np.concatenate((at, np.broadcast_to(some["list"].to_numpy(), (len(ids), len(some)))), axis=1)
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                score, at = np.take_along_axis(near, best, 1), np.take_along_axis(lists, best, 1)
        found = np.flatnonzero(score.ravel() > -2)
        yield pd.DataFrame({"q": found // k, "list": at.ravel()[found].astype(np.int32), "score": score.ravel()[found]})

    found = indexed.select("cid", "list", "vector").mapInPandas(nearest, "q long, list int, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "list")
    true = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("q", "list").toPandas()
    if not len(true):
        return LEAST_PROBES
    needed = quantiser.probes_needed(queries[true["q"].to_numpy()], true["list"].to_numpy())
    return max(LEAST_PROBES, int(np.quantile(needed, PROBE_RECALL, method="higher")))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` for which ``is_query`` holds, its k nearest other rows."""
    spark = vectors.sparkSession
    kind = "float" if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "double"
    real = np.float32 if kind == "float" else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), is_query.alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(_usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["d"]
    keyed = rows.filter(F.size("v") == dim).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), F.col("v"))})

    first = keyed.select("k1", "k2", "vec_id", "v").withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id")))
    first = first.filter(F.col("place") <= k + 1)
    classes = first.groupBy("k1", "k2").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"))
    classes = materialise(classes, "vector-classes")
    n = classes.count()
    part = F.shiftrightunsigned(F.xxhash64(F.lit(3), F.col("k1")), 11).cast("double") / F.lit(float(2**53))
    sample = classes.filter(part < min(1.0, SAMPLE_ROWS / n)).select("v").toPandas()["v"]
    if not len(sample):
        sample = classes.limit(1).select("v").toPandas()["v"]
    lists = int(min(MAX_LISTS, max(1, round(n**0.5)), len(sample)))
    quantiser = Quantiser(np.stack(sample.to_list()).astype(real), lists)
    model = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(real)
                at, codes, error = model.value.encode(own)
                packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (codes, own)]
                names = ["k1", "k2", "cid", "ids", "list", "error", "codes", "vector"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(at, pa.int32()), pa.array(error, pa.float32()), *packed], names=names)

    coded = "k1 long, k2 long, cid long, ids array<long>, list int, error float, codes binary, vector binary"
    indexed = materialise(classes.select("k1", "k2", "cid", "ids", "v").mapInArrow(encode, coded), "vector-index")

    asked = keyed.filter("is_query").select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    wanted = indexed.join(asked.select("k1", "k2").distinct(), ["k1", "k2"]).select(F.col("cid").alias("qid"), "vector")
    wanted = materialise(wanted, "vector-queries")
    probes = fitted_probes(indexed, wanted, quantiser, real, k)

    probes = min(probes, lists)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = model.value.probes(_stacked(batch["vector"], real), probes)
                yield batch.loc[batch.index.repeat(probes)].assign(list=at.ravel().astype(np.int32))

    probing = materialise(wanted.mapInPandas(probe, "qid long, vector binary, list int"), "vector-probes")
    blocks = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("row_blocks"))
    blocks = blocks.join(probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("query_blocks")), "list")
    blocks = F.broadcast(blocks)  # MAX_LISTS rows at most
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = indexed.join(blocks, "list").withColumn("rb", mine("cid", "row_blocks")).withColumn("qb", upto("query_blocks")).select("list", "rb", "qb", "cid", "ids", "error", "codes", "vector")
    right = probing.join(blocks, "list").withColumn("qb", mine("qid", "query_blocks")).withColumn("rb", upto("row_blocks")).select("list", "rb", "qb", "qid", "vector")

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(queries):
            codes, base = _stacked(own["codes"], np.uint8), _stacked(own["vector"], real)
            ids, cid, error = own["ids"].to_numpy(), own["cid"].to_numpy(), own["error"].to_numpy() + SLACK
            for a in range(0, len(queries), 64):
                some = queries.iloc[a : a + 64]
                vectors_here = _stacked(some["vector"], real)
                near = model.value.approximate(vectors_here, int(own["list"].iloc[0]), codes)
                for qid, vector, best in zip(some["qid"], vectors_here, best_rows(near, error, vectors_here, base, k + 1), strict=True):
                    score = exact_cosine(vector, base[best])
                    top = np.lexsort((cid[best], -score))[: k + 1]
                    out += [(qid, cid[best[j]], ids[best[j]], score[j]) for j in top]
        return pd.DataFrame(out, columns=["qid", "cid", "ids", "score"])

    keys = ["list", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "qid long, cid long, ids array<long>, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = materialise(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("qid", "ids", "score"), "vector-found")

    ids_of = indexed.select("k1", "k2", F.col("cid").alias("qid"))
    pairs = asked.join(ids_of, ["k1", "k2"]).join(found, "qid").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
