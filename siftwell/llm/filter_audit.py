"""How five document filters interact: contractions of a contingency tensor.

1. One projection judges each text by the filters A to D and digests it; the rows that go on are a few dozen bytes long.
2. E asks whether a smaller id has the same text: the least id of each digest is a partial aggregate, joined back so that
   the rows of a hot digest can be split (:func:`join_sums`).
3. Documents become counts (all, good, toxic) by part and the five flags: 32 rows for each part at most, with map-side sums.
4. The counts of a part, reshaped to 2x2x2x2x2 for each kind of count, are contracted with a vector for each axis: *pass*
   for the filters before a step, *fail* for the step's own, *all* for those after it. One einsum over the orders and
   steps gives every column.

Defined results: a null text counts as empty, so it fails A and, if a smaller id has an empty or null text, E. A null
``part`` is the empty string, and joins rows whose part is that. Rows without an id fail E nowhere and make no other row fail it; repeated
rows of one id count each, and don't fail E because of each other. A document is good (toxic) if any label row of its
id says 1. Documents without labels are neither. A part has all its orders and steps, with zeros; an empty table gives
an empty result. Further columns of either input are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import UPPER, let, materialise, words_of
from siftwell.llm.components import join_sums

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 50, 65, 5, "#$%&*|"
ORDERS = [*permutations(range(len(FILTERS)))]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _without(text: Column, letters: str) -> Column:
    return F.char_length(F.translate(text, letters, ""))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, digest`` and the flags ``A`` to ``D`` (1: the document fails) of each row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    seen = slim.withColumn("w", counts).withColumn("chars", F.char_length("text"))
    fails = {
        "A": F.col("w.n") < MIN_WORDS,
        "B": 100 * F.col("w.d").cast("long") < DISTINCT_PERCENT * F.col("w.n").cast("long"),
        "C": 100 * (F.col("chars") - _without(F.col("text"), UPPER)).cast("long") > CAPITALS_PERCENT * F.col("chars").cast("long"),
        "D": F.col("chars") > _without(F.col("text"), SYMBOLS),
    }
    return seen.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *(f.cast("int").alias(k) for k, f in fails.items()))


def tensor_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, A .. E, n, good, toxic``: the filled cells of each part's tensor."""
    rows = materialise(judged(docs, id_col, text_col, part_col), "judged")
    least = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    least = materialise(least.filter("first_id < last_id").select("digest", "first_id"), "copied-texts")
    rows = join_sums(rows, least, "digest", "left")
    rows = rows.withColumn("E", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")).select("doc_id", "part", *FILTERS)
    said = labels.select(F.col(id_col).cast("long").alias("doc_id"), *((F.col(c) == 1).cast("int").alias(n) for c, n in (("quality", "good"), ("toxic", "bad"))))
    said = said.filter("doc_id is not null and (good = 1 or bad = 1)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(n) for c, n in (("good", "good"), ("bad", "toxic")))]
    return join_sums(rows, said, "doc_id", "left").groupBy("part", *FILTERS).agg(*sums)


def contract(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of each order and step, as arrays ``[order, step]``, of a part's tensor ``[n | good | toxic, a, b, c, d, e]``.

    A step is five vectors, one for each axis of the tensor, of how often *pass* and *fail* are taken.
    """
    passes, fails, either = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    n = len(FILTERS)

    def steps(before: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.empty((len(ORDERS), n, n, 2), np.int64)
        for i, order in enumerate(ORDERS):
            for k, axis in enumerate(order):
                out[i, k] = either
                out[i, k, list(order[:k])] = before
                out[i, k, axis] = own
        return out

    def over(which: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return np.einsum("zabcde,ota,otb,otc,otd,ote->zot", which, *(vectors[:, :, axis] for axis in range(n)), optimize="greedy")

    lost = over(tensor, steps(passes, fails))
    all_fail = over(tensor[:1], steps(either, fails))[0]
    alone = np.empty((n, n, 2), np.int64)
    alone[:] = passes
    alone[np.arange(n), np.arange(n)] = fails
    only = np.einsum("abcde,xa,xb,xc,xd,xe->x", tensor[0], *(alone[:, axis] for axis in range(n)), optimize="greedy")
    axes = np.array(ORDERS)
    shapley = np.bincount(axes.ravel(), weights=lost[0].ravel(), minlength=n).astype(np.int64)
    return {
        "kept": over(tensor[:1], steps(passes, passes))[0], "removed": lost[0], "redundant": all_fail - lost[0], "unique_fails": only[axes],
        "good_lost": lost[1], "toxic_lost": lost[2], "shapley": shapley[axes],
    }


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, filter_order, step`` and what the step's filter does there: see the columns in ``COUNTS``."""
    names = np.array(["".join(FILTERS[a] for a in order) for order in ORDERS])

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        tensor = np.zeros((3, *[2] * len(FILTERS)), np.int64)
        tensor[(slice(None), *(cells[f].to_numpy() for f in FILTERS))] = cells[["n", "good", "toxic"]].to_numpy().T
        out = {k: v.ravel() for k, v in contract(tensor).items()}
        return pd.DataFrame({"part": key[0], "filter_order": names.repeat(len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)), **out})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return tensor_rows(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(run, schema)
