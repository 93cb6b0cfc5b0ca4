"""Recall on rows of other kinds than those of the given tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import line_dedup, vector_search


def recall(spark, x, kind="float", k=5):
    """Share of the truly nearest that are found; scores must be those of double precision."""
    x = x.astype(np.float32 if kind == "float" else np.float64)
    wide = x.astype(np.float64)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = vector_search.nearest_neighbours(df, F.col("vec_id") % 50 == 0, k).toPandas()
    hits = 0
    for i, mine in got.groupby("query_id"):
        near = unit @ unit[i]
        near[i] = -2
        assert len(mine) == k and np.abs(near[mine["vec_id"]] - mine["score"]).max() < 1e-14
        hits += int((mine["score"] >= np.sort(near)[-k] - 1e-15).sum())
    return hits / (k * len(x[::50]))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_much_closer_than_the_codes_tell(spark, kind):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=(1, 64)) + 1e-3 * rng.normal(size=(3000, 64)), rng.normal(size=(1500, 64))))
    rng.shuffle(x)
    assert recall(spark, x, kind) >= 0.97


def test_queries_unlike_the_other_vectors(spark):
    rng = np.random.default_rng(1)
    families = rng.normal(size=(100, 64))
    x = families[rng.integers(0, 100, 4000)] + 1e-2 * rng.normal(size=(4000, 64))
    x[::50] = rng.normal(size=(80, 64))
    assert recall(spark, x) >= 0.97


def test_lines_with_a_letter_changed_in_many_words(spark):
    """One letter in 20, 30 and 40 % of the words, an edit similarity of 0.9 or more: nearly every pair is joined."""
    rng, rows = random.Random(2), []
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(8, 60))]
        own = list(w)
        for at in rng.sample(range(len(w)), round((0.2, 0.3, 0.4)[i % 3] * len(w))):
            k = rng.randrange(len(own[at]))
            own[at] = own[at][:k] + "z" + own[at][k + 1 :]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(own))]
    gone = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_dropped > 0").collect()}
    assert all(i % 2 for i in gone)
    assert [sum(2 * i + 1 in gone for i in range(j, 150, 3)) >= 45 for j in range(3)] == [True] * 3
