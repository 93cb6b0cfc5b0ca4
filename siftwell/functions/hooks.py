"""Typed places for a caller's own models: scores, vectors and unit resolvers, run in Arrow batches where the rows are.

No model and no client is shipped. A function is called once for each batch in a task; what it returns is checked there, so
that a wrong length or type stops with a message instead of moving values to other rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from siftwell.operators.joins import exact_topk
from siftwell.operators.ranking import apply_rerank


def scorer(function: Callable[[pd.Series, pd.Series], object]) -> Callable[[Column, Column], Column]:
    """A column function of two text columns from ``function(queries, texts) -> a number for each``. Rows with a null on either side are
    not given to it and have no score, nor have rows whose score is no finite number."""

    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=queries.index)
        there = queries.notna() & texts.notna()
        if there.any():
            found = np.asarray(function(queries[there], texts[there]), dtype=float)
            if found.shape != (int(there.sum()),):
                raise ValueError(f"a scorer returned {found.shape} for {int(there.sum())} rows")
            out[there] = found
        return out.where(np.isfinite(out), None)

    run.__annotations__ = {"queries": pd.Series, "texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


def embedder(function: Callable[[pd.Series], object], width: int) -> Callable[[Column], Column]:
    """A column function of a text column from ``function(texts) -> rows of width numbers``; a null text has no vector."""

    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        there = texts.notna()
        if there.any():
            found = np.asarray(function(texts[there]), dtype=np.float32)
            if found.shape != (int(there.sum()), width):
                raise ValueError(f"an embedder returned {found.shape} for {int(there.sum())} rows of {width}")
            out[there] = pd.Series(list(found), index=texts[there].index, dtype=object)
        return out

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, ArrayType(FloatType()))


def rerank_with(candidates: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """Candidates ``(query_id, document_id, rank, query_text, text)`` in the order of a caller's scores; those without one stay behind."""
    scored = candidates.select("query_id", "document_id", score(F.col("query_text"), F.col("text")).alias("relevance"))
    return apply_rerank(candidates.select("query_id", "document_id", "rank"), scored.filter("relevance is not null"))


def semantic_search_with(queries: DataFrame, docs: DataFrame, embed: Callable[[Column], Column], k: int, threshold: float) -> DataFrame:
    """``query_id, rank, document_id, score``: the ``k`` nearest of ``docs (document_id, text)`` to each of ``queries
    (query_id, text)`` by cosine above ``threshold``, of a caller's vectors. Rows without a vector, or with a zero one, take no part.

    Ids of both sides are made apart (even and odd) for the blocked product, which answers a stated query set.
    """
    vector = lambda df, i, name: df.select((F.col(name).cast("long") * 2 + i).alias("vec_id"), embed(F.col("text")).alias("embedding"))
    both = vector(docs, 0, "document_id").unionByName(vector(queries, 1, "query_id")).filter(F.exists("embedding", lambda x: x != 0))
    asked = F.pmod(F.col("vec_id"), F.lit(2)) == 1
    found = exact_topk(both, asked, k, threshold, candidates=~asked)
    whole = lambda c, i: ((F.col(c) - i) / 2).cast("long")
    return found.select(whole("query_id", 1).alias("query_id"), "rank", whole("vec_id", 0).alias("document_id"), "score")


def resolve_units(blocks: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """A caller's resolver for each document: all blocks of a document, in order, in one call; its rows have the declared schema."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        return function(own.sort_values("block_index", ignore_index=True))

    return blocks.groupBy("document_id").applyInPandas(run, schema)
