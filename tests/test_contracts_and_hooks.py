"""Table contracts, lineage of evidence, and a caller's own scorers, embedders and resolvers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.functions import hooks as H
from siftwell.operators import lineage as L
from siftwell.sources import contracts as C


def test_contract_round_trip(spark, tmp_path):
    root, runs = str(tmp_path), C.CONTRACTS["runs"]
    rows = [
        ("r1", "v", "q", "succeeded", "2024-01-01", None, {"a": "1.5"}), ("r2", "v", "q", "failed", "2024-01-02", "boom", None), ("r3", "v", None, "ready", "2024-01-01", None, None), ("r4", "v", "q", "odd", "2024-01-01", None, None),
        ("r5", "v", "q", "ready", "no day", None, None), ("r6", "v", "q", "ready", "2024-01-01", "why", None), ("r7", "v", "q1", "ready", "2024-01-01", None, None), ("r7", "v", "q2", "ready", "2024-01-01", None, None), ("r8", "v", "q", "ready", "2024-01-03", None, None), ("r8", "v", "q", "ready", "2024-01-03", None, None),
    ]
    df = spark.createDataFrame(rows, "ID string, variant_id string, query string, status string, day string, error string, timings map<string,string>").withColumn("extra", F.lit(1)).repartition(3)
    C.write_contract(df, root, runs)
    got = C.read_contract(spark, root, runs)
    assert got.schema.names == runs.struct().names and dict(got.dtypes)["day"] == "date" and dict(got.dtypes)["timings"] == "map<string,double>"
    kept = {r["id"]: r for r in got.collect()}
    assert set(kept) == {"r1", "r2", "r7", "r8"} and got.count() == 4 and kept["r1"]["day"] == dt.date(2024, 1, 1) and kept["r1"]["timings"] == {"a": 1.5}
    bad = sorted((r["id"], r["reasons"]) for r in C.read_rejected(spark, root, runs).collect())
    assert bad == [("r3", ["missing:query"]), ("r4", ["rule:status"]), ("r5", ["type:day", "missing:day"]), ("r6", ["rule:error"]), ("r7", ["repeated_key"]), ("r8", ["repeated_key"])]
    # A day that comes again replaces itself; other days stay.
    C.write_contract(df.filter("ID = 'r1'").withColumn("status", F.lit("cancelled")), root, runs)
    assert {r["id"]: r["status"] for r in C.read_contract(spark, root, runs).collect()} == {"r1": "cancelled", "r2": "failed", "r8": "ready"}


def test_each_contract_takes_its_own_rows(spark):
    for c in C.CONTRACTS.values():
        empty = spark.createDataFrame([], c.struct())
        good, bad = C.conform(empty, c)
        assert good.schema.names == c.struct().names and good.count() == bad.count() == 0
    edges = spark.createDataFrame([("a", "b", "next", None), ("a", "a", "next", None), ("a", "b", "refs", "1"), ("a", "b", "next", "2")], "source string, target string, type string, document_id string")
    good, bad = C.conform(edges, C.CONTRACTS["edges"])
    assert good.count() == 2 and sorted(r["reasons"][0] for r in bad.collect()) == ["repeated_key", "rule:loop"]


def test_decisions_and_gaps(spark):
    chunks = spark.createDataFrame([("d1", "c1", 1, 2, "text", None), ("d1", "c2", 1, 1, "Table", "warning"), ("d1", "c3", None, 1, None, None), ("d2", "c4", 3, 3, "text", "ok")], "document_id string, chunk_id string, page_start int, page_end int, modality string, quality_status string")
    blocks = spark.createDataFrame([("c1", "b2"), ("c1", "b1"), ("c2", "b3"), ("c1", "b1")], "chunk_id string, block_id string")
    warnings = spark.createDataFrame([("c4", "w1"), ("c4", "w2")], "chunk_id string, warning_id string")
    graph = spark.createDataFrame([("d1", "g1", "failed", 1, 1, 1), ("d1", "g2", "succeeded", 2, 1, 2), ("d2", "g3", "failed", 0, 0, 1)], "document_id string, record_id string, status string, node_count int, edge_count int, created_at int")
    decisions = L.evidence_decisions(chunks, blocks, warnings, graph)
    got = {r["decision_id"]: (r["decision_type"], r["status"], r["input_block_ids"], r["output_chunk_ids"], r["warning_ids"]) for r in decisions.collect()}
    assert got == {
        "decision-page-stitch-c1": ("page_stitch", "recorded", ["b1", "b2"], ["c1"], []), "decision-modal-route-c2": ("modal_route", "recorded", ["b3"], ["c2"], []), "decision-quality-warning-c2": ("quality_warning", "warning", ["b3"], ["c2"], []),
        "decision-quality-warning-c4": ("quality_warning", "ok", [], ["c4"], ["w1", "w2"]), "decision-graph-g2": ("chunk_materialization", "succeeded", [], ["c1", "c2", "c3"], []), "decision-graph-g3": ("quality_gate", "failed", [], ["c4"], []),
    }
    docs = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "document_id string")
    gaps = {(r["document_id"], r["kind"], r["what"]) for r in L.evidence_gaps(docs, chunks, blocks, decisions, graph, 2).collect()}
    assert gaps == {
        ("d1", "limitation", "1 chunks are not shown"), ("d2", "missing_section", "parser_blocks"), ("d2", "limitation", "latest graph projection is failed"), *(("d3", "missing_section", s) for s in ("chunks", "parser_blocks", "normalization_decisions")),
        ("d3", "limitation", "no chunks have been materialized"), ("d3", "limitation", "no graph projection record"),
    }


def test_a_callers_scorer(spark):
    def shared_words(queries, texts):
        return [len({*q.split()} & {*t.split()}) if t else float("nan") for q, t in zip(queries, texts, strict=True)]

    rows = [(1, 10, 1, "a b", "x"), (1, 11, 2, "a b", "b a"), (1, 12, 3, "a b", "a"), (1, 13, 4, "a b", None), (1, 14, 5, "a b", "")]
    df = spark.createDataFrame(rows, "query_id long, document_id long, rank int, query_text string, text string")
    got = {r["document_id"]: (r["new_rank"], r["relevance"], r["status"]) for r in H.rerank_with(df, H.scorer(shared_words)).collect()}
    assert got == {11: (1, 2.0, "ranked"), 12: (2, 1.0, "ranked"), 10: (3, 0.0, "ranked"), 13: (4, None, "missing"), 14: (5, None, "missing")}
    with pytest.raises(Exception, match="a scorer returned"):
        df.select(H.scorer(lambda q, t: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])(F.col("query_text"), F.col("text"))).coalesce(1).collect()


def test_a_callers_embedder_and_resolver(spark):
    def letters(texts):
        return np.array([[t.count(c) for c in "abc"] for t in texts])

    docs = spark.createDataFrame([(1, "aab"), (2, "b"), (3, None), (4, "zzz"), (5, "c")], "document_id long, text string")
    queries = spark.createDataFrame([(1, "ab"), (2, "c")], "query_id long, text string")
    got = [(r["query_id"], r["rank"], r["document_id"], round(r["score"], 6)) for r in H.semantic_search_with(queries, docs, H.embedder(letters, 3), 2, 0.1).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, 0.948683), (1, 2, 2, 0.707107), (2, 1, 5, 1.0)]
    with pytest.raises(Exception, match="an embedder returned"):
        docs.select(H.embedder(letters, 4)(F.col("text"))).collect()
    blocks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "document_id long, block_index int, text string")
    units = H.resolve_units(blocks, lambda own: pd.DataFrame({"document_id": own["document_id"][:1], "unit": ["".join(own["text"])]}), "document_id long, unit string")
    assert sorted(map(tuple, units.collect())) == [(1, "ab"), (2, "c")]
