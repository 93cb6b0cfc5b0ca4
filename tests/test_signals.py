"""Each signal of the hybrid score on pairs made for it."""

import pytest
from pyspark.sql import functions as F

from siftwell.operators import signals as S

CASES = [
    ("nothing shared", dict(query_text="alpha", text="beta"), {}),
    ("coverage and density", dict(query_text="alpha beta the", text="Alpha gamma, delta eps"), {"term_coverage": 5.0, "semantic_density": 0.5}),
    ("aliases count for coverage only", dict(query_text="alpha", text="beta", aliases=["beta"]), {"term_coverage": 5.0}),
    ("whole query", dict(query_text=" Red Fox ", text="the red fox"), {"exact_phrase": 8.0, "term_coverage": 10.0, "semantic_density": 2.0}),
    ("quoted phrase", dict(query_text='where is "one two three four"?', text="x one two three four y z"), {"exact_phrase": 24.0, "term_coverage": 10.0, "semantic_density": 2 * 4 / 7}),
    ("worded phrase", dict(query_text="line that says that kings  queens rooks pawns.", text="kings queens rooks pawns"), {"exact_phrase": 24.0, "term_coverage": 10 * 4 / 6, "semantic_density": 2.0}),
    ("three terms are no phrase", dict(query_text='find "one two three"', text="one two three"), {"term_coverage": 10 * 3 / 4, "semantic_density": 2.0}),
    ("exact reference", dict(query_text="q", text="t", requested="[1:2]", references=["[1:2]"], same_parent=True), {"reference_exact": 100.0}),
    ("reference in a range", dict(query_text="q", text="t", requested="[1:2]", references=None, in_range=True), {"reference_exact": 100.0}),
    ("same parent", dict(query_text="q", text="t", requested="[1:2]", same_parent=True), {"same_parent_reference": 60.0}),
    ("same parent with a unit", dict(query_text="q", text="t", requested="[1:2]", same_parent=True, names_unit=True, previous_ref="[1:2]"), {"same_parent_reference": 5.0, "neighbor_match": 30.0}),
    ("blocked graph", dict(query_text="q", text="t", requested="[1:2]", references=["[1:2]"], next_ref="[1:2]", graph_confidence="blocked"), {}),
    ("no reference asked", dict(query_text="q", text="t", references=["[1:2]"], same_parent=True), {}),
    ("arabic token", dict(query_text="وكتاب", text="هذا كِتَاب", script="arabic"), {"arabic_exact": 40.0, "arabic_token": 24.0}),
    ("arabic phrase at boundaries", dict(query_text="كتاب جديد", text="في كتاب جديد هنا", script="arabic"), {"arabic_exact": 40.0, "exact_phrase": 8.0, "term_coverage": 10.0, "semantic_density": 1.0}),
    ("arabic phrase inside a word", dict(query_text="كتاب جد", text="في كتاب جديد", script="arabic"), {"exact_phrase": 8.0, "term_coverage": 5.0, "semantic_density": 2 / 3}),
    ("arabic of another script's domain", dict(query_text="كتاب", text="ب كتاب"), {"exact_phrase": 8.0, "term_coverage": 10.0, "semantic_density": 1.0}),
    ("metadata", dict(query_text="german law report", text="t", tags=["German", "x", ""], fields=["law", None], title="A Report on Law"), {"metadata_boost": 6.0}),
    ("metadata cap", dict(query_text="a1 b2 c3 d4 e5 f6 g7", text="t", tags=["a1", "b2", "c3", "d4"], title="a1 b2 c3 d4 e5 f6 g7"), {"metadata_boost": 12.0}),
    ("layout cap", dict(query_text="a1 b2 c3 d4 e5", text="t", layout=["A1 b2", "c3", None, "d4 e5"]), {"layout_context": 16.0}),
    ("count", dict(query_text="How many verses", text="it has 114 CHAPTERS", count_terms=["chapters"]), {"answer_bearing_count": 30.0}),
    ("count in the title", dict(query_text="total", text="verses", title="12 of them", count_terms=["verses"]), {"answer_bearing_count": 30.0}),
    ("a digit is no count", dict(query_text="how many", text="has 7 chapters", count_terms=["chapters"]), {}),
    ("guidance", dict(query_text="prayer asking for guidance to the straight path", text="guide  us to the straight path"), {"guidance_request": 40.0, "term_coverage": 4.0, "semantic_density": 1.0}),
    ("intent", dict(query_text="q", text="t", intent=2.5), {"domain_intent": 2.5}),
    ("null text", dict(query_text="q", text=None), {}),
]


def test_each_signal(spark):
    kinds = {"query_text": "string", "text": "string", **S.OPTIONAL}
    rows = [(i, *(case.get(c) for c in kinds)) for i, (_, case, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
    out = {r["id"]: r for r in S.with_signals(df).withColumn("score", S.weighted_score()).collect()}
    for i, (name, _, want) in enumerate(CASES):
        got = {s: out[i][s] for s in S.SIGNALS if out[i][s]}
        assert got == pytest.approx(want), name
        assert out[i]["score"] == pytest.approx(sum(want.values()), abs=1e-6)


def test_weights_veto_and_empty_queries(spark):
    rows = [(1, "alpha", "alpha", None), (2, " ", "alpha", None), (3, None, "alpha", None), (4, "كتاب", "كتاب", False), (5, "alpha", "alpha", False)]
    df = spark.createDataFrame(rows, "id int, query_text string, text string, allows_exact boolean")
    out = S.with_signals(df).withColumn("score", S.weighted_score({"term_coverage": 0.5, "exact_phrase": 0.0}))
    assert {r["id"]: r["score"] for r in out.collect()} == {1: 7.0, 2: 1.0, 3: 1.0, 4: 0.0, 5: 7.0}
    assert set(df.columns) <= set(out.columns) and S.with_signals(df.limit(0)).count() == 0


def test_fusion_of_candidates(spark):
    """Ranks and not scores make the fused score; direct evidence comes first, a hypothesis alone comes last; copies are one candidate."""
    from siftwell.operators.ranking import fuse_candidates

    rows = [
        (1, 1, 1, "pgvector", 1, 10, 5, None, 1, "a", 0.9, 0.0, None), (1, 2, 3, "native", 3, 11, 5, None, 1, "a", 0.1, 99.0, []), (1, 1, 2, "pgvector", 2, 12, 6, None, 1, "b", 0.8, 0.0, ["arabic_exact"]), (1, 2, 1, "native", 1, 13, 7, None, 1, "c", 0.2, 0.0, ["reference_hypothesis"]),
        (1, 3, 1, "lexical", 1, 14, None, "r", 1, "d", 0.2, 0.0, None), (1, 3, 2, "lexical", 2, 15, None, None, None, " E ", 0.2, 0.0, None), (1, 4, 1, "graph", 1, 16, None, None, None, "e", 0.3, 0.0, None), (1, 5, 1, "reference", 1, 17, 8, None, 1, "f", 0.1, 0.0, ["reference_exact", "target_phrase"]),
        (2, 1, 1, "odd", 1, 18, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "query_id int, list int, rank int, tool string, tool_rank int, candidate_id int, chunk_id int, runtime_id string, document_id int, text string, base_score double, final_score double, features array<string>")
    out = [(r["candidate_id"], r["tools"], r["direct_boost"], r["reason"]) for r in fuse_candidates(df, 9).filter("query_id = 1").orderBy("rank").collect()]
    assert out == [
        (17, ["reference"], 100.0, "exact_reference_match"), (12, ["pgvector"], 90.0, "direct_arabic_match"), (15, ["lexical", "graph"], 0.0, None), (14, ["lexical"], 0.0, None), (10, ["pgvector", "native"], 0.0, None), (13, ["native"], 0.0, None),
    ]
    scores = {r["candidate_id"]: r["score"] for r in fuse_candidates(df, 9).collect()}
    assert scores[10] == pytest.approx(1 / 61 + 1 / 63) and scores[15] == pytest.approx(1 / 62 + 1 / 61) and scores[18] == pytest.approx(1 / 61)
    assert fuse_candidates(df, 2).filter("query_id = 1").count() == 2
