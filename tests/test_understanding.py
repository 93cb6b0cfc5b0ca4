"""Domains and intents: each rule, and its place in the order of rules."""

from pyspark.sql import functions as F

from siftwell.operators import understanding as U
from siftwell.operators.contracts import Contract


def test_signals_and_families(spark):
    rows = [
        (1, "Law ", None, ["Table"], "en"), (1, None, "x", None, " "), (2, "patient", None, ["law"], None), (3, "tax", None, None, None), (4, "API", None, ["figure"], None), (5, "odd", None, None, None), (6, None, None, ["equation", "paper"], None),
        (7, "Report", None, None, None), (8, None, None, None, None), (9, "medicine", None, ["reference"], None), (10, "invoice", None, ["figure"], None), (11, "code", None, None, None),
    ]
    df = spark.createDataFrame(rows, "document_id int, domain string, collection string, tags array<string>, language string")
    signals = U.domain_signals(df)
    assert {r["document_id"]: r["signals"] for r in signals.collect() if r["document_id"] in (1, 8)} == {1: ["en", "law", "table", "x"], 8: []}
    marked = signals.withColumns({"has_contract": F.col("document_id").isin(1, 5), "has_reference_hint": F.col("document_id").isin(2, 3, 7, 11)})
    got = {r["document_id"]: tuple(r)[1:6] for r in U.classify_domain(marked).collect()}
    assert got == {
        1: ("legal_reference", "legal_reference", "table", "graph", True), 2: ("legal_reference", "legal_reference", "reference", "vector", False), 3: ("financial_reference", "financial_reference", "reference", "vector", False),
        4: ("code_reference", "code_reference", "figure", "vector", False), 5: ("reference_heavy", "reference_heavy", "reference", "graph", True), 6: ("multimodal_layout", "generic", "equation", "full", False), 7: ("general", "research_semantic", "reference", "vector", False),
        8: ("general", "generic", None, "vector", False), 9: ("medical_reference", "medical_reference", "reference", "vector", False), 10: ("financial_reference", "financial_reference", "figure", "full", False), 11: ("code_reference", "code_reference", None, "vector", False),
    }


def test_intents_in_order(spark):
    contracts = [Contract("{a}:{b}")]
    cases = {
        "what is near 2:255 and its context": ("reference", "graph_context_hybrid", "reference_exact", True, []), "Who says that Light, upon light!": ("phrase_lookup", "reference_first_hybrid", "phrase_exact", True, ["light upon light"]),
        "he says about": ("semantic", "semantic_hybrid", None, False, []), "How many chapters after this": ("count", "count_metadata_hybrid", "title_count", False, []), "an overview": ("summary", "semantic_hybrid", None, False, []),
        "related summary": ("summary", "graph_context_hybrid", None, False, []), "plain question": ("semantic", "semantic_hybrid", None, False, []), "وكتاب": ("arabic_exact_token", "reference_first_hybrid", "arabic_exact_token", True, ["وكتاب", "كتاب"]),
        "كتاب a b c": ("semantic", "semantic_hybrid", None, False, []), "quote !?": ("semantic", "semantic_hybrid", None, False, []), "": ("semantic", "semantic_hybrid", None, False, []),
    }
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(cases)] + [(99, "count 1:2", ["a", "b"])], "query_id int, text string, expansions array<string>")
    out = {r["query_id"]: r for r in U.understand_queries(df, contracts, declared_arabic=True).collect()}
    for i, (text, (intent, strategy, first, direct, terms)) in enumerate(cases.items()):
        r = out[i]
        names = [p["name"] for p in r["passes"]]
        assert (r["intent"], r["strategy"], r["direct_evidence_required"], r["required_terms"]) == (intent, strategy, direct, terms), text
        assert names == ([first] if first else []) + U.SEMANTIC_PASSES and r["passes"][0]["direct_evidence"] == direct
    assert out[0]["reference_hints"] == ["2:255"] and {p["query"] for p in out[1]["passes"]} == {"light upon light"}
    r = out[99]
    assert r["intent"] == "lexical_expanded_token" and [(p["name"], p["query"]) for p in r["passes"]][:3] == [("lexical_expanded_token", "a"), ("lexical_expanded_token", "b"), ("semantic_metadata", "count 1:2")]
    assert {r["intent"] for r in U.understand_queries(df.filter("text = 'وكتاب'"), contracts).collect()} == {"semantic"}
