"""What a corpus is about and what a query asks for, by ordered rules over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.arabic import query_variants
from siftwell.functions.text import stripped
from siftwell.operators.contracts import Contract, parse_references

# Metadata keys that carry signals, families by their signals in order of precedence, layouts in theirs.
SIGNAL_KEYS = ["domain", "document_type", "collection", "content_role", "citation_style", "language", "layout_hint", "parser_layout"]
SIGNAL_LISTS = ["tags", "layout_types", "modalities"]
FAMILIES = {
    "legal_reference": ["legal", "law", "statute", "policy", "contract"],
    "medical_reference": ["medical", "clinical", "medicine", "diagnosis", "patient"],
    "financial_reference": ["finance", "financial", "invoice", "tax", "accounting"],
    "code_reference": ["code", "api", "source_code", "stacktrace", "software"],
}
RESEARCH = ["research", "paper", "report", "scientific"]
LAYOUTS = ["table", "figure", "equation", "reference"]
MODAL = LAYOUTS[:3]
# Patterns of a query's intent.
GRAPH = r"(?i)\b(?:surrounding|connected|related|nearby|neighboring|previous|next|before|after|context|around)\b"
PHRASE = r"(?i)\b(?:(?:says|say)(?!\s+about\b)|phrase|quote)\b(?:\s+(?:that|is|was|as))?\s+(.+)"
COUNT, SUMMARY = r"\b(how many|count|number of|total)\b", r"\b(summary|summarize|overview)\b"
ARABIC = r"[\x{0600}-\x{06FF}]"
SEMANTIC_PASSES = ["semantic_metadata", "vector_db", "native_vector"]


def domain_signals(metadata: DataFrame) -> DataFrame:
    """``document_id, signals``: the different values, in lower case and in order, of a document's metadata rows."""
    have = set(metadata.columns)
    single = [F.array(c) for c in SIGNAL_KEYS if c in have]
    many = [F.coalesce(c, F.array().cast("array<string>")) for c in SIGNAL_LISTS if c in have]
    values = F.filter(F.transform(F.concat(F.array().cast("array<string>"), *single, *many), lambda v: F.lower(stripped(v))), lambda v: v.isNotNull() & (v != ""))
    gathered = metadata.select("document_id", F.explode_outer(values).alias("v")).groupBy("document_id").agg(F.sort_array(F.collect_set("v")).alias("signals"))
    return gathered


def classify_domain(signals: DataFrame) -> DataFrame:
    """``signals (document_id, signals, has_reference_hint, has_contract)`` with family, profile, hints and whether references
    weigh: the first family in order that has a signal; without one, a verified contract, a modal layout, research, none."""
    hint, contract = F.coalesce("has_reference_hint", F.lit(False)), F.coalesce("has_contract", F.lit(False))
    any_of = lambda words: F.arrays_overlap("signals", F.array(*map(F.lit, words)))
    layout = F.coalesce(*(F.when(F.array_contains("signals", name), name) for name in LAYOUTS))
    effective = F.coalesce(layout, F.when(hint, "reference"))
    family = F.lit(None).cast("string")
    for name, words in reversed(FAMILIES.items()):
        family = F.when(any_of(words), name).otherwise(family)
    modal = F.coalesce(layout.isin(MODAL), F.lit(False))
    rows = signals.withColumns({"_family": family, "_layout": layout, "_effective": effective, "_modal": modal, "_research": any_of(RESEARCH)})
    known, other = F.col("_family"), F.col("_family").isNull()
    layout_hint = (
        F.when(known == "financial_reference", F.coalesce("_effective", F.lit("table"))).when(known == "code_reference", F.col("_layout")).when(other & contract, F.coalesce("_layout", F.lit("reference")))
        .when(other & F.col("_modal"), F.col("_layout")).otherwise(F.col("_effective"))
    )
    rows = rows.withColumn("layout_hint", layout_hint)
    full = F.coalesce(F.col("layout_hint").isin(MODAL), F.lit(False))
    hint_of = (
        F.when((known == "legal_reference") & contract, "graph").when(known == "code_reference", "vector").when(known.isNotNull() & full, "full").when(known.isNotNull(), "vector").when(contract, "graph").when(F.col("_modal"), "full").otherwise("vector")
    )
    return rows.select(
        "document_id", F.coalesce(known, F.when(contract, "reference_heavy").when(F.col("_modal"), "multimodal_layout").otherwise("general")).alias("domain_profile_id"),
        F.coalesce(known, F.when(contract, "reference_heavy").when(F.col("_modal"), "generic").when(F.col("_research"), "research_semantic").otherwise("generic")).alias("domain_family"),
        "layout_hint", hint_of.alias("materialization_hint"), contract.alias("reference_heavy"), "signals",
    )


def target_phrase(text: Column) -> Column:
    """What follows ``says``, ``phrase`` or ``quote``: letters and digits in lower case with single spaces; null if there is nothing."""
    found = F.lower(F.regexp_extract(text, PHRASE, 1))
    return F.nullif(F.trim(F.regexp_replace(found, r"[^0-9a-z\x{0600}-\x{06FF}]+", " ")), F.lit(""))


def understand_queries(queries: DataFrame, contracts: list[Contract], declared_arabic: bool = False) -> DataFrame:
    """``queries (query_id, text)`` and, if any, ``expansions array<string>`` with intent, answer type, strategy, terms, whether
    the graph's neighbours are asked for, and the retrieval passes in order.

    The rules in order: expansions of the domain, references by contract, a short Arabic query, a phrase, a count, a
    summary, anything else. One projection; references are parsed by compiled contracts.
    """
    none = F.array().cast("array<string>")
    rows = queries if "expansions" in queries.columns else queries.withColumn("expansions", none)
    values = F.struct(
        F.coalesce("expansions", none).alias("expanded"), parse_references(F.col("text"), contracts).alias("references"), query_variants(F.col("text")).alias("variants"), target_phrase(F.col("text")).alias("phrase"),
        (F.col("text").rlike(ARABIC) & (F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) <= 3)).alias("arabic"), F.col("text").rlike(GRAPH).alias("graph"),
    )
    rows = rows.select("query_id", "text", F.inline(F.array(values)))
    intent = (
        F.when(F.size("expanded") > 0, "lexical_expanded_token").when(F.size("references") > 0, "reference").when(F.col("arabic"), "arabic_exact_token" if declared_arabic else "semantic").when(F.col("phrase").isNotNull(), "phrase_lookup")
        .when(F.lower("text").rlike(COUNT), "count").when(F.lower("text").rlike(SUMMARY), "summary").otherwise("semantic")
    )
    rows = rows.withColumn("intent", intent)
    is_ = lambda *names: F.col("intent").isin(*names)
    direct = is_("lexical_expanded_token", "reference", "arabic_exact_token", "phrase_lookup")
    strategy = F.when(is_("count"), "count_metadata_hybrid").when(F.col("graph"), "graph_context_hybrid").when(direct, "reference_first_hybrid").otherwise("semantic_hybrid")
    first = F.when(is_("reference"), "reference_exact").when(is_("arabic_exact_token"), "arabic_exact_token").when(is_("phrase_lookup"), "phrase_exact").when(is_("count"), "title_count")
    asked = F.when(is_("arabic_exact_token"), F.coalesce(F.get("variants", F.lit(0)), F.col("text"))).when(is_("phrase_lookup"), F.col("phrase")).otherwise(F.col("text"))
    as_pass = lambda name, q, evidence: F.struct(name.alias("name"), q.alias("query"), evidence.alias("direct_evidence"))
    own = F.when(is_("lexical_expanded_token"), F.transform("expanded", lambda e: as_pass(F.lit("lexical_expanded_token"), e, F.lit(True)))).when(first.isNotNull(), F.array(as_pass(first, asked, direct)))
    query = F.when(is_("lexical_expanded_token"), F.col("text")).otherwise(asked)
    others = F.array(*(as_pass(F.lit(p), query, F.lit(False)) for p in SEMANTIC_PASSES))
    terms = F.when(is_("lexical_expanded_token"), F.col("expanded")).when(is_("arabic_exact_token"), F.col("variants")).when(is_("phrase_lookup"), F.array("phrase")).otherwise(none)
    return rows.select(
        "query_id", "intent", F.when(direct, "reference").when(is_("count"), "count").when(is_("summary"), "summary").otherwise("semantic").alias("answer_type"), strategy.alias("strategy"), F.coalesce("graph", F.lit(False)).alias("graph_context_required"),
        terms.alias("required_terms"), F.when(is_("reference"), F.col("references")).otherwise(none).alias("reference_hints"), direct.alias("direct_evidence_required"), F.when(own.isNull(), others).otherwise(F.concat(own, others)).alias("passes"),
    )
