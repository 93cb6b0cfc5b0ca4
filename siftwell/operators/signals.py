"""The signals of a hybrid score, each a built-in column of a query and a chunk that other operators have joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import arabic as A
from siftwell.functions.text import SCRIPTS, STOP_TERMS, stripped
from siftwell.operators.policies import WORD

# What each signal is worth at most, by factor or by cap.
EXACT, SAME_PARENT, SAME_PARENT_UNIT, NEIGHBOUR = 100.0, 60.0, 5.0, 30.0
COVERAGE, DENSITY, PHRASE, ANSWER_PHRASE = 10.0, 2.0, 8.0, 24.0
METADATA_CAP, TITLE_CAP, TITLE_TERM, LAYOUT_CAP, LAYOUT_TERM = 12.0, 10.0, 2.0, 16.0, 4.0
ARABIC_EXACT, ARABIC_TOKEN, COUNT, GUIDANCE = 40.0, 24.0, 30.0, 40.0
SIGNALS = ["reference_exact", "neighbor_match", "same_parent_reference", "exact_phrase", "term_coverage", "semantic_density", "arabic_exact", "arabic_token", "metadata_boost", "layout_context", "answer_bearing_count", "guidance_request", "domain_intent"]
# How a query asks for a number or for a wording.
COUNT_QUERY = r"\b(how many|count|number of|total)\b"
NUMBER = r"\b\d{2,}\b"
QUOTED = r'"([^"]{8,160})"'
WORDED = [r"\b(?:that|which)\s+says?\s+(.+?)(?:[.?!]|$)", r"\bsays?\s+(.+?)(?:[.?!]|$)", r"\btranslated\s+as\s+(.+?)(?:[.?!]|$)"]
NOISE = r"^(?:that|which|the verse)\s+"
ASKS, GUIDES = ["ask", "asks", "asking", "request", "requests", "prayer"], ["guidance", "guide", "guides", "guided"]

#: Columns that a pair may lack; null then.
OPTIONAL = {
    "title": "string", "tags": "array<string>", "fields": "array<string>", "layout": "array<string>", "count_terms": "array<string>", "aliases": "array<string>", "requested": "string", "references": "array<string>", "in_range": "boolean",
    "same_parent": "boolean", "names_unit": "boolean", "previous_ref": "string", "next_ref": "string", "allows_exact": "boolean", "graph_confidence": "string", "script": "string", "intent": "double",
}


def terms(text: Column) -> Column:
    """Different lower-case words without stop terms."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))), F.array(*map(F.lit, STOP_TERMS)))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _contains_any(text: Column, some: Column) -> Column:
    return F.exists(some, lambda x: F.contains(text, F.lower(x)))


def answer_phrases(query: Column) -> Column:
    """Quoted or worded phrases of four terms or more that a lower-case query asks for."""
    found = F.concat(F.regexp_extract_all(query, F.lit(QUOTED), F.lit(1)), *(F.transform(F.regexp_extract_all(query, F.lit(p), F.lit(1)), lambda x: F.regexp_replace(stripped(x), NOISE, "")) for p in WORDED))
    return F.array_distinct(F.filter(F.transform(found, lambda x: stripped(F.regexp_replace(x, r"\s+", " "))), lambda x: F.size(terms(x)) >= 4))


def metadata_boost() -> Column:
    """A point for each tag or field that the query holds, and two for each term shared with the title, both capped."""
    held = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: (x != "") & F.contains("_q", F.lower(x))))
    return F.least(F.lit(METADATA_CAP), held("tags") + held("fields") + F.least(F.lit(TITLE_CAP), _shared(F.col("_qt"), terms(F.col("title"))) * TITLE_TERM))


def layout_boost() -> Column:
    return F.least(F.lit(LAYOUT_CAP), _shared(F.col("_qt"), terms(F.array_join(F.coalesce("layout", F.array().cast("array<string>")), " "))) * LAYOUT_TERM)


def count_boost() -> Column:
    """For a query that asks how many: the text or its title has a number of two digits or more and a term of the domain's answers."""
    both = F.lower(F.concat(F.col("text"), F.lit(" "), F.coalesce("title", F.lit(""))))
    return F.when(F.col("_q").rlike(COUNT_QUERY) & both.rlike(NUMBER) & F.coalesce(_contains_any(both, F.col("count_terms")), F.lit(False)), COUNT).otherwise(0.0)


def with_signals(pairs: DataFrame) -> DataFrame:
    """``pairs (query_text, text)`` and any of :data:`OPTIONAL`, with the 13 signals and ``veto``, which sets a score to 0.

    ``aliases``: further terms of the query (:func:`siftwell.operators.policies.expanded_terms`) for the coverage; ``intent``:
    the boost of :func:`siftwell.operators.policies.intent_boosts`. Everything else is a comparison inside the row, so this
    adds no exchange to the plan that found the pairs.
    """
    none = F.array().cast("array<string>")
    rows = pairs.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in pairs.columns})
    # Shared values first, in a generator, so that they are computed once however many signals use them.
    q = F.lower(stripped(F.coalesce("query_text", F.lit(""))))
    body = F.lower(F.coalesce("text", F.lit("")))
    shared = F.struct(q.alias("_q"), body.alias("_t"), terms(q).alias("_qt"), terms(body).alias("_ct"), A.query_variants(F.coalesce("query_text", F.lit(""))).alias("_av"), A.folded_tokens(F.coalesce("text", F.lit(""))).alias("_at"), A.folded_arabic(F.coalesce("text", F.lit(""))).alias("_as"))
    rows = rows.select("*", shared.alias("_s")).select(*rows.columns, F.inline(F.array("_s")))
    asked = F.array_distinct(F.concat("_qt", F.coalesce("aliases", none)))
    share = lambda n, of, factor: F.when((F.size(of) > 0) & (F.size("_ct") > 0), n / F.size(of) * factor).otherwise(0.0)
    exact_ok = F.coalesce("allows_exact", F.lit(True))
    ref_ok = exact_ok & ~F.coalesce(F.col("graph_confidence") == "blocked", F.lit(False)) & F.col("requested").isNotNull()
    is_exact = F.coalesce(ref_ok & (F.coalesce(F.array_contains("references", F.col("requested")), F.lit(False)) | F.coalesce("in_range", F.lit(False))), F.lit(False))
    parent = F.when(F.coalesce("names_unit", F.lit(False)), SAME_PARENT_UNIT).otherwise(SAME_PARENT)
    beside = F.coalesce(F.col("requested") == F.col("previous_ref"), F.lit(False)) | F.coalesce(F.col("requested") == F.col("next_ref"), F.lit(False))
    arabic_ok = exact_ok & F.coalesce(F.col("script") == "arabic", F.lit(False))
    named = F.arrays_overlap("_av", "_at")
    letter = SCRIPTS["arabic"]
    whole = F.exists("_av", lambda v: F.contains(v, F.lit(" ")) & F.rlike(F.col("_as"), F.concat(F.lit(f"(?<!{letter})\\Q"), F.replace(v, F.lit("\\E"), F.lit("")), F.lit(f"\\E(?!{letter})"))))
    guided = F.arrays_overlap("_qt", F.array(*map(F.lit, ASKS))) & F.arrays_overlap("_qt", F.array(*map(F.lit, GUIDES))) & F.contains("_q", F.lit("straight path")) & F.contains("_t", F.lit("straight path")) & F.col("_t").rlike(r"\bguide\s+us\b")
    points = lambda when, value: F.when(when, value).otherwise(0.0)
    signals = {
        "reference_exact": points(is_exact, EXACT), "neighbor_match": points(ref_ok & beside, NEIGHBOUR), "same_parent_reference": points(ref_ok & ~is_exact & F.coalesce("same_parent", F.lit(False)), parent),
        "exact_phrase": F.when((F.col("_q") != "") & F.contains("_t", F.col("_q")), PHRASE).when(_contains_any(F.col("_t"), answer_phrases(F.col("_q"))), ANSWER_PHRASE).otherwise(0.0),
        "term_coverage": share(_shared(asked, F.col("_ct")), asked, COVERAGE), "semantic_density": F.when((F.size("_qt") > 0) & (F.size("_ct") > 0), _shared(F.col("_qt"), F.col("_ct")) / F.size("_ct") * DENSITY).otherwise(0.0),
        "arabic_exact": points(arabic_ok & (named | whole), ARABIC_EXACT), "arabic_token": points(arabic_ok & named, ARABIC_TOKEN), "metadata_boost": metadata_boost(), "layout_context": layout_boost(), "answer_bearing_count": count_boost(),
        "guidance_request": points(guided, GUIDANCE), "domain_intent": F.coalesce("intent", F.lit(0.0)),
    }
    veto = F.col("query_text").rlike(letter) & ~exact_ok
    out = rows.select(*rows.columns, *(c.cast("double").alias(n) for n, c in signals.items()), F.coalesce(veto, F.lit(False)).alias("veto"))
    return out.drop("_t", "_qt", "_ct", "_av", "_at", "_as", *(c for c in OPTIONAL if c not in pairs.columns)).withColumnRenamed("_q", "asked")


def weighted_score(weights: dict[str, float] | None = None) -> Column:
    """The sum of the signals of :func:`with_signals`, each times its weight (1 where none is given); 1 for an empty query, 0 for a vetoed pair."""
    total = F.lit(0.0)
    for name in SIGNALS:
        total = total + F.col(name) * float((weights or {}).get(name, 1.0))
    return F.when(F.col("asked") == "", 1.0).when(F.col("veto"), 0.0).otherwise(F.round(total, 6))
