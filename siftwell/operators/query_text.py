"""Reading queries: domain, intent, expansions, lanes, references, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import word_count


def domain_of(text: Column) -> Column:
    """The first domain whose signals occur."""
    return (
        F.when(F.lower(text).rlike("license|gnu|apache"), "legal").when(text.rlike("[{};=]{2}"), "code").when(F.contains(text, F.lit(" | ")), "multimodal")
        .when(text.rlike("[0-9]{4}"), "reference_heavy").otherwise("general")
    )


def query_intent(text: Column) -> Column:
    return (
        F.when(text.rlike("[0-9]+:[0-9]+"), "reference").when(F.lower(text).rlike('"[^"]+"'), "phrase").when(word_count(text) <= 3, "keyword")
        .when(F.contains(text, F.lit("?")), "question").otherwise("semantic")
    )


def expand_queries(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """``expansion`` of each keyword that is a word of a query: an equi-join on the queries' different words."""
    words = queries.select("item_id", F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "))).alias("keyword"))
    return words.join(keywords, "keyword").select("item_id", "expansion")


def plan_lanes(queries: DataFrame, lanes: list[str]) -> DataFrame:
    """One row for each query and lane in order of priority, with a status and a reason."""
    planned = queries.select("*", F.posexplode(F.array(*map(F.lit, lanes))).alias("p", "lane"))
    reference, graph = F.col("lane") == "reference", F.col("lane") == "graph"
    status = F.when(reference & F.col("has_reference"), "required").when(reference | (graph & ~F.col("graph_ready")), "skipped").otherwise("planned")
    reason = (
        F.when(reference & F.col("has_reference"), "query names a reference").when(reference, "no reference in query")
        .when(graph & ~F.col("graph_ready"), "graph not ready").otherwise("ready")
    )
    return planned.select("item_id", "lane", (F.col("p") + 1).alias("priority"), status.alias("status"), reason.alias("reason"))


def word_targets(text: Column, most: int = 5) -> Column:
    """Different words that follow ``word`` or ``term``; a query of one word is its own target."""
    named = F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:word|term) ([a-z]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.when(word_count(text) == 1, F.array(F.lower(F.trim(text)))).otherwise(named)), 1, most)


def references_in(text: Column) -> Column:
    """Canonical ``[a:b]`` references in a text, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+:[0-9]+"), F.lit(0)), lambda r: F.concat(F.lit("["), r, F.lit("]"))))
