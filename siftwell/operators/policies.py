"""Search policies as tables: intents, aliases and vocabulary that a domain gives, joined by term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of a policy, a query or a chunk, compared in lower case.
WORD = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"
_NUMBER = r"(?U)\b\d+(?:[.,]\d+)?\b"
_ANY = "*"


def policy_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def symmetric_aliases(aliases: DataFrame) -> DataFrame:
    """Different ``(term, alias)`` of an alias table in both directions, in lower case; a term is no alias of itself."""
    low = aliases.select(F.lower(F.trim("term")).alias("term"), F.lower(F.trim("alias")).alias("alias")).filter("term != '' and alias != ''")
    return low.unionByName(low.select(F.col("alias").alias("term"), F.col("term").alias("alias"))).filter("term != alias").distinct()


def expanded_terms(terms: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """``terms (key, term)`` and, by one join on the term, their aliases."""
    more = terms.join(symmetric_aliases(aliases), "term").select(key, F.col("alias").alias("term"))
    return terms.select(key, "term").unionByName(more).distinct()


def _seams(words: Column) -> Column:
    """The last letter of each word with the first one of the next: what a phrase and a text that holds it share."""
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.right(w, F.lit(1)), F.lit(" "), F.left(F.get(words, i + 1), F.lit(1))))
    return F.array_distinct(pairs)


def query_intents(queries: DataFrame, intents: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(query_id, intent_id)``: a query has an intent if any of its words, or an alias of one, is a query term of it, or
    if its words in a row hold a phrase of it; an intent without terms and phrases is that of every query.

    Words meet by equality; a phrase meets the queries that share one of its seams between words, and is then compared.
    """
    matchers = intents.select("intent_id", F.explode(F.coalesce("query_terms", F.array().cast("array<string>"))).alias("t")).select("intent_id", policy_words(F.col("t")).alias("w")).filter(F.size("w") > 0)
    words = queries.select("query_id", policy_words(F.col("text")).alias("w"))
    asked = expanded_terms(words.select("query_id", F.explode("w").alias("term")).distinct(), aliases, "query_id")
    single = matchers.filter(F.size("w") == 1).select("intent_id", F.get("w", F.lit(0)).alias("term")).distinct()
    phrases = matchers.filter(F.size("w") > 1).select("intent_id", F.array_join("w", " ").alias("phrase"), F.get(_seams(F.col("w")), F.lit(0)).alias("seam")).distinct()
    seams = words.select("query_id", F.array_join("w", " ").alias("line"), F.explode(_seams(F.col("w"))).alias("seam"))
    said = seams.join(phrases, "seam").filter(F.contains("line", F.col("phrase")))
    free = intents.join(matchers.select("intent_id").distinct(), "intent_id", "left_anti").select("intent_id", F.lit(_ANY).alias("key"))
    always = queries.select("query_id", F.lit(_ANY).alias("key")).join(free, "key")
    return asked.join(single, "term").select("query_id", "intent_id").unionByName(said.select("query_id", "intent_id")).unionByName(always.select("query_id", "intent_id")).distinct()


def intent_boosts(pairs: DataFrame, intents: DataFrame, aliases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``query_id, document_id, boost, intents`` of pairs ``(query_id, document_id, query_text, text)``.

    ``intents (intent_id, query_terms, vocabulary, requires_number, boost)``; a word of an intent's vocabulary that is a
    ``key`` of ``vocabulary (key, term)`` stands for that key's terms as well. An intent counts if the query has it, the
    text has a word of its vocabulary (if it names any), and the text has a number (if it asks for one). Boosts add up.
    """
    none = F.array().cast("array<string>")
    has = query_intents(pairs.select("query_id", F.col("query_text").alias("text")).distinct(), intents, aliases)
    named = intents.select("intent_id", F.explode(F.coalesce("vocabulary", none)).alias("t")).select("intent_id", F.explode(policy_words(F.col("t"))).alias("term")).distinct()
    keys = vocabulary.select(F.lower("key").alias("_key"), F.explode(policy_words(F.col("term"))).alias("_term")).distinct()
    named = named.unionByName(named.join(keys, F.col("term") == F.col("_key")).select("intent_id", F.col("_term").alias("term"))).distinct()
    chunks = pairs.select("document_id", "text").dropDuplicates(["document_id"])
    held = chunks.select("document_id", F.explode(F.array_distinct(policy_words(F.col("text")))).alias("term"))
    fits = held.join(named, "term").select("document_id", "intent_id").distinct().withColumn("fits", F.lit(True))
    numbers = chunks.select("document_id", F.col("text").rlike(_NUMBER).alias("number"))
    rules = intents.join(named.select("intent_id").distinct().withColumn("bound", F.lit(True)), "intent_id", "left")
    rules = rules.select("intent_id", F.coalesce("requires_number", F.lit(False)).alias("requires_number"), F.col("boost").cast("double").alias("boost"), F.coalesce("bound", F.lit(False)).alias("bound"))
    able = pairs.select("query_id", "document_id").join(has.join(rules, "intent_id"), "query_id").join(fits, ["document_id", "intent_id"], "left").join(numbers, "document_id")
    able = able.filter((~F.col("bound") | F.coalesce("fits", F.lit(False))) & (~F.col("requires_number") | F.coalesce("number", F.lit(False))))
    sums = able.groupBy("query_id", "document_id").agg(F.sum("boost").alias("boost"), F.count(F.lit(1)).alias("intents"))
    out = pairs.select("query_id", "document_id").join(sums, ["query_id", "document_id"], "left")
    return out.select("query_id", "document_id", F.coalesce("boost", F.lit(0.0)).alias("boost"), F.coalesce("intents", F.lit(0)).alias("intents"))
