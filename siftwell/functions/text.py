"""Column expressions over text: all built-in, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"

# Scripts and the ranges of their letters.
SCRIPTS = {
    "arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]",
    "cyrillic": r"[\x{0400}-\x{04FF}]",
    "devanagari": r"[\x{0900}-\x{097F}]",
    "greek": r"[\x{0370}-\x{03FF}]",
    "han": r"[\x{4E00}-\x{9FFF}]",
    "hebrew": r"[\x{0590}-\x{05FF}]",
    "latin": r"[A-Za-z\x{00C0}-\x{024F}]",
}

# Words that carry no search meaning.
STOP_TERMS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "what", "when", "where", "which", "who", "why", "with",
]

#: Ordered redaction rules: name, pattern. Patterns use only what Java and RE2 share.
REDACTIONS = [
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("bearer", r"(?i)bearer [a-z0-9._-]{12,}"),
    ("api_key", r"(?i)\b(?:api[_-]?key|token|secret|password)\s*[=:]\s*[^\s,;]+"),
    ("cloud_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("private_host", r"\b(?:localhost|127\.0\.0\.1|10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|192\.168\.[0-9]{1,3}\.[0-9]{1,3})\b"),
    ("path", r"(?:/home|/root|/Users|/var|/etc)/[^\s,;]+"),
    ("phone", r"\+?[0-9][0-9() -]{8,}[0-9]"),
]


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def scripts_of(text: Column) -> Column:
    """Names of the scripts that occur in a text, in alphabetical order."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern), F.lit(name)) for name, pattern in SCRIPTS.items())))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\x0b\x0c]+"))


def estimated_tokens(text: Column) -> Column:
    """The largest of words, a quarter of the characters, three quarters of the Arabic letters, half of the code symbols, and 1."""
    arabic = F.regexp_count(text, F.lit(SCRIPTS["arabic"]))
    symbols = F.regexp_count(text, F.lit(r"[{}()\[\];=<>/*+\\-]"))
    return F.greatest(
        word_count(text), F.floor(F.char_length(text) / 4).cast("int"), F.floor(arabic * 0.75).cast("int"), F.floor(symbols / 2).cast("int"), F.lit(1)
    ).cast("long")


def search_terms(text: Column) -> Column:
    """Different lower-case word tokens without stop terms."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, STOP_TERMS)))


def prefilter_terms(text: Column, most: int = 5) -> Column:
    """Up to ``most`` different terms of three characters or more in order of appearance; none if the text has Arabic."""
    long_ones = F.filter(search_terms(text), lambda t: F.char_length(t) >= 3)
    return F.when(text.rlike(SCRIPTS["arabic"]), F.array().cast("array<string>")).otherwise(F.slice(long_ones, 1, most))


def redacted(text: Column) -> Column:
    """Each rule's matches replaced by ``[REDACTED:rule]``, rule after rule."""
    for name, pattern in REDACTIONS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(f"[REDACTED:{name}]"))
    return text


def redaction_hits(text: Column) -> Column:
    """``rule, matches`` for each rule that matches the text as it is."""
    counts = F.array(*(F.struct(F.lit(name).alias("rule"), F.regexp_count(text, F.lit(pattern)).alias("matches")) for name, pattern in REDACTIONS))
    return F.filter(counts, lambda c: c["matches"] > 0)


def sanitised(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def binary_like(text: Column) -> Column:
    """NUL, or more replacement and control characters than the larger of 3 and a hundredth of the length."""
    strange = F.regexp_count(text, F.lit(r"[\x{FFFD}\x01-\x08\x0e-\x1f]"))
    return F.contains(text, F.lit("\x00")) | (strange > F.greatest(F.lit(3), F.floor(F.char_length(text) / 100).cast("int")))


def breadcrumb(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(p != "", p) for p in parts))), " > ")


def normalise_arabic(text: Column) -> Column:
    """Alef forms folded, tatweel and marks removed, white space collapsed; compatibility forms are left as they are."""
    folded = F.translate(text, "آأإٱى", "ااااي")
    return stripped(F.regexp_replace(F.regexp_replace(folded, r"[\x{0640}\x{064B}-\x{065F}\x{0670}]", ""), r"[ \t\n\r\x0b\x0c]+", " "))


def arabic_tokens(text: Column) -> Column:
    """Different Arabic tokens in order; one that begins with waw is followed by its form without."""
    tokens = F.regexp_extract_all(normalise_arabic(text), F.lit(r"[\x{0621}-\x{064A}]+"), F.lit(0))
    forms = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("و")) & (F.char_length(t) > 3), F.array(t, F.substring(t, 2, 1_000_000))).otherwise(F.array(t)))
    return F.array_distinct(F.flatten(forms))
