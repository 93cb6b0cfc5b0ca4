"""Compatibility folding and Arabic search forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts of these alone are their own compatibility form; a test goes through them. Others are folded in Arrow batches.
PLAIN = r"[\x00-\x7F\x{00C0}-\x{00FF}\x{0400}-\x{045F}\x{0621}-\x{064A}]*"
#: White space of all scripts.
SPACE = r"[\x09-\x0D\x1C-\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# Forms of alef and yeh, tatweel, marks, letters of a token.
LETTERS, FOLDED = "أإآٱى", "ااااي"
TATWEEL = "ـ"
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
TOKEN = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]+"


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """The compatibility form (NFKC): presentation forms, ligatures and widths as plain letters. Texts of plain letters
    don't go to Python: the function's input is null for them."""
    plain = text.rlike(f"^{PLAIN}$")
    return F.coalesce(_compatible(F.when(~plain, text)), text)


def folded_arabic(text: Column) -> Column:
    """Compatibility form, alef and yeh in one form each, no tatweel, no marks, single spaces."""
    bare = F.regexp_replace(F.translate(compatible(text), LETTERS + TATWEEL, FOLDED), MARKS, "")
    return F.regexp_replace(F.regexp_replace(bare, SPACE, " "), "^ | $", "")


def folded_tokens(text: Column) -> Column:
    """Different Arabic tokens of the folded text in order; one of three letters or more that begins with waw is followed by its form without."""
    tokens = F.regexp_extract_all(folded_arabic(text), F.lit(TOKEN), F.lit(0))
    forms = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("و")) & (F.char_length(t) > 2), F.array(t, F.substring(t, 2, 1_000_000))).otherwise(F.array(t)))
    return F.array_distinct(F.flatten(forms))


def query_variants(text: Column) -> Column:
    """The folded query and, if it begins with waw, the query without it."""
    whole = folded_arabic(text)
    return F.array_distinct(F.array_compact(F.array(F.nullif(whole, F.lit("")), F.when(F.startswith(whole, F.lit("و")) & (F.char_length(whole) > 2), F.substring(whole, 2, 1_000_000)))))
