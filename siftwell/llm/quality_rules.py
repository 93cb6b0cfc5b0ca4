"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Every metric is a built-in expression over one row, so the whole rule set is a map-only plan: no shuffle, no user
function, column pruning and predicate pushdown as in any other projection.

Defined results: a null text counts as empty and has no words; an empty text fails the length rule; repeated rows
and ties are judged row by row; an empty table gives an empty result; columns of the input with the names of metrics
are replaced by the metrics; other columns are kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import WORD, let, words_of

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "it", "with", "be", "on", "as", "at", "by", "this", "are", "or",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "que", "qui", "dans", "en", "pour", "est", "au", "sur", "avec",
    "der", "die", "das", "und", "ein", "eine", "den", "dem", "von", "zu", "mit", "ist", "nicht", "im", "für", "auf",
    "el", "los", "las", "y", "del", "por", "con", "una", "se", "no", "al", "su", "lo", "o", "a",
]


class Rule(NamedTuple):
    """A document passes if ``low <= metric <= high``; a bound of None doesn't count, and neither does a null metric."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The thresholds of the production query. ``base_*`` are given by the contract: fewer than 50 words, or more than
#: half of the words in three-word windows that occur again.
BASE_RULES = [Rule("base_words", "n_words", low=50), Rule("base_repeats", "repeat_ratio", high=0.5)]
RULES = [
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("word_length_low", "mean_word_chars", low=2.5),
    Rule("word_length_high", "mean_word_chars", high=12.0),
    Rule("upper_case", "upper_ratio", high=0.3),
    Rule("exclamation", "exclaim_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("different_stop_words", "n_stop", low=2),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
]

METRICS = ["n_words", "word_chars", "n_stop", "n_stop_words", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim"]

#: Up to so many repeated windows, their places are found by membership; beyond, by sorting.
FEW = 12


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the array, the first occurrence included.

    Windows are compared by 64-bit hashes. Texts whose windows are all distinct are done after one hash set; of the
    others, those with few repeated windows look their places up, and the rest sort (hash, place) pairs.
    """

    def looked_up(hashes: Column) -> Column:
        repeated = let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: F.coalesce(F.get(s, i - 1) == h, F.lit(False))))
        return let(repeated, lambda r: F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(r, h), i)), lambda p: p.isNotNull()))

    def sorted_out(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def places(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            kept = F.transform(s, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["at"]))
            return F.sort_array(F.filter(kept, lambda p: p.isNotNull()))

        return let(pairs, places)

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"))
        return F.aggregate(places, start, step, lambda a: a["total"])

    def count(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        windows = F.slice(hashes, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

        def of(h: Column) -> Column:
            again = let(F.size(h) - F.size(F.array_distinct(h)), lambda n: F.when(n == 0, 0).when(n <= FEW, 1).otherwise(2))
            return let(again, lambda k: F.when(k == 0, F.lit(0).cast("long")).when(k == 1, covered(looked_up(h))).otherwise(covered(sorted_out(h))))

        return let(windows, of)

    return let(words, count)


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the metric columns of :data:`METRICS` and the ratios the rules refer to. ``n_stop_words`` counts all stop words,
    ``n_stop`` different ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    count_lines = lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    stop = F.array(*map(F.lit, STOP_WORDS))
    count_words = lambda w: F.struct(
        F.size(w).alias("n"),
        F.char_length(F.array_join(w, "")).alias("chars"),
        F.size(F.array_intersect(w, stop)).alias("stop"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).alias("stops"),
        repeated_words(w).alias("repeat"),
    )
    counted = docs.withColumns({"_w": let(words_of(text), count_words), "_l": let(with_word, count_lines)})
    counted = counted.withColumns(
        {
            "n_words": F.col("_w")["n"].cast("long"),
            "word_chars": F.col("_w")["chars"].cast("long"),
            "n_stop": F.col("_w")["stop"].cast("long"),
            "n_stop_words": F.col("_w")["stops"].cast("long"),
            "n_repeat_words": F.col("_w")["repeat"],
            "n_lines": F.col("_l")["n"].cast("long"),
            "n_dup_lines": F.col("_l")["dup"].cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
            "n_exclaim": F.regexp_count(text, F.lit("!")).cast("long"),
        }
    ).drop("_w", "_l")
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counted.withColumns(
        {
            "symbol_ratio": over("n_symbols", "n_words"),
            "stop_ratio": over("n_stop_words", "n_words"),
            "mean_word_chars": over("word_chars", "n_words"),
            "upper_ratio": over("n_upper", "word_chars"),
            "exclaim_ratio": over("n_exclaim", "n_words"),
            "dup_line_ratio": over("n_dup_lines", "n_lines"),
            "repeat_ratio": over("n_repeat_words", "n_words"),
        }
    )


def compile_rules(rules: list[Rule]) -> Column:
    """The names of the rules that a row breaks, in the table's order."""
    broken = []
    for r in rules:
        bounds = [b for b in (r.low is not None and F.col(r.metric) < r.low, r.high is not None and F.col(r.metric) > r.high) if b is not False]
        wrong = bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
        broken.append(F.when(wrong, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with metrics, ``broken`` (names of the rules broken), ``base_failed`` and ``kept``."""
    rules = RULES if rules is None else rules
    judged = with_metrics(docs, text_col).withColumns({"base_failed": F.size(compile_rules(BASE_RULES)) > 0, "broken": compile_rules([*BASE_RULES, *rules])})
    return judged.withColumn("kept", F.size("broken") == 0)
