"""All matches of a pattern with their places and groups, as a column: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private code points that mark matches; where a text has them, patterns see the replacement character instead.
BEGIN, GROUP, END = "\ue000", "\ue001", "\ue002"
MATCHES = "array<struct<start: int, end: int, value: string, groups: array<string>>>"

# Redaction rules in their order.
SECRET_RULES = [
    ("openai_key", r"sk-[A-Za-z0-9_-]{8,}"),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("github_pat", r"github_pat_[A-Za-z0-9_]+"),
    ("github_token", r"(?i)ghp_[A-Za-z0-9_]{20,}"),
    ("slack_token", r"xox[baprs]-[A-Za-z0-9-]+"),
    ("google_api_key", r"AIza[0-9A-Za-z_-]{20,}"),
    ("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._=-]{6,}\b"),
    ("localhost", r"localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]"),
    ("private_10_net", r"10\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("private_172_net", r"172\.(1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3}"),
    ("private_192_net", r"192\.168\.\d{1,3}\.\d{1,3}"),
    ("local_absolute_path", r"""(?i)(?<![A-Za-z0-9])[A-Za-z]:[\\/][^"'\s]+|/Users/[^\s"']+|/home/[^\s"']+|/tmp/[^\s"']+|/var/[^\s"']+"""),
    ("unc_path", r"""\\\\[A-Za-z0-9][^\s\\/:*?"<>|]*\\[^\s"']+"""),
    ("file_uri", r"(?i)file://"),
]


def unicode_pattern(pattern: str) -> str:
    """``pattern`` with letters, digits and white space of all scripts in its classes."""
    return f"(?U){pattern}"


def matches_of(text: Column, pattern: str, groups: int = 0) -> Column:
    """``start, end, value, groups`` of each non-empty match of a Java pattern, in order; places are code points from 0.

    The text is marked by one replacement and cut at the marks, so a match is judged where it stands (look-behind and word
    boundaries work) and groups are those of that match; a group that took no part is empty. Null for a null text.
    """
    clean = F.translate(text, BEGIN + GROUP + END, "\ufffd" * 3)
    marked = F.regexp_replace(clean, F.lit(pattern), F.lit(BEGIN + "$0" + "".join(f"{GROUP}${k}" for k in range(1, groups + 1)) + END))
    parts = F.split(marked, BEGIN, -1)
    whole = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    start = F.struct(F.char_length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(MATCHES).alias("out"))

    def add(acc: Column, part: Column) -> Column:
        inside = F.split(F.substring_index(part, END, 1), GROUP, -1)
        value = F.get(inside, F.lit(0))
        after = acc["at"] + F.char_length(value)
        found = F.struct(acc["at"].alias("start"), after.alias("end"), value.alias("value"), F.slice(inside, 2, max(groups, 1)).alias("groups"))
        rest = F.char_length(part) - F.char_length(F.substring_index(part, END, 1)) - 1
        return F.struct((after + rest).alias("at"), F.concat(acc["out"], F.array(found).cast(MATCHES)).alias("out"))

    return F.filter(F.aggregate(whole, start, add, lambda acc: acc["out"]), lambda m: m["end"] > m["start"])


def secret_matches(text: Column, rules: list[tuple[str, str]] = SECRET_RULES) -> Column:
    """``start, end, rule, value`` of every match of every rule, by place, then rule."""

    def of(name: str, pattern: str) -> Column:
        return F.transform(matches_of(text, unicode_pattern(pattern)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(name).alias("rule"), m["value"].alias("value")))

    return F.sort_array(F.concat(*(of(name, pattern) for name, pattern in rules)))


def without_overlaps(matches: Column) -> Column:
    """Of matches sorted by place, those that stand: the first to begin, of equal begins the longest (then the first rule),
    and none that begins inside one that stands."""
    order = F.array_sort(matches, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0))
    kind = "array<struct<start: int, end: int, rule: string, value: string>>"
    start = F.struct(F.lit(0).alias("upto"), F.array().cast(kind).alias("out"))
    keep = lambda acc, m: F.when(m["start"] >= acc["upto"], F.struct(m["end"].alias("upto"), F.concat(acc["out"], F.array(m).cast(kind)).alias("out"))).otherwise(acc)
    return F.aggregate(order, start, keep, lambda acc: acc["out"])


def secrets_redacted(text: Column, rules: list[tuple[str, str]] = SECRET_RULES) -> Column:
    """Each rule's matches replaced by ``[REDACTED:rule]``, rule after rule, so that a later rule sees what earlier ones left."""
    for name, pattern in rules:
        text = F.regexp_replace(text, F.lit(unicode_pattern(pattern)), F.lit(f"[REDACTED:{name}]"))
    return text
