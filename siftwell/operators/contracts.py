"""Reference contracts, compiled into expressions when a plan is made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.matches import matches_of, unicode_pattern

#: A contract becomes a few expressions, so their number is part of the plan's size.
MAX_CONTRACTS = 64
# Fixed value: what a template's field matches.
FIELD = r"[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*"


@dataclass(frozen=True)
class Contract:
    """How a corpus writes its references. Patterns name their groups as ``(?P<name>...)``; ``template`` is ``{name}`` and text."""

    template: str | None = None
    primary: list[str] = field(default_factory=list)
    inline: list[str] = field(default_factory=list)
    context: list[str] = field(default_factory=list)
    unit: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    verified: bool = True


def read_contracts(rows: DataFrame) -> list[Contract]:
    """The verified contracts of a table ``(contract_id, template, anchors array<struct<kind, regex>>, required, verified)``
    in the order of their ids; more than ``MAX_CONTRACTS`` are an error, as they would have to be joined, not compiled."""
    kept = rows.filter("verified").orderBy("contract_id").limit(MAX_CONTRACTS + 1).collect()
    if len(kept) > MAX_CONTRACTS:
        raise ValueError(f"more than {MAX_CONTRACTS} contracts")
    of = lambda r, kind: [a["regex"] for a in r["anchors"] or [] if a["kind"] == kind and a["regex"]]
    return [Contract(r["template"], of(r, "primary_anchor"), of(r, "inline_references"), of(r, "context_anchor"), of(r, "unit_anchor"), list(r["required"] or [])) for r in kept]


def _compiled(pattern: str) -> tuple[str, dict[str, int], int] | None:
    """A Java pattern with numbered groups, the numbers of the named ones, and how many groups it has; None if it is none."""
    try:
        own = re.compile(pattern, re.IGNORECASE)
    except re.error:
        return None
    names = dict(own.groupindex)
    numbered = re.sub(r"\(\?P=(\w+)\)", lambda m: f"(?:\\{names[m[1]]})", re.sub(r"\(\?P<\w+>", "(", pattern))
    return unicode_pattern(f"(?i){numbered}"), names, own.groups


def _template_pattern(template: str | None) -> str | None:
    if not template:
        return None
    names: list[str] = []
    parts = [r"(?<![A-Za-z0-9_])"]
    try:
        for literal, name, _, _ in Formatter().parse(template):
            parts.append(re.sub(r"([^\w\s])", r"\\\1", literal))
            if name:
                if not re.fullmatch(r"[A-Za-z]\w*", name) or name in names:
                    return None
                names.append(name)
                parts.append(f"(?P<{name}>{FIELD})")
    except ValueError:
        return None
    return "".join([*parts, r"(?![A-Za-z0-9_])"]) if names else None


def _named(groups: Column, names: dict[str, int]) -> Column:
    """The groups that took part, by name."""
    if not names:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.get(groups, F.lit(i - 1)).alias("value")) for n, i in names.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "")))


def _rendered(groups: Column, template: str | None) -> Column:
    """The canonical reference of named groups; null if the template asks for one that is missing."""
    if not template:
        return F.lit(None).cast("string")
    out = []
    try:
        for literal, name, _, _ in Formatter().parse(template):
            out.append(F.lit(literal))
            if name is not None:
                out.append(F.try_element_at(groups, F.lit(name)))
    except ValueError:
        return F.lit(None).cast("string")
    return F.nullif(F.trim(F.concat(*out)), F.lit(""))


def _each(text: Column, pattern: str, reference) -> Column:
    compiled = _compiled(pattern)
    if compiled is None:
        return F.array().cast("array<string>")
    java, names, n = compiled
    return F.transform(matches_of(text, java, n), lambda m: reference(_named(m["groups"], names), m["value"]))


def contract_references(text: Column, contract: Contract) -> Column:
    """References of one contract: by its template, then by single anchors, then by units in the context before them."""
    none = F.array().cast("array<string>")
    found = []
    whole = _template_pattern(contract.template)
    if whole:
        required = F.array(*map(F.lit, contract.required)) if contract.required else none
        full = lambda g: F.size(F.array_except(required, F.map_keys(g))) == 0
        found.append(_each(text, whole, lambda g, v: F.when(full(g), _rendered(g, contract.template))))
    for pattern in [*contract.primary, *contract.inline]:
        found.append(_each(text, pattern, lambda g, v: F.coalesce(_rendered(g, contract.template), F.nullif(F.trim(v), F.lit("")))))

    def events_of(kind: str, order: int, java: str, names: dict[str, int], n: int) -> Column:
        return F.transform(matches_of(text, java, n), lambda m: F.struct(m["start"].alias("at"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), _named(m["groups"], names).alias("groups")))

    contexts, units = ([c for c in map(_compiled, patterns) if c] for patterns in (contract.context, contract.unit))
    if contexts and units:
        events = [events_of("context", i, *c) for i, c in enumerate(contexts)] + [events_of("unit", len(contexts) + i, *c) for i, c in enumerate(units)]
        every = F.array_sort(F.concat(*events), lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(a["order"] - b["order"]))
        over = lambda low, high: F.map_zip_with(low, high, lambda _, a, b: F.coalesce(b, a))
        start = F.struct(F.create_map().cast("map<string,string>").alias("context"), none.alias("out"))

        def step(acc: Column, e: Column) -> Column:
            both = over(acc["context"], e["groups"])
            unit = F.struct(acc["context"].alias("context"), F.concat(acc["out"], F.array(_rendered(both, contract.template))).alias("out"))
            return F.when(e["kind"] == "context", F.struct(both.alias("context"), acc["out"].alias("out"))).otherwise(unit)

        found.append(F.aggregate(every, start, step, lambda acc: acc["out"]))
    return F.array_compact(F.concat(*found)) if found else none


def parse_references(text: Column, contracts: list[Contract]) -> Column:
    """Different canonical references of a text by the verified contracts, in the order in which they were found."""
    own = [contract_references(text, c) for c in contracts if c.verified]
    return F.array_distinct(F.concat(*own)) if own else F.array().cast("array<string>")
