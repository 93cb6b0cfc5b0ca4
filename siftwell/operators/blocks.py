"""Parser blocks and their warnings: types, rendering, validation, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags and parser types by block type.
BLOCK_TYPES = {
    "text": ["h1", "h2", "title", "p", "li", "text", "paragraph", "heading", "list"],
    "table": ["td", "table"],
    "image": ["img", "image", "figure"],
    "equation": ["math", "equation", "formula"],
}


def block_type(tag: Column) -> Column:
    kind = F.lit("unknown")
    for name, tags in BLOCK_TYPES.items():
        kind = F.when(F.lower(tag).isin(tags), F.lit(name)).otherwise(kind)
    return kind


def modal_text() -> Column:
    """Searchable text of a block ``(block_type, text, caption, latex)``: table cells in bars, captions before bodies,
    and the type in brackets where nothing else is there."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    body = (
        F.when(F.col("block_type") == "table", F.concat(F.coalesce(F.concat(some("caption"), F.lit("\n")), F.lit("")), F.lit("| "), some("text"), F.lit(" |")))
        .when(F.col("block_type") == "image", F.coalesce(some("caption"), some("text")))
        .when(F.col("block_type") == "equation", F.coalesce(some("latex"), some("text")))
        .otherwise(some("text"))
    )
    return F.coalesce(body, F.concat(F.lit("["), F.col("block_type"), F.lit("]")))


def modal_warnings() -> Column:
    """Codes of what a block ``(block_type, text, caption, latex)`` lacks."""
    lacks = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    return F.array_compact(
        F.array(
            F.when((F.col("block_type") == "table") & lacks("text"), F.lit("table_without_body")),
            F.when((F.col("block_type") == "image") & lacks("caption"), F.lit("image_without_caption")),
            F.when((F.col("block_type") == "equation") & lacks("latex"), F.lit("equation_without_latex")),
        )
    )


def repair_page_ranges(rows: DataFrame) -> DataFrame:
    """Fill and order ``page_start`` and ``page_end`` from each other and from ``page``; ``diagnostics`` names each fix."""
    first = F.coalesce("page_start", "page", "page_end")
    last = F.coalesce("page_end", "page_start", "page")
    no_start, no_end, page = F.col("page_start").isNull(), F.col("page_end").isNull(), F.col("page").isNotNull()
    fixes = F.array_compact(
        F.array(
            F.when(no_start & no_end & page, F.lit("page_promoted")),
            F.when(no_start & ~no_end, F.lit("start_filled")),
            F.when(no_end & ~no_start, F.lit("end_filled")),
            F.when(first > last, F.lit("range_swapped")),
            F.when(page & ~(no_start & no_end), F.lit("page_dropped")),
        )
    )
    return rows.withColumns({"diagnostics": fixes, "page_start": F.least(first, last), "page_end": F.greatest(first, last)}).drop("page")


def scrub_paths(meta: Column) -> Column:
    """A metadata map without path keys and without absolute paths among its values."""
    return F.map_filter(meta, lambda k, v: ~k.isin("artifact_path", "path", "file_path") & ~F.coalesce(v.rlike(r"^(/|[A-Za-z]:\\)"), F.lit(False)))


def prefixed_text(text: Column, context: Column) -> Column:
    return F.when(F.startswith(text, F.lit("[Context:")) | (context == ""), text).otherwise(F.concat(F.lit("[Context: "), context, F.lit("]\n"), text))


def normalise_blocks(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Blocks of allowed tags as they are; others with their ``recovery`` text, or quarantined with none."""
    fine = F.col("tag").isin(allowed)
    saved = F.coalesce(F.col("recovery") != "", F.lit(False))
    return rows.select(
        "document_id", "block_index", F.when(fine, F.col("text")).when(saved, F.col("recovery")).otherwise("").alias("text"),
        F.when(fine, "kept").when(saved, "recovered").otherwise("quarantined").alias("action"),
    )


def classify_warnings(warnings: DataFrame, policy: DataFrame) -> DataFrame:
    """Severity and suppression of each warning: the policy of its code and block type, else of its block type, else of
    its code, else a warning. The policy table is joined three times; each key holds one policy."""
    out, picked = warnings, []
    for k, (code, kind) in enumerate([(True, True), (False, True), (True, False)]):
        own = policy.filter((F.col("code").isNotNull() if code else F.col("code").isNull()) & (F.col("block_type").isNotNull() if kind else F.col("block_type").isNull()))
        on = [c for c, used in (("code", code), ("block_type", kind)) if used]
        out = out.join(own.select(*on, F.col("severity").alias(f"_s{k}"), F.col("suppressed").alias(f"_q{k}")).dropDuplicates(on), on, "left")
        picked.append(k)
    return out.withColumns({
        "severity": F.coalesce(*(F.col(f"_s{k}") for k in picked), F.lit("warning")), "suppressed": F.coalesce(*(F.col(f"_q{k}") for k in picked), F.lit(False)),
    }).drop(*(f"_{c}{k}" for c in "sq" for k in picked))


def contract_status() -> Column:
    return F.when(F.col("has_contract"), "compiled_reference_contract").when(F.col("has_metadata"), "metadata_only").otherwise("generic")


def merged_parameters(preset: Column, own: Column) -> Column:
    """Two maps in one; where both have a key, ``own`` wins."""
    return F.map_zip_with(preset, own, lambda k, a, b: F.coalesce(b, a))


#: What a content list says of a block; fields that are missing are null.
CONTENT_LIST = "array<struct<type: string, text: string, page_idx: int, text_level: int>>"


def read_blocks(lists: DataFrame) -> DataFrame:
    """Ordered blocks of JSON content lists ``(document_id, content)``; what is no such list is skipped."""
    items = lists.select("document_id", F.from_json("content", CONTENT_LIST, {"mode": "PERMISSIVE"}).alias("items"))
    return items.select("document_id", F.posexplode("items").alias("block_index", "b")).filter("b is not null").select("document_id", "block_index", "b.*")
