"""Warnings on candidates, diagnostics, repairs and layout relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import stripped


def clean_parser_noise(text: Column) -> Column:
    """Without lines of formula marks only, with single spaces and at most one blank line in a row."""
    text = F.regexp_replace(text, r"(?m)^[$\\{}^_*#%&|~ ]+$", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def backfilled(text: Column, search_text: Column) -> Column:
    return F.when(F.coalesce(search_text, F.lit("")) == "", F.lower(text)).otherwise(search_text)


def expand_multi_reference(rows: DataFrame, anchor: str) -> DataFrame:
    """Rows with several anchors become one row per anchor, numbered; others stay."""
    parts = F.filter(F.split(F.regexp_replace("text", f"({anchor})", "\x01$1"), "\x01", -1), lambda x: x.rlike(anchor))
    units = F.when(F.size(parts) > 1, parts).otherwise(F.array("text"))
    out = rows.select("document_id", "chunk_index", F.size(units).alias("n"), F.posexplode(units).alias("p", "text"))
    return out.select("document_id", "chunk_index", F.when(F.col("n") > 1, F.concat(F.lit("ref"), (F.col("p") + 1).cast("string"))).otherwise("").alias("suffix"), "text")


def spans_to_blocks(spans: DataFrame, blocks: DataFrame, group: list[str]) -> DataFrame:
    """First and last block that a character span overlaps; the join is one of equality on the group."""
    both = spans.join(blocks, group).filter((F.col("char_start") < F.col("span_end")) & (F.col("char_end") > F.col("span_start")))
    return both.groupBy(*group, "span_start").agg(F.min("block_index").alias("first_block"), F.max("block_index").alias("last_block"))


def layout_neighbours(boxes: DataFrame, kinds: DataFrame, limit: int) -> DataFrame:
    """Neighbours of each box on its page: of the same kind (3), next in order (5), overlapping in a band (4); boosts add up."""
    from siftwell.operators.joins import bbox_overlap

    own = kinds.select("page_id", "block", "kind")
    a, b = own.select("page_id", F.col("block").alias("a"), "kind"), own.select("page_id", F.col("block").alias("b"), "kind")
    same = a.join(b, ["page_id", "kind"]).filter(F.abs(F.col("a") - F.col("b")).between(1, 4)).select("page_id", "a", "b", F.lit(3).alias("points"))
    step = own.select("page_id", F.col("block").alias("a"), F.explode(F.array(F.col("block") - 1, F.col("block") + 1)).alias("b")).join(own.select("page_id", F.col("block").alias("b")), ["page_id", "b"]).select("page_id", "a", "b", F.lit(5).alias("points"))
    pairs = bbox_overlap(boxes)
    over = pairs.select("page_id", "a", "b", F.lit(4).alias("points")).unionByName(pairs.select("page_id", F.col("b").alias("a"), F.col("a").alias("b"), F.lit(4).alias("points")))
    scored = same.unionByName(step).unionByName(over).groupBy("page_id", "a", "b").agg(F.sum("points").alias("score"))
    order = Window.partitionBy("page_id", "a").orderBy(F.desc("score"), "b")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def intent_boost(pairs: DataFrame, intents: list[tuple[str, str, str, float]]) -> DataFrame:
    """Sum of the boosts of intents ``(name, query term, text term, boost)`` whose terms occur on both sides."""
    total = F.lit(0.0)
    for _, q, t, boost in intents:
        total = total + F.when(F.contains(F.lower("query_text"), F.lit(q)) & F.contains(F.lower("text"), F.lit(t)), boost).otherwise(0.0)
    return pairs.withColumn("boost", total)


def reference_match(rows: DataFrame) -> DataFrame:
    """``exact`` if the value is listed, ``range`` if it lies between ``first`` and ``last``, else ``none``."""
    return rows.withColumn("match", F.when(F.array_contains("listed", F.col("value")), "exact").when(F.col("value").between(F.col("first"), F.col("last")), "range").otherwise("none"))


def seed_fusion(candidates: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """One row per query and identity (chunk, else document), with the tool's boost added, ranked."""
    table = F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair))
    key = F.coalesce(F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")), F.concat(F.lit("document:"), F.col("document_id").cast("string")))
    score = F.round(F.col("score") + F.coalesce(F.try_element_at(table, "tool"), F.lit(0.0)), 6)
    best = candidates.select("query_id", key.alias("identity"), "tool", score.alias("score")).groupBy("query_id", "identity").agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "identity")))


def annotate_warnings(candidates: DataFrame, warnings: DataFrame) -> DataFrame:
    """Warning codes on candidates, and how many candidates of each query carry one."""
    codes = warnings.groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    marked = candidates.join(codes, "document_id", "left")
    return marked.withColumn("with_warnings", F.count("codes").over(Window.partitionBy("query_id")))


def repair_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("chunks"), F.sum("repairs").alias("repairs"), F.sum("downgrades").alias("downgrades"))


def local_script_repair(chunks: DataFrame, pattern: str) -> DataFrame:
    """Chunks that lack a script take the first neighbour's text that has it."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    has = F.col("text").rlike(pattern)
    source = F.coalesce(F.when(F.lag("text").over(order).rlike(pattern), F.lag("text").over(order)), F.when(F.lead("text").over(order).rlike(pattern), F.lead("text").over(order)))
    return chunks.withColumns({"_h": has, "_s": source}).select("document_id", "chunk_index", F.when(~F.col("_h"), F.col("_s")).alias("added"))


def empty_query_diagnostics(queries: DataFrame, candidates: DataFrame, reports: DataFrame, most: int = 5) -> DataFrame:
    """For queries without candidates, the first references of the documents they name that miss a script."""
    empty = queries.join(candidates.select("query_id").distinct(), "query_id", "left_anti")
    hits = empty.join(reports, "document_id", "left")
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("unit"))).filter(F.col("r") <= most)
    return ranked.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.col("unit").cast("string"))), ",").alias("references"), F.bool_and(F.col("unit").isNull()).alias("unknown_document"))


def warning_items(warnings: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Deduplicated warnings with a preview of their chunk, the first ``limit`` of each document, and the total."""
    one = warnings.groupBy("document_id", "code", "page").agg(F.min("chunk_index").alias("chunk_index"))
    shown = one.join(chunks.select("document_id", "chunk_index", F.substring("text", 1, 40).alias("preview")), ["document_id", "chunk_index"])
    w = Window.partitionBy("document_id")
    ranked = shown.withColumns({"place": F.row_number().over(w.orderBy("page", "code")), "total": F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col("place") <= limit).withColumn("truncated", F.col("total") > limit)
