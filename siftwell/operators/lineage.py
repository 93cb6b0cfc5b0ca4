"""From parser blocks over warnings to chunks: which decisions were made, what they rest on, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of content that a chunk keeps as it is.
MODAL = ["table", "image", "figure", "equation", "chart"]


def evidence_decisions(chunks: DataFrame, blocks: DataFrame, warnings: DataFrame, graph: DataFrame) -> DataFrame:
    """``document_id, decision_id, decision_type, status, input_block_ids, output_chunk_ids, warning_ids, limitation``.

    ``chunks (document_id, chunk_id, page_start, page_end, modality, quality_status)``, ``blocks (chunk_id, block_id)``,
    ``warnings (chunk_id, warning_id)``, ``graph (document_id, record_id, status, node_count, edge_count, created_at)``.

    A chunk over several pages is a ``page_stitch``, one of another kind than text a ``modal_route``, one with warnings (or
    the status ``warning``) a ``quality_warning``; a document's latest graph record is a ``chunk_materialization`` if it
    succeeded, else a ``quality_gate``. The ids of a chunk's blocks and warnings are gathered once and joined to the chunks
    once; the kinds come of one pass over that. A document's chunk ids are gathered for its graph decision only.
    """
    ids = lambda df, c: df.groupBy("chunk_id").agg(F.sort_array(F.collect_set(c)).alias(f"{c}s"))
    none = F.array().cast("array<string>")
    own = chunks.join(ids(blocks, "block_id"), "chunk_id", "left").join(ids(warnings, "warning_id"), "chunk_id", "left")
    own = own.withColumns({"block_ids": F.coalesce("block_ids", none), "warning_ids": F.coalesce("warning_ids", none)})
    warned = (F.size("warning_ids") > 0) | F.coalesce(F.col("quality_status") == "warning", F.lit(False))
    kind = lambda name, when, status, warnings_of: F.when(when, F.struct(F.lit(name).alias("type"), status.alias("status"), warnings_of.alias("warning_ids")))
    kinds = F.array_compact(F.array(
        kind("page_stitch", F.coalesce(F.col("page_start") != F.col("page_end"), F.lit(False)), F.lit("recorded"), none),
        kind("modal_route", F.coalesce(F.lower("modality").isin(MODAL), F.lit(False)), F.lit("recorded"), none),
        kind("quality_warning", warned, F.coalesce("quality_status", F.lit("recorded")), F.col("warning_ids")),
    ))
    of_chunks = own.select("document_id", "chunk_id", "block_ids", F.explode(kinds).alias("k")).select(
        "document_id", F.concat_ws("-", F.lit("decision"), F.replace(F.col("k.type"), F.lit("_"), F.lit("-")), "chunk_id").alias("decision_id"), F.col("k.type").alias("decision_type"), "k.status",
        F.col("block_ids").alias("input_block_ids"), F.array("chunk_id").alias("output_chunk_ids"), "k.warning_ids", F.lit(None).cast("string").alias("limitation"),
    )
    last = graph.groupBy("document_id").agg(F.max_by(F.struct("record_id", "status", "node_count", "edge_count"), F.struct("created_at", "record_id")).alias("g"))
    every = chunks.groupBy("document_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))
    done = F.col("g.status") == "succeeded"
    of_graph = last.join(every, "document_id", "left").select(
        "document_id", F.concat(F.lit("decision-graph-"), F.col("g.record_id")).alias("decision_id"), F.when(done, "chunk_materialization").otherwise("quality_gate").alias("decision_type"), F.col("g.status").alias("status"),
        none.alias("input_block_ids"), F.coalesce("chunk_ids", none).alias("output_chunk_ids"), none.alias("warning_ids"), F.when(~done, F.concat(F.lit("latest graph projection is "), F.col("g.status"))).alias("limitation"),
    )
    return of_chunks.unionByName(of_graph)


def evidence_gaps(documents: DataFrame, chunks: DataFrame, blocks: DataFrame, decisions: DataFrame, graph: DataFrame, most_chunks: int) -> DataFrame:
    """``document_id, kind, what``: sections that a document's evidence lacks, and limits of what it can show.

    One row for each absent one of chunks, parser blocks and decisions; limitations are no chunks, more chunks than the
    ``most_chunks`` that are shown, no graph record, or a latest one that has not succeeded. Documents that stand in none
    of the tables but ``documents`` have all of them: the counts are joined from the outside.
    """
    counted = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    with_blocks = chunks.select("document_id", "chunk_id").join(blocks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    last = graph.groupBy("document_id").agg(F.max_by("status", F.struct("created_at", "record_id")).alias("graph"))
    rows = documents.select("document_id").distinct()
    for table, name in ((chunks, "chunks"), (with_blocks, "blocks"), (decisions, "decisions")):
        rows = rows.join(counted(table, name), "document_id", "left")
    rows = rows.join(last, "document_id", "left").na.fill(0, ["chunks", "blocks", "decisions"])

    def row(when: Column, kind: str, what: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), what.alias("what")))

    found = F.array_compact(F.array(
        row(F.col("chunks") == 0, "missing_section", F.lit("chunks")), row(F.col("blocks") == 0, "missing_section", F.lit("parser_blocks")), row(F.col("decisions") == 0, "missing_section", F.lit("normalization_decisions")),
        row(F.col("chunks") == 0, "limitation", F.lit("no chunks have been materialized")), row(F.col("chunks") > most_chunks, "limitation", F.concat((F.col("chunks") - most_chunks).cast("string"), F.lit(" chunks are not shown"))),
        row(F.col("graph").isNull(), "limitation", F.lit("no graph projection record")), row(F.col("graph") != "succeeded", "limitation", F.concat(F.lit("latest graph projection is "), F.col("graph"))),
    ))
    return rows.select("document_id", F.explode(found).alias("f")).select("document_id", "f.kind", "f.what")
