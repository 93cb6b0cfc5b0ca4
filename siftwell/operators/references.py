"""Reference units of a document: which anchor each block belongs to, and the units that come of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import stripped

# Why a block has no reference.
BEFORE_REFERENCE, GAP, NOT_CARRIED = "unassigned_before_first_reference", "max_page_gap_exceeded", "carry_forward_disabled"


def assemble_reference_units(blocks: DataFrame, max_gap: int | None = None, carry_forward: bool = True) -> DataFrame:
    """``document_id, block_index, unit_block, reference, role, reason`` of each block that has a text or a warning.

    ``blocks (document_id, block_index, page_start, page_end, text, has_warning, reference, is_header)``: a block with a
    text and a ``reference`` is an anchor. A unit is named by the index of its anchor or, without a reference, of its first block.

    * Blocks after an anchor are its body, until the next anchor or the first block that begins more than ``max_gap`` pages
      after the end of the block before it (of those that show anything; unknown pages are near). That block stands alone.
    * Blocks with a text beyond it, and those before the first anchor, wait for the next anchor: a run of them, which a
      block with a warning only would cut, is attached to it if its last block is within the gap, else is a unit by itself.
    * After such an attachment the gap of the anchor's next block is measured from the run's last block, so whether a run
      waits at all can depend on whether the run before it was attached. Between two anchors that is a function of one
      truth value: constant, the same or its opposite. Constants and the parity of opposites since then give every value
      without folding the blocks one by one.
    * Without ``carry_forward`` each block that is no anchor stands alone, and closes its unit.

    Two windows by document and two by document and anchor: all of the blocks of a document are sorted in one task.
    """
    order = Window.partitionBy("document_id").orderBy("block_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    has_text = F.coalesce(stripped(F.col("text")) != "", F.lit(False))
    rows = blocks.select("document_id", "block_index", "page_start", "page_end", "reference", F.coalesce("is_header", F.lit(False)).alias("header"), has_text.alias("worded"), (has_text | F.coalesce("has_warning", F.lit(False))).alias("shown"))
    rows = rows.withColumn("anchor", F.col("worded") & F.col("reference").isNotNull())
    last = F.last(F.when(F.col("shown"), F.struct("block_index", "page_end", "worded", "anchor")), ignorenulls=True).over(before)
    rows = rows.withColumns({"u": F.sum(F.col("anchor").cast("int")).over(upto), "last": last})
    # The last anchor, with the block before it that shows anything.
    rows = rows.withColumn("own", F.last(F.when(F.col("anchor"), F.struct("block_index", "reference", "header", "page_start", "last")), ignorenulls=True).over(upto))
    unit = ["document_id", "u"]
    if not carry_forward:
        alone = rows.filter(F.col("shown") & ~F.col("anchor"))
        first = F.row_number().over(Window.partitionBy(*unit).orderBy("block_index")) == 1
        alone = alone.select("document_id", "block_index", F.col("block_index").alias("unit_block"), F.lit(None).cast("string").alias("reference"), F.lit("unassigned").alias("role"), F.when(first & (F.col("u") > 0), NOT_CARRIED).otherwise(BEFORE_REFERENCE).alias("reason"))
        return alone.unionByName(rows.filter("anchor").select("document_id", "block_index", F.col("block_index").alias("unit_block"), "reference", _header_role(F.col("header")).alias("role"), F.lit(None).cast("string").alias("reason")))

    far = lambda end, start: F.coalesce(start - end > max_gap, F.lit(False)) if max_gap is not None else F.lit(False)
    body = ~F.col("anchor") & (F.col("u") > 0)
    plain = body & far(F.col("last.page_end"), F.col("page_start"))
    after_run = F.when(F.col("last.block_index") == F.col("own.block_index"), body & far(F.col("own.last.page_end"), F.col("page_start"))).otherwise(plain)
    gaps = rows.withColumns({"gap0": F.when(plain, F.col("block_index")), "gap1": F.when(after_run, F.col("block_index"))})

    by_anchor = Window.partitionBy("document_id").orderBy("u")
    units = gaps.groupBy(*unit).agg(F.min("gap0").alias("gap0"), F.min("gap1").alias("gap1"), F.first("own").alias("own"))
    waits = F.col("own.last.worded") & ~F.col("own.last.anchor") & ~far(F.col("own.last.page_end"), F.col("own.page_start"))
    beyond = lambda gap: F.coalesce(waits & ((F.col("u") == 1) | (F.col("own.last.block_index") > F.lag(gap).over(by_anchor))), F.lit(False))
    units = units.withColumns({"if0": beyond("gap0"), "if1": beyond("gap1")})
    fixed = F.col("if0") == F.col("if1")
    units = units.withColumns({"since": F.sum(fixed.cast("int")).over(by_anchor), "start": F.last(F.when(fixed, F.col("if0")), ignorenulls=True).over(by_anchor)})
    flips = F.sum((F.col("if0") & ~F.col("if1")).cast("int")).over(Window.partitionBy("document_id", "since").orderBy("u"))
    units = units.withColumn("attached", F.col("start") != (flips % 2 == 1))
    units = units.select(*unit, F.when(F.col("attached"), F.col("gap1")).otherwise(F.col("gap0")).alias("gap"), "attached", F.lead("attached", 1, False).over(by_anchor).alias("hands_on"), F.lead("own").over(by_anchor).alias("next"))

    placed = rows.filter("shown").join(units, unit)
    at = F.col("block_index")
    closed = (F.col("u") == 0) | F.coalesce(at > F.col("gap"), F.lit(False))
    within = Window.partitionBy(*unit).orderBy("block_index")
    cut = (closed & ~F.col("worded")).cast("int")
    placed = placed.withColumns({"closed": closed, "cuts": F.sum(cut).over(within), "all_cuts": F.sum(cut).over(Window.partitionBy(*unit))})
    waiting = F.col("closed") & F.col("worded")
    goes_on = waiting & F.col("hands_on") & (F.col("cuts") == F.col("all_cuts"))
    run = Window.partitionBy(*unit, "cuts", "waiting").orderBy("block_index")
    placed = placed.withColumns({"waiting": waiting, "goes_on": goes_on})
    placed = placed.withColumn("first_of_run", F.first("block_index").over(run))
    is_body = ~F.col("anchor") & ~F.col("closed") & (F.col("gap").isNull() | (at < F.col("gap")))
    has_body = F.col("attached") | ~F.col("own.header") | (F.sum((is_body & F.col("worded")).cast("int")).over(within) > 1)
    following = lambda some: F.when(some, "reference_continuation").otherwise("reference_body")
    return placed.select(
        "document_id", "block_index",
        F.when(F.col("anchor") | is_body, F.col("own.block_index")).when(F.col("goes_on"), F.col("next.block_index")).when(F.col("waiting"), F.col("first_of_run")).otherwise(at).alias("unit_block"),
        F.when(F.col("anchor") | is_body, F.col("own.reference")).when(F.col("goes_on"), F.col("next.reference")).alias("reference"),
        F.when(F.col("anchor"), _header_role(F.col("header"))).when(is_body, F.when(F.col("worded"), following(has_body)).otherwise("parser_warning"))
        .when(F.col("goes_on"), following(at > F.col("first_of_run"))).otherwise("unassigned").alias("role"),
        F.when(F.col("anchor") | is_body | F.col("goes_on"), None).when(at == F.col("gap"), GAP).otherwise(BEFORE_REFERENCE).alias("reason"),
    )


def _header_role(header: Column) -> Column:
    return F.when(header, "reference_header").otherwise("reference_body")


def reference_unit_rows(assembled: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each unit of :func:`assemble_reference_units`: its blocks (the anchor's first), pages, text, kind and reason."""
    own = blocks.select("document_id", "block_index", "page_start", "page_end", stripped(F.coalesce("text", F.lit(""))).alias("text"))
    both = assembled.join(own, ["document_id", "block_index"])
    said = F.when(F.col("role").isin("reference_body", "reference_continuation", "unassigned") & (F.col("text") != ""), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct((F.col("block_index") != F.col("unit_block")).alias("later"), "block_index", said.alias("text"))))
    pages = F.array("page_start", "page_end")
    return both.groupBy("document_id", "unit_block").agg(
        F.max("reference").alias("reference"), F.max("reason").alias("reason"), F.count(F.lit(1)).alias("blocks"), F.min(F.array_min(pages)).alias("page_start"), F.max(F.array_max(pages)).alias("page_end"),
        F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n").alias("text"), F.bool_or(F.col("role") == "parser_warning").alias("has_warning"),
    ).withColumn("kind", F.when(F.col("reference").isNull(), "provenance").when(F.col("text") == "", "header_only").otherwise("reference"))
