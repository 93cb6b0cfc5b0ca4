"""Order within documents, sets and top-k: windows over document keys, with every order ending in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def stitch(chunks: DataFrame) -> DataFrame:
    """Join a part to the one before if that ends without terminal punctuation and this begins in lower case; a hyphen
    at the seam goes, and hyphens anywhere else stay."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    before = F.lag("text").over(order)
    joins = before.isNotNull() & ~F.coalesce(before.rlike(r"[.!?:;]$"), F.lit(True)) & F.col("text").rlike("^[a-z]")
    runs = chunks.withColumns({"part": F.sum((~joins).cast("int")).over(order), "joins": joins, "broken": before.rlike("[a-z]-$")})
    runs = runs.withColumn("ends", F.lead("joins").over(order) & F.col("text").rlike("[a-z]-$"))
    own = F.when(F.coalesce("ends", F.lit(False)), F.regexp_replace("text", "-$", "")).otherwise(F.col("text"))
    seam = F.when(~F.col("joins") | F.coalesce("broken", F.lit(False)), "").otherwise(" ")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", F.concat(seam, own).alias("text")))), lambda c: c["text"])
    return runs.groupBy("document_id", "part").agg(F.min("chunk_index").alias("chunk_index"), F.count(F.lit(1)).alias("parts"), F.array_join(ordered, "").alias("text")).drop("part")


def carry_forward(blocks: DataFrame, is_anchor: Column, most_gap: int, position: str = "page") -> DataFrame:
    """Blocks belong to the last anchor until the next one, or until the first gap of more than ``most_gap`` pages;
    beyond, and before the first anchor, they have no unit (``unit`` is null)."""
    order = Window.partitionBy("document_id").orderBy("block_index")
    rows = blocks.withColumns({"_a": is_anchor, "_gap": F.col(position) - F.lag(position).over(order) > most_gap})
    rows = rows.withColumn("_u", F.sum(F.col("_a").cast("int")).over(order))
    unit = Window.partitionBy("document_id", "_u")
    closed = F.min(F.when(F.coalesce("_gap", F.lit(False)) & ~F.col("_a"), F.col("block_index"))).over(unit)
    rows = rows.withColumn("_c", closed)
    inside = (F.col("_u") > 0) & (F.col("_c").isNull() | (F.col("block_index") < F.col("_c")))
    return rows.withColumn("unit", F.when(inside, F.col("_u"))).drop("_a", "_gap", "_u", "_c")


def finish_units(carried: DataFrame) -> DataFrame:
    """Size, pages and kind of each unit."""
    return carried.filter("unit is not null").groupBy("document_id", "unit").agg(
        F.count(F.lit(1)).alias("blocks"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.when(F.count(F.lit(1)) == 1, "header_only").otherwise("body").alias("status"),
    )


def reading_order(boxes: DataFrame, width: float = 1000.0, full: float = 0.7, gap: float = 0.05) -> DataFrame:
    """Order of boxes on a page: full-width ones cut bands; inside a band columns by gaps in x, left to right, then down."""
    page = Window.partitionBy("page_id")
    middle = (F.col("y0") + F.col("y1")) / 2
    rows = boxes.withColumns({"wide": F.col("x1") - F.col("x0") >= full * width, "mid": middle})
    by_y = page.orderBy("mid", "block")
    rows = rows.withColumn("band", F.sum(F.col("wide").cast("int")).over(by_y))
    band = Window.partitionBy("page_id", "band", "wide").orderBy("x0", "x1", "block")
    edge = F.max("x1").over(band.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("starts", F.coalesce((F.col("x0") - edge > gap * width).cast("int"), F.lit(0)))
    rows = rows.withColumn("column", F.sum("starts").over(band))
    order = page.orderBy("band", F.desc("wide"), "column", "y0", "x0", "block")
    return rows.select("page_id", "block", F.row_number().over(order).alias("place"))


def inherit_context(matches: DataFrame) -> DataFrame:
    """Anchors without a context take that of the last anchor that has one."""
    order = Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return matches.withColumn("context", F.last("context", ignorenulls=True).over(order))


def anchor_windows(blocks: DataFrame, is_anchor: Column) -> DataFrame:
    """The anchors before and after each block that is none."""
    back = Window.partitionBy("document_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("document_id").orderBy("block_index").rowsBetween(1, Window.unboundedFollowing)
    here = F.when(is_anchor, F.col("block_index"))
    rows = blocks.withColumns({"_a": is_anchor, "previous": F.last(here, ignorenulls=True).over(back), "next": F.first(here, ignorenulls=True).over(ahead)})
    return rows.filter(~F.col("_a")).select("document_id", "block_index", "previous", "next")


def neighbour_refs(refs: DataFrame, key: list[str], unit: str) -> DataFrame:
    """References one unit before and after, if above 0, and the observed neighbours."""
    order = Window.partitionBy(*key).orderBy(unit)
    return refs.withColumns({
        "previous_ref": F.when(F.col(unit) > 1, F.col(unit) - 1), "next_ref": F.col(unit) + 1, "observed_previous": F.lag(unit).over(order), "observed_next": F.lead(unit).over(order),
    })


def page_of(df: DataFrame, key: str, order: list, offset: int, limit: int) -> DataFrame:
    """A page of each key's rows, newest first, with the total and whether there is more."""
    w = Window.partitionBy(key)
    rows = df.withColumns({"place": F.row_number().over(w.orderBy(*order)), "total": F.count(F.lit(1)).over(w)})
    return rows.filter((F.col("place") > offset) & (F.col("place") <= offset + limit)).withColumn("has_more", F.col("total") > offset + limit)


def capped_graph(edges: DataFrame, key: str, most: int) -> DataFrame:
    """Edges of each graph whose ends are both among its first nodes, and whether the graph was cut."""
    nodes = edges.select(key, F.col("source").alias("id")).unionByName(edges.select(key, F.col("target").alias("id"))).distinct()
    w = Window.partitionBy(key)
    ranked = nodes.withColumns({"r": F.row_number().over(w.orderBy("id")), "n": F.count(F.lit(1)).over(w)}).filter(F.col("r") <= most)
    kept = edges.join(ranked.select(key, F.col("id").alias("source"), (F.col("n") > most).alias("truncated")), [key, "source"])
    return kept.join(ranked.select(key, F.col("id").alias("target")), [key, "target"], "left_semi")


def filtered_graph(edges: DataFrame, nodes: DataFrame, edge_type: str) -> DataFrame:
    """Edges of a type with both ends among the visible nodes."""
    ids = nodes.select("id")
    return edges.filter(F.col("type") == edge_type).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def union_first_wins(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; of rows with one key those of ``first``."""
    return first.unionByName(second.join(first.select(*key), key, "left_anti"), allowMissingColumns=True)
