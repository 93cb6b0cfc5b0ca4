"""Layout: relations of chunks on pages, captions and what they belong to, the direction in which a page is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relations without a contract, kinds by token, and what each relation adds to a score.
DEFAULT_RELATIONS = ["same_page", "same_reference", "layout_group", "reading_order"]
RELATIONS = [*DEFAULT_RELATIONS, "bbox_overlap", "table_caption", "figure_caption", "equation"]
PROXIMITY, OVERLAP = 150.0, 0.0
FAMILIES = {"table": ["table", "table_cell", "table_row", "table_header"], "figure": ["figure", "image", "picture"], "equation": ["equation", "formula"], "caption": ["caption"]}
BASE, BASE_BOOST = 9.0, 1.5
POINTS = {"near": 1.0, "bbox_overlap": 1.0, "layout_group": 2.0, "reading_order": 1.0, "table_caption": 2.0, "figure_caption": 2.0, "equation": 2.0}
REASONS = {"near": "spatial_proximity", "bbox_overlap": "bbox_overlap", "layout_group": "layout_group", "reading_order": "reading_order_neighbor", "table_caption": "table_caption", "figure_caption": "figure_caption", "equation": "equation"}
#: Height of the bands that boxes are looked up by.
BAND = 150


def layout_tokens(*values: Column) -> Column:
    """Different lower-case words of type and role columns, ``table_cell`` as itself and as its parts."""
    words = F.flatten(F.transform(F.array_compact(F.array(*values)), lambda v: F.split(F.translate(F.lower(v), "-/", "_ "), r"\s+")))
    return F.array_distinct(F.filter(F.concat(words, F.flatten(F.transform(words, lambda w: F.split(w, "_")))), lambda w: w != ""))


def in_family(tokens: Column, family: str) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, FAMILIES[family])))


def assign_captions(chunks: DataFrame) -> DataFrame:
    """``document_id, chunk_index, target, family, distance``: the table or figure next to each caption on its page.

    ``chunks (document_id, page, chunk_index, tokens, y0, y1)``. An as-of join from both sides: on the page's boxes sorted
    by their middle, the last table or figure above and the first one below are carried to each caption, and the nearer
    one counts (the upper, if both are as near). Captions of a page without either have no row.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    family = F.when(in_family(F.col("tokens"), "caption"), None).when(in_family(F.col("tokens"), "table"), "table").when(in_family(F.col("tokens"), "figure"), "figure")
    rows = chunks.select("document_id", "page", "chunk_index", in_family(F.col("tokens"), "caption").alias("caption"), middle.alias("mid"), family.alias("family")).filter("page is not null and mid is not null and (caption or family is not null)")
    body = F.when(F.col("family").isNotNull(), F.struct("mid", "chunk_index", "family"))
    order = Window.partitionBy("document_id", "page").orderBy("mid", "chunk_index")
    sides = rows.withColumns({
        "up": F.last(body, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "down": F.first(body, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
    }).filter("caption")
    nearer = F.when(F.col("up").isNull() | (F.col("down.mid") - F.col("mid") < F.col("mid") - F.col("up.mid")), F.col("down")).otherwise(F.col("up"))
    found = sides.withColumn("body", nearer).filter("body is not null")
    return found.select("document_id", "chunk_index", F.col("body.chunk_index").alias("target"), "body.family", F.abs(F.col("mid") - F.col("body.mid")).alias("distance"))


def with_caption_groups(chunks: DataFrame) -> DataFrame:
    """``chunks`` with a group ``near-<target>`` more in ``groups`` of each caption and of the table or figure it is next to."""
    pairs = assign_captions(chunks)
    name = F.concat(F.lit("near-"), F.col("target").cast("string"))
    both = pairs.select("document_id", "chunk_index", name.alias("g")).unionByName(pairs.select("document_id", F.col("target").alias("chunk_index"), name.alias("g")).distinct())
    more = both.groupBy("document_id", "chunk_index").agg(F.collect_set("g").alias("_more"))
    joined = chunks.join(more, ["document_id", "chunk_index"], "left")
    return joined.withColumn("groups", F.array_union(F.coalesce("groups", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


def layout_relations(seeds: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The chunks that are related to any seed of a query by layout: a flag for each relation, reasons, scores and the place.

    ``seeds (query_id, document_id, chunk_index, contract)``: ``contract`` (``struct<relationships: array<string>,
    vertical_proximity: double, horizontal_overlap_min: double>``) is null where none is verified; a query uses the
    relations of all its contracts, the largest proximity and the smallest overlap. ``chunks (document_id, chunk_index,
    page, reference, groups, reading_order, tokens, x0, y0, x1, y1, blocked)``; the first of ``groups`` is the layout group.

    Chunks are looked for in the documents of the query's seeds. Each relation is a join on its own key (page, reference,
    group, reading order, page and band of boxes), with the keys of a query's seeds made different first, and a query's
    chunk is one row of flags after a partial aggregate, so no two chunks are compared outside a key.
    """
    own = seeds.join(chunks, ["document_id", "chunk_index"])
    scope = seeds.select("query_id", "document_id").distinct()
    known = F.col("contract").isNotNull()
    kinds = F.when(F.size(F.coalesce("contract.relationships", F.array().cast("array<string>"))) > 0, F.col("contract.relationships")).otherwise(F.array(*map(F.lit, DEFAULT_RELATIONS)))
    policy = own.groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.collect_set(F.when(known, kinds)))).alias("relations"), F.max(F.when(known, F.coalesce("contract.vertical_proximity", F.lit(PROXIMITY)))).alias("proximity"),
        F.min(F.when(known, F.coalesce("contract.horizontal_overlap_min", F.lit(OVERLAP)))).alias("overlap"),
    )
    policy = policy.select("query_id", F.when(F.size("relations") > 0, F.col("relations")).otherwise(F.array(*map(F.lit, DEFAULT_RELATIONS))).alias("relations"), F.coalesce("proximity", F.lit(PROXIMITY)).alias("proximity"), F.coalesce("overlap", F.lit(OVERLAP)).alias("overlap"))
    free = chunks.filter(~F.coalesce("blocked", F.lit(False)))
    ids = ["query_id", "document_id", "chunk_index"]

    def keyed(column: str, name: str) -> DataFrame:
        keys = own.select("query_id", column).filter(F.col(column).isNotNull()).distinct().join(scope, "query_id")
        return keys.join(free.select("document_id", "chunk_index", column), ["document_id", column]).select(*ids, F.lit(name).alias("flag"))

    own = own.withColumn("layout_group", F.get("groups", F.lit(0)))
    free = free.withColumn("layout_group", F.get("groups", F.lit(0)))
    found = [keyed("page", "same_page"), keyed("reference", "same_reference"), keyed("layout_group", "layout_group")]
    steps = own.select("query_id", "document_id", F.explode(F.array(F.col("reading_order") - 1, F.col("reading_order") + 1)).alias("reading_order")).distinct()
    found.append(steps.join(free.select("document_id", "chunk_index", "reading_order"), ["document_id", "reading_order"]).select(*ids, F.lit("reading_order").alias("flag")))

    middle = (F.col("y0") + F.col("y1")) / 2
    boxed = lambda df: df.filter("page is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    mine = boxed(own).join(policy, "query_id").select("query_id", "page", middle.alias("sy"), F.col("x0").alias("s0"), F.col("x1").alias("s1"), "proximity", "overlap").distinct()
    bands = F.sequence(F.floor((F.col("sy") - F.col("proximity")) / BAND), F.floor((F.col("sy") + F.col("proximity")) / BAND))
    mine = mine.withColumn("band", F.explode(bands)).join(scope, "query_id")
    theirs = boxed(free).select("document_id", "chunk_index", "page", middle.alias("cy"), F.col("x0").alias("c0"), F.col("x1").alias("c1"), F.floor(middle / BAND).alias("band"))
    near = mine.join(theirs, ["document_id", "page", "band"]).filter(F.abs(F.col("sy") - F.col("cy")) <= F.col("proximity"))
    shared = F.greatest(F.lit(0.0), F.least("s1", "c1") - F.greatest("s0", "c0")) / F.greatest(F.lit(1.0), F.least(F.col("s1") - F.col("s0"), F.col("c1") - F.col("c0")))
    found.append(near.select(*ids, F.explode(F.when(shared >= F.col("overlap"), F.array(F.lit("near"), F.lit("bbox_overlap"))).otherwise(F.array(F.lit("near")))).alias("flag")))

    kinds_of = {f"is_{f}": in_family(F.col("tokens"), f) for f in FAMILIES}
    grouped = own.withColumns(kinds_of).withColumn("group", F.explode("groups")).groupBy("query_id", "group").agg(*(F.bool_or(f"is_{f}").alias(f"seed_{f}") for f in FAMILIES))
    partners = free.withColumns(kinds_of).select("document_id", "chunk_index", F.explode("groups").alias("group"), *kinds_of)
    pairs = grouped.join(scope, "query_id").join(partners, ["document_id", "group"])
    caption = lambda f: (F.col("seed_caption") & F.col(f"is_{f}")) | (F.col("is_caption") & F.col(f"seed_{f}"))
    flags = F.array_compact(F.array(F.when(caption("table"), F.lit("table_caption")), F.when(caption("figure"), F.lit("figure_caption")), F.when(F.col("seed_equation") | F.col("is_equation"), F.lit("equation"))))
    found.append(pairs.select(*ids, F.explode(flags).alias("flag")))

    every = found[0]
    for some in found[1:]:
        every = every.unionByName(some)
    rows = every.groupBy(*ids).agg(*(F.bool_or(F.col("flag") == f).alias(f) for f in [*RELATIONS, "near"])).join(policy.select("query_id", "relations"), "query_id")
    rows = rows.withColumns({r: F.col(r) & F.array_contains("relations", r) for r in RELATIONS})
    rows = rows.withColumn("near", F.col("near") & F.col("same_page")).filter(F.exists(F.array(*RELATIONS), lambda x: x))
    rows = rows.join(seeds.select(*ids).distinct(), ids, "left_anti")
    boost = F.lit(0.0)
    for flag, points in POINTS.items():
        boost = boost + F.when(F.col(flag), points).otherwise(0.0)
    reasons = F.array_compact(F.array(F.lit("layout_neighbor"), *(F.when(F.col(f), F.lit(name)) for f, name in REASONS.items())))
    order = Window.partitionBy("query_id").orderBy("document_id", "chunk_index")
    placed = rows.select(*ids, *RELATIONS, reasons.alias("reasons"), (BASE_BOOST + boost).alias("boost_score"), (BASE + BASE_BOOST + boost).alias("final_score"), F.row_number().over(order).alias("place"))
    return placed.filter(F.col("place") <= max(limit, 1))

# A block this wide cuts a page into bands; a gap this wide cuts a band into columns.
FULL_WIDTH, COLUMN_GAP = 0.7, 0.05
RIGHT_TO_LEFT = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}]"


def page_directions(blocks: DataFrame) -> DataFrame:
    """``document_id, page, rtl``: a vote of the letters of each page's texts; a page without letters reads left to right."""
    own, letters = F.regexp_count("text", F.lit(RIGHT_TO_LEFT)), F.regexp_count("text", F.lit(r"\p{L}"))
    sums = blocks.groupBy("document_id", "page").agg(F.coalesce(F.sum(own), F.lit(0)).alias("a"), F.coalesce(F.sum(letters), F.lit(0)).alias("n"))
    return sums.select("document_id", "page", (2 * F.col("a") > F.col("n")).alias("rtl"))


def document_order(blocks: DataFrame) -> DataFrame:
    """``document_id, block_index, place, rtl``: the order in which the blocks of a document are read, from 1.

    ``blocks (document_id, page, block_index, x0, y0, x1, y1, text)``. Pages follow each other, blocks without a page last.
    A page on which any block has no box keeps its input order. Else blocks of 70 % of the page's width or more cut it into
    bands, a gap of more than 5 % of the width between the blocks of a band cuts it into columns, and columns are read from
    the side where the page's script begins, each from top to bottom; with fewer than two narrow blocks all are read from
    top to bottom. Four windows by page; what cuts is a running count, so a page is sorted in one task and never a document.
    """
    page = Window.partitionBy("document_id", "page")
    boxed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    rows = blocks.join(page_directions(blocks).withColumnRenamed("page", "_page").withColumnRenamed("document_id", "_doc"), (F.col("document_id") == F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page"))).drop("_page", "_doc")
    rows = rows.withColumns({"kept": ~F.min(boxed).over(page), "width": F.greatest(F.lit(1.0), F.max("x1").over(page), F.max(F.col("x1") - F.col("x0")).over(page))})
    rows = rows.withColumn("wide", F.coalesce(F.col("x1") - F.col("x0") >= FULL_WIDTH * F.col("width"), F.lit(False)))
    rows = rows.withColumn("plain", F.col("kept") | (F.count_if(~F.col("wide")).over(page) < 2))
    # Blocks without a page are ordered by their index wherever a height would order them.
    down = F.when(F.col("page").isNull(), F.col("block_index").cast("double")).otherwise(F.col("y0"))
    rows = rows.withColumns({"down": down, "across": F.when(F.col("page").isNull(), 0.0).otherwise(F.col("x0"))})
    # A separator opens a band below it; a block is in the band of the separators that begin above its middle.
    at = F.when(F.col("wide"), F.col("y0")).otherwise((F.col("y0") + F.col("y1")) / 2)
    above = F.sum(F.col("wide").cast("int")).over(page.orderBy(at, F.desc("wide")).rangeBetween(Window.unboundedPreceding, 0))
    rank = F.row_number().over(page.orderBy(F.desc("wide"), "down", "across", "block_index"))
    rows = rows.withColumns({"at": at, "band": F.when(F.col("wide"), rank).otherwise(above)})
    column = Window.partitionBy("document_id", "page", "wide", "band").orderBy("x0", "block_index")
    edge = F.max("x1").over(column.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("starts", F.coalesce((F.col("x0") - edge > COLUMN_GAP * F.col("width")).cast("int"), F.lit(0)))
    rows = rows.withColumn("column", F.sum("starts").over(column))
    side = F.when(F.col("rtl"), -F.col("column")).otherwise(F.col("column"))
    free = lambda c, other=None: F.when(F.col("plain"), other).otherwise(c)
    keys = [
        free(F.col("band")), free((~F.col("wide")).cast("int")), free(side), F.when(F.col("kept"), F.col("block_index").cast("double")).otherwise(F.col("down")), F.when(F.col("kept"), 0.0).otherwise(F.col("across")), F.col("block_index"),
    ]
    within = F.row_number().over(page.orderBy(*keys))
    before = blocks.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("document_id").orderBy(F.asc_nulls_last("page")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("within", within).select("document_id", "page", "block_index", "within", "rtl")
    starts = before.select(F.col("document_id").alias("_doc"), F.col("page").alias("_page"), "before")
    out = placed.join(starts, (F.col("document_id") == F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page")))
    return out.select("document_id", "block_index", (F.col("before") + F.col("within")).cast("int").alias("place"), "rtl")
