"""Queries of page layout over blocks of the given pages, with boxes that follow from a block's place."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import layout as Y
from siftwell.plans.inputs import BLOCKS, blocks

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


#: Every seventh place of a page is laid out alike: a table, its caption, a figure, a caption below it, an equation.
LAID_OUT = BLOCKS + """, laid AS (SELECT document_id, block_index AS chunk_index, block_index // 6 AS page, CASE WHEN text LIKE '%tion%' THEN 'tion:' || block_index // 9 END AS reference, CASE WHEN block_index % 5 <> 4 THEN ['g' || (block_index // 4)] ELSE []::VARCHAR[] END AS own_groups,
  CASE WHEN block_index % 11 <> 0 THEN block_index END AS reading_order, CASE block_index % 7 WHEN 1 THEN 'Table-Cell' WHEN 2 THEN 'caption' WHEN 4 THEN 'body/image' WHEN 5 THEN 'caption' WHEN 6 THEN 'formula' ELSE 'text' END AS kind,
  ((block_index % 2) * 400 + block_index * 37 % 90)::DOUBLE AS x0, ((block_index % 2) * 400 + block_index * 37 % 90 + 200)::DOUBLE AS x1, CASE WHEN block_index % 13 <> 12 THEN (block_index % 6 * 90)::DOUBLE END AS y0, (block_index % 6 * 90 + 40)::DOUBLE AS y1, length(text) < 4 AS blocked, text FROM blocks),
bodies AS (SELECT document_id, page, chunk_index, (y0 + y1) / 2 AS mid, CASE kind WHEN 'Table-Cell' THEN 'table' ELSE 'figure' END AS family FROM laid WHERE kind IN ('Table-Cell', 'body/image') AND y0 IS NOT NULL),
near_bodies AS (SELECT c.document_id, c.chunk_index, b.chunk_index AS target, family, abs((c.y0 + c.y1) / 2 - mid) AS distance, row_number() OVER (PARTITION BY c.document_id, c.chunk_index ORDER BY abs((c.y0 + c.y1) / 2 - mid), (mid, b.chunk_index) > ((c.y0 + c.y1) / 2, c.chunk_index)) AS r
  FROM laid c JOIN bodies b ON b.document_id = c.document_id AND b.page = c.page WHERE c.kind = 'caption' AND c.y0 IS NOT NULL),
captions AS (SELECT document_id, chunk_index, target, family, distance FROM near_bodies WHERE r = 1)"""


def laid_out(spark, d):
    b, i = blocks(spark, d), F.col("block_index")
    kind = F.when(i % 7 == 1, "Table-Cell").when(i % 7 == 2, "caption").when(i % 7 == 4, "body/image").when(i % 7 == 5, "caption").when(i % 7 == 6, "formula").otherwise("text")
    x0 = ((i % 2) * 400 + i * 37 % 90).cast("double")
    return b.select(
        "document_id", i.alias("chunk_index"), F.floor(i / 6).alias("page"), F.when(F.contains("text", F.lit("tion")), F.concat(F.lit("tion:"), F.floor(i / 9).cast("string"))).alias("reference"),
        F.when(i % 5 != 4, F.array(F.concat(F.lit("g"), F.floor(i / 4).cast("string")))).otherwise(F.array().cast("array<string>")).alias("groups"), F.when(i % 11 != 0, i).alias("reading_order"), Y.layout_tokens(F.lit(None).cast("string"), kind).alias("tokens"),
        x0.alias("x0"), (x0 + 200).alias("x1"), F.when(i % 13 != 12, (i % 6 * 90).cast("double")).alias("y0"), (i % 6 * 90 + 40).cast("double").alias("y1"), (F.char_length("text") < 4).alias("blocked"), "text",
    )


@query("j10_assign_captions", f"WITH {LAID_OUT} SELECT * FROM captions")
def j10_captions(spark, d):
    return Y.assign_captions(laid_out(spark, d))


_CONTRACTS = [("ou", ["same_page", "bbox_overlap", "table_caption", "figure_caption"], 120.0, 0.5), ("en", ["layout_group", "equation", "reading_order", "same_reference", "table_caption"], 200.0, 0.25)]


@query("j10_layout_relations", f"""WITH {LAID_OUT}, chunked AS (SELECT l.*, list_distinct(list_concat(own_groups, list_concat(coalesce(a, []), coalesce(b, [])))) AS groups FROM laid l LEFT JOIN (SELECT document_id, chunk_index, ['near-' || target] AS a FROM captions) USING (document_id, chunk_index)
  LEFT JOIN (SELECT DISTINCT document_id, target AS chunk_index, ['near-' || target] AS b FROM captions) USING (document_id, chunk_index)),
rows AS (SELECT *, kind = 'caption' AS cap, kind = 'Table-Cell' AS tab, kind = 'body/image' AS fig, kind = 'formula' AS eq, own_groups[1] AS og, list_filter(groups, lambda g: g <> coalesce(own_groups[1], ''))[1] AS ng FROM chunked),
seeds AS (SELECT document_id // 2 AS query_id, *, CASE WHEN text LIKE '%ou%' THEN 0 WHEN text LIKE '%en%' THEN 1 END AS contract FROM rows WHERE text LIKE '%tion%' AND chunk_index % 3 < 2),
policy AS (SELECT query_id, CASE WHEN count(contract) = 0 THEN ['same_page', 'same_reference', 'layout_group', 'reading_order'] ELSE list_distinct(flatten(list(CASE contract WHEN 0 THEN {_CONTRACTS[0][1]} WHEN 1 THEN {_CONTRACTS[1][1]} ELSE [] END))) END AS rel,
  coalesce(max(CASE contract WHEN 0 THEN 120.0 WHEN 1 THEN 200.0 END), 150.0) AS prox, coalesce(min(CASE contract WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 END), 0.0) AS ov FROM seeds GROUP BY 1),
pairs AS (SELECT s.query_id, c.document_id, c.chunk_index, s.page = c.page AS pg, s.reference = c.reference AS ref, coalesce(s.og, s.ng) = coalesce(c.og, c.ng) AS grp, s.document_id = c.document_id AND abs(s.reading_order - c.reading_order) = 1 AS ord,
    s.page = c.page AND abs((s.y0 + s.y1) / 2 - (c.y0 + c.y1) / 2) <= prox AS close, greatest(0.0, least(s.x1, c.x1) - greatest(s.x0, c.x0)) / greatest(1.0, least(s.x1 - s.x0, c.x1 - c.x0)) >= ov AS beside, len(list_intersect(s.groups, c.groups)) > 0 AS share,
    s.cap AND c.tab OR c.cap AND s.tab AS tc, s.cap AND c.fig OR c.cap AND s.fig AS fc, s.eq OR c.eq AS e, rel FROM seeds s JOIN policy USING (query_id) JOIN (SELECT DISTINCT query_id, document_id FROM seeds) q ON q.query_id = s.query_id JOIN rows c ON c.document_id = q.document_id WHERE NOT c.blocked),
flags AS (SELECT query_id, document_id, chunk_index, any_value(rel) AS rel, coalesce(bool_or(pg), false) AS pg, coalesce(bool_or(ref), false) AS ref, coalesce(bool_or(grp), false) AS grp, coalesce(bool_or(ord), false) AS ord, coalesce(bool_or(close), false) AS close, coalesce(bool_or(close AND beside), false) AS box,
  bool_or(share AND tc) AS tc, bool_or(share AND fc) AS fc, bool_or(share AND e) AS e FROM pairs GROUP BY 1, 2, 3),
kept AS (SELECT query_id, document_id, chunk_index, pg AND list_contains(rel, 'same_page') AS same_page, ref AND list_contains(rel, 'same_reference') AS same_reference, grp AND list_contains(rel, 'layout_group') AS layout_group, ord AND list_contains(rel, 'reading_order') AS reading_order,
  box AND list_contains(rel, 'bbox_overlap') AS bbox_overlap, tc AND list_contains(rel, 'table_caption') AS table_caption, fc AND list_contains(rel, 'figure_caption') AS figure_caption, e AND list_contains(rel, 'equation') AS equation, close AND pg AND list_contains(rel, 'same_page') AS near
  FROM flags WHERE (query_id, document_id, chunk_index) NOT IN (SELECT query_id, document_id, chunk_index FROM seeds)),
scored AS (SELECT *, near::INT + bbox_overlap::INT + 2 * layout_group::INT + reading_order::INT + 2 * table_caption::INT + 2 * figure_caption::INT + 2 * equation::INT AS points FROM kept WHERE same_page OR same_reference OR layout_group OR reading_order OR bbox_overlap OR table_caption OR figure_caption OR equation)
SELECT query_id, document_id, chunk_index, same_page, same_reference, layout_group, reading_order, bbox_overlap, table_caption, figure_caption, equation,
  concat_ws(',', 'layout_neighbor', CASE WHEN near THEN 'spatial_proximity' END, CASE WHEN bbox_overlap THEN 'bbox_overlap' END, CASE WHEN layout_group THEN 'layout_group' END, CASE WHEN reading_order THEN 'reading_order_neighbor' END, CASE WHEN table_caption THEN 'table_caption' END,
    CASE WHEN figure_caption THEN 'figure_caption' END, CASE WHEN equation THEN 'equation' END) AS reasons, 1.5 + points::DOUBLE AS boost_score, 10.5 + points::DOUBLE AS final_score, place::INT AS place
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index) AS place FROM scored) WHERE place <= 40""")
def j10_relations(spark, d):
    chunks = Y.with_caption_groups(laid_out(spark, d))
    contract = F.lit(None)
    for word, relations, proximity, overlap in reversed(_CONTRACTS):
        own = F.struct(F.array(*map(F.lit, relations)).alias("relationships"), F.lit(proximity).alias("vertical_proximity"), F.lit(overlap).alias("horizontal_overlap_min"))
        contract = F.when(F.contains("text", F.lit(word)), own).otherwise(contract)
    seeds = laid_out(spark, d).filter(F.contains("text", F.lit("tion")) & (F.col("chunk_index") % 3 < 2)).select(F.floor(F.col("document_id") / 2).alias("query_id"), "document_id", "chunk_index", contract.alias("contract"))
    return Y.layout_relations(seeds, chunks, 40).withColumn("reasons", F.array_join("reasons", ","))


#: Boxes in up to three columns with separators; the words of every third page stand in right-to-left letters.
_READ = BLOCKS + """, rb AS (SELECT document_id, (block_index // 12)::INT AS page, block_index, CASE WHEN block_index % 8 = 3 THEN 0.0 ELSE (block_index % 3 * 330)::DOUBLE END AS x0, (block_index % 12 // 3 * 60 + block_index * 7 % 11)::DOUBLE AS y0,
  CASE WHEN block_index % 8 = 3 THEN 900.0 ELSE (block_index % 3 * 330 + 200 + block_index % 4 * 30)::DOUBLE END AS x1, CASE WHEN document_id % 17 = 16 AND block_index % 12 = 5 THEN NULL ELSE (block_index % 12 // 3 * 60 + block_index * 7 % 11 + 40)::DOUBLE END AS y1,
  CASE WHEN (document_id + block_index // 12) % 3 = 0 THEN translate(lower(text), 'etaoinsrhl', 'ابتثجحخدذر') ELSE text END AS text FROM blocks)"""


def _read(spark, d):
    b, i = blocks(spark, d), F.col("block_index")
    y = (F.floor(i % 12 / 3) * 60 + i * 7 % 11).cast("double")
    text = F.when((F.col("document_id") + F.floor(i / 12)) % 3 == 0, F.translate(F.lower("text"), "etaoinsrhl", "ابتثجحخدذر")).otherwise(F.col("text"))
    return b.select(
        "document_id", F.floor(i / 12).cast("int").alias("page"), "block_index", F.when(i % 8 == 3, 0.0).otherwise((i % 3 * 330).cast("double")).alias("x0"), y.alias("y0"),
        F.when(i % 8 == 3, 900.0).otherwise((i % 3 * 330 + 200 + i % 4 * 30).cast("double")).alias("x1"), F.when(~((F.col("document_id") % 17 == 16) & (i % 12 == 5)), y + 40).alias("y1"), text.alias("text"),
    )


@query("w5_document_order", f"""WITH {_READ}, votes AS (SELECT document_id, page, 2 * sum(len(regexp_extract_all(text, '[\\x{{0590}}-\\x{{08FF}}]'))) > sum(len(regexp_extract_all(text, '\\pL'))) AS rtl, bool_and(y1 IS NOT NULL) AS boxed, greatest(max(x1), 1.0) AS width FROM rb GROUP BY 1, 2),
v AS (SELECT rb.*, rtl, boxed, width, x1 - x0 >= 0.7 * width AS wide FROM rb JOIN votes USING (document_id, page)),
s AS (SELECT *, count(*) FILTER (WHERE NOT wide) OVER (PARTITION BY document_id, page) >= 2 AS banded FROM v),
b AS (SELECT s.*, (SELECT count(*) FROM v w WHERE w.document_id = s.document_id AND w.page = s.page AND w.wide AND CASE WHEN s.wide THEN (w.y0, w.x0, w.block_index) < (s.y0, s.x0, s.block_index) ELSE (s.y0 + s.y1) / 2 >= w.y0 END) AS above FROM s),
c AS (SELECT *, coalesce(x0 - max(x1) OVER (PARTITION BY document_id, page, wide, above ORDER BY x0, block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.05 * width, false)::INT AS starts FROM b),
k AS (SELECT *, sum(starts) OVER (PARTITION BY document_id, page, wide, above ORDER BY x0, block_index) AS col FROM c)
SELECT document_id, block_index, (row_number() OVER (PARTITION BY document_id ORDER BY page, CASE WHEN boxed AND banded THEN above * 2 + wide::INT END, CASE WHEN boxed AND banded AND NOT wide THEN CASE WHEN rtl THEN -col ELSE col END END, CASE WHEN boxed THEN y0 ELSE block_index END, CASE WHEN boxed THEN x0 END, block_index))::INT AS place, rtl FROM k""")
def w5_order(spark, d):
    return Y.document_order(_read(spark, d))
