"""Queries of order, sets, top-k and graph caps over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import windows as W
from siftwell.plans.inputs import BLOCKS, CHUNKS, blocks, chunks, table
from siftwell.plans.join_queries import BOXES, boxes

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


@query("w1_latest_per_key", "SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w1(spark, d):
    return W.latest_per_key(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type", "value")


@query("w2_stitch_pages", f"""WITH {CHUNKS}, l AS (SELECT *, lag(text) OVER w AS before FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)),
j AS (SELECT *, coalesce(NOT regexp_matches(before, '[.!?:;]$'), false) AND regexp_matches(text, '^[a-z]') AS joins, coalesce(regexp_matches(before, '[a-z]-$'), false) AS broken FROM l),
p AS (SELECT *, sum((NOT joins)::INT) OVER w AS part, coalesce(lead(joins) OVER w, false) AND regexp_matches(text, '[a-z]-$') AS ends FROM j WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index))
SELECT document_id, min(chunk_index) AS chunk_index, count(*) AS parts, string_agg(CASE WHEN joins AND NOT broken THEN ' ' ELSE '' END || CASE WHEN ends THEN left(text, length(text) - 1) ELSE text END, '' ORDER BY chunk_index) AS text FROM p GROUP BY document_id, part""")
def w2(spark, d):
    return W.stitch(chunks(spark, d))


_CARRIED = f"""{BLOCKS}, b AS (SELECT document_id, block_index, tag IN ('h1', 'h2', 'title') AS a, CAST(block_index * block_index // 7 AS INTEGER) AS page FROM blocks), g AS (SELECT *, coalesce(page - lag(page) OVER w > 4, false) AS gap, sum(a::INT) OVER w AS u FROM b WINDOW w AS (PARTITION BY document_id ORDER BY block_index)),
c AS (SELECT *, min(block_index) FILTER (WHERE gap AND NOT a) OVER (PARTITION BY document_id, u) AS closed FROM g), carried AS (SELECT document_id, block_index, page, CASE WHEN u > 0 AND (closed IS NULL OR block_index < closed) THEN u::BIGINT END AS unit FROM c)"""


def _carried(spark, d):
    rows = blocks(spark, d).withColumn("page", F.floor(F.col("block_index") * F.col("block_index") / 7).cast("int"))
    return W.carry_forward(rows, F.col("tag").isin("h1", "h2", "title"), 4).select("document_id", "block_index", "page", "unit")


@query("w3_carry_forward_references", f"WITH {_CARRIED} SELECT * FROM carried")
def w3(spark, d):
    return _carried(spark, d)


@query("w4_finish_reference_units", f"WITH {_CARRIED} SELECT document_id, unit, count(*) AS blocks, min(page) AS page_start, max(page) AS page_end, CASE WHEN count(*) = 1 THEN 'header_only' ELSE 'body' END AS status FROM carried WHERE unit IS NOT NULL GROUP BY 1, 2")
def w4(spark, d):
    return W.finish_units(_carried(spark, d))


@query("w5_reading_order", f"""WITH {BOXES}, bx AS (SELECT page_id, block, x0, CASE WHEN block % 6 = 0 THEN x0 + 800 ELSE x1 END AS x1, y0, y1 FROM boxes), a AS (SELECT *, x1 - x0 >= 700 AS wide, (y0 + y1) / 2 AS mid FROM bx), b AS (SELECT *, sum(wide::INT) OVER (PARTITION BY page_id ORDER BY mid, block) AS band FROM a),
c AS (SELECT *, CASE WHEN coalesce(x0 - max(x1) OVER (PARTITION BY page_id, band, wide ORDER BY x0, x1, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 50, false) THEN 1 ELSE 0 END AS starts FROM b),
e AS (SELECT *, sum(starts) OVER (PARTITION BY page_id, band, wide ORDER BY x0, x1, block) AS col FROM c)
SELECT page_id, block, CAST(row_number() OVER (PARTITION BY page_id ORDER BY band, wide DESC, col, y0, x0, block) AS INTEGER) AS place FROM e""")
def w5(spark, d):
    return W.reading_order(boxes(spark, d).withColumn("x1", F.when(F.col("block") % 6 == 0, F.col("x0") + 800).otherwise(F.col("x1"))))


@query("w6_contextual_references", f"""WITH {BLOCKS}, m AS (SELECT document_id, block_index AS position, CASE WHEN tag IN ('h1', 'h2') THEN text END AS context FROM blocks) SELECT document_id, position, last_value(context IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM m""")
def w6(spark, d):
    return W.inherit_context(blocks(spark, d).select("document_id", F.col("block_index").alias("position"), F.when(F.col("tag").isin("h1", "h2"), F.col("text")).alias("context")))


@query("w7_anchor_windows", f"""WITH {BLOCKS}, m AS (SELECT document_id, block_index, tag IN ('h1', 'h2', 'title') AS a FROM blocks), n AS (SELECT *, max(block_index) FILTER (WHERE a) OVER (PARTITION BY document_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
min(block_index) FILTER (WHERE a) OVER (PARTITION BY document_id ORDER BY block_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM m) SELECT document_id, block_index, previous, next FROM n WHERE NOT a""")
def w7(spark, d):
    return W.anchor_windows(blocks(spark, d), F.col("tag").isin("h1", "h2", "title"))


@query("w8_neighbour_refs", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS previous_ref, l_linenumber + 1 AS next_ref, lag(l_linenumber) OVER w AS observed_previous, lead(l_linenumber) OVER w AS observed_next FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def w8(spark, d):
    return W.neighbour_refs(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey"], "l_linenumber")


@query("w9_page_options", """SELECT event_id, user_id, CAST(place AS INTEGER) AS place, total, total > 20 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE place > 10 AND place <= 20""")
def w9(spark, d):
    return W.page_of(table(spark, d, "events"), "user_id", [F.desc("ts"), "event_id"], 10, 10).select("event_id", "user_id", "place", "total", "has_more")


@query("l1_search_page", f"""WITH {CHUNKS}, s AS (SELECT document_id, chunk_index, len(regexp_extract_all(lower(text), '[a-z0-9]+')) % 13 AS score FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index) AS place, count(*) OVER (PARTITION BY document_id) AS total FROM s WHERE score > 0)
SELECT document_id, chunk_index, score, CAST(place AS INTEGER) AS place, total, total > 5 AS has_more FROM r WHERE place <= 5""")
def l1(spark, d):
    rows = chunks(spark, d).select("document_id", "chunk_index", (F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+")) % 13).cast("long").alias("score"))
    return W.page_of(rows.filter("score > 0"), "document_id", [F.desc("score"), "chunk_index"], 0, 5)


_EDGES = "e AS (SELECT o_orderpriority AS graph, 'c' || o_custkey AS source, 'o' || o_orderkey AS target, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS type FROM orders)"


def _edges(spark, d):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("graph"), s("c", "o_custkey").alias("source"), s("o", "o_orderkey").alias("target"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("type"))


@query("l3_render_caps", f"""WITH {_EDGES}, n AS (SELECT graph, source AS id FROM e UNION SELECT graph, target FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY id) AS r, count(*) OVER (PARTITION BY graph) AS n FROM n), k AS (SELECT * FROM r WHERE r <= 2000)
SELECT e.graph, e.source, e.target, e.type, a.n > 2000 AS truncated FROM e JOIN k a ON a.graph = e.graph AND a.id = e.source JOIN k b ON b.graph = e.graph AND b.id = e.target""")
def l3(spark, d):
    return W.capped_graph(_edges(spark, d), "graph", 2000)


@query("l5_filter_graph", f"WITH {_EDGES}, n AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'o' || o_orderkey FROM orders) SELECT graph, source, target, type FROM e WHERE type = 'done' AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)")
def l5(spark, d):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    nodes = table(spark, d, "customer").filter("c_acctbal > 0").select(s("c", "c_custkey")).unionByName(table(spark, d, "orders").select(s("o", "o_orderkey")))
    return W.filtered_graph(_edges(spark, d), nodes, "done")


@query("l4_best_row_per_document", "SELECT o_custkey AS document_id, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best, max(o_totalprice) AS score FROM orders GROUP BY 1")
def l4(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.max("o_totalprice").alias("score"))


@query("u2_prefilter_union", """SELECT doc_id, 'labels' AS origin FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def u2(spark, d):
    first = table(spark, d, "labels").select("doc_id", F.lit("labels").alias("origin"))
    return W.union_first_wins(first, table(spark, d, "documents").select("doc_id", F.lit("documents").alias("origin")), ["doc_id"])


@query("u3_distinct_paths", f"WITH {_EDGES} SELECT DISTINCT a.source, b.source AS other FROM e a JOIN e b ON a.target = b.target UNION SELECT source, target FROM e WHERE type = 'done'")
def u3(spark, d):
    e = _edges(spark, d)
    pairs = e.select("source", "target").join(e.select(F.col("source").alias("other"), "target"), "target").select("source", "other")
    return pairs.union(e.filter("type = 'done'").select("source", "target")).distinct()


@query("u4_distinct_first_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def u4(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("u6_element_sets", """WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (WHERE value < 20))) AS a, list_sort(list_distinct(list(event_type) FILTER (WHERE value > 60))) AS b FROM events GROUP BY 1)
SELECT user_id, CAST(coalesce(len(list_intersect(a, b)), 0) AS INTEGER) AS both, CAST(coalesce(len(list_distinct(list_concat(a, b))), 0) AS INTEGER) AS either, CAST(coalesce(len(list_filter(a, lambda x: NOT coalesce(list_contains(b, x), false))), 0) AS INTEGER) AS only_a FROM s""")
def u6(spark, d):
    sets = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") < 20, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("b"))
    return sets.select("user_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("only_a"))
