"""Queries of warnings, repairs, layout and set similarity over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions.text import search_terms
from siftwell.operators import chunking as C
from siftwell.operators import evidence as E
from siftwell.operators.similar_sets import similar_sets
from siftwell.plans.inputs import _TRIM, BLOCKS, CHUNKS, WARNINGS, blocks, chunks, table, warnings
from siftwell.plans.join_queries import BOXES, boxes
from siftwell.plans.ranking_queries import FUSION, PAIRS, TOKENS, _pairs, retrieval

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


@query("a8_backfill_search_columns", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE lower(text) END) AS search_md5 FROM documents")
def a8(spark, d):
    rows = table(spark, d, "documents").withColumn("search", F.when(F.col("doc_id") % 3 == 0, "kept").otherwise(""))
    return rows.select("doc_id", F.md5(E.backfilled(F.col("text"), F.col("search"))).alias("search_md5"))


@query("b6_clean_parser_noise", "SELECT doc_id, md5(" + _TRIM.format("regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[$\\\\{}^_*#%&|~ ]+$', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')").replace("{}", "{}") + ") AS clean_md5 FROM documents")
def b6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(E.clean_parser_noise(F.col("text"))).alias("clean_md5"))


@query("c7_expand_multi_reference_blocks", f"""WITH {CHUNKS}, p AS (SELECT document_id, chunk_index, text, list_filter(string_split(regexp_replace(text, '[0-9]+', chr(1) || '\\0', 'g'), chr(1)), lambda x: regexp_matches(x, '[0-9]+')) AS p FROM chunks)
SELECT document_id, chunk_index, '' AS suffix, text FROM p WHERE len(p) <= 1 UNION ALL SELECT document_id, chunk_index, 'ref' || i, p[i] FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM p WHERE len(p) > 1)""")
def c7(spark, d):
    return E.expand_multi_reference(chunks(spark, d), "[0-9]+")


_OFFSETS = f"""{BLOCKS}, f AS (SELECT *, CASE WHEN block_index = 0 OR tag IN ('h1', 'h2', 'title') THEN 1 ELSE 0 END AS starts FROM blocks), g AS (SELECT *, sum(starts) OVER (PARTITION BY document_id ORDER BY block_index) - 1 AS group_index FROM f),
o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id, group_index ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM g)"""


@query("c10_span_to_blocks", f"""WITH {_OFFSETS}, s AS (SELECT document_id, group_index, unnest(range(0, CAST(max(char_start + length(text)) AS BIGINT) + 1, 200)) AS span_start FROM o GROUP BY 1, 2)
SELECT document_id, CAST(group_index AS INTEGER) AS group_index, span_start, min(block_index) AS first_block, max(block_index) AS last_block FROM s JOIN o USING (document_id, group_index) WHERE char_start < span_start + 200 AND char_start + length(text) > span_start GROUP BY 1, 2, 3""")
def c10(spark, d):
    own = C.ordered_text_groups(blocks(spark, d), F.col("tag").isin("h1", "h2", "title"))
    group = ["document_id", "group_index"]
    spans = own.groupBy(*group).agg(F.max("char_end").alias("e")).select(*group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("e"), F.lit(200).cast("long"))).alias("span_start"))
    return E.spans_to_blocks(spans.withColumn("span_end", F.col("span_start") + 200), own, group)


@query("j10_layout_neighbours", f"""WITH {BOXES}, k AS (SELECT document_id AS page_id, block_index AS block, tag AS kind FROM blocks), ov AS (SELECT a.page_id, a.block AS a, b.block AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.block <> b.block
WHERE abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= 150 AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) >= 0.5),
u AS (SELECT a.page_id, a.block AS a, b.block AS b, 3 AS points FROM k a JOIN k b ON a.page_id = b.page_id AND a.kind = b.kind AND abs(a.block - b.block) BETWEEN 1 AND 4 UNION ALL SELECT a.page_id, a.block, b.block, 5 FROM k a JOIN k b ON a.page_id = b.page_id AND abs(a.block - b.block) = 1 UNION ALL SELECT page_id, a, b, 4 FROM ov),
s AS (SELECT page_id, a, b, sum(points)::BIGINT AS score FROM u GROUP BY 1, 2, 3) SELECT page_id, a, b, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page_id, a ORDER BY score DESC, b) AS place FROM s) WHERE place <= 4""")
def j10(spark, d):
    kinds = blocks(spark, d).select(F.col("document_id").alias("page_id"), F.col("block_index").alias("block"), F.col("tag").alias("kind"))
    return E.layout_neighbours(boxes(spark, d), kinds, 4)


_INTENTS = [("who", "that", "the", 2.0), ("where", "in", "was", 1.5), ("shape", "hein", "that", 4.0)]


@query("k5_intent_boost", f"WITH {PAIRS} SELECT query_id, document_id, " + " + ".join(f"CASE WHEN contains(lower(query_text), '{q}') AND contains(lower(text), '{t}') THEN {b}::DOUBLE ELSE 0 END" for _, q, t, b in _INTENTS) + " AS boost FROM pairs")
def k5(spark, d):
    return E.intent_boost(_pairs(spark, d), _INTENTS).select("query_id", "document_id", "boost")


@query("k6_reference_match", """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 IN (l_suppkey % 10, l_linenumber) THEN 'exact' WHEN l_partkey % 10 BETWEEN l_suppkey % 4 AND l_suppkey % 4 + 3 THEN 'range' ELSE 'none' END AS match FROM lineitem""")
def k6(spark, d):
    rows = table(spark, d, "lineitem").withColumns({
        "value": F.col("l_partkey") % 10, "listed": F.array(F.col("l_suppkey") % 10, F.col("l_linenumber").cast("long")), "first": F.col("l_suppkey") % 4, "last": F.col("l_suppkey") % 4 + 3,
    })
    return E.reference_match(rows).select("l_orderkey", "l_linenumber", "match")


@query("k10_seed_fusion", """WITH c AS (SELECT user_id AS query_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id * 7 % 40 END AS chunk_id, event_id * 3 % 20 AS document_id, event_type AS tool, value AS score FROM events),
b AS (SELECT query_id, coalesce('chunk:' || chunk_id, 'document:' || document_id) AS identity, tool, round(score + CASE tool WHEN 'search' THEN 10 WHEN 'purchase' THEN 5 ELSE 0 END, 6) AS score FROM c), s AS (SELECT query_id, identity, max(score) AS score, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM b GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity) AS INTEGER) AS rank FROM s""")
def k10(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("query_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 7 % 40).alias("chunk_id"), (F.col("event_id") * 3 % 20).alias("document_id"), F.col("event_type").alias("tool"), F.col("value").alias("score"))
    return E.seed_fusion(rows, {"search": 10.0, "purchase": 5.0})


@query("k15_rank_delta", f"WITH {FUSION} SELECT query_id, document_id, t.rank AS before, f.rank AS after, t.rank - f.rank AS delta FROM fused f JOIN term_lane t USING (query_id, document_id)")
def k15(spark, d):
    from siftwell.operators.ranking import rare_terms, term_lane
    from siftwell.plans.ranking_queries import LANE, RARE, _inputs

    queries, docs = _inputs(spark, d)
    before = term_lane(rare_terms(queries, docs, RARE), docs, LANE).select("query_id", "document_id", F.col("rank").alias("before"))
    after = retrieval(spark, d).select("query_id", "document_id", F.col("rank").alias("after"))
    return after.join(before, ["query_id", "document_id"]).withColumn("delta", F.col("before") - F.col("after"))


@query("k17_near_duplicates", f"""WITH s AS (SELECT doc_id, list_sort({TOKENS.format("text")}) AS t FROM documents), f AS (SELECT t, min(doc_id) AS id FROM s WHERE len(t) > 0 GROUP BY t),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS n, len(a.t) + len(b.t) AS total FROM f a JOIN f b ON a.id < b.id AND len(a.t) >= 0.65 * len(b.t) - 1e-9 AND len(b.t) >= 0.65 * len(a.t) - 1e-9)
SELECT a, b, round(n / (total - n), 9) AS similarity FROM p WHERE n >= 0.65 * (total - n) - 1e-9""")
def k17(spark, d):
    return similar_sets(table(spark, d, "documents").select(F.col("doc_id").alias("id"), search_terms(F.col("text")).alias("terms")), 0.65)


@query("k19_warning_annotation", f"""WITH {WARNINGS}, c AS (SELECT document_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM warnings GROUP BY 1), q AS (SELECT user_id AS query_id, event_id, event_id * 7 % 1200 AS document_id FROM events)
SELECT query_id, event_id, document_id, codes, count(codes) OVER (PARTITION BY query_id) AS with_warnings FROM q LEFT JOIN c USING (document_id)""")
def k19(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("query_id"), "event_id", (F.col("event_id") * 7 % 1200).alias("document_id"))
    return E.annotate_warnings(rows, warnings(spark, d))


@query("g8_quality_repair_report", "SELECT o_orderstatus AS status, count(*) AS chunks, sum(o_orderkey % 3)::BIGINT AS repairs, sum(o_custkey % 2)::BIGINT AS downgrades FROM orders GROUP BY 1")
def g8(spark, d):
    return E.repair_report(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3).alias("repairs"), (F.col("o_custkey") % 2).alias("downgrades")))


@query("g10_local_script_repair", f"""WITH {CHUNKS}, n AS (SELECT *, lag(text) OVER w AS a, lead(text) OVER w AS b FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index))
SELECT document_id, chunk_index, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN CASE WHEN regexp_matches(a, '[0-9]') THEN a WHEN regexp_matches(b, '[0-9]') THEN b END END AS added FROM n""")
def g10(spark, d):
    return E.local_script_repair(chunks(spark, d), "[0-9]")


@query("g27_quality_diagnostics", """WITH q AS (SELECT c_custkey AS query_id, c_custkey % 1300 AS document_id FROM customer), e AS (SELECT * FROM q WHERE query_id NOT IN (SELECT user_id FROM events)), r AS (SELECT doc_id AS document_id, CAST(doc_id * 10 + quality AS BIGINT) AS unit FROM labels),
k AS (SELECT query_id, unit, row_number() OVER (PARTITION BY query_id ORDER BY unit) AS r FROM e LEFT JOIN r USING (document_id)) SELECT query_id, coalesce(string_agg(CAST(unit AS VARCHAR), ',' ORDER BY CAST(unit AS VARCHAR)), '') AS "references", bool_and(unit IS NULL) AS unknown_document FROM k WHERE r <= 5 GROUP BY 1""")
def g27(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 1300).alias("document_id"))
    found = table(spark, d, "events").select(F.col("user_id").alias("query_id"))
    reports = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") * 10 + F.col("quality")).alias("unit"))
    return E.empty_query_diagnostics(q, found, reports)


@query("g29_warning_items", f"""WITH {WARNINGS}, o AS (SELECT document_id, code, page, min(chunk_index) AS chunk_index FROM warnings GROUP BY 1, 2, 3), s AS (SELECT o.*, substr(text, 1, 40) AS preview FROM o JOIN chunks USING (document_id, chunk_index)),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, code) AS place, count(*) OVER (PARTITION BY document_id) AS total FROM s) SELECT document_id, chunk_index, code, page, preview, CAST(place AS INTEGER) AS place, total, total > 3 AS truncated FROM r WHERE place <= 3""")
def g29(spark, d):
    return E.warning_items(warnings(spark, d), chunks(spark, d), 3)


@query("g31_normalisation_decisions", f"""WITH {WARNINGS}, l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT document_id, 'quality_warning' AS decision, code AS detail FROM warnings UNION ALL SELECT document_id, 'modal_route', block_type FROM warnings WHERE block_type = 'table'
UNION ALL SELECT doc_id, 'graph_record', last FROM documents JOIN l ON user_id = doc_id""")
def g31(spark, d):
    w = warnings(spark, d)
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("document_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("detail"))
    graph = table(spark, d, "documents").select(F.col("doc_id").alias("document_id")).join(last, "document_id").select("document_id", F.lit("graph_record").alias("decision"), "detail")
    rows = w.select("document_id", F.lit("quality_warning").alias("decision"), F.col("code").alias("detail"))
    return rows.unionByName(w.filter("block_type = 'table'").select("document_id", F.lit("modal_route").alias("decision"), F.col("block_type").alias("detail"))).unionByName(graph)


@query("u1_lane_union", "SELECT user_id AS query_id, event_id, 'search' AS lane, value AS score, NULL AS note FROM events WHERE event_type = 'search' UNION ALL SELECT user_id, event_id, 'view', NULL, props FROM events WHERE event_type = 'view'")
def u1(spark, d):
    e = table(spark, d, "events")
    own = lambda t: e.filter(F.col("event_type") == t).withColumn("lane", F.lit(t)).withColumnRenamed("user_id", "query_id")
    return own("search").select("query_id", "event_id", "lane", F.col("value").alias("score")).unionByName(own("view").select("query_id", "event_id", "lane", F.col("props").alias("note")), allowMissingColumns=True)


@query("u5_expected_minus_available", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def u5(spark, d):
    return table(spark, d, "conversations").select("conv_id").distinct().join(table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("conv_id")), "conv_id", "left_anti")
