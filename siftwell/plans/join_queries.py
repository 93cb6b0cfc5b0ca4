"""Queries of joins over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import chunking as C
from siftwell.operators import joins as J
from siftwell.plans.inputs import BLOCKS, CHUNKS, WARNINGS, blocks, chunks, table, warnings
from siftwell.plans.text_queries import _STOP

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


TERMS = f"""query_terms AS (SELECT item_id AS query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p) AS r FROM (
  SELECT item_id, term, min(p) AS p FROM (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark))
  WHERE length(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY ALL)) WHERE r <= 5)"""


def query_terms(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.prefilter_terms(F.col("text"))).alias("term"))


@query("j1_lexical_prefilter", f"""WITH {CHUNKS}, {TERMS}, m AS (SELECT query_id, document_id, chunk_index, count(*) AS matched FROM query_terms JOIN chunks ON contains(lower(chunks.text), term) GROUP BY ALL),
f AS (SELECT m.*, matched = n AS full_match, bool_or(matched = n) OVER (PARTITION BY query_id) AS any_full FROM m JOIN (SELECT query_id, count(*) AS n FROM query_terms GROUP BY 1) USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index) AS place FROM f WHERE full_match OR NOT any_full)
SELECT query_id, document_id, chunk_index, matched, CAST(place AS INTEGER) AS place FROM r WHERE place <= 50""")
def j1(spark, d):
    return J.lexical_prefilter(query_terms(spark, d), chunks(spark, d), 50)


@query("j2_reference_prefilter", """SELECT DISTINCT page_id AS query_id, document_id, preview_ref FROM (SELECT page_id, regexp_extract(url, 'page=([0-9]+)', 1) AS reference FROM pages WHERE contains(url, 'page='))
JOIN (SELECT page_id AS document_id, CAST(page_id AS VARCHAR) AS preview_ref FROM pages WHERE NOT contains(url, '#')) ON reference = preview_ref""")
def j2(spark, d):
    pages = table(spark, d, "pages")
    refs = pages.filter(F.contains("url", F.lit("page="))).select(F.col("page_id").alias("query_id"), F.regexp_extract("url", "page=([0-9]+)", 1).alias("reference"))
    return J.reference_prefilter(refs, pages.select(F.col("page_id").alias("document_id"), F.col("page_id").cast("string").alias("preview_ref"), (~F.contains("url", F.lit("#"))).alias("eligible")))


@query("j3_token_prefilter", f"""WITH {CHUNKS}, {TERMS}, tokens AS (SELECT DISTINCT document_id, chunk_index, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM chunks)
SELECT DISTINCT query_id, document_id, chunk_index FROM query_terms JOIN tokens ON term = token""")
def j3(spark, d):
    tokens = chunks(spark, d).select("document_id", "chunk_index", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    return J.token_prefilter(query_terms(spark, d).withColumnRenamed("term", "token"), tokens)


CANDIDATES = "candidates AS (SELECT user_id AS query_id, event_id * 7 % 1200 AS document_id, value FROM events)"


def candidates(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") * 7 % 1200).alias("document_id"), "value")


@query("j4_hydrate", f"""WITH {CANDIDATES} SELECT query_id, CASE WHEN doc_id IS NULL THEN 'missing' WHEN lang = 'en' THEN 'hydrated' ELSE 'out_of_scope' END AS status, count(*) AS n
FROM candidates LEFT JOIN documents ON doc_id = document_id GROUP BY ALL""")
def j4(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    return J.hydrate(candidates(spark, d), docs, F.col("lang") == "en").groupBy("query_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("j5_vector_hydrate", """WITH c AS (SELECT event_id // 3 AS query_id, event_id * 7 % 1200 AS document_id, CASE WHEN event_id % 2 = 0 THEN value END AS score, CASE WHEN event_id % 3 = 0 THEN value / 2 END AS similarity, value AS distance FROM events)
SELECT query_id, document_id, round(coalesce(score, similarity, 1 / (1 + greatest(distance, 0))), 9) AS score FROM c WHERE query_id NOT IN (SELECT query_id FROM c WHERE document_id NOT IN (SELECT doc_id FROM documents))""")
def j5(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.floor(F.col("event_id") / 3).alias("query_id"), (F.col("event_id") * 7 % 1200).alias("document_id"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("score"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 2).alias("similarity"), F.col("value").alias("distance"))
    return J.vector_hydrate(rows, table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))).withColumn("score", F.round("score", 9))


@query("j6_warning_hydration", f"""WITH {WARNINGS}, p AS (SELECT document_id, chunk_index, sha1(lower(trim(text))) AS print FROM chunks), c AS (SELECT document_id, print, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM p JOIN warnings USING (document_id, chunk_index) GROUP BY ALL)
SELECT document_id, chunk_index, codes FROM p JOIN c USING (document_id, print)""")
def j6(spark, d):
    return J.share_warnings(chunks(spark, d), warnings(spark, d))


@query("j7_reading_order_neighbours", f"""WITH {CHUNKS} SELECT s.document_id, s.chunk_index AS seed_index, CAST(c.chunk_index - s.chunk_index AS INTEGER) AS step, c.chunk_index FROM chunks s JOIN chunks c ON s.document_id = c.document_id AND abs(s.chunk_index - c.chunk_index) = 1 WHERE contains(s.text, 'that')""")
def j7(spark, d):
    every = chunks(spark, d)
    return J.order_neighbours(every.filter(F.contains("text", F.lit("that"))), every)


SECTIONED = CHUNKS + """, sectioned AS (SELECT document_id, chunk_index, text, sum(CASE WHEN chunk_index = 0 OR length(text) < 25 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY chunk_index) AS section_index FROM chunks)"""


def sectioned(spark, d):
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks(spark, d).withColumn("section_index", F.sum(((F.col("chunk_index") == 0) | (F.char_length("text") < 25)).cast("int")).over(order))


@query("j8_context_window", f"""WITH {SECTIONED}, p AS (SELECT s.document_id, s.chunk_index AS seed_index, c.chunk_index, CASE WHEN abs(s.chunk_index - c.chunk_index) = 1 THEN 8 ELSE 0 END AS a, CASE WHEN s.section_index = c.section_index THEN 1 ELSE 0 END AS b
FROM sectioned s JOIN sectioned c ON s.document_id = c.document_id AND s.chunk_index <> c.chunk_index AND (abs(s.chunk_index - c.chunk_index) = 1 OR s.section_index = c.section_index) WHERE contains(s.text, 'that')),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, seed_index ORDER BY a + b DESC, abs(chunk_index - seed_index), chunk_index) AS place FROM p)
SELECT document_id, seed_index, chunk_index, CASE WHEN a > 0 AND b > 0 THEN 'adjacent,same_section' WHEN a > 0 THEN 'adjacent' ELSE 'same_section' END AS reasons, CAST(a + b AS BIGINT) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 6""")
def j8(spark, d):
    every = sectioned(spark, d)
    return J.context_window(every.filter(F.contains("text", F.lit("that"))), every, 6)


#: Chunks with links: sections are the parents and headings, the first letters are the section path, numbers of letters the ranges.
_RELATED = SECTIONED + """, ch AS (SELECT document_id, document_id * 100000 + chunk_index AS chunk_id, CASE WHEN chunk_index % 7 <> 6 THEN chunk_index END AS reading_order, CASE WHEN chunk_index % 5 = 4 THEN document_id * 100000 + chunk_index // 5 END AS parent_id,
  CASE WHEN chunk_index % 3 = 2 THEN document_id * 100000 + chunk_index - 2 END AS previous_id, CASE WHEN chunk_index % 4 = 3 THEN document_id * 100000 + chunk_index + 3 END AS next_id, 'h' || section_index AS heading_path, CASE WHEN chunk_index % 2 = 0 THEN lower(left(text, 2)) END AS section_path,
  length(text) % 40 AS parent_start, length(text) % 40 + chunk_index % 2 AS parent_end, CASE WHEN length(text) % 3 > 0 THEN chunk_index END AS unit_start, chunk_index + chunk_index % 3 AS unit_end, text FROM sectioned),
seeds AS (SELECT document_id // 3 AS query_id, *, length(text) % 2 = 0 AS paths, length(text) % 4 < 2 AS ranges FROM ch WHERE contains(text, 'that') AND length(text) % 5 = 0)"""


def _related(spark, d):
    c, size, i = sectioned(spark, d), F.char_length("text"), F.col("chunk_index")
    at = lambda k: F.col("document_id") * 100000 + k
    every = c.select(
        "document_id", at(i).alias("chunk_id"), F.when(i % 7 != 6, i).alias("reading_order"), F.when(i % 5 == 4, at(F.floor(i / 5))).alias("parent_id"), F.when(i % 3 == 2, at(i - 2)).alias("previous_id"), F.when(i % 4 == 3, at(i + 3)).alias("next_id"),
        F.concat(F.lit("h"), F.col("section_index").cast("string")).alias("heading_path"), F.when(i % 2 == 0, F.lower(F.left("text", F.lit(2)))).alias("section_path"), (size % 40).alias("parent_start"), (size % 40 + i % 2).alias("parent_end"),
        F.when(size % 3 > 0, i).alias("unit_start"), (i + i % 3).alias("unit_end"), "text",
    )
    asked = every.filter(F.contains("text", F.lit("that")) & (size % 5 == 0))
    return asked.select(F.floor(F.col("document_id") / 3).alias("query_id"), "chunk_id", (size % 2 == 0).alias("paths"), (size % 4 < 2).alias("ranges")), every.drop("text")


@query("j8_context_relations", f"""WITH {_RELATED}, scope AS (SELECT DISTINCT query_id, document_id FROM seeds), p AS (SELECT c.document_id, c.chunk_id, c.reading_order, s.query_id,
  s.document_id = c.document_id AND abs(s.reading_order - c.reading_order) = 1 AS r0, c.chunk_id = s.parent_id AS r1, c.chunk_id = s.previous_id OR c.chunk_id = s.next_id OR c.previous_id = s.chunk_id OR c.next_id = s.chunk_id AS r2, c.parent_id = s.parent_id AS r3,
  s.paths AND c.heading_path = s.heading_path AS r4, s.paths AND c.section_path = s.section_path AS r5, s.ranges AND s.parent_start <= c.parent_end AND c.parent_start <= s.parent_end AND greatest(0, c.unit_start - s.unit_end, s.unit_start - c.unit_end) <= 1 AND s.unit_start IS NOT NULL AND c.unit_start IS NOT NULL AS r6
  FROM seeds s JOIN scope USING (query_id) JOIN ch c ON c.document_id = scope.document_id),
f AS (SELECT query_id, document_id, chunk_id, any_value(reading_order) AS reading_order, bool_or(r0) AS r0, bool_or(r1) AS r1, bool_or(r2) AS r2, bool_or(r3) AS r3, bool_or(r4) AS r4, bool_or(r5) AS r5, bool_or(r6) AS r6 FROM p GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, reading_order NULLS LAST, chunk_id) AS place FROM f WHERE (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AND (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM seeds))
SELECT query_id, document_id, chunk_id, concat_ws(',', 'context_window', CASE WHEN r0 THEN 'reading_order_adjacent' END, CASE WHEN r1 THEN 'parent_context' END, CASE WHEN r2 THEN 'linked_context' END, CASE WHEN r3 THEN 'sibling_context' END, CASE WHEN r4 THEN 'heading_path_context' END,
  CASE WHEN r5 THEN 'section_path_context' END, CASE WHEN r6 THEN 'reference_range_context' END) AS reasons, place::INT AS place FROM k WHERE place <= 25""")
def j8_relations(spark, d):
    return J.context_relations(*_related(spark, d), 25).withColumn("reasons", F.array_join("reasons", ","))


@query("j9_near_reference_ranges", """WITH r AS (SELECT l_orderkey AS parent, l_linenumber AS id, l_partkey % 100 AS first, l_partkey % 100 + l_suppkey % 5 AS last FROM lineitem)
SELECT DISTINCT a.parent, a.id AS a, b.id AS b, greatest(0, b.first - a.last, a.first - b.last) AS gap FROM r a JOIN r b ON a.parent = b.parent AND a.id < b.id WHERE greatest(0, b.first - a.last, a.first - b.last) <= 3""")
def j9(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 100).alias("first"), (F.col("l_partkey") % 100 + F.col("l_suppkey") % 5).alias("last"))
    return J.near_ranges(rows, 3)


_AXES = "l_orderkey * 10 + l_linenumber AS id, l_returnflag AS k, l_suppkey % 50 AS parent_start, l_suppkey % 50 + l_linenumber % 3 AS parent_end, l_partkey % 97 AS unit_start, l_partkey % 97 + l_quantity::BIGINT % 6 AS unit_end"


@query("j9_range_pairs", f"""WITH r AS (SELECT {_AXES}, l_quantity FROM lineitem), s AS (SELECT * FROM r WHERE l_quantity >= 50)
SELECT r.k, s.id AS seed, r.id, greatest(0, r.unit_start - s.unit_end, s.unit_start - r.unit_end) AS gap FROM s JOIN r ON r.k = s.k AND r.id <> s.id AND r.parent_start <= s.parent_end AND s.parent_start <= r.parent_end AND r.unit_start - s.unit_end <= 2 AND s.unit_start - r.unit_end <= 2""")
def j9_pairs(spark, d):
    li = table(spark, d, "lineitem")
    parent, unit = F.col("l_suppkey") % 50, F.col("l_partkey") % 97
    rows = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("k"), parent.alias("parent_start"), (parent + F.col("l_linenumber") % 3).alias("parent_end"),
        unit.alias("unit_start"), (unit + F.col("l_quantity").cast("long") % 6).alias("unit_end"), "l_quantity",
    )
    return J.near_range_pairs(rows.filter("l_quantity >= 50"), rows, 2, ["k"])


BOXES = BLOCKS + """, boxes AS (SELECT document_id AS page_id, block_index AS block, (block_index % 2) * 400 + block_index * 37 % 90 AS x0, (block_index % 2) * 400 + block_index * 37 % 90 + 200 AS x1, block_index * 60 AS y0, block_index * 60 + 40 AS y1 FROM blocks)"""


def boxes(spark, d):
    x0 = (F.col("block_index") % 2) * 400 + F.col("block_index") * 37 % 90
    return blocks(spark, d).select(F.col("document_id").alias("page_id"), F.col("block_index").alias("block"), x0.alias("x0"), (x0 + 200).alias("x1"), (F.col("block_index") * 60).alias("y0"), (F.col("block_index") * 60 + 40).alias("y1"))


@query("j11_bbox_overlap", f"""WITH {BOXES} SELECT a.page_id, a.block AS a, b.block AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.block < b.block
WHERE abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= 150 AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) >= 0.5""")
def j11(spark, d):
    return J.bbox_overlap(boxes(spark, d))


EDGES = "edges AS (SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"


def edges(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = table(spark, d, "orders").select(name("c", "o_custkey").alias("source"), name("o", "o_orderkey").alias("target"))
    return o.unionByName(table(spark, d, "lineitem").select(name("o", "l_orderkey").alias("source"), name("p", "l_partkey").alias("target")))


GRAPH = f"""{EDGES}, graph AS (SELECT * FROM edges UNION ALL SELECT 'o' || o_orderkey, 'o' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders UNION ALL SELECT 'c' || o_custkey, 'p' || l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 48),
nodes AS (SELECT 'c' || c_custkey AS node, 'document' AS kind FROM customer UNION ALL SELECT 'o' || o_orderkey, 'reference' FROM orders UNION ALL SELECT 'p' || p_partkey, 'chunk' FROM part)"""


def graph(spark, d):
    """Customers are documents, orders are references (linked with the customer's next one), parts are chunks."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    bridges = orders.withColumn("after", after).select(name("o", "o_orderkey").alias("source"), name("o", "after").alias("target")).filter("target is not null")
    large = lines.filter("l_quantity >= 48").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(name("c", "o_custkey").alias("source"), name("p", "l_partkey").alias("target"))
    kinds = {"customer": ("c", "c_custkey", "document"), "orders": ("o", "o_orderkey", "reference"), "part": ("p", "p_partkey", "chunk")}
    nodes = [table(spark, d, t).select(name(p, c).alias("node"), F.lit(kind).alias("kind")) for t, (p, c, kind) in kinds.items()]
    return nodes[0].unionByName(nodes[1]).unionByName(nodes[2]), edges(spark, d).unionByName(bridges).unionByName(large)


@query("j12_graph_expand", f"""WITH {GRAPH}, u AS (SELECT source, target FROM graph WHERE target IS NOT NULL UNION SELECT target, source FROM graph WHERE target IS NOT NULL), t AS (SELECT source, target, kind FROM u JOIN nodes ON node = target),
seeds AS (SELECT 'c' || c_custkey AS seed FROM customer WHERE c_mktsegment = 'BUILDING'), near AS (SELECT seed, target AS via FROM seeds JOIN t ON source = seed WHERE kind = 'reference'),
far AS (SELECT seed, target AS via FROM near JOIN t ON source = via WHERE kind = 'reference'),
reached AS (SELECT seed, node, min(path) AS path FROM (SELECT seed, seed AS via, 0 AS path FROM seeds UNION SELECT seed, via, 1 FROM near UNION SELECT seed, via, 2 FROM far) JOIN (SELECT source AS via, target AS node FROM t WHERE kind = 'chunk') USING (via) WHERE node <> seed GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY path, node) AS place FROM reached) SELECT seed, node, CAST(path AS INTEGER) AS path, CAST(place AS INTEGER) AS place, greatest(1.0, 20.0 - place)::DOUBLE AS score FROM r WHERE place <= 20""")
def j12(spark, d):
    seeds = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("seed"))
    return J.graph_expand(seeds, *graph(spark, d), 20)


@query("j13_semantic_topk", """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p WHERE score > 0.2) SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def j13(spark, d):
    return J.exact_topk(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, 10, 0.2)


@query("j14_lexical_vector_stub", f"""WITH {CHUNKS}, {TERMS}, m AS (SELECT DISTINCT query_id, document_id, chunk_index FROM query_terms JOIN chunks ON contains(lower(chunks.text), term)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index) AS rank FROM m)
SELECT query_id, document_id, chunk_index, round(greatest(0.01, 1.0 / rank), 9)::DOUBLE AS score FROM r LEFT JOIN labels ON doc_id = document_id WHERE rank <= 100 AND coalesce(quality = 1, true)""")
def j14(spark, d):
    ranked = J.first_hits(query_terms(spark, d), chunks(spark, d), 100)
    policy = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("index_vector"))
    kept = C.policy_filter(ranked.join(policy, "document_id", "left"), "index_vector")
    return kept.select("query_id", "document_id", "chunk_index", F.round(F.greatest(F.lit(0.01), 1 / F.col("rank")), 9).alias("score"))


@query("j16_missing_ids", f"WITH {CANDIDATES} SELECT DISTINCT document_id FROM candidates WHERE document_id NOT IN (SELECT doc_id FROM documents)")
def j16(spark, d):
    return J.missing_ids(candidates(spark, d), table(spark, d, "documents").withColumnRenamed("doc_id", "document_id"), "document_id")


@query("j17_index_readiness", """WITH r AS (SELECT user_id * 5 AS document_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events),
s AS (SELECT document_id, bool_or(status = 'succeeded') AS ready, arg_max(status, (ts, event_id)) AS last FROM r GROUP BY 1)
SELECT doc_id AS document_id, coalesce('latest index is ' || last, 'no index record') AS reason FROM documents LEFT JOIN s ON doc_id = document_id WHERE NOT coalesce(ready, false)""")
def j17(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("running")
    records = e.select((F.col("user_id") * 5).alias("document_id"), "ts", F.col("event_id").alias("record_id"), status.alias("status"))
    return J.index_readiness(table(spark, d, "documents").select(F.col("doc_id").alias("document_id")), records)


@query("j18_case_variant_grid", "SELECT item_id, variant FROM benchmark, (VALUES ('base'), ('graph'), ('rerank')) AS v(variant)")
def j18(spark, d):
    return J.case_variant_grid(table(spark, d, "benchmark").select("item_id"), ["base", "graph", "rerank"])


@query("j19_warning_links", f"""WITH {WARNINGS} SELECT w.document_id, w.chunk_index, w.code, CAST(w.document_id AS VARCHAR) || '#' || w.chunk_index AS block_id, coalesce(l.quality, -1) AS decision FROM warnings w LEFT JOIN labels l ON doc_id = document_id""")
def j19(spark, d):
    decisions = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("decision"))
    block = F.concat(F.col("document_id").cast("string"), F.lit("#"), F.col("chunk_index").cast("string"))
    return warnings(spark, d).join(decisions, "document_id", "left").select("document_id", "chunk_index", "code", block.alias("block_id"), F.coalesce("decision", F.lit(-1)).alias("decision"))


@query("j20_relationship_edges", f"""WITH {CHUNKS}, n AS (SELECT document_id, chunk_index, lead(chunk_index) OVER (PARTITION BY document_id ORDER BY chunk_index) AS nx FROM chunks),
r AS (SELECT document_id, chunk_index, CAST(ref AS BIGINT) AS target_id FROM (SELECT document_id, chunk_index, unnest(list_distinct(regexp_extract_all(text, '\\b[0-9]{{1,4}}\\b'))) AS ref FROM chunks))
SELECT document_id || '#' || chunk_index AS source, document_id || '#' || nx AS target, 'next_chunk' AS type FROM n WHERE nx IS NOT NULL
UNION ALL SELECT document_id || '#' || chunk_index, CAST(target_id AS VARCHAR), 'references' FROM r WHERE target_id IN (SELECT doc_id FROM documents)""")
def j20(spark, d):
    every = chunks(spark, d)
    refs = every.select("document_id", "chunk_index", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,4}\b"), F.lit(0)))).alias("r"))
    return J.relationship_edges(every, refs.select("document_id", "chunk_index", F.col("r").cast("long").alias("target_id")))


GRAPH = "g AS (SELECT 'o' || o_orderkey AS source, o_orderpriority || o_custkey AS alias, 'c' || o_custkey || o_orderstatus AS target, CASE WHEN o_orderstatus = 'P' THEN 'odd' ELSE 'mentions' END AS type FROM orders)"


def _graph(spark, d):
    s = lambda c: F.col(c).cast("string")
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("o"), s("o_orderkey")).alias("source"), F.concat(F.col("o_orderpriority"), s("o_custkey")).alias("alias"), F.concat(F.lit("c"), s("o_custkey"), F.col("o_orderstatus")).alias("target"),
        F.when(F.col("o_orderstatus") == "P", "odd").otherwise("mentions").alias("type"),
    )
    return J.project_graph(rows, ["MENTIONS"])


@query("j21_project_graph_edges", f"WITH {GRAPH} SELECT DISTINCT source, target, CASE WHEN upper(type) = 'MENTIONS' THEN 'MENTIONS' ELSE 'RELATED' END AS type FROM g WHERE alias IN (SELECT alias FROM g GROUP BY 1 HAVING count(DISTINCT target) = 1)")
def j21e(spark, d):
    return _graph(spark, d)[1]


@query("j21_project_graph_nodes", f"WITH {GRAPH}, e AS (SELECT * FROM g WHERE alias IN (SELECT alias FROM g GROUP BY 1 HAVING count(DISTINCT target) = 1)) SELECT source AS id FROM e UNION SELECT target FROM e")
def j21n(spark, d):
    return _graph(spark, d)[0]
