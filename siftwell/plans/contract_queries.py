"""Queries of durable tables, evidence lineage and evaluation gates over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwell.operators import aggregates as A
from siftwell.operators import lineage as L
from siftwell.plans.inputs import CHUNKS, WARNINGS, chunks, table, warnings
from siftwell.sources import contracts as C

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


#: Events as runs: signups lack a query, clicks have a status of their own, errors that didn't fail have an error, ids repeat by user and minute.
_RUNS = """r AS (SELECT user_id || '-' || CASE WHEN event_id % 50 < 2 THEN event_id // 50 ELSE event_id + 1000000 END AS id, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'clicked' ELSE 'succeeded' END WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'ready' ELSE 'failed' END ELSE 'succeeded' END AS status,
  CASE WHEN event_type <> 'signup' OR event_id % 2 = 0 THEN props END AS query, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error, ts::DATE AS day FROM events),
m AS (SELECT *, list_filter([CASE WHEN query IS NULL THEN 'missing:query' END, CASE WHEN status = 'clicked' THEN 'rule:status' END, CASE WHEN status <> 'failed' AND error IS NOT NULL THEN 'rule:error' END], lambda x: x IS NOT NULL) AS reasons FROM r)"""


@query("a9_contract_round_trip", f"""WITH {_RUNS}, k AS (SELECT id, status, error, day, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id) AS p FROM m WHERE len(reasons) = 0)
SELECT 'kept' AS outcome, '' AS reasons, day, count(*) AS n FROM k WHERE p = 1 AND n = 1 GROUP BY day UNION ALL SELECT 'rejected', array_to_string(reasons, ','), day, count(*) FROM m WHERE len(reasons) > 0 GROUP BY ALL
UNION ALL SELECT 'repeated', '', NULL, count(*) - count(DISTINCT id) FROM m WHERE len(reasons) = 0""")
def a9_round_trip(spark, d):
    e, contract = table(spark, d, "events"), C.CONTRACTS["runs"]
    number = F.when(F.col("event_id") % 50 < 2, F.floor(F.col("event_id") / 50)).otherwise(F.col("event_id") + 1000000)
    status = F.when(F.col("event_type") == "click", F.when(F.col("event_id") % 3 == 0, "clicked").otherwise("succeeded")).when(F.col("event_type") == "error", F.when(F.col("event_id") % 5 == 0, "ready").otherwise("failed")).otherwise("succeeded")
    runs = e.select(
        F.concat_ws("-", "user_id", number).alias("id"), F.lit("base").alias("variant_id"), status.alias("status"), F.when((F.col("event_type") != "signup") | (F.col("event_id") % 2 == 0), F.col("props")).alias("query"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"), F.to_date("ts").cast("string").alias("day"),
    )
    root = f"{C.working_folder(spark)}/siftwell/a9-{uuid.uuid4().hex}"
    C.write_contract(runs, root, contract)
    kept, bad = C.read_contract(spark, root, contract), C.read_rejected(spark, root, contract)
    # Which of the rows of a repeated id is kept depends on hashes, so such ids are counted, not dated.
    again = F.array_contains("reasons", "repeated_key")
    single = kept.join(bad.filter(again).select("id").distinct(), "id", "left_anti").groupBy("day").agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("outcome"), F.lit("").alias("reasons"), "day", "n")
    rejected = bad.filter(~again).groupBy(F.array_join("reasons", ",").alias("reasons"), "day").agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("outcome"), "reasons", "day", "n")
    repeated = bad.filter(again).agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated").alias("outcome"), F.lit("").alias("reasons"), F.lit(None).cast("date").alias("day"), "n")
    return single.unionByName(rejected).unionByName(repeated)


#: Chunks of two lines as pages, every line a block, warnings of the texts, orders as graph records of documents.
_EVIDENCE = WARNINGS + """, ev_chunks AS (SELECT document_id, document_id || '.' || chunk_index // 3 AS chunk_id, (min(line) // 8)::INT AS page_start, (max(line) // 8)::INT AS page_end, CASE WHEN min(text) LIKE '%|%' THEN 'Table' WHEN count(*) = 1 THEN 'equation' ELSE 'text' END AS modality,
  CASE WHEN max(length(text)) < 20 THEN 'warning' WHEN min(chunk_index) % 2 = 0 THEN 'ok' END AS quality_status FROM chunks WHERE document_id % 9 <> 8 GROUP BY document_id, chunk_index // 3),
ev_blocks AS (SELECT document_id || '.' || chunk_index // 3 AS chunk_id, document_id || ':' || line AS block_id FROM chunks WHERE length(text) > 8),
ev_warnings AS (SELECT DISTINCT document_id || '.' || chunk_index // 3 AS chunk_id, code || '@' || document_id || ':' || chunk_index AS warning_id FROM warnings),
ev_graph AS (SELECT o_custkey AS document_id, 'g' || o_orderkey AS record_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS created_at FROM orders),
latest AS (SELECT document_id, arg_max(record_id, (created_at, record_id)) AS record_id, arg_max(status, (created_at, record_id)) AS status FROM ev_graph GROUP BY 1),
full_chunks AS (SELECT c.*, coalesce((SELECT list_sort(list(DISTINCT block_id)) FROM ev_blocks b WHERE b.chunk_id = c.chunk_id), []) AS blocks, coalesce((SELECT list_sort(list(DISTINCT warning_id)) FROM ev_warnings w WHERE w.chunk_id = c.chunk_id), []) AS warns FROM ev_chunks c),
decisions AS (SELECT document_id, 'decision-page-stitch-' || chunk_id AS decision_id, 'page_stitch' AS decision_type, 'recorded' AS status, blocks, [chunk_id] AS outs, [] AS warns, NULL AS limitation FROM full_chunks WHERE page_start <> page_end
  UNION ALL SELECT document_id, 'decision-modal-route-' || chunk_id, 'modal_route', 'recorded', blocks, [chunk_id], [], NULL FROM full_chunks WHERE modality <> 'text'
  UNION ALL SELECT document_id, 'decision-quality-warning-' || chunk_id, 'quality_warning', coalesce(quality_status, 'recorded'), blocks, [chunk_id], warns, NULL FROM full_chunks WHERE len(warns) > 0 OR quality_status = 'warning'
  UNION ALL SELECT document_id, 'decision-graph-' || record_id, CASE WHEN status = 'succeeded' THEN 'chunk_materialization' ELSE 'quality_gate' END, status, [], coalesce((SELECT list_sort(list(DISTINCT chunk_id)) FROM ev_chunks c WHERE c.document_id = l.document_id), []), [], CASE WHEN status <> 'succeeded' THEN 'latest graph projection is ' || status END FROM latest l)"""


def _evidence(spark, d):
    own = chunks(spark, d)
    chunk = F.concat_ws(".", "document_id", F.floor(F.col("chunk_index") / 3)).alias("chunk_id")
    least = own.filter("document_id % 9 != 8").groupBy("document_id", chunk).agg(
        F.floor(F.min("line") / 8).cast("int").alias("page_start"), F.floor(F.max("line") / 8).cast("int").alias("page_end"),
        F.when(F.contains(F.min("text"), F.lit("|")), "Table").when(F.count(F.lit(1)) == 1, "equation").otherwise("text").alias("modality"),
        F.when(F.max(F.char_length("text")) < 20, "warning").when(F.min("chunk_index") % 2 == 0, "ok").alias("quality_status"),
    )
    blocks = own.filter(F.char_length("text") > 8).select(chunk, F.concat_ws(":", "document_id", "line").alias("block_id"))
    warned = warnings(spark, d).select(chunk, F.concat(F.col("code"), F.lit("@"), F.concat_ws(":", "document_id", "chunk_index")).alias("warning_id"))
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    graph = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("record_id"), status.alias("status"), F.lit(0).alias("node_count"), F.lit(0).alias("edge_count"), F.col("o_orderdate").alias("created_at"))
    return least, blocks, warned, graph


@query("g31_evidence_decisions", f"""WITH {_EVIDENCE} SELECT document_id, decision_id, decision_type, status, array_to_string(blocks, ',') AS input_block_ids, array_to_string(outs, ',') AS output_chunk_ids, array_to_string(warns, ',') AS warning_ids, limitation FROM decisions""")
def g31_decisions(spark, d):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return L.evidence_decisions(*_evidence(spark, d)).select("document_id", "decision_id", "decision_type", "status", joined("input_block_ids"), joined("output_chunk_ids"), joined("warning_ids"), "limitation")


@query("g31_evidence_gaps", f"""WITH {_EVIDENCE}, n AS (SELECT doc_id AS document_id, (SELECT count(*) FROM ev_chunks c WHERE c.document_id = doc_id) AS chunks, (SELECT count(*) FROM ev_chunks c WHERE c.document_id = doc_id AND c.chunk_id IN (SELECT chunk_id FROM ev_blocks)) AS blocks,
  (SELECT count(*) FROM decisions x WHERE x.document_id = doc_id) AS decided, (SELECT any_value(status) FROM latest l WHERE l.document_id = doc_id) AS graph FROM (SELECT DISTINCT doc_id FROM documents))
SELECT document_id, 'missing_section' AS kind, 'chunks' AS what FROM n WHERE chunks = 0 UNION ALL SELECT document_id, 'missing_section', 'parser_blocks' FROM n WHERE blocks = 0 UNION ALL SELECT document_id, 'missing_section', 'normalization_decisions' FROM n WHERE decided = 0
UNION ALL SELECT document_id, 'limitation', 'no chunks have been materialized' FROM n WHERE chunks = 0 UNION ALL SELECT document_id, 'limitation', (chunks - 3) || ' chunks are not shown' FROM n WHERE chunks > 3
UNION ALL SELECT document_id, 'limitation', 'no graph projection record' FROM n WHERE graph IS NULL UNION ALL SELECT document_id, 'limitation', 'latest graph projection is ' || graph FROM n WHERE graph <> 'succeeded'""")
def g31_gaps(spark, d):
    own, blocks, warned, graph = _evidence(spark, d)
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return L.evidence_gaps(documents, own, blocks, L.evidence_decisions(own, blocks, warned, graph), graph, 3)


#: Orders as cases with their lines as results: the rank is the line's number, its flags are lane, grade and reference.
_GATES = """res AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, l_partkey % 50 AS chunk_id, l_suppkey % 5 AS source_id, l_partkey % 7 AS reference_id, CASE WHEN l_returnflag = 'R' THEN 'graph' ELSE 'vector' END AS lane, l_quantity::BIGINT % 4 AS grade FROM lineitem),
cases AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'F' THEN 'exact_reference' ELSE 'semantic' END AS query_class, [o_custkey % 7, o_custkey % 3] AS refs, [o_custkey % 5] AS sources, CASE WHEN o_orderkey % 2 = 0 THEN [o_custkey % 50, (o_custkey + 1) % 50, (o_custkey + 2) % 50] ELSE [] END AS graph, [o_custkey % 4, o_orderkey % 6] AS required, [o_custkey % 4, o_custkey % 6] AS assembled FROM orders WHERE o_orderkey IN (SELECT query_id FROM res))"""


@query("g22_baseline_gates", f"""WITH {_GATES}, top AS (SELECT c.*, r.source_id, r.reference_id FROM cases c JOIN res r USING (query_id) WHERE rank = 1),
n AS (SELECT query_id, sum((2 ** grade - 1) / log2(rank + 1)) FILTER (WHERE rank <= 3) AS dcg, sum((2 ** grade - 1) / log2(best + 1)) FILTER (WHERE best <= 3) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS best FROM res SEMI JOIN cases USING (query_id)) GROUP BY 1),
m AS (SELECT 'exact_reference_hit_rate' AS metric, avg(list_contains(refs, reference_id)::INT) AS value, 1.0 AS gate FROM top WHERE query_class = 'exact_reference' UNION ALL SELECT 'source_accuracy', avg(list_contains(sources, source_id)::INT), 1.0 FROM top
  UNION ALL SELECT 'graph_expansion_precision', avg(list_contains(graph, chunk_id)::INT), 0.8 FROM res JOIN cases USING (query_id) WHERE lane = 'graph' AND len(graph) > 0 UNION ALL SELECT 'reranker_ndcg', avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 1 END), 0.98 FROM n
  UNION ALL SELECT 'context_grounding_rate', sum(len(list_intersect(list_distinct(required), assembled))) / sum(len(list_distinct(required))), 1.0 FROM cases)
SELECT metric, round(coalesce(value, 1.0), 9)::DOUBLE AS value, gate::DOUBLE AS gate, coalesce(value, 1.0) >= gate AS passed FROM m""")
def g22_gates(spark, d):
    from pyspark.sql import Window

    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    results = li.select(
        F.col("l_orderkey").alias("query_id"), rank.alias("rank"), (F.col("l_partkey") % 50).alias("chunk_id"), (F.col("l_suppkey") % 5).alias("source_id"), (F.col("l_partkey") % 7).alias("reference_id"),
        F.when(F.col("l_returnflag") == "R", "graph").otherwise("vector").alias("lane"), (F.col("l_quantity").cast("long") % 4).alias("grade"),
    )
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    cases = o.select(
        k.alias("query_id"), F.when(F.col("o_orderstatus") == "F", "exact_reference").otherwise("semantic").alias("query_class"), F.array(c % 7, c % 3).alias("expected_references"), F.array(c % 5).alias("expected_sources"),
        F.when(k % 2 == 0, F.array(c % 50, (c + 1) % 50, (c + 2) % 50)).otherwise(F.array().cast("array<bigint>")).alias("relevant_graph"), F.array(c % 4, k % 6).alias("required"), F.array(c % 4, c % 6).alias("assembled"),
    )
    cases = cases.join(results.select("query_id").distinct(), "query_id", "left_semi")
    return A.baseline_gates(cases, results, 3)


_STATUSES = ["queued", "done", "failed", ""]


@query("g8_repairs_of_documents", f"""WITH c AS (SELECT l_suppkey AS document_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_returnflag = 'R' AS applied, CASE WHEN l_linestatus = 'O' THEN l_quantity::BIGINT % 3 END AS downgraded, l_partkey, (l_partkey % 3)::INT AS n FROM lineitem),
q AS (SELECT document_id, chunk_id, unnest(range(0, n)) AS p, l_partkey FROM c), r AS (SELECT document_id, chunk_id || '/' || p AS block_id, {_STATUSES}[((l_partkey + p) % 4 + 1)::INT] AS status, row_number() OVER (PARTITION BY document_id ORDER BY chunk_id, p, l_partkey) AS k FROM q),
s AS (SELECT document_id, count(*) FILTER (WHERE applied) AS script_repairs, coalesce(sum(downgraded), 0)::BIGINT AS noise_downgrades, sum(n)::BIGINT AS requests FROM c GROUP BY 1), n AS (SELECT document_id, status, count(*) AS n FROM r WHERE status <> '' GROUP BY 1, 2)
SELECT document_id, script_repairs, noise_downgrades, requests, coalesce((SELECT string_agg(status || '=' || n.n, ',' ORDER BY status) FROM n WHERE n.document_id = s.document_id), '') AS statuses, coalesce((SELECT string_agg(block_id, ' ' ORDER BY k) FROM r WHERE r.document_id = s.document_id AND k <= 25), '') AS samples FROM s""")
def g8_repairs(spark, d):
    li = table(spark, d, "lineitem")
    chunk = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    n = (F.col("l_partkey") % 3).cast("int")
    every = F.transform(F.array(F.lit(0), F.lit(1)), lambda p: F.struct(F.concat_ws("/", chunk, p).alias("block_id"), F.element_at(F.array(*map(F.lit, _STATUSES)), ((F.col("l_partkey") + p) % 4 + 1).cast("int")).alias("status")))
    rows = li.select(
        F.col("l_suppkey").alias("document_id"), chunk.alias("chunk_id"), F.when(F.col("l_returnflag") == "R", "applied").otherwise("skipped").alias("script_status"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("long") % 3).alias("downgraded"), F.slice(every, F.lit(1), n).alias("requests"),
    )
    return A.quality_repairs(rows).withColumn("samples", F.array_join("samples", " "))
