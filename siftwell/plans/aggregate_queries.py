"""Queries of quality, evaluation and health aggregates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import aggregates as A
from siftwell.plans.inputs import BLOCKS, CHUNKS, WARNINGS, blocks, chunks, table, warnings
from siftwell.plans.ranking_queries import FUSION, retrieval
from siftwell.plans.text_queries import _RANGES, _script_sql
from siftwell.streaming import jobs as X
from siftwell.streaming import keyed_ingest as KI

QUERIES: dict = {}
SUPPRESSED = "(block_type = 'table' AND code = 'short_chunk')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


@query("g1_parser_quality_summary", f"WITH {WARNINGS} SELECT code, count(DISTINCT (document_id, chunk_index)) AS n_chunks FROM warnings WHERE NOT {SUPPRESSED} GROUP BY 1")
def g1(spark, d):
    return A.warning_summary(warnings(spark, d), F.expr(SUPPRESSED))


@query("g2_parser_quality_details", f"""WITH {WARNINGS}, p AS (SELECT code, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM (SELECT code, page, row_number() OVER (PARTITION BY code ORDER BY page) AS r FROM (SELECT DISTINCT code, page FROM warnings)) WHERE r <= 20 GROUP BY 1)
SELECT code, count(*) AS raw_warnings, count(*) FILTER (WHERE NOT {SUPPRESSED}) AS counted_warnings, count(DISTINCT (document_id, chunk_index)) AS raw_chunks, count(DISTINCT (document_id, chunk_index)) FILTER (WHERE NOT {SUPPRESSED}) AS counted_chunks,
count(*) FILTER (WHERE block_type = 'table') AS in_tables, any_value(pages) AS pages FROM warnings JOIN p USING (code) GROUP BY 1""")
def g2(spark, d):
    return A.warning_details(warnings(spark, d), F.expr(SUPPRESSED))


@query("g3_dedupe_warnings", f"""WITH {WARNINGS}, o AS (SELECT DISTINCT document_id, code, block_type, page, expected_script FROM warnings)
SELECT * FROM o WHERE expected_script IS NOT NULL OR NOT EXISTS (SELECT 1 FROM o AS s WHERE s.expected_script IS NOT NULL AND s.document_id = o.document_id AND s.code = o.code AND s.page = o.page)""")
def g3(spark, d):
    return A.dedupe_warnings(warnings(spark, d))


@query("g4_warning_groups", f"""WITH {WARNINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id, code, expected_script ORDER BY chunk_index) AS r FROM warnings)
SELECT document_id, code, expected_script, count(*) AS n, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) FILTER (WHERE r <= 5) AS samples FROM r GROUP BY 1, 2, 3""")
def g4(spark, d):
    return A.warning_groups(warnings(spark, d))


UNITS = f"""{CHUNKS}, units AS (SELECT document_id, chunk_index AS unit, list_sort(list_filter([CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digit' END], lambda x: x IS NOT NULL)) AS scripts FROM chunks),
quality AS (SELECT document_id, unit, concat_ws(',', CASE WHEN NOT list_contains(scripts, 'latin') THEN 'latin' END, CASE WHEN NOT list_contains(scripts, 'digit') THEN 'digit' END) AS missing,
CASE WHEN len(scripts) = 0 THEN 'unresolved' WHEN len(scripts) = 2 THEN 'passed' ELSE 'missing' END AS status, len(scripts) = 2 AS index_vector, len(scripts) > 0 AS persist_chunk FROM units)"""


def _quality(spark, d):
    scripts = F.array_compact(F.array(F.when(F.col("text").rlike("[A-Za-z]"), "latin"), F.when(F.col("text").rlike("[0-9]"), "digit")))
    return A.reference_quality(chunks(spark, d).select("document_id", F.col("chunk_index").alias("unit"), scripts.alias("scripts")), ["latin", "digit"])


@query("g5_reference_quality", f"WITH {UNITS} SELECT * FROM quality")
def g5(spark, d):
    return _quality(spark, d)


@query("g6_chunk_quality_policy", f"""WITH {UNITS} SELECT document_id, bool_and(index_vector) AS index_vector, bool_and(persist_chunk) AS persist_chunk, coalesce(string_agg(DISTINCT status, ',' ORDER BY status) FILTER (WHERE status <> 'passed'), '') AS flags FROM quality GROUP BY 1""")
def g6(spark, d):
    return A.chunk_policy(_quality(spark, d))


@query("g7_index_quality_report", f"""WITH {UNITS}, s AS (SELECT document_id, count(*) AS units, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'unresolved') AS unresolved FROM quality GROUP BY 1)
SELECT doc_id AS document_id, coalesce(units, 0) AS units, coalesce(passed, 0) AS passed, coalesce(missing, 0) AS missing, coalesce(unresolved, 0) AS unresolved, CASE WHEN coalesce(units, 0) > 0 THEN round(passed / units, 6) ELSE 0 END::DOUBLE AS coverage,
CASE WHEN coalesce(units, 0) = 0 THEN 'quality_unknown' WHEN passed = units THEN 'passed' WHEN passed > 0 THEN 'partial' ELSE 'failed' END AS status FROM documents LEFT JOIN s ON doc_id = document_id""")
def g7(spark, d):
    return A.quality_report(_quality(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("document_id")))


@query("g9_repair_warning_counts", f"""WITH {WARNINGS} SELECT code, max(n) AS n FROM (SELECT code, count(*) AS n FROM warnings GROUP BY 1 UNION ALL SELECT code, count(DISTINCT document_id) * 2 FROM warnings GROUP BY 1 UNION ALL SELECT 'no_text', count(*) FROM documents WHERE text = '') GROUP BY 1""")
def g9(spark, d):
    w = warnings(spark, d)
    none = table(spark, d, "documents").agg(F.count_if(F.col("text") == "").alias("n")).select(F.lit("no_text").alias("code"), "n")
    return A.largest_counts(w.groupBy("code").agg(F.count(F.lit(1)).alias("n")), w.groupBy("code").agg((F.count_distinct("document_id") * 2).alias("n")), none)


@query("g11_repair_steps", f"WITH {WARNINGS} SELECT code, count(*) AS n, CASE code WHEN 'short_chunk' THEN 'merge' WHEN 'symbol_noise' THEN 'clean' ELSE 'inspect' END AS step FROM warnings GROUP BY 1")
def g11(spark, d):
    return A.repair_steps(warnings(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n")), {"short_chunk": "merge", "symbol_noise": "clean"})


@query("g12_extraction_contract", f"""WITH {CHUNKS}, s AS (SELECT document_id, sum(length(text))::BIGINT AS chars, count(DISTINCT line % 8) AS pages, bool_or(regexp_matches(text, '(endobj|endstream|/FlateDecode)')) AS raw, count(DISTINCT CASE WHEN line > 40 THEN 'b' ELSE 'a' END) AS backends FROM chunks GROUP BY 1)
SELECT document_id, chars, pages, CASE WHEN chars < 50 THEN 'too_short' WHEN raw THEN 'raw_syntax' WHEN pages < 0.5 * (1 + document_id % 9) THEN 'pages_missing' WHEN backends > 1 THEN 'mixed_backends' ELSE 'ok' END AS result FROM s""")
def g12(spark, d):
    rows = chunks(spark, d).withColumns({"page": F.col("line") % 8, "backend": F.when(F.col("line") > 40, "b").otherwise("a")})
    return A.extraction_contract(rows, table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (1 + F.col("doc_id") % 9).alias("total_pages")))


@query("g13_page_count", f"""WITH r AS (SELECT document_id, least(s, e) AS a, greatest(s, e) AS b FROM (SELECT document_id, coalesce(page_start, page, page_end) AS s, coalesce(page_end, page_start, page) AS e FROM {_RANGES}) WHERE s IS NOT NULL)
SELECT document_id, count(DISTINCT p) AS pages FROM (SELECT document_id, unnest(range(a, b + 1)) AS p FROM r) GROUP BY 1""")
def g13(spark, d):
    from siftwell.operators.blocks import repair_page_ranges

    li = table(spark, d, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("document_id"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 40).alias("page"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey") % 50).alias("page_start"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 50).alias("page_end"),
    )
    return A.page_count(repair_page_ranges(rows).filter("page_start is not null"))


@query("g14_script_preflight", f"""WITH s AS (SELECT doc_id, lang, {_script_sql('text')} AS scripts FROM documents) SELECT lang, count(*) AS documents, count(*) FILTER (WHERE scripts LIKE '%latin%') AS passed, round(count(*) FILTER (WHERE scripts LIKE '%latin%') / count(*), 6) AS ratio FROM s GROUP BY 1""")
def g14(spark, d):
    good = F.array_contains(T.scripts_of(F.col("text")), "latin")
    sums = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(good).alias("passed"))
    return sums.withColumn("ratio", F.round(F.col("passed") / F.col("documents"), 6))


@query("g15_identity_ranges", """SELECT l_orderkey AS chunk_id, f AS field, min(v) AS start, max(v) AS "end" FROM (SELECT l_orderkey, 'part' AS f, l_partkey AS v FROM lineitem UNION ALL SELECT l_orderkey, 'supplier', l_suppkey FROM lineitem) GROUP BY 1, 2""")
def g15(spark, d):
    pairs = F.array(F.struct(F.lit("part").alias("field"), F.col("l_partkey").alias("value")), F.struct(F.lit("supplier").alias("field"), F.col("l_suppkey").alias("value")))
    return A.identity_ranges(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.explode(pairs).alias("p")).select("chunk_id", "p.*"))


@query("g16_contract_validation", f"""WITH {CHUNKS}, c(contract, p) AS (VALUES ('digits', '[0-9]+'), ('bars', '[|]'), ('shout', '[A-Z]{{4,}}')), s AS (SELECT document_id, contract, sum(len(regexp_extract_all(text, p)))::BIGINT AS units, count(*) FILTER (WHERE regexp_matches(text, p)) AS pages FROM chunks, c GROUP BY 1, 2)
SELECT document_id, contract, units, pages, units < 3 AS rejected, CAST(row_number() OVER (PARTITION BY document_id ORDER BY units DESC, pages DESC, contract) AS INTEGER) AS place FROM s""")
def g16(spark, d):
    return A.contract_validation(chunks(spark, d).withColumn("page", F.col("line")), {"digits": "[0-9]+", "bars": "[|]", "shout": "[A-Z]{4,}"}, 3)


@query("g17_experiment_counts", """SELECT c_custkey AS experiment_id, coalesce(r.n, 0) AS runs, coalesce(s.n, 0) AS scores FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) r ON r.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) s ON s.o_custkey = c_custkey""")
def g17(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"))
    return A.experiment_counts(table(spark, d, "customer").select(F.col("c_custkey").alias("experiment_id")), runs, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id")))


@query("g18_score_answers", """WITH a AS (SELECT conv_id, turn, lower(text) AS t, turn % 2 = 1 AS has_expected FROM conversations WHERE role = 'assistant'),
h AS (SELECT *, (contains(t, 'the')::INT + contains(t, 'que')::INT) / 2 AS e, contains(t, 'er')::INT AS i, (contains(t, 'zz')::INT + contains(t, 'qq')::INT) / 2 AS v FROM a)
SELECT conv_id, turn, round(100 * (CASE WHEN has_expected THEN 0.5 * e ELSE 0 END + 0.35 * i + 0.15 * (1 - v)) / CASE WHEN has_expected THEN 1.0 ELSE 0.5 END, 6)::DOUBLE AS score, true AS scoreable FROM h""")
def g18(spark, d):
    none = F.array().cast("array<string>")
    rows = table(spark, d, "conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("answer"), F.when(F.col("turn") % 2 == 1, F.array(F.lit("the"), F.lit("que"))).otherwise(none).alias("expected"), F.array(F.lit("er")).alias("must_include"), F.array(F.lit("zz"), F.lit("qq")).alias("must_avoid"),
    )
    return A.score_answers(rows).select("conv_id", "turn", "score", "scoreable")


@query("g19_optimizer_summary", """WITH s AS (SELECT o_custkey AS experiment_id, o_orderpriority AS variant_id, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(avg(o_totalprice), 6) AS avg_score, round(sum(o_totalprice), 2) AS total_score, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_run FROM orders GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY avg_score DESC, failed, runs DESC, total_score DESC, variant_id) = 1 AS winner FROM s""")
def g19(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("done")
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("experiment_id"), F.col("o_orderpriority").alias("variant_id"), F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("score"), status.alias("status"))
    return A.optimizer_summary(runs)


RELEVANT = "relevant AS (SELECT item_id AS query_id, doc_id AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
METRICS = f"""{FUSION}, {RELEVANT}, h AS (SELECT f.query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM fused f JOIN relevant USING (query_id, document_id) WHERE rank <= 10 GROUP BY 1),
w AS (SELECT query_id, count(*) AS relevant FROM relevant GROUP BY 1), sh AS (SELECT query_id, count(*) AS shown FROM fused WHERE rank <= 10 GROUP BY 1),
m AS (SELECT query_id, coalesce(shown, 0) AS shown, coalesce(w.relevant, 0) AS relevant, coalesce(hits, 0) AS hits, first, dcg FROM sh FULL JOIN w USING (query_id) LEFT JOIN h USING (query_id)),
metrics AS (SELECT query_id, (CASE WHEN shown > 0 THEN round(hits / shown, 6) ELSE 0 END)::DOUBLE AS precision, (CASE WHEN relevant > 0 THEN round(hits / relevant, 6) ELSE 0 END)::DOUBLE AS recall, (CASE WHEN hits > 0 THEN 1 ELSE 0 END)::DOUBLE AS hit, coalesce(round(1 / first, 6), 0)::DOUBLE AS mrr,
(CASE WHEN hits > 0 THEN round(dcg / list_sum(list_transform(range(1, greatest(1, least(relevant, 10)) + 1), lambda i: 1 / log2(i + 1))), 6) ELSE 0 END)::DOUBLE AS ndcg FROM m)"""


def _relevant(spark, d):
    """Documents that hold a passage: they share all its word windows, so the passage lane finds them; then the texts are compared."""
    from siftwell.operators.ranking import passage_lane

    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    near = passage_lane(queries, docs, 1 << 30).select("query_id", "document_id")
    both = near.join(queries.withColumnRenamed("text", "q"), "query_id").join(docs, "document_id")
    return both.filter(F.contains("text", F.col("q"))).select("query_id", "document_id")


@query("g20_retrieval_metrics", f"WITH {METRICS} SELECT * FROM metrics")
def g20(spark, d):
    return A.retrieval_metrics(retrieval(spark, d).select("query_id", "document_id", "rank"), _relevant(spark, d), 10)


_MINIMUMS = {"precision": 0.75, "recall": 0.7, "mrr": 0.8, "hit": 1.0}


@query("g21_quality_gate", f"WITH {METRICS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS actual, {v}::DOUBLE AS minimum, round(avg({m}), 6) < {v} AS failed FROM metrics" for m, v in _MINIMUMS.items()))
def g21(spark, d):
    return A.quality_gate(g20(spark, d), _MINIMUMS)


@query("g22_graded_ndcg", """WITH r AS (SELECT user_id AS query_id, event_id, CAST(floor(value) AS BIGINT) % 4 AS grade, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS best FROM r),
s AS (SELECT query_id, round(sum(CASE WHEN rank <= 10 THEN (2.0 ** grade - 1) / log2(rank + 1) ELSE 0 END), 9) AS dcg, round(sum(CASE WHEN best <= 10 THEN (2.0 ** grade - 1) / log2(best + 1) ELSE 0 END), 9) AS ideal FROM b GROUP BY 1)
SELECT query_id, (CASE WHEN ideal > 0 THEN round(dcg / ideal, 6) ELSE 0 END)::DOUBLE AS ndcg FROM s""")
def g22(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return A.graded_ndcg(table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.floor("value") % 4).alias("grade"), rank.alias("rank")), 10)


@query("g23_regression_verdicts", f"""WITH {FUSION}, j AS (SELECT item_id AS query_id, CAST(1 + item_id % 3 AS BIGINT) AS required_rank, CASE WHEN contains(d.text, b.text) THEN rank END AS hit FROM benchmark b LEFT JOIN fused f ON f.query_id = item_id LEFT JOIN documents d ON d.doc_id = f.document_id)
SELECT query_id, required_rank, min(hit) AS first_rank, CASE WHEN min(hit) <= required_rank THEN 'PASS' ELSE 'FAIL' END AS verdict FROM j GROUP BY 1, 2""")
def g23(spark, d):
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (1 + F.col("item_id") % 3).alias("required_rank"), F.col("text").alias("expected"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return A.regression_verdicts(cases, retrieval(spark, d).select("query_id", "document_id", "rank").join(docs, "document_id"))


def _stages(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), "ts", "value")


@query("g24_stage_rollup", """WITH s AS (SELECT user_id AS job_id, event_type AS stage, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM events GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY last_ts DESC, stage) = 1 AS current FROM s""")
def g24(spark, d):
    return A.stage_rollup(_stages(spark, d))


@query("g25_latency_percentiles", """WITH s AS (SELECT event_type AS lane, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS runs FROM events GROUP BY 1) SELECT *, CASE WHEN p95 >= 60 THEN 'over' WHEN p95 >= 48 THEN 'near' ELSE 'healthy' END AS budget FROM s""")
def g25(spark, d):
    return A.latency_percentiles(table(spark, d, "events").select(F.col("event_type").alias("lane"), "value"), 60.0)


@query("g26_pathway_status", """WITH st(place, stage) AS (VALUES (0, 'view'), (1, 'click'), (2, 'search'), (3, 'purchase'), (4, 'refund')), r AS (SELECT DISTINCT user_id * 100 + event_id % 20 AS run_id FROM events),
w AS (SELECT user_id * 100 + event_id % 20 AS run_id, event_type AS stage, max(CASE WHEN value > 80 THEN 2 ELSE 1 END) AS w FROM events GROUP BY 1, 2)
SELECT run_id, CAST(place AS INTEGER) AS place, stage, CASE WHEN w = 2 THEN 'failed' WHEN w = 1 THEN 'done' ELSE 'not_run' END AS status FROM r CROSS JOIN st LEFT JOIN w USING (run_id, stage)""")
def g26(spark, d):
    traces = table(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 20).alias("run_id"), F.col("event_type").alias("stage"), F.when(F.col("value") > 80, "failed").otherwise("ok").alias("word"))
    return A.pathway_status(traces, ["view", "click", "search", "purchase", "refund"])


@query("g28_graph_readiness", """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT c_custkey AS document_id, CASE WHEN last IS NULL THEN 'missing' WHEN last = 'purchase' THEN 'ready' ELSE 'degraded' END AS status FROM customer LEFT JOIN l ON user_id = c_custkey""")
def g28(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    joined = table(spark, d, "customer").join(last, F.col("user_id") == F.col("c_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("document_id"), F.when(F.col("last").isNull(), "missing").when(F.col("last") == "purchase", "ready").otherwise("degraded").alias("status"))


@query("g30_query_lane_policy", """WITH q AS (SELECT DISTINCT user_id AS query_id, event_id * 7 % 1200 AS document_id FROM events) SELECT query_id, bool_and(coalesce(quality = 1, true)) AS vector_ok, bool_or(coalesce(toxic = 1, false)) AS blocked, count(*) FILTER (WHERE quality IS NULL) AS unknown_documents FROM q LEFT JOIN labels ON doc_id = document_id GROUP BY 1""")
def g30(spark, d):
    q = table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") * 7 % 1200).alias("document_id")).distinct()
    docs = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("vector_ok"), (F.col("toxic") == 1).alias("blocked"))
    return A.lane_policy(q, docs)


@query("x2_stage_state", """SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS stage, max(ts) AS ts, count(*) AS events, CAST(CASE arg_max(event_type, (ts, event_id)) WHEN 'view' THEN 10 WHEN 'click' THEN 40 WHEN 'search' THEN 60 WHEN 'purchase' THEN 100 ELSE 0 END AS INTEGER) AS progress FROM events GROUP BY 1""")
def x2(spark, d):
    return X.stage_state(_stages(spark, d))


@query("x3_stalled_jobs", """WITH l AS (SELECT user_id AS job_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS stage, count(*) FILTER (WHERE event_type = 'error') AS attempts FROM events GROUP BY 1)
SELECT *, CASE WHEN attempts >= 14 THEN 'fail' WHEN stage = 'search' THEN 'resume' ELSE 'retry' END AS action FROM l WHERE last_ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOURS AND stage <> 'purchase'""")
def x3(spark, d):
    return X.stalled_jobs(_stages(spark, d), "2024-01-31 00:00:00", "24 hours", 14)


@query("x4_run_health", """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS lane, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE value > 50) AS over_budget, round(max(value), 6) AS slowest FROM events GROUP BY 1, 2""")
def x4(spark, d):
    return X.run_health(table(spark, d, "events").withColumnRenamed("event_type", "lane"), late=None)


@query("x5_quality_drift", """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, CAST(user_id % 5 AS VARCHAR) AS source, event_type AS code, count(*) AS warnings FROM events GROUP BY 1, 2, 3""")
def x5(spark, d):
    return X.quality_drift(table(spark, d, "events").select("ts", (F.col("user_id") % 5).cast("string").alias("source"), F.col("event_type").alias("code")), late=None)


@query("x5_bursts", """WITH g AS (SELECT user_id AS job_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS n, event_id FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k FROM g)
SELECT job_id, min(ts) AS start, count(*) AS events FROM s GROUP BY job_id, k""")
def x5b(spark, d):
    return X.bursts(_stages(spark, d), "2 hours", late=None)


@query("x1_stream_ingest", f"""WITH {CHUNKS}, c AS (SELECT text, min(doc_id) AS document_id FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT document_id, chunk_index, line, k.text, sha256(c.text) AS sha256 FROM c JOIN chunks k USING (document_id)""")
def x1(spark, d):
    return X.ingest(table(spark, d, "documents"))


@query("x1_keyed_ingest", """WITH r AS (SELECT user_id AS doc, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_type || chr(10) || (value::BIGINT % 40) END AS text FROM events),
last AS (SELECT doc, arg_max(coalesce(text, ''), seq) AS text FROM r GROUP BY 1), held AS (SELECT l.doc, l.text, min(r.seq) AS seq FROM last l JOIN r ON r.doc = l.doc AND r.seq > coalesce((SELECT max(o.seq) FROM r o WHERE o.doc = l.doc AND coalesce(o.text, '') <> l.text), -1) WHERE l.text <> '' GROUP BY 1, 2),
owners AS (SELECT text, arg_min(doc, (seq, doc)) AS document_id FROM held GROUP BY 1)
SELECT document_id, sha256(text) AS sha256, (i - 1)::INT AS chunk_index, i::INT AS line, string_split(text, chr(10))[i] AS text FROM owners, (VALUES (1), (2)) t(i)""")
def x1_keyed(spark, d):
    text = F.when(F.col("event_type") != "error", F.concat("event_type", F.lit("\n"), (F.rint("value").cast("long") % 40).cast("string")))
    return KI.batch_standing(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), text.alias("text"), F.col("event_id").alias("seq")))
