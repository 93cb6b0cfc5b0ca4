"""Queries of sources, projections and chunking over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import blocks as B
from siftwell.operators import chunking as C
from siftwell.operators import query_text as Q
from siftwell.plans.inputs import _TRIM, BLOCKS, CHUNKS, WARNINGS, blocks, chunks, table, warnings
from siftwell.sources import tables as S

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


@query("a1_line_chunks", f"WITH {CHUNKS} SELECT * FROM chunks")
def a1(spark, d):
    return chunks(spark, d)


@query("a3_eval_cases", f"""WITH raw AS (SELECT conv_id, turn, {_TRIM.format("text")} AS q, role FROM conversations)
SELECT CASE WHEN conv_id % 2 = 0 THEN 'c' || conv_id || '-' || turn ELSE 'case-' || (conv_id * 1000 + turn) END AS id, q AS query, 2 AS n_include
FROM raw WHERE role = 'user' AND q <> ''""")
def a3(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'user'")
    own = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    raw = rows.select(own.alias("case_id"), F.col("text").alias("question"), F.lit("alpha| beta|").alias("must_include"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_number"))
    good, _ = S.normalise_cases(raw)
    return good.select("id", "query", F.size("must_include").alias("n_include"))


@query("a4_dedupe_uploads", """SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id,
doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents""")
def a4(spark, d):
    return S.dedupe_uploads(table(spark, d, "documents"))


@query("a5_replace_document_chunks", f"""WITH {CHUNKS}, bad AS (SELECT doc_id FROM labels WHERE quality = 0)
SELECT * FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM bad)
UNION ALL SELECT document_id, chunk_index, line, 'new: ' || text FROM chunks WHERE document_id IN (SELECT doc_id FROM bad)""")
def a5(spark, d):
    every = chunks(spark, d)
    bad = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("document_id")).distinct()
    return S.replace_document_chunks(every, every.join(bad, "document_id", "left_semi").withColumn("text", F.concat(F.lit("new: "), F.col("text"))))


@query("a6_cleanup_index", """WITH records AS (SELECT event_id AS record_id, user_id AS document_id, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events)
SELECT record_id, document_id, CASE WHEN document_id % 7 = 0 THEN 'stale' ELSE status END AS status FROM records WHERE document_id % 7 <> 0 OR status = 'succeeded'""")
def a6(spark, d):
    events = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("running")
    records = events.select(F.col("event_id").alias("record_id"), F.col("user_id").alias("document_id"), status.alias("status"))
    return S.cleanup_index(records, records.filter("document_id % 7 = 0"))


@query("a7_build_chunk_rows", f"""WITH {CHUNKS} SELECT document_id, chunk_index, 'text' AS content_type, CASE WHEN line % 2 = 0 THEN 'p' || line ELSE source || ':' || line END AS preview_ref,
CASE WHEN line % 5 = 0 THEN '' ELSE lower(c.text) END AS search_text,
document_id || '|None|' || CASE WHEN line % 2 = 0 THEN 'p' || line ELSE 'None' END || '|' || chunk_index AS chunk_identity FROM chunks c JOIN documents ON doc_id = document_id""")
def a7(spark, d):
    pieces = chunks(spark, d).withColumns({
        "content_type": F.lit(""), "preview_ref": F.when(F.col("line") % 2 == 0, F.concat(F.lit("p"), F.col("line").cast("string"))).otherwise(""),
        "artifact": F.lit(None).cast("string"), "searchable": F.col("line") % 5 != 0,
    })
    return S.build_chunk_rows(pieces, table(spark, d, "documents"))


def _first_rule(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in T.REDACTIONS) + " END"


@query("a10_export_evidence", f"SELECT doc_id, {_first_rule('text')} AS rule FROM documents")
def a10(spark, d):
    safe, unsafe = S.export_evidence(table(spark, d, "documents").select("doc_id", "text"))
    return safe.select("doc_id", F.lit(None).cast("string").alias("rule")).unionByName(unsafe.select("doc_id", "rule"))


def _script_sql(text: str) -> str:
    return "concat_ws(','," + ",".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN '{n}' END" for n, p in T.SCRIPTS.items()) + ")"


@query("b1_detect_scripts", f"SELECT doc_id, {_script_sql('text')} AS scripts FROM documents")
def b1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.scripts_of(F.col("text")), ",").alias("scripts"))


_ARABIC = "trim(regexp_replace(regexp_replace(translate(text, 'آأإٱى', 'ااااي'), '[\\x{0640}\\x{064B}-\\x{065F}\\x{0670}]', '', 'g'), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))"


@query("b2_normalise_arabic", f"WITH {CHUNKS} SELECT document_id, chunk_index, {_ARABIC} AS normalised FROM chunks")
def b2(spark, d):
    return chunks(spark, d).select("document_id", "chunk_index", T.normalise_arabic(F.col("text")).alias("normalised"))


@query("b3_arabic_tokens", f"""WITH {CHUNKS}, t AS (SELECT document_id, chunk_index, regexp_extract_all({_ARABIC}, '[\\x{{0621}}-\\x{{064A}}]+') AS t FROM chunks),
f AS (SELECT document_id, chunk_index, flatten(list_transform(t, lambda x: CASE WHEN starts_with(x, 'و') AND length(x) > 3 THEN [x, substr(x, 2)] ELSE [x] END)) AS f FROM t)
SELECT document_id, chunk_index, coalesce(array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ' '), '') AS tokens FROM f""")
def b3(spark, d):
    return chunks(spark, d).select("document_id", "chunk_index", F.array_join(T.arabic_tokens(F.col("text")), " ").alias("tokens"))


@query("b4_sanitize", "SELECT event_id, replace(event_type, chr(0), '') AS event_type, CASE WHEN isfinite(value) THEN value END AS value FROM events")
def b4(spark, d):
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return table(spark, d, "events").select("event_id", T.sanitised(F.col("event_type")).alias("event_type"), finite.alias("value"))


@query("b5_scrub_paths", """SELECT event_id, k, v FROM (SELECT event_id, 'props' AS k, props AS v FROM events UNION ALL SELECT event_id, 'type', event_type FROM events)
UNION ALL SELECT event_id, 'note', 'ok' FROM events""")
def b5(spark, d):
    meta = F.create_map(
        F.lit("props"), F.col("props"), F.lit("type"), F.col("event_type"), F.lit("path"), F.lit("x"), F.lit("where"), F.lit("/srv/data/1"), F.lit("note"), F.lit("ok")
    )
    return table(spark, d, "events").select("event_id", F.explode(B.scrub_paths(meta)).alias("k", "v"))


@query("b7_estimate_tokens", """SELECT doc_id, greatest(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+')), length(text) // 4, CAST(floor(len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}]')) * 0.75) AS BIGINT),
len(regexp_extract_all(text, '[{}()\\[\\];=<>/*+\\\\-]')) // 2, 1)::BIGINT AS tokens FROM documents""")
def b7(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("b8_classify_blocks", f"""WITH {BLOCKS} SELECT document_id, block_index, CASE WHEN tag IN ('td') THEN 'table' WHEN tag IN ('h1', 'h2', 'title', 'p', 'li') THEN 'text' ELSE 'unknown' END AS block_type FROM blocks""")
def b8(spark, d):
    return blocks(spark, d).select("document_id", "block_index", B.block_type(F.col("tag")).alias("block_type"))


@query("b9_render_modal_text", f"""WITH {BLOCKS} SELECT document_id, block_index, CASE WHEN tag = 'td' THEN CASE WHEN trim(text) = '' THEN '[table]' ELSE '| ' || trim(text) || ' |' END
WHEN trim(text) <> '' THEN trim(text) ELSE '[text]' END AS rendered FROM blocks""")
def b9(spark, d):
    rows = blocks(spark, d).withColumn("block_type", B.block_type(F.col("tag"))).withColumns({"caption": F.lit(None).cast("string"), "latex": F.lit(None).cast("string")})
    return rows.select("document_id", "block_index", B.modal_text().alias("rendered"))


@query("b10_validate_modal", f"""WITH {BLOCKS}, typed AS (SELECT *, CASE WHEN tag = 'td' THEN 'table' WHEN tag = 'li' THEN 'image' WHEN tag = 'h2' THEN 'equation' ELSE 'text' END AS t FROM blocks)
SELECT document_id, block_index, 'table_without_body' AS code FROM typed WHERE t = 'table' AND trim(text) = ''
UNION ALL SELECT document_id, block_index, 'image_without_caption' FROM typed WHERE t = 'image' AND length(text) < 6
UNION ALL SELECT document_id, block_index, 'equation_without_latex' FROM typed WHERE t = 'equation'""")
def b10(spark, d):
    kind = F.when(F.col("tag") == "td", "table").when(F.col("tag") == "li", "image").when(F.col("tag") == "h2", "equation").otherwise("text")
    rows = blocks(spark, d).withColumns({"block_type": kind, "caption": F.when(F.char_length("text") >= 6, F.col("text")), "latex": F.lit(None).cast("string")})
    return rows.select("document_id", "block_index", F.explode(B.modal_warnings()).alias("code"))


_RANGES = "(SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 40 END AS page, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 50 END AS page_start, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 50 END AS page_end FROM lineitem)"


@query("b11_repair_page_ranges", f"""WITH r AS (SELECT *, coalesce(page_start, page, page_end) AS s, coalesce(page_end, page_start, page) AS e FROM {_RANGES})
SELECT document_id, chunk_index, least(s, e) AS page_start, greatest(s, e) AS page_end, concat_ws(',', CASE WHEN page_start IS NULL AND page_end IS NULL AND page IS NOT NULL THEN 'page_promoted' END,
CASE WHEN page_start IS NULL AND page_end IS NOT NULL THEN 'start_filled' END, CASE WHEN page_end IS NULL AND page_start IS NOT NULL THEN 'end_filled' END, CASE WHEN s > e THEN 'range_swapped' END,
CASE WHEN page IS NOT NULL AND (page_start IS NOT NULL OR page_end IS NOT NULL) THEN 'page_dropped' END) AS diagnostics FROM r""")
def b11(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 40).alias("page"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey") % 50).alias("page_start"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 50).alias("page_end"),
    )
    return B.repair_page_ranges(rows).select("document_id", "chunk_index", "page_start", "page_end", F.array_join("diagnostics", ",").alias("diagnostics"))


@query("b12_evidence_context", f"""WITH {CHUNKS} SELECT document_id, chunk_index, source || CASE WHEN line > 1 THEN ' > line ' || line ELSE '' END || ' > ' || lang AS breadcrumb FROM chunks c JOIN documents ON doc_id = document_id""")
def b12(spark, d):
    rows = chunks(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", "lang"), "document_id")
    path = F.when(F.col("line") > 1, F.concat(F.lit("line "), F.col("line").cast("string"))).otherwise("")
    return rows.select("document_id", "chunk_index", T.breadcrumb(F.col("source"), path, F.col("lang")).alias("breadcrumb"))


@query("b13_prefixed_embedding_text", """SELECT doc_id, CASE WHEN text LIKE '[Context:%' THEN text ELSE '[Context: ' || source || ' > ' || lang || ']' || chr(10) || text END AS embedding_text FROM documents""")
def b13(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", B.prefixed_text(F.col("text"), T.breadcrumb(F.col("source"), F.col("lang"))).alias("embedding_text"))


_REDACTED = "text"
for _name, _pattern in T.REDACTIONS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '[REDACTED:{_name}]', 'g')"


@query("b14_redact", f"SELECT doc_id, md5({_REDACTED}) AS redacted_md5, length({_REDACTED}) AS n_chars FROM documents")
def b14(spark, d):
    safe = T.redacted(F.col("text"))
    return table(spark, d, "documents").select("doc_id", safe.alias("r")).select("doc_id", F.md5("r").alias("redacted_md5"), F.char_length("r").cast("long").alias("n_chars"))


@query("b14_redaction_matches", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, len(regexp_extract_all(text, '{p}')) AS matches FROM documents WHERE regexp_matches(text, '{p}')" for n, p in T.REDACTIONS))
def b14m(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.redaction_hits(F.col("text"))).alias("h")).select("doc_id", "h.rule", F.col("h.matches").cast("long").alias("matches"))


@query("b15_binary_like_filter", "SELECT doc_id FROM documents WHERE NOT contains(text, chr(0)) AND len(regexp_extract_all(text, '[\\x{FFFD}\\x01-\\x08\\x0e-\\x1f]')) <= greatest(3, length(text) // 100)")
def b15(spark, d):
    return table(spark, d, "documents").filter(~T.binary_like(F.col("text"))).select("doc_id")


@query("b16_sample_pages", f"""WITH {CHUNKS}, n AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM chunks)
SELECT document_id, chunk_index FROM n WHERE chunk_index IN (0, 1, n // 2, n - 1)""")
def b16(spark, d):
    return C.sample_positions(chunks(spark, d), 4).select("document_id", "chunk_index")


@query("b17_policy_filter", f"""WITH {CHUNKS} SELECT document_id, chunk_index FROM chunks LEFT JOIN labels ON doc_id = document_id WHERE coalesce(quality = 1, true)""")
def b17(spark, d):
    policy = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("index_vector"))
    return C.policy_filter(chunks(spark, d).join(policy, "document_id", "left"), "index_vector").select("document_id", "chunk_index")


_STOP = ", ".join(f"'{t}'" for t in T.STOP_TERMS)


@query("b18_search_terms", f"""SELECT item_id, t AS term FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM benchmark) WHERE t NOT IN ({_STOP})""")
def b18(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.search_terms(F.col("text"))).alias("term"))


@query("b19_prefilter_terms", f"""WITH t AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)),
f AS (SELECT item_id, term, min(p) AS p FROM t WHERE length(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY ALL)
SELECT item_id, term FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p) AS r FROM f) WHERE r <= 5""")
def b19(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.prefilter_terms(F.col("text"))).alias("term"))


@query("b20_classify_domain", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'license|gnu|apache') THEN 'legal' WHEN regexp_matches(text, '[{};=]{2}') THEN 'code' WHEN contains(text, ' | ') THEN 'multimodal'
WHEN regexp_matches(text, '[0-9]{4}') THEN 'reference_heavy' ELSE 'general' END AS domain FROM documents""")
def b20(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.domain_of(F.col("text")).alias("domain"))


@query("b21_classify_query", """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]+:[0-9]+') THEN 'reference' WHEN regexp_matches(lower(text), '"[^"]+"') THEN 'phrase' WHEN len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+')) <= 3 THEN 'keyword'
WHEN contains(text, '?') THEN 'question' ELSE 'semantic' END AS intent FROM conversations WHERE role = 'user'""")
def b21(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", Q.query_intent(F.col("text")).alias("intent"))


@query("b22_expand_query", """WITH k(keyword, expansion) AS (VALUES ('that', 'which'), ('the', 'la'), ('was', 'is'), ('erthe', 'earth'))
SELECT item_id, expansion FROM benchmark JOIN k ON contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || keyword || ' ')""")
def b22(spark, d):
    words = spark.createDataFrame([("that", "which"), ("the", "la"), ("was", "is"), ("erthe", "earth")], "keyword string, expansion string")
    return Q.expand_queries(table(spark, d, "benchmark").select("item_id", "text"), words)


@query("b23_plan_lanes", """WITH lanes(lane, priority) AS (VALUES ('reference', 1), ('lexical', 2), ('vector', 3), ('graph', 4)), q AS (SELECT item_id, regexp_matches(text, '[0-9]') AS has_ref, length(text) AS n FROM benchmark)
SELECT item_id, lane, CAST(priority AS INTEGER) AS priority, CASE WHEN lane = 'reference' AND has_ref THEN 'required' WHEN lane = 'reference' THEN 'skipped' WHEN lane = 'graph' AND n < 150 THEN 'skipped' ELSE 'planned' END AS status,
CASE WHEN lane = 'reference' AND has_ref THEN 'query names a reference' WHEN lane = 'reference' THEN 'no reference in query' WHEN lane = 'graph' AND n < 150 THEN 'graph not ready' ELSE 'ready' END AS reason FROM q, lanes""")
def b23(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.col("text").rlike("[0-9]").alias("has_reference"), (F.char_length("text") >= 150).alias("graph_ready"))
    return Q.plan_lanes(q, ["reference", "lexical", "vector", "graph"])


@query("b24_source_labels", f"""WITH {CHUNKS} SELECT document_id, chunk_index, coalesce(source, 'unknown') || ' · line ' || line AS label FROM chunks LEFT JOIN documents ON doc_id = document_id""")
def b24(spark, d):
    return C.source_labels(chunks(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename")))


_POLICY = "(VALUES ('short_chunk', 'table', 'info', true), ('short_chunk', NULL, 'warning', false), (NULL, 'table', 'warning', false), ('symbol_noise', 'text', 'error', false)) AS policy(code, block_type, severity, suppressed)"


@query("b25_classify_warnings", f"""WITH {WARNINGS} SELECT w.document_id, w.chunk_index, w.code, coalesce(a.severity, b.severity, c.severity, 'warning') AS severity, coalesce(a.suppressed, b.suppressed, c.suppressed, false) AS suppressed
FROM warnings w LEFT JOIN {_POLICY.replace('AS policy', 'AS a')} ON a.code = w.code AND a.block_type = w.block_type LEFT JOIN {_POLICY.replace('AS policy', 'AS b')} ON b.code IS NULL AND b.block_type = w.block_type
LEFT JOIN {_POLICY.replace('AS policy', 'AS c')} ON c.code = w.code AND c.block_type IS NULL""")
def b25(spark, d):
    rows = [("short_chunk", "table", "info", True), ("short_chunk", None, "warning", False), (None, "table", "warning", False), ("symbol_noise", "text", "error", False)]
    policy = spark.createDataFrame(rows, "code string, block_type string, severity string, suppressed boolean")
    return B.classify_warnings(warnings(spark, d), policy).select("document_id", "chunk_index", "code", "severity", "suppressed")


@query("b26_normalise_blocks", f"""WITH {BLOCKS} SELECT document_id, block_index, CASE WHEN tag IN ('h1', 'h2', 'p', 'title') THEN text WHEN tag = 'td' AND text <> '' THEN '[recovered] ' || text ELSE '' END AS text,
CASE WHEN tag IN ('h1', 'h2', 'p', 'title') THEN 'kept' WHEN tag = 'td' AND text <> '' THEN 'recovered' ELSE 'quarantined' END AS action FROM blocks""")
def b26(spark, d):
    rows = blocks(spark, d).withColumn("recovery", F.when((F.col("tag") == "td") & (F.col("text") != ""), F.concat(F.lit("[recovered] "), F.col("text"))))
    return B.normalise_blocks(rows, ["h1", "h2", "p", "title"])


@query("b27_contract_status", """SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]+:[0-9]+') THEN 'compiled_reference_contract' WHEN lang <> 'en' THEN 'metadata_only' ELSE 'generic' END AS contract_status FROM documents""")
def b27(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").rlike("[0-9]+:[0-9]+").alias("has_contract"), (F.col("lang") != "en").alias("has_metadata"))
    return docs.select("doc_id", B.contract_status().alias("contract_status"))


@query("b28_variant_parameters", """SELECT c_custkey, 'k' AS name, CAST(c_custkey % 9 AS BIGINT) AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'k', 10 FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT c_custkey, 'limit', 20 FROM customer UNION ALL SELECT c_custkey, 'own', c_custkey FROM customer WHERE c_custkey % 2 = 0""")
def b28(spark, d):
    own = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("k"), F.col("c_custkey") % 9, F.lit("own"), F.col("c_custkey"))).otherwise(F.create_map().cast("map<string,bigint>"))
    preset = F.create_map(F.lit("k"), F.lit(10).cast("long"), F.lit("limit"), F.lit(20).cast("long"))
    return table(spark, d, "customer").select("c_custkey", F.explode(B.merged_parameters(preset, own)).alias("name", "value"))


@query("a2_read_blocks", f"WITH {BLOCKS} SELECT document_id, block_index, tag AS type, text FROM blocks WHERE document_id % 11 <> 3")
def a2(spark, d):
    """Content lists made of the pages' blocks; those of every eleventh page are cut off, so that they are no JSON."""
    ordered = blocks(spark, d).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("block_index", "tag", "text"))).alias("b"))
    content = F.to_json(F.transform("b", lambda b: F.struct(b["tag"].alias("type"), b["text"].alias("text"))))
    lists = ordered.select("document_id", F.when(F.col("document_id") % 11 == 3, F.substring(content, 1, 20)).otherwise(content).alias("content"))
    return B.read_blocks(lists).select("document_id", "block_index", "type", "text")


@query("c1_markdown_sections", f"""WITH {CHUNKS}, flagged AS (SELECT *, CASE WHEN chunk_index = 0 OR regexp_matches(text, '^(#{{1,4}} |[Pp]age [0-9]+|[0-9]+\\.)') OR length(text) < 25 THEN 1 ELSE 0 END AS starts FROM chunks),
s AS (SELECT *, sum(starts) OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS section FROM flagged)
SELECT document_id, CAST(section AS INTEGER) AS section_index, string_agg(text, chr(10) ORDER BY chunk_index) AS text FROM s GROUP BY ALL""")
def c1(spark, d):
    starts = F.col("text").rlike(r"^(#{1,4} |[Pp]age [0-9]+|[0-9]+\.)") | (F.char_length("text") < 25)
    return C.sections(chunks(spark, d), starts)


_COUNT = "len(regexp_extract_all({}, '[^ \\t\\n\\r\\x0b\\x0c]+'))"


def _folded(target: int, most: int) -> str:
    """Pieces of ``parts (document_id, i, text, n)``, ``i`` from 0, by a recursive fold."""
    fresh = f"f.fill > 0 AND (f.fill >= {target} OR f.fill + o.n > {most})"
    return f"""fold(document_id, i, bin, fill) AS (SELECT document_id, i, 0, n FROM parts WHERE i = 0 UNION ALL
  SELECT f.document_id, o.i, CASE WHEN {fresh} THEN f.bin + 1 ELSE f.bin END, CASE WHEN {fresh} THEN o.n ELSE f.fill + o.n END FROM fold f JOIN parts o ON o.document_id = f.document_id AND o.i = f.i + 1)
SELECT document_id, bin AS piece_index, string_agg(text, chr(10) ORDER BY i) AS text, CAST(sum(n) AS BIGINT) AS n_words FROM fold JOIN parts USING (document_id, i) GROUP BY 1, 2"""


@query("c3_pack_sections", f"WITH RECURSIVE {CHUNKS}, parts AS (SELECT document_id, chunk_index AS i, text, {_COUNT.format('text')} AS n FROM chunks), {_folded(120, 200)}")
def c3(spark, d):
    return C.pack_sections(chunks(spark, d), target_words=120, most_words=200)


@query("c2_hard_split", f"""WITH RECURSIVE split AS (SELECT doc_id AS document_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
sentences AS (SELECT document_id, k, trim(s[k], ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS text FROM (SELECT document_id, s, unnest(range(1, len(s) + 1)) AS k FROM split)),
cut AS (SELECT document_id, k, 0 AS j, text, {_COUNT.format('text')} AS n FROM sentences WHERE text <> '' AND {_COUNT.format('text')} <= 150
  UNION ALL SELECT document_id, k, j, array_to_string(w[j * 150 + 1 : j * 150 + 150], ' '), least(150, len(w) - j * 150) FROM (SELECT document_id, k, w, unnest(range(0, (len(w) - 1) // 150 + 1)) AS j FROM (SELECT document_id, k, regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+') AS w FROM sentences WHERE {_COUNT.format('text')} > 150))),
parts AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY k, j) - 1 AS INTEGER) AS i, text, n FROM cut), {_folded(150, 150)}""")
def c2(spark, d):
    return C.hard_split(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), most_words=150)


@query("c4_chunk_profile", """SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]+:[0-9]+') THEN 'reference' WHEN n_chars > 20000 THEN 'book' WHEN contains(text, ' | ') THEN 'table' ELSE 'generic' END AS profile,
CASE WHEN regexp_matches(text, '[0-9]+:[0-9]+') THEN 500 WHEN n_chars > 20000 THEN 1000 WHEN contains(text, ' | ') THEN 400 ELSE 1000 END AS target_words,
CASE WHEN regexp_matches(text, '[0-9]+:[0-9]+') THEN 900 WHEN n_chars > 20000 THEN 1500 WHEN contains(text, ' | ') THEN 800 ELSE 1500 END AS most_words FROM documents""")
def c4(spark, d):
    return C.chunk_profile(table(spark, d, "documents"))


@query("c5_ordered_text_groups", f"""WITH {BLOCKS}, f AS (SELECT *, CASE WHEN block_index = 0 OR tag IN ('h1', 'h2', 'title') THEN 1 ELSE 0 END AS starts FROM blocks),
g AS (SELECT *, sum(starts) OVER (PARTITION BY document_id ORDER BY block_index) - 1 AS grp FROM f),
o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id, grp ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM g)
SELECT document_id, block_index, CAST(grp AS INTEGER) AS group_index, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + length(text) AS BIGINT) AS char_end FROM o""")
def c5(spark, d):
    return C.ordered_text_groups(blocks(spark, d), F.col("tag").isin("h1", "h2", "title"))


@query("c6_split_reference_units", """WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '[0-9]+', chr(1) || '\\0', 'g'), chr(1)) AS p FROM documents), u AS (SELECT doc_id, unnest(CASE WHEN len(p) > 1 THEN list_concat([p[1] || p[2]], p[3:]) ELSE p END) AS text,
generate_subscripts(CASE WHEN len(p) > 1 THEN list_concat([p[1] || p[2]], p[3:]) ELSE p END, 1) - 1 AS i FROM parts)
SELECT doc_id, CAST(i AS INTEGER) AS unit_index, md5(text) AS text_md5 FROM u""")
def c6(spark, d):
    return C.split_reference_units(table(spark, d, "documents").select("doc_id", "text"), "[0-9]+").select("doc_id", "unit_index", F.md5("text").alias("text_md5"))


@query("c8_title_candidate", f"""WITH {BLOCKS}, t AS (SELECT document_id, string_agg(text, ' ' ORDER BY block_index) AS title FROM blocks WHERE block_index < 2 GROUP BY 1)
SELECT document_id, title FROM t WHERE len(string_split(title, ' ')) <= 18 AND NOT regexp_matches(title, '^(#|[0-9]+\\.)')""")
def c8(spark, d):
    return C.title_candidates(blocks(spark, d))


@query("c9_split_metadata", f"""WITH {CHUNKS} SELECT document_id, chunk_index, CAST(row_number() OVER (PARTITION BY document_id ORDER BY line) - 1 AS INTEGER) AS split_index, count(*) OVER (PARTITION BY document_id) AS split_count FROM chunks""")
def c9(spark, d):
    return C.split_metadata(chunks(spark, d)).select("document_id", "chunk_index", "split_index", "split_count")
