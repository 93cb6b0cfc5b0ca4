"""Queries of scoring, fusion, reranking and answers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import query_text as Q
from siftwell.operators import ranking as R
from siftwell.operators import signals as S
from siftwell.plans.inputs import table
from siftwell.plans.text_queries import _STOP

QUERIES: dict = {}
RARE, LANE, FUSED = 6, 50, 20


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


def _inputs(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return queries, table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")


def retrieval(spark, d):
    """The flagship: passages as queries, two lanes over all documents, fused by reciprocal rank."""
    queries, docs = _inputs(spark, d)
    terms = R.term_lane(R.rare_terms(queries, docs, RARE), docs, LANE)
    return R.fuse({"terms": terms, "passages": R.passage_lane(queries, docs, LANE)}, FUSED)


TERM_LANE = f"""qt AS (SELECT item_id AS query_id, term FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark) WHERE term NOT IN ({_STOP})),
dt AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents) WHERE term IN (SELECT term FROM qt)),
df AS (SELECT term, count(*) AS n FROM dt GROUP BY 1),
rare AS (SELECT query_id, term, n FROM (SELECT query_id, term, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(n, 0), term) AS r FROM qt LEFT JOIN df USING (term)) WHERE r <= {RARE}),
ts AS (SELECT query_id, doc_id AS document_id, round(count(*) / any_value(asked), 9) AS score FROM rare JOIN dt USING (term) JOIN (SELECT query_id, count(*) AS asked FROM rare GROUP BY 1) USING (query_id) GROUP BY 1, 2),
term_lane AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM ts) WHERE rank <= {LANE})"""


def _windows(t: str, key: str, name: str) -> str:
    return f"""{name} AS (SELECT DISTINCT k, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) AS i FROM (SELECT {key} AS k, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {t})))"""


PASSAGE_LANE = f"""{_windows("benchmark", "item_id", "qw")}, {_windows("documents", "doc_id", "dw")},
ps AS (SELECT qw.k AS query_id, dw.k AS document_id, count(*)::DOUBLE AS score FROM qw JOIN dw USING (s) GROUP BY 1, 2),
passage_lane AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM ps) WHERE rank <= {LANE})"""
FUSION = f"""{TERM_LANE}, {PASSAGE_LANE}, u AS (SELECT query_id, document_id, rank, 'terms' AS lane FROM term_lane UNION ALL SELECT query_id, document_id, rank, 'passages' FROM passage_lane),
fs AS (SELECT query_id, document_id, round(sum(1 / (60 + rank)), 9) AS score, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes FROM u GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM fs) WHERE rank <= {FUSED})"""


@query("k2_rare_terms", f"WITH {TERM_LANE} SELECT * FROM rare")
def k2r(spark, d):
    queries, docs = _inputs(spark, d)
    return R.rare_terms(queries, docs, RARE)


@query("k8_lane_rank_terms", f"WITH {TERM_LANE} SELECT * FROM term_lane")
def k8t(spark, d):
    queries, docs = _inputs(spark, d)
    return R.term_lane(R.rare_terms(queries, docs, RARE), docs, LANE)


@query("k8_lane_rank_passages", f"WITH {PASSAGE_LANE} SELECT * FROM passage_lane")
def k8p(spark, d):
    queries, docs = _inputs(spark, d)
    return R.passage_lane(queries, docs, LANE)


@query("k11_rrf_fuse", f"WITH {FUSION} SELECT * FROM fused")
def k11(spark, d):
    return retrieval(spark, d)


def _pairs(spark, d):
    queries, docs = _inputs(spark, d)
    fused = retrieval(spark, d)
    return fused.join(queries.withColumnRenamed("text", "query_text"), "query_id").join(docs, "document_id")


TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+')), lambda x: x NOT IN (" + _STOP + "))"
PAIRS = f"""{FUSION}, pairs AS (SELECT f.*, b.text AS query_text, d.text AS text, {TOKENS.format("b.text")} AS q, {TOKENS.format("d.text")} AS c FROM fused f JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = document_id)"""


@query("k2_term_coverage_density", f"""WITH {PAIRS} SELECT query_id, document_id, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, c)) / len(q), 9) ELSE 0 END AS coverage, CASE WHEN len(c) > 0 THEN round(len(list_intersect(q, c)) / len(c), 9) ELSE 0 END AS density FROM pairs""")
def k2(spark, d):
    return R.coverage_density(_pairs(spark, d)).select("query_id", "document_id", "coverage", "density")


@query("k3_phrase_score", f"""WITH {PAIRS}, h AS (SELECT query_id, document_id, lower(text) AS t, CASE WHEN query_id % 2 = 0 THEN lower(query_text) ELSE 'find "' || array_to_string((string_split(lower(query_text), ' '))[1:5], ' ') || '" in "a b"' END AS asked FROM pairs),
p AS (SELECT *, list_filter(regexp_extract_all(asked, '"([^"]+)"', 1), lambda x: len(string_split(x, ' ')) >= 4) AS phrases FROM h)
SELECT query_id, document_id, CASE WHEN contains(t, asked) THEN 8 WHEN len(list_filter(phrases, lambda x: contains(t, x))) > 0 THEN 24 ELSE 0 END AS phrase FROM p""")
def k3(spark, d):
    """Every other passage is asked for by its first five words, in quotes."""
    words = F.array_join(F.slice(F.split(F.lower("query_text"), " "), 1, 5), " ")
    asked = F.when(F.col("query_id") % 2 == 0, F.col("query_text")).otherwise(F.concat(F.lit('find "'), words, F.lit('" in "a b"')))
    return _pairs(spark, d).select("query_id", "document_id", R.phrase_score(asked, F.col("text")).alias("phrase"))


def _signals(spark, d):
    """``head``: the overlap with the title, which is the first line of a text."""
    rows = R.coverage_density(_pairs(spark, d)).withColumn("phrase", R.phrase_score(F.col("query_text"), F.col("text")))
    overlap = R.capped_overlap(T.search_terms(F.col("query_text")), T.search_terms(F.get(F.split("text", "\n", -1), F.lit(0))), 2.0, 12.0)
    return rows.withColumn("head", overlap)


SIGNALS = f"""{PAIRS}, s0 AS (SELECT *, {TOKENS.format("string_split(text, chr(10))[1]")} AS h FROM pairs),
signals AS (SELECT query_id, document_id, rank, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, c)) / len(q), 9) ELSE 0 END AS coverage, CASE WHEN len(c) > 0 THEN round(len(list_intersect(q, c)) / len(c), 9) ELSE 0 END AS density,
CASE WHEN contains(lower(text), lower(query_text)) THEN 8 ELSE 0 END AS phrase, least(12.0, len(list_intersect(q, h)) * 2.0)::DOUBLE AS head FROM s0)"""


@query("k1_hybrid_score", f"WITH {SIGNALS} SELECT query_id, document_id, round(coverage * 10 + density * 2 + phrase + head, 6) AS score FROM signals")
def k1(spark, d):
    return _signals(spark, d).select("query_id", "document_id", R.hybrid_score({"coverage": 10, "density": 2, "phrase": 1, "head": 1}).alias("score"))


@query("k4_head_boost", f"WITH {SIGNALS} SELECT query_id, document_id, head FROM signals")
def k4(spark, d):
    return _signals(spark, d).select("query_id", "document_id", "head")


@query("k7_explain_scores", f"""WITH {SIGNALS}, l AS (SELECT query_id, document_id, unnest([coverage, density, phrase, head]) AS v, unnest(['coverage', 'density', 'phrase', 'head']) AS s FROM signals)
SELECT query_id, document_id, coalesce(string_agg(s, ',' ORDER BY round(v, 6) DESC, s) FILTER (WHERE round(v, 6) > 0), '') AS explanation FROM l GROUP BY 1, 2""")
def k7(spark, d):
    return _signals(spark, d).select("query_id", "document_id", R.explain(["coverage", "density", "phrase", "head"]).alias("explanation"))


_PASSES = "c AS (SELECT user_id AS query_id, event_id AS candidate_id, event_id * 7 % 40 AS chunk_id, CAST(event_id % 5 AS INTEGER) AS pass_order, value > 90 AS direct FROM events)"


def _passes(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("candidate_id"), (F.col("event_id") * 7 % 40).alias("chunk_id"), (F.col("event_id") % 5).cast("int").alias("pass_order"), (F.col("value") > 90).alias("direct"),
    )


@query("k9_direct_evidence_stop", f"""WITH {_PASSES}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pass_order, candidate_id) AS r FROM c) WHERE r = 1),
s AS (SELECT query_id, min(pass_order) FILTER (WHERE direct) AS stop FROM f GROUP BY 1) SELECT query_id, candidate_id, chunk_id, pass_order, direct FROM f JOIN s USING (query_id) WHERE stop IS NULL OR pass_order <= stop""")
def k9(spark, d):
    return R.direct_evidence_stop(_passes(spark, d))


@query("k12_merge_duplicates", """WITH c AS (SELECT user_id AS query_id, event_id AS candidate_id, event_id * 7 % 40 AS chunk_id, value AS score, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS title, event_type AS reason FROM events)
SELECT query_id, chunk_id, arg_max(candidate_id, (score, -candidate_id)) AS candidate_id, max(score) AS score, coalesce(first(title ORDER BY score DESC, candidate_id), max(title)) AS title, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM c GROUP BY ALL""")
def k12(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("candidate_id"), (F.col("event_id") * 7 % 40).alias("chunk_id"), F.col("value").alias("score"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("title"), F.col("event_type").alias("reason"))
    return R.merge_duplicates(rows)


@query("k13_query_aware_order", """WITH f AS (SELECT o_custkey AS query_id, o_orderkey % 3 AS document_id, o_totalprice AS score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders),
t AS (SELECT *, count(DISTINCT document_id) FILTER (WHERE rank <= 3) OVER q AS n_top, max(document_id) FILTER (WHERE rank = 1) OVER q AS lead_doc, max(score) FILTER (WHERE rank = 1) OVER q AS lead_score FROM f WINDOW q AS (PARTITION BY query_id)),
l AS (SELECT *, min(rank) FILTER (WHERE document_id <> lead_doc AND score >= 0.65 * lead_score) OVER (PARTITION BY query_id) AS lift FROM t)
SELECT query_id, document_id, score, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n_top = 1 AND rank = lift THEN 1.5 ELSE rank END) AS INTEGER) AS place FROM l""")
def k13(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 3).alias("document_id"), F.col("o_totalprice").alias("score"), "o_orderkey")
    ranked = R.top_k(rows, ["query_id"], [F.desc("score"), "o_orderkey"], 1 << 30).drop("o_orderkey")
    return R.query_aware_order(ranked)


@query("k14_apply_rerank", f"""WITH {FUSION}, s AS (SELECT doc_id AS document_id, n_chars % 97 AS relevance FROM documents WHERE doc_id % 4 <> 0),
j AS (SELECT f.query_id, f.document_id, f.rank, relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC NULLS LAST, rank) AS INTEGER) AS new_rank FROM fused f LEFT JOIN s USING (document_id))
SELECT *, CASE WHEN relevance IS NULL THEN 'missing' ELSE 'ranked' END AS status, rank - new_rank AS delta FROM j""")
def k14(spark, d):
    fused = retrieval(spark, d).select("query_id", "document_id", "rank")
    scores = table(spark, d, "documents").filter("doc_id % 4 != 0").select(F.col("doc_id").alias("document_id"), (F.col("n_chars") % 97).alias("relevance"))
    return R.apply_rerank(fused, fused.select("query_id", "document_id").join(scores, "document_id"))


@query("k16_diversify", f"""WITH RECURSIVE {PAIRS}, o AS (SELECT query_id, document_id, rank, c, rank = 7 AS must_keep, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM pairs),
fold(query_id, i, chosen, ranks, ids) AS (SELECT DISTINCT query_id, 0::BIGINT, []::VARCHAR[][], []::INTEGER[], []::BIGINT[] FROM o
  UNION ALL SELECT f.query_id, f.i + 1, CASE WHEN takes THEN list_append(f.chosen, o.c) ELSE f.chosen END, CASE WHEN takes THEN list_append(f.ranks, o.rank) ELSE f.ranks END, CASE WHEN takes THEN list_append(f.ids, o.document_id) ELSE f.ids END
  FROM fold f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1, LATERAL (SELECT o.must_keep OR (len(f.chosen) < 5 AND len(list_filter(f.chosen, lambda x: len(list_intersect(x, o.c)) > 0 AND len(list_intersect(x, o.c)) >= 0.65 * len(list_distinct(list_concat(x, o.c))))) = 0) AS takes))
SELECT query_id, CAST(p - 1 AS INTEGER) AS place, ids[p] AS document_id, ranks[p] AS rank FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS p FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1))""")
def k16(spark, d):
    rows = _pairs(spark, d).select("query_id", "document_id", "rank", "text", (F.col("rank") == 7).alias("must_keep"))
    return R.diversify(rows, 5)


@query("k18_graph_seeds", f"""WITH {FUSION} SELECT query_id, document_id, CAST(place AS INTEGER) AS place FROM (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM fused LEFT JOIN labels ON doc_id = document_id WHERE coalesce(quality = 1, true)) WHERE place <= 5""")
def k18(spark, d):
    policy = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("ok"))
    allowed = retrieval(spark, d).join(policy, "document_id", "left").filter(F.coalesce("ok", F.lit(True)))
    return R.top_k(allowed, ["query_id"], ["rank"], 5, "place").select("query_id", "document_id", "place")


def _tokens(t: str) -> str:
    """Estimated tokens of a text in SQL."""
    return f"""greatest(len(regexp_extract_all({t}, '[^ \\t\\n\\r\\x0b\\x0c]+')), length({t}) // 4, CAST(floor(len(regexp_extract_all({t}, '[\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}\\x{{08A0}}-\\x{{08FF}}]')) * 0.75) AS BIGINT), len(regexp_extract_all({t}, '[{{}}()\\[\\];=<>/*+\\\\-]')) // 2, 1)"""


_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
BUDGET, HARD = 1500, 400
CONTEXT = f"""{PAIRS}, e AS (SELECT p.query_id, p.document_id, p.rank, md5(p.text) AS key, p.text, contains(p.text, query_text) AS direct, CASE WHEN toxic = 1 THEN 'quality_policy_block' END AS policy, {_tokens("p.text")} AS tokens FROM pairs p LEFT JOIN labels ON doc_id = p.document_id),
g AS (SELECT *, tokens > {HARD} AS cut, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: x <> '')[1] AS paragraph FROM e),
h AS (SELECT *, CASE WHEN NOT cut THEN text WHEN paragraph IS NOT NULL AND {_tokens("paragraph")} <= {HARD} THEN paragraph ELSE array_to_string((regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+'))[1:{HARD}], ' ') END AS shown FROM g),
o AS (SELECT *, {_tokens("shown")} AS own, row_number() OVER (PARTITION BY query_id ORDER BY direct DESC, rank) AS i FROM h),
fold(query_id, i, seen, used, document_id, rank, kept, reason, direct, tokens, shown) AS (SELECT DISTINCT query_id, 0::BIGINT, []::VARCHAR[], 0::BIGINT, NULL::BIGINT, NULL::INTEGER, false, NULL::VARCHAR, false, 0::BIGINT, NULL::VARCHAR FROM o
  UNION ALL SELECT f.query_id, f.i + 1, CASE WHEN takes THEN list_append(f.seen, o.key) ELSE f.seen END, CASE WHEN takes THEN f.used + o.own ELSE f.used END, o.document_id, o.rank, takes,
    CASE WHEN dup THEN 'duplicate' WHEN o.policy IS NOT NULL THEN o.policy WHEN over AND NOT o.direct THEN 'token_budget' WHEN over THEN 'direct_over_budget' WHEN o.cut THEN 'truncated' END, o.direct, o.own, o.shown
  FROM fold f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1, LATERAL (SELECT list_contains(f.seen, o.key) AS dup, f.used + o.tokens > {BUDGET} AS over) x, LATERAL (SELECT NOT dup AND o.policy IS NULL AND (o.direct OR NOT over) AS takes) y)"""


def _context(spark, d):
    policy = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 1, "quality_policy_block").alias("policy"))
    rows = _pairs(spark, d).join(policy, "document_id", "left")
    return R.assemble_context(rows.select("query_id", "rank", "document_id", F.md5("text").alias("key"), "text", F.contains("text", F.col("query_text")).alias("direct"), "policy"), BUDGET, HARD)


@query("k20_assemble_context", f"WITH RECURSIVE {CONTEXT} SELECT query_id, rank, document_id, kept, reason, tokens, md5(shown) AS text_md5 FROM fold WHERE i > 0")
def k20(spark, d):
    return _context(spark, d).select("query_id", "rank", "document_id", "kept", "reason", "tokens", F.md5("text").alias("text_md5"))


@query("k20_context_status", f"""WITH RECURSIVE {CONTEXT} SELECT query_id, count(*) FILTER (WHERE kept) AS evidence, coalesce(sum(tokens) FILTER (WHERE kept), 0)::BIGINT AS tokens, count(*) FILTER (WHERE NOT kept) AS dropped,
CASE WHEN bool_or(kept AND direct) THEN 'grounded' ELSE 'insufficient_evidence' END AS status FROM fold WHERE i > 0 GROUP BY 1""")
def k20_status(spark, d):
    return R.context_status(_context(spark, d))


@query("q1_parse_query_references", "SELECT conv_id, turn, '[' || r || ']' AS reference FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[0-9]+:[0-9]+'))) AS r FROM conversations)")
def q1(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(Q.references_in(F.col("text"))).alias("reference"))


@query("q2_extract_word_targets", """WITH t AS (SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+')) = 1 THEN [lower(trim(text))] ELSE regexp_extract_all(lower(text), '\\b(?:word|term) ([a-z]+)', 1) END AS w FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, unnest(w) AS target, generate_subscripts(w, 1) AS i FROM t), f AS (SELECT conv_id, turn, target, min(i) AS i FROM p GROUP BY ALL)
SELECT conv_id, turn, target FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM f) WHERE r <= 5""")
def q2(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.explode(Q.word_targets(F.col("text"))).alias("target"))


@query("q3_verify_hypotheses", f"""WITH {PAIRS}, targets AS (SELECT query_id, term AS target FROM rare), w AS (SELECT query_id, document_id, rank, unnest(c) AS target FROM pairs), f AS (SELECT query_id, target, arg_min(document_id, rank) AS document_id FROM w GROUP BY 1, 2)
SELECT query_id, target, document_id, CASE WHEN document_id IS NULL THEN 'not_found' ELSE 'confirmed' END AS status FROM targets LEFT JOIN f USING (query_id, target)""")
def q3(spark, d):
    queries, docs = _inputs(spark, d)
    targets = R.rare_terms(queries, docs, RARE).select("query_id", F.col("term").alias("target"))
    return R.verify_targets(targets, _pairs(spark, d).select("query_id", "rank", "document_id", "text"))


@query("q4_evidence_first_answer", f"""WITH {FUSION}, e AS (SELECT query_id, rank, '[S' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || '] ' || substr(trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')), 1, 520) AS line, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM fused JOIN documents ON doc_id = document_id)
SELECT query_id, string_agg(line, chr(10) ORDER BY n) AS answer FROM e WHERE n <= 5 GROUP BY 1""")
def q4(spark, d):
    return R.evidence_answer(_pairs(spark, d).select("query_id", "rank", "text"))


@query("q5_ground_answers", """WITH a AS (SELECT conv_id * 1000 + turn AS query_id, text || CASE WHEN turn % 3 = 0 THEN ' [S1] [S9]' WHEN turn % 3 = 1 THEN ' [S2]' ELSE '' END AS answer, CAST(turn % 4 AS INTEGER) AS available FROM conversations WHERE role = 'assistant'),
c AS (SELECT query_id, available, list_distinct(list_transform(regexp_extract_all(answer, '\\[S([0-9]+)\\]', 1), lambda x: CAST(x AS INTEGER))) AS cited FROM a), u AS (SELECT *, list_filter(cited, lambda x: x > available) AS bad FROM c)
SELECT query_id, CAST(len(cited) AS INTEGER) AS n_cited, CAST(len(bad) AS INTEGER) AS n_unknown, CASE WHEN len(bad) > 0 THEN 'unknown_citation' WHEN len(cited) = 0 AND available > 0 THEN 'uncited' ELSE 'grounded' END AS status FROM u""")
def q5(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    mark = F.when(F.col("turn") % 3 == 0, " [S1] [S9]").when(F.col("turn") % 3 == 1, " [S2]").otherwise("")
    return R.ground_answers(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.col("text"), mark).alias("answer"), (F.col("turn") % 4).cast("int").alias("available")))


#: Metadata of documents: the first line is the title, language and source are tag and field, the last line is the layout's
#: text, and terms of the passage count (in alphabetical order); every passage asks "how many", and names a term of its own as reference.
_META = """meta AS (SELECT doc_id AS document_id, string_split(text, chr(10))[1] AS title, lang, source, string_split(text, chr(10))[-1] AS layout FROM documents),
sp AS (SELECT p.query_id, p.document_id, 'how many ' || CASE WHEN p.query_id % 2 = 0 THEN lang || ' ' ELSE '' END || p.query_text || CASE WHEN p.query_id % 3 = 0 THEN ' ' || coalesce(source, '') ELSE '' END AS query_text, p.text, title, lang, source, layout FROM pairs p JOIN meta USING (document_id))"""
_SW = r"list_filter(list_sort(list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'))), lambda x: x NOT IN (" + _STOP + "))"
_SIGNED = f"""{_META}, st AS (SELECT *, lower(trim(query_text)) AS q, lower(text) AS t, {_SW.format("query_text")} AS qt, {_SW.format("text")} AS ct, {_SW.format("title")} AS tt, {_SW.format("layout")} AS lt FROM sp),
sg AS (SELECT query_id, document_id, CASE WHEN contains(t, q) THEN 8.0 ELSE 0.0 END AS exact_phrase, CASE WHEN len(qt) > 0 AND len(ct) > 0 THEN len(list_intersect(qt, ct)) / len(qt) * 10 ELSE 0 END AS term_coverage, CASE WHEN len(qt) > 0 AND len(ct) > 0 THEN len(list_intersect(qt, ct)) / len(ct) * 2 ELSE 0 END AS semantic_density,
  least(12.0, contains(q, lower(coalesce(lang, chr(1))))::INT + contains(q, lower(coalesce(source, chr(1))))::INT + least(10.0, len(list_intersect(qt, tt)) * 2.0))::DOUBLE AS metadata_boost, least(16.0, len(list_intersect(qt, lt)) * 4.0)::DOUBLE AS layout_context,
  CASE WHEN regexp_matches(t || ' ' || lower(coalesce(title, '')), '\\b[0-9]{{2,}}\\b') AND contains(t || ' ' || lower(coalesce(title, '')), lower(qt[3])) THEN 30.0 ELSE 0.0 END AS answer_bearing_count,
  CASE WHEN list_contains(tt[1:3], qt[4]) THEN 100.0 ELSE 0.0 END AS reference_exact, CASE WHEN qt[4] = coalesce(tt[4], '') OR qt[4] = coalesce(tt[5], '') THEN 30.0 ELSE 0.0 END AS neighbor_match FROM st)"""


def _signed(spark, d):
    docs = table(spark, d, "documents")
    lines = F.split("text", "\n", -1)
    meta = docs.select(F.col("doc_id").alias("document_id"), F.get(lines, F.lit(0)).alias("title"), "lang", "source", F.element_at(lines, -1).alias("last"))
    pairs = _pairs(spark, d).select("query_id", "document_id", "query_text", "text").join(meta, "document_id")
    text = F.concat(F.lit("how many "), F.when(F.col("query_id") % 2 == 0, F.concat("lang", F.lit(" "))).otherwise(""), F.col("query_text"), F.when(F.col("query_id") % 3 == 0, F.concat(F.lit(" "), F.coalesce("source", F.lit("")))).otherwise(""))
    pairs = pairs.withColumn("query_text", text)
    own, title = F.array_sort(S.terms(F.col("query_text"))), F.array_sort(S.terms(F.col("title")))
    at = lambda c, k: F.get(c, F.lit(k - 1))
    return S.with_signals(pairs.select(
        "query_id", "document_id", "query_text", "text", "title", F.array("lang").alias("tags"), F.array("source").alias("fields"), F.array("last").alias("layout"), F.array_compact(F.array(at(own, 3))).alias("count_terms"),
        at(own, 4).alias("requested"), F.slice(title, 1, 3).alias("references"), at(title, 4).alias("previous_ref"), at(title, 5).alias("next_ref"),
    ))


@query("k4_boosts", f"WITH {PAIRS}, {_SIGNED} SELECT query_id, document_id, metadata_boost, layout_context, answer_bearing_count FROM sg")
def k4_boosts(spark, d):
    return _signed(spark, d).select("query_id", "document_id", "metadata_boost", "layout_context", "answer_bearing_count")


@query("k1_signal_scores", f"""WITH {PAIRS}, {_SIGNED} SELECT query_id, document_id, reference_exact, neighbor_match, exact_phrase, round(term_coverage, 9) AS term_coverage, round(semantic_density, 9) AS semantic_density,
round(reference_exact + neighbor_match + exact_phrase + term_coverage * 0.5 + semantic_density + metadata_boost * 2 + layout_context + answer_bearing_count, 6) AS score FROM sg""")
def k1_scores(spark, d):
    score = S.weighted_score({"term_coverage": 0.5, "metadata_boost": 2.0})
    return _signed(spark, d).select("query_id", "document_id", "reference_exact", "neighbor_match", "exact_phrase", F.round("term_coverage", 9).alias("term_coverage"), F.round("semantic_density", 9).alias("semantic_density"), score.alias("score"))


_TOOLS = {"view": "native", "click": "lexical", "error": "graph", "purchase": "reference_exact", "signup": "pgvector"}
_CANDIDATES = """c AS (SELECT user_id AS query_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS list, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank,
  CASE event_type WHEN 'view' THEN 'native' WHEN 'click' THEN 'lexical' WHEN 'error' THEN 'graph' WHEN 'purchase' THEN 'reference_exact' ELSE 'pgvector' END AS tool, event_id % 9 AS tool_rank, event_id AS candidate_id, CASE WHEN event_id % 4 > 0 THEN event_id * 7 % 40 END AS chunk_id, CASE WHEN event_id % 3 > 0 THEN event_id % 10 END AS runtime_id,
  event_id % 5 AS document_id, props AS text, value AS base_score, CASE WHEN event_id % 6 > 0 THEN value / 2 ELSE 0 END AS final_score, list_filter([CASE WHEN value > 60 THEN 'target_phrase' END, CASE WHEN value > 90 THEN 'reference_exact' END, CASE WHEN event_id % 31 = 0 THEN 'reference_hypothesis' END], lambda x: x IS NOT NULL) AS features FROM events),
k AS (SELECT *, coalesce('chunk:' || chunk_id, 'runtime:' || runtime_id, 'text:' || document_id || ':' || sha1(lower(trim(text)))) AS key, CASE WHEN list_contains(features, 'reference_hypothesis') THEN 5 WHEN list_contains(features, 'reference_exact') THEN 100 WHEN list_contains(features, 'target_phrase') THEN 80
  WHEN tool = 'reference_exact' THEN 70 WHEN tool = 'lexical' THEN 60 WHEN tool = 'pgvector' THEN 20 ELSE 10 END AS direct, CASE tool WHEN 'reference_exact' THEN 40 WHEN 'lexical' THEN 35 WHEN 'graph' THEN 30 WHEN 'pgvector' THEN 20 ELSE 10 END AS lane, CASE WHEN final_score <> 0 THEN final_score ELSE base_score END AS own FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY direct DESC, own DESC, lane DESC, tool_rank, list, rank) AS r, sum(1 / (60 + rank)) OVER (PARTITION BY query_id, key) AS rrf FROM k)"""


@query("k11_fuse_candidates", f"""WITH {_CANDIDATES}, t AS (SELECT query_id, key, string_agg(tool, ',' ORDER BY list) AS tools FROM (SELECT query_id, key, tool, min(list) AS list FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN list_contains(features, 'reference_exact') THEN 100.0 WHEN list_contains(features, 'target_phrase') THEN 80.0 ELSE 0.0 END::DOUBLE AS direct_boost, CASE WHEN list_contains(features, 'reference_exact') THEN 'exact_reference_match' WHEN list_contains(features, 'target_phrase') THEN 'target_phrase_match' END AS reason FROM w WHERE r = 1),
s AS (SELECT *, round(rrf + direct_boost, 9) AS score FROM b)
SELECT query_id, key, candidate_id, tools, direct_boost, reason, score, rank::INT AS rank FROM (SELECT s.query_id, s.key, candidate_id, tools, direct_boost, reason, score, row_number() OVER (PARTITION BY s.query_id ORDER BY direct DESC, score DESC, lane DESC, tool_rank, s.key) AS rank FROM s JOIN t ON t.query_id = s.query_id AND t.key = s.key) WHERE rank <= 20""")
def k11_candidates(spark, d):
    from pyspark.sql import Window

    e, i = table(spark, d, "events"), F.col("event_id")
    names = list(_TOOLS)
    features = F.array_compact(F.array(F.when(F.col("value") > 60, F.lit("target_phrase")), F.when(F.col("value") > 90, F.lit("reference_exact")), F.when(i % 31 == 0, F.lit("reference_hypothesis"))))
    rows = e.select(
        F.col("user_id").alias("query_id"), F.array_position(F.array(*map(F.lit, names)), F.col("event_type")).alias("list"), F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")).alias("rank"),
        F.element_at(F.create_map(*(F.lit(x) for pair in _TOOLS.items() for x in pair)), F.col("event_type")).alias("tool"), (i % 9).alias("tool_rank"), i.alias("candidate_id"), F.when(i % 4 > 0, i * 7 % 40).alias("chunk_id"), F.when(i % 3 > 0, i % 10).alias("runtime_id"),
        (i % 5).alias("document_id"), F.col("props").alias("text"), F.col("value").alias("base_score"), F.when(i % 6 > 0, F.col("value") / 2).otherwise(0.0).alias("final_score"), features.alias("features"),
    )
    return R.fuse_candidates(rows, 20).select("query_id", "key", "candidate_id", F.array_join("tools", ",").alias("tools"), "direct_boost", "reason", "score", "rank")


_PLANNED = """r AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_id AS candidate_id, CASE WHEN event_id % 11 > 0 THEN CASE WHEN user_id % 5 = 0 THEN 1 WHEN value > 12 + user_id % 30 THEN user_id ELSE event_id % 4 END END AS document_id, round(value / 10) AS score, event_id % 6 AS tool_rank,
  CASE user_id % 3 WHEN 0 THEN 'comparison' WHEN 1 THEN 'semantic' END AS intent, user_id % 4 AS documents, user_id % 7 AS lim FROM events)"""


@query("k13_order_for_intent", f"""WITH {_PLANNED}, b AS (SELECT *, document_id IS NOT NULL AND row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, rank) = 1 AS best, min(rank) OVER (PARTITION BY query_id, document_id) AS seen FROM r),
n AS (SELECT query_id, count(*) FILTER (WHERE best) AS docs, list(DISTINCT document_id) FILTER (WHERE rank <= greatest(lim, 1) AND document_id IS NOT NULL) AS shown, max(score) FILTER (WHERE rank = 1) AS lead FROM b GROUP BY 1),
m AS (SELECT b.*, documents > 1 AND docs > 1 AND intent IS NOT DISTINCT FROM 'comparison' AS compared, documents > 1 AND docs > 1 AND intent IS DISTINCT FROM 'comparison' AND len(coalesce(shown, [])) <= 1 AND best AND NOT list_contains(coalesce(shown, []), document_id) AND score >= lead * 0.65 AS other FROM b JOIN n USING (query_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, best ORDER BY score DESC, tool_rank, seen) AS head, other AND row_number() OVER (PARTITION BY query_id, other ORDER BY score DESC, tool_rank, seen) = 1 AS lifted FROM m)
SELECT query_id, rank::INT AS rank, candidate_id, document_id, score, tool_rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN compared THEN (NOT best)::INT WHEN rank = 1 THEN 0 WHEN lifted THEN 1 ELSE 2 END, CASE WHEN compared AND best THEN head ELSE rank END)::INT AS place FROM h""")
def k13_intent(spark, d):
    from pyspark.sql import Window

    e, u, i = table(spark, d, "events"), F.col("user_id"), F.col("event_id")
    document = F.when(i % 11 > 0, F.when(u % 5 == 0, F.lit(1).cast("long")).when(F.col("value") > 12 + u % 30, u).otherwise(i % 4))
    ranked = e.select(u.alias("query_id"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"), i.alias("candidate_id"), document.alias("document_id"), F.round(F.col("value") / 10).alias("score"), (i % 6).alias("tool_rank"))
    plans = e.select(u.alias("query_id"), F.when(u % 3 == 0, "comparison").when(u % 3 == 1, "semantic").alias("intent"), (u % 4).alias("documents"), (u % 7).alias("limit")).distinct()
    return R.order_for_intent(ranked, plans)
