"""The queries of this folder, as ``__spark_entry__.py`` registers them, and their DuckDB SQL."""

from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import chat_format, embedding_dedup, filter_audit, language_id, lexical_search, licenses, line_dedup, minhash, mixing, packing, quality_cnn, quality_rules, vector_search
from siftwell.llm.common import table
from siftwell.llm.sampling import id_crc


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learn_and_identify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weight_col=mixing.length_odds())
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_cnn.score(docs, quality_cnn.learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(id_crc("doc_id"), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_turns(rows))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_vector_search": op6_vector_search,
    "op7_license_scan": op7_license_scan,
    "op8_chat_format": op8_chat_format,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_ranked_search": op13_ranked_search,
}

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP_LIST = ", ".join("'" + w + "'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
_CONTROL = "|".join(re.sub(r"([\[\]|/])", r"\\\1", c) for c in chat_format.CONTROL)

_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op8_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(25 + length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op10_quality_rules": f"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT rid, g FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM g JOIN again USING (rid, g) CROSS JOIN (VALUES (0), (1), (2)) AS s(k) GROUP BY 1),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
m AS (SELECT doc_id, len(w) AS n_words, length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS word_chars, len(regexp_extract_all(text, '[{quality_rules.SYMBOLS}]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_exclaim,
  len(list_intersect(list_distinct(w), [{_STOP_LIST}])) AS n_stop, len(list_filter(w, lambda x: x IN ({_STOP_LIST}))) AS n_stop_words FROM w JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_symbols <= 0.1 * n_words AND word_chars >= 2.5 * n_words AND word_chars <= 12 * n_words
  AND n_upper <= 0.3 * word_chars AND n_exclaim <= 0.3 * n_words AND n_stop_words >= 0.02 * n_words AND n_stop >= 2 AND n_dup_lines <= 0.5 * n_lines AS kept FROM b""",
    "op11_embedding_dedup": """WITH RECURSIVE u AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM u WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.rid AS a, b.rid AS b, b.vec_id AS id FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9),
reach AS (SELECT rid, vec_id AS id FROM ok UNION SELECT links.a, reach.id FROM links JOIN reach ON links.b = reach.rid),
n AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY 1), least AS (SELECT rid, min(id) AS c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(vec_id = coalesce(c, vec_id), true) AS kept FROM u LEFT JOIN n USING (rid) LEFT JOIN least USING (rid)""",
    "op12_filter_audit": f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
first AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY 1),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
f AS (SELECT part, doc_id IN (FROM good) AS good, doc_id IN (FROM bad) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
  100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails FROM d JOIN first USING (text)),
l AS (SELECT x, i FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS t(x, i)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, o, unnest(range(1, 6)) AS step FROM o),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2),
j AS (SELECT *, fails[o[step]] AS own, list_bool_or([false] || [fails[x] for x in o[:step - 1]]) AS before, len([x for x in fails if x]) = 1 AS single FROM cells, s),
r AS (SELECT part, filter_order, step, any_value(o[step]) AS filter, sum(n) FILTER (WHERE NOT own AND NOT before) AS kept, sum(n) FILTER (WHERE own AND NOT before) AS removed,
  sum(n) FILTER (WHERE own AND before) AS redundant, sum(n) FILTER (WHERE own AND single) AS unique_fails, sum(good) FILTER (WHERE own AND NOT before) AS good_lost,
  sum(toxic) FILTER (WHERE own AND NOT before) AS toxic_lost FROM j GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley FROM r""",
    "op13_ranked_search": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_ASCII_LOWER}, '{_TERM}') AS w FROM documents),
t AS (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
tf AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY rid, term),
g AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
df AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM g) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_ASCII_LOWER}, '{_TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::BIGINT AS score FROM q JOIN df USING (term) JOIN tf USING (term), g GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 50""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
