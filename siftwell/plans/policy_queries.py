"""Queries of redaction places, reference contracts and search policies, all of whose rules are data."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import arabic as A
from siftwell.functions import matches as M
from siftwell.operators import contracts as K
from siftwell.operators import policies as P
from siftwell.operators import understanding as U
from siftwell.plans.inputs import CHUNKS, chunks, table
from siftwell.plans.ranking_queries import PAIRS, _pairs

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


#: A line of a run's log for each order, with secrets, private hosts and paths made of the order's columns.
_KINDS = [
    "' at 10.' || o_custkey % 300 || '.0.' || o_orderkey % 1000 || ' and localhost'", "' from file:///home/u' || o_custkey || '/f \"/var/x\"'", "' token GHP_' || md5(o_orderpriority || o_orderkey) || ' sk-short'",
    "' Bearer ' || md5('' || o_orderkey) || ' é sk-' || md5('x' || o_orderkey)", "' AKIA' || upper(left(md5('' || o_custkey), 16)) || ' AKIA0'", "' on 172.' || o_orderkey % 40 || '.1.2, 192.168.0.' || o_custkey % 256 || ' [::1]'",
    "' C:\\data\\' || o_orderkey || ' \\\\srv\\share\\' || o_custkey || ' é/tmp/y'",
]
LOG = "log AS (SELECT o_orderkey, 'run ' || o_orderkey || ' ' || o_orderpriority || CASE o_orderkey % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_KINDS)) + " END AS line FROM orders)"
#: The same rules for an engine without look-behind: a letter after a letter or digit is one without a word boundary before it.
_RE2 = [(name, p.replace("(?<![A-Za-z0-9])", r"\b")) for name, p in M.SECRET_RULES]
_RULES = "rules(rule, pattern) AS (VALUES " + ", ".join("('{}', '{}')".format(n, p.replace("'", "''")) for n, p in _RE2) + ")"
_FOUND = LOG + f""", {_RULES}, cut AS (SELECT o_orderkey, rule, regexp_extract_all(line, pattern) AS v, string_split_regex(line, pattern) AS p FROM log, rules),
each AS (SELECT o_orderkey, rule, v, p, unnest(range(1, len(v) + 1)) AS i FROM cut),
found AS (SELECT o_orderkey, rule, v[i] AS value, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::INT AS start FROM each)"""


def log_lines(spark, d):
    o = table(spark, d, "orders")
    s = lambda c: F.col(c).cast("string")
    rest = lambda c, n: (F.col(c) % n).cast("string")
    key, cust = s("o_orderkey"), s("o_custkey")
    kinds = [
        F.concat(F.lit(" at 10."), rest("o_custkey", 300), F.lit(".0."), rest("o_orderkey", 1000), F.lit(" and localhost")), F.concat(F.lit(" from file:///home/u"), cust, F.lit('/f "/var/x"')),
        F.concat(F.lit(" token GHP_"), F.md5(F.concat("o_orderpriority", key)), F.lit(" sk-short")), F.concat(F.lit(" Bearer "), F.md5(key), F.lit(" é sk-"), F.md5(F.concat(F.lit("x"), key))),
        F.concat(F.lit(" AKIA"), F.upper(F.left(F.md5(cust), F.lit(16))), F.lit(" AKIA0")), F.concat(F.lit(" on 172."), rest("o_orderkey", 40), F.lit(".1.2, 192.168.0."), rest("o_custkey", 256), F.lit(" [::1]")),
        F.concat(F.lit(" C:\\data\\"), key, F.lit(" \\\\srv\\share\\"), cust, F.lit(" é/tmp/y")),
    ]
    tail = F.get(F.array(*kinds), (F.col("o_orderkey") % 7).cast("int"))
    return o.select("o_orderkey", F.concat(F.lit("run "), key, F.lit(" "), F.col("o_orderpriority"), tail).alias("line"))


@query("b14_redaction_places", f"WITH {_FOUND} SELECT o_orderkey, rule, start, start + length(value)::INT AS \"end\", value FROM found")
def b14_places(spark, d):
    return log_lines(spark, d).select("o_orderkey", F.explode(M.secret_matches(F.col("line"))).alias("m")).select("o_orderkey", "m.rule", "m.start", "m.end", "m.value")


_REDACTED = "line"
for _name, _pattern in _RE2:
    _REDACTED = "regexp_replace({}, '{}', '[REDACTED:{}]', 'g')".format(_REDACTED, _pattern.replace("'", "''"), _name)


@query("b14_redacted_log", f"""WITH RECURSIVE {_FOUND}, o AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY start, length(value) DESC, rule) AS i FROM found),
fold AS (SELECT o_orderkey, 0::BIGINT AS i, 0 AS upto, 0 AS standing FROM log UNION ALL SELECT f.o_orderkey, f.i + 1, CASE WHEN o.start >= upto THEN o.start + length(o.value)::INT ELSE upto END, standing + (o.start >= upto)::INT FROM fold f JOIN o ON o.o_orderkey = f.o_orderkey AND o.i = f.i + 1),
n AS (SELECT o_orderkey, max(standing) AS standing FROM fold GROUP BY 1)
SELECT o_orderkey, {_REDACTED} AS redacted, standing::INT AS standing FROM log JOIN n USING (o_orderkey)""")
def b14_log(spark, d):
    standing = F.size(M.without_overlaps(M.secret_matches(F.col("line"))))
    return log_lines(spark, d).select("o_orderkey", M.secrets_redacted(F.col("line")).alias("redacted"), standing.alias("standing"))


#: What a customer asks about: each order and its lines, its priority, and one reference in full.
ASKED = """lines AS (SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN ' LINE ' ELSE ' line ' END || l_linenumber, ',' ORDER BY l_linenumber, l_partkey) AS own FROM lineitem GROUP BY 1),
asked AS (SELECT o_custkey AS query_id, string_agg('Order ' || o_orderkey || coalesce(own, '') || ' priority ' || left(o_orderpriority, 1), '; ' ORDER BY o_orderkey) || ' see ' || o_custkey || ':0 and 1:2x' AS text FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY 1)"""
_CONTRACT = [(1, "{order}:{line}", [("primary_anchor", r"priority\s+[0-9]"), ("context_anchor", r"order (?P<order>\d+)"), ("unit_anchor", r"line (?P<line>\d+)")], ["order", "line"], True), (2, "Q{n}", [("primary_anchor", r"order \d")], None, False)]


@query("q1_contract_references", f"""WITH {ASKED}, r AS (SELECT o_custkey AS query_id, 0 AS kind, 0::BIGINT AS a, 0 AS b, o_custkey || ':0' AS reference FROM orders UNION ALL SELECT o_custkey, 0, 1, 0, '1:2x' FROM orders UNION ALL SELECT o_custkey, 1, o_orderkey, 0, 'priority ' || left(o_orderpriority, 1) FROM orders
  UNION ALL SELECT o_custkey, 2, o_orderkey, l_linenumber, o_orderkey || ':' || l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT query_id, reference, min((kind, a, b)) AS first_at FROM r GROUP BY 1, 2) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY first_at))::INT AS place, reference FROM f""")
def q1_contracts(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.concat(F.when(F.col("l_linenumber") % 2 == 0, " LINE ").otherwise(" line "), F.col("l_linenumber").cast("string")).alias("t")).alias("l"))
    lines = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["t"]), ",").alias("own"))
    rows = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    said = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.coalesce("own", F.lit("")), F.lit(" priority "), F.left("o_orderpriority", F.lit(1)))
    asked = rows.groupBy(F.col("o_custkey").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", said.alias("t")))).alias("o"))
    text = F.concat(F.array_join(F.transform("o", lambda x: x["t"]), "; "), F.lit(" see "), F.col("query_id").cast("string"), F.lit(":0 and 1:2x"))
    contracts = K.read_contracts(spark.createDataFrame(_CONTRACT, "contract_id int, template string, anchors array<struct<kind: string, regex: string>>, required array<string>, verified boolean"))
    found = asked.select("query_id", F.posexplode(K.parse_references(text, contracts)).alias("p", "reference"))
    return found.select("query_id", (F.col("p") + 1).alias("place"), "reference")


#: A domain's policy, of the words of each passage: terms, a phrase, vocabulary, aliases; every fourth intent asks nothing of the query.
_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_\x{0600}-\x{06FF}]+')"
POLICY = f"""words AS (SELECT item_id, {_W} AS w FROM benchmark),
intents AS (SELECT item_id AS intent_id, CASE WHEN item_id % 4 = 3 THEN [] ELSE [upper(w[3]), w[4] || '-' || w[5]] END AS query_terms, CASE WHEN item_id % 5 = 4 THEN [] ELSE [w[6], 'k' || item_id] END AS vocabulary, item_id % 3 = 0 AS requires_number, (1 + item_id % 4)::DOUBLE AS boost FROM words),
aliases AS (SELECT w[2] AS term, w[3] AS alias FROM words), vocabulary AS (SELECT 'K' || item_id AS key, w[8] || ' ' || w[9] AS term FROM words)"""


def _policy(spark, d):
    words = table(spark, d, "benchmark").select("item_id", P.policy_words(F.col("text")).alias("w"))
    w, i, none = (lambda k: F.get("w", F.lit(k - 1))), F.col("item_id"), F.array().cast("array<string>")
    intents = words.select(
        i.alias("intent_id"), F.when(i % 4 == 3, none).otherwise(F.array(F.upper(w(3)), F.concat(w(4), F.lit("-"), w(5)))).alias("query_terms"),
        F.when(i % 5 == 4, none).otherwise(F.array(w(6), F.concat(F.lit("k"), i.cast("string")))).alias("vocabulary"), (i % 3 == 0).alias("requires_number"), (1 + i % 4).cast("double").alias("boost"),
    )
    return intents, words.select(w(2).alias("term"), w(3).alias("alias")), words.select(F.concat(F.lit("K"), i.cast("string")).alias("key"), F.concat_ws(" ", w(8), w(9)).alias("term"))


@query("k5_intent_policies", f"""WITH {PAIRS}, {POLICY}, either_way AS (SELECT term, alias FROM aliases WHERE term <> alias UNION SELECT alias, term FROM aliases WHERE term <> alias),
own_words AS (SELECT DISTINCT query_id, query_text, list_distinct({_W.replace("text", "query_text")}) AS own, array_to_string({_W.replace("text", "query_text")}, ' ') AS line FROM pairs), qx AS (SELECT query_id, line, list_distinct(list_concat(own, coalesce((SELECT list(alias) FROM either_way WHERE list_contains(own, term)), []))) AS terms FROM own_words),
i AS (SELECT intents.*, list_transform(query_terms, lambda x: array_to_string(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+'), ' ')) AS m, list_concat(vocabulary, coalesce((SELECT flatten(list(regexp_extract_all(term, '[\\p{{L}}\\p{{N}}_]+'))) FROM vocabulary v WHERE list_contains(intents.vocabulary, lower(v.key))), [])) AS vocab FROM intents),
c AS (SELECT DISTINCT document_id, {_W} AS words, regexp_matches(text, '\\b[0-9]+([.,][0-9]+)?\\b') AS number FROM pairs),
b AS (SELECT p.query_id, p.document_id, boost FROM pairs p JOIN qx USING (query_id) JOIN c USING (document_id), i
  WHERE (len(m) = 0 OR len(list_filter(m, lambda x: CASE WHEN contains(x, ' ') THEN contains(line, x) ELSE list_contains(terms, x) END)) > 0) AND (len(vocab) = 0 OR len(list_intersect(vocab, words)) > 0) AND (NOT requires_number OR number))
SELECT query_id, document_id, coalesce(sum(boost), 0)::DOUBLE AS boost, count(boost) AS intents FROM pairs LEFT JOIN b USING (query_id, document_id) GROUP BY 1, 2""")
def k5_policies(spark, d):
    return P.intent_boosts(_pairs(spark, d).select("query_id", "document_id", "query_text", "text"), *_policy(spark, d))


#: The chunks in Arabic presentation forms: some letters as single forms, a few as a ligature, marked letters and wide ones.
_LATIN, _FORMS, _BASES = "etaoinsrhldc", "ﺍﺎﻭﻮﻣﻤﺑﻛﺃﻯ\uff41\u2460", "ااوومم" + "بكايa1"
_SHAPED = f"translate(replace(replace(lower(text), 'th', 'ﻻ'), 'u', 'كَـ'), '{_LATIN}', '{_FORMS}')"
_UNSHAPED = f"translate(replace(replace(lower(text), 'th', 'لا'), 'u', 'ك'), '{_LATIN}', '{_BASES}')"
_FOLDED = f"trim(regexp_replace({_UNSHAPED}, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))"


def shaped_chunks(spark, d):
    ligated = F.replace(F.replace(F.lower("text"), F.lit("th"), F.lit("ﻻ")), F.lit("u"), F.lit("كَـ"))
    return chunks(spark, d).select("document_id", "chunk_index", F.translate(ligated, _LATIN, _FORMS).alias("text"))


@query("b2_compatibility_folding", f"WITH {CHUNKS} SELECT document_id, chunk_index, md5({_FOLDED}) AS folded_md5 FROM chunks")
def b2_folding(spark, d):
    return shaped_chunks(spark, d).select("document_id", "chunk_index", F.md5(A.folded_arabic(F.col("text"))).alias("folded_md5"))


@query("b3_arabic_tokens_of_forms", f"""WITH {CHUNKS}, t AS (SELECT document_id, chunk_index, regexp_extract_all({_FOLDED}, '[\\x{{0600}}-\\x{{06FF}}]+') AS t FROM chunks),
f AS (SELECT document_id, chunk_index, flatten(list_transform(t, lambda x: CASE WHEN starts_with(x, 'و') AND length(x) > 2 THEN [x, substr(x, 2)] ELSE [x] END)) AS f FROM t)
SELECT document_id, chunk_index, coalesce(array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ' '), '') AS tokens FROM f""")
def b3_forms(spark, d):
    return shaped_chunks(spark, d).select("document_id", "chunk_index", F.array_join(A.folded_tokens(F.col("text")), " ").alias("tokens"))


#: Metadata of documents: words of the source and of the first line as domain, tags and layout, which name families here and there.
_DOMAINS = ["law", "patient", "tax", "API", "report", "plain"]
_ABOUT = f"""about AS (SELECT doc_id AS document_id, [{", ".join(f"'{x}'" for x in _DOMAINS)}][(length(text) % 11 + 1)::INT] AS domain, [lang, CASE WHEN n_chars % 5 = 0 THEN 'Table' WHEN n_chars % 5 = 1 THEN 'figure' END, CASE WHEN n_chars % 7 = 0 THEN 'policy' END] AS tags, source AS collection, n_chars % 3 = 0 AS hint, n_chars % 4 = 0 AS contract FROM documents)"""


@query("b20_domain_families", f"""WITH {_ABOUT}, s AS (SELECT document_id, bool_or(hint) AS hint, bool_or(contract) AS contract, list_sort(list_distinct(flatten(list(list_filter(list_transform(list_concat([domain, collection], tags), lambda x: lower(trim(x))), lambda x: x <> ''))))) AS s FROM about GROUP BY 1),
f AS (SELECT *, CASE WHEN len(list_intersect(s, ['legal', 'law', 'statute', 'policy', 'contract'])) > 0 THEN 'legal_reference' WHEN list_contains(s, 'patient') THEN 'medical_reference' WHEN list_contains(s, 'tax') THEN 'financial_reference' WHEN list_contains(s, 'api') THEN 'code_reference' END AS family,
  CASE WHEN list_contains(s, 'table') THEN 'table' WHEN list_contains(s, 'figure') THEN 'figure' END AS layout FROM s),
h AS (SELECT *, CASE WHEN family = 'financial_reference' THEN coalesce(layout, CASE WHEN hint THEN 'reference' ELSE 'table' END) WHEN family = 'code_reference' THEN layout WHEN family IS NULL AND contract THEN coalesce(layout, 'reference') ELSE coalesce(layout, CASE WHEN hint THEN 'reference' END) END AS layout_hint FROM f)
SELECT document_id, coalesce(family, CASE WHEN contract THEN 'reference_heavy' WHEN layout IS NOT NULL THEN 'multimodal_layout' ELSE 'general' END) AS domain_profile_id,
  coalesce(family, CASE WHEN contract THEN 'reference_heavy' WHEN layout IS NOT NULL THEN 'generic' WHEN list_contains(s, 'report') THEN 'research_semantic' ELSE 'generic' END) AS domain_family, layout_hint,
  CASE WHEN family = 'legal_reference' AND contract THEN 'graph' WHEN family = 'code_reference' THEN 'vector' WHEN family IS NOT NULL THEN CASE WHEN layout_hint IN ('table', 'figure') THEN 'full' ELSE 'vector' END WHEN contract THEN 'graph' WHEN layout IS NOT NULL THEN 'full' ELSE 'vector' END AS materialization_hint,
  contract AS reference_heavy, array_to_string(s, ',') AS signals FROM h""")
def b20_families(spark, d):
    n = F.col("n_chars")
    about = table(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), F.get(F.array(*map(F.lit, _DOMAINS)), (F.char_length("text") % 11).cast("int")).alias("domain"), F.array("lang", F.when(n % 5 == 0, "Table").when(n % 5 == 1, "figure"), F.when(n % 7 == 0, "policy")).alias("tags"),
        F.col("source").alias("collection"), (n % 3 == 0).alias("hint"), (n % 4 == 0).alias("contract"),
    )
    flags = about.groupBy("document_id").agg(F.bool_or("hint").alias("has_reference_hint"), F.bool_or("contract").alias("has_contract"))
    return U.classify_domain(U.domain_signals(about).join(flags, "document_id")).withColumn("signals", F.array_join("signals", ","))


#: What users said, with a wording that asks for something put before it by turn and conversation.
_ASKS = ["", "phrase that ", "How many: ", "give an overview of ", "Order ", "before this, "]


@query("b21_understand_queries", f"""WITH a AS (SELECT conv_id * 1000 + turn AS query_id, [{", ".join(f"'{x}'" for x in _ASKS)}][(conv_id + turn // 2) % {len(_ASKS)} + 1] || CASE WHEN (conv_id + turn // 2) % {len(_ASKS)} = 4 THEN conv_id || ':' || turn || ' ' ELSE '' END || string_split(text, ' ')[1] || ' ' || coalesce(string_split(text, ' ')[2], '') AS text FROM conversations WHERE role = 'user'),
v AS (SELECT query_id, text, regexp_extract(text, '(?i)\\b(?:says|say|phrase|quote)\\b(?:\\s+(?:that|is|was|as))?\\s+(.+)', 1) AS said, list_distinct(regexp_extract_all(text, '\\b[0-9]+:[0-9]+\\b')) AS refs, regexp_matches(lower(text), '\\b(surrounding|connected|related|nearby|neighboring|previous|next|before|after|context|around)\\b') AS graph FROM a),
w AS (SELECT *, nullif(trim(regexp_replace(lower(said), '[^0-9a-z]+', ' ', 'g')), '') AS phrase FROM v),
i AS (SELECT *, CASE WHEN len(refs) > 0 THEN 'reference' WHEN phrase IS NOT NULL THEN 'phrase_lookup' WHEN regexp_matches(lower(text), '\\b(how many|count|number of|total)\\b') THEN 'count' WHEN regexp_matches(lower(text), '\\b(summary|summarize|overview)\\b') THEN 'summary' ELSE 'semantic' END AS intent FROM w)
SELECT query_id, intent, CASE WHEN intent IN ('reference', 'phrase_lookup') THEN 'reference' ELSE intent END AS answer_type, CASE WHEN intent = 'count' THEN 'count_metadata_hybrid' WHEN graph THEN 'graph_context_hybrid' WHEN intent IN ('reference', 'phrase_lookup') THEN 'reference_first_hybrid' ELSE 'semantic_hybrid' END AS strategy,
  graph AS graph_context_required, CASE WHEN intent = 'phrase_lookup' THEN phrase ELSE '' END AS required_terms, CASE WHEN intent = 'reference' THEN array_to_string(refs, ',') ELSE '' END AS reference_hints, intent IN ('reference', 'phrase_lookup') AS direct_evidence_required,
  concat_ws('|', CASE intent WHEN 'reference' THEN 'reference_exact=' || text WHEN 'phrase_lookup' THEN 'phrase_exact=' || phrase WHEN 'count' THEN 'title_count=' || text END, 'semantic_metadata=' || q, 'vector_db=' || q, 'native_vector=' || q) AS passes
FROM (SELECT *, CASE WHEN intent = 'phrase_lookup' THEN phrase ELSE text END AS q FROM i)""")
def b21_understand(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    kind = (F.col("conv_id") + F.floor(F.col("turn") / 2)) % len(_ASKS)
    words = F.split("text", " ", -1)
    reference = F.when(kind == 4, F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit(" "))).otherwise("")
    text = F.concat(F.get(F.array(*map(F.lit, _ASKS)), kind.cast("int")), reference, F.get(words, F.lit(0)), F.lit(" "), F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    out = U.understand_queries(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), text.alias("text")), [K.Contract("{a}:{b}")])
    passes = F.array_join(F.transform("passes", lambda p: F.concat(p["name"], F.lit("="), p["query"])), "|")
    return out.select("query_id", "intent", "answer_type", "strategy", "graph_context_required", F.array_join("required_terms", ",").alias("required_terms"), F.array_join("reference_hints", ",").alias("reference_hints"), "direct_evidence_required", passes.alias("passes"))
