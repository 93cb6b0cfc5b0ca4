"""Scoring, fusion, reranking, diversity, context packing and answers, always keyed by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import estimated_tokens, search_terms, stripped


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k of each group; Spark prunes before the shuffle (window group limit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def rare_terms(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``query_id, term, n`` of each query's ``k`` rarest terms by document frequency, those found nowhere included."""
    asked = queries.select("query_id", F.explode(search_terms(F.col("text"))).alias("term"))
    words = docs.select(F.explode(search_terms(F.col("text"))).alias("term"))
    counts = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return top_k(asked.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))), ["query_id"], ["n", "term"], k).drop("rank")


def term_lane(terms: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Documents by the share of a query's rare terms that they hold: an equi-join on terms that few documents have."""
    words = docs.select("document_id", F.explode(search_terms(F.col("text"))).alias("term"))
    asked = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    hits = words.join(terms.select("query_id", "term"), "term").groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
    scored = hits.join(asked, "query_id").select("query_id", "document_id", F.round(F.col("n") / F.col("asked"), 9).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), "document_id"], k)


def _shingles(text: Column, width: int) -> Column:
    """Different runs of ``width`` words; of a shorter text, all its words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))

    def windows(w: Column) -> Column:
        whole = F.transform(w, lambda x, i: F.array_join(F.slice(w, i + 1, width), " "))
        return F.array_distinct(F.slice(whole, F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))))

    return F.get(F.transform(F.array(words), windows), F.lit(0))


def passage_lane(queries: DataFrame, docs: DataFrame, k: int, width: int = 4) -> DataFrame:
    """Documents by the number of a query's word windows that they hold."""
    asked = queries.select("query_id", F.explode(_shingles(F.col("text"), width)).alias("s"))
    held = docs.select("document_id", F.explode(_shingles(F.col("text"), width)).alias("s"))
    hits = held.join(asked, "s").groupBy("query_id", "document_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return top_k(hits, ["query_id"], [F.desc("score"), "document_id"], k)


def fuse(lanes: dict[str, DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lanes ``(query_id, document_id, rank)``: the sum of ``1 / (constant + rank)``."""
    union = None
    for name, lane in lanes.items():
        part = lane.select("query_id", "document_id", "rank", F.lit(name).alias("lane"))
        union = part if union is None else union.unionByName(part)
    merged = union.groupBy("query_id", "document_id").agg(
        F.round(F.aggregate(F.sort_array(F.collect_list(1 / (constant + F.col("rank")))), F.lit(0.0), lambda a, x: a + x), 9).alias("score"),
        F.array_join(F.sort_array(F.collect_set("lane")), ",").alias("lanes"),
    )
    return top_k(merged, ["query_id"], [F.desc("score"), "document_id"], k)


def coverage_density(pairs: DataFrame) -> DataFrame:
    """Share of the query's terms in the text, and of the text's terms in the query, of pairs ``(query_text, text)``."""
    both = F.size(F.array_intersect("q", "c"))
    out = pairs.withColumns({"q": search_terms(F.col("query_text")), "c": search_terms(F.col("text"))})
    share = lambda n: F.when(F.size(n) > 0, F.round(both / F.size(n), 9)).otherwise(0.0)
    return out.withColumns({"coverage": share("q"), "density": share("c")}).drop("q", "c")


def phrase_score(query: Column, text: Column) -> Column:
    """8 if the text holds the whole query, 24 for a quoted phrase of four words or more, else 0."""
    phrases = F.filter(F.regexp_extract_all(F.lower(query), F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.size(F.split(p, " ")) >= 4)
    return F.when(F.contains(F.lower(text), F.lower(query)), 8).when(F.exists(phrases, lambda p: F.contains(F.lower(text), p)), 24).otherwise(0)


def capped_overlap(left: Column, right: Column, points: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.size(F.array_intersect(left, right)) * points)


def hybrid_score(signals: dict[str, float]) -> Column:
    """Weighted sum of signal columns."""
    total = F.lit(0.0)
    for name, weight in signals.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * weight
    return F.round(total, 6)


def explain(signals: list[str]) -> Column:
    """Positive signals, largest first, as ``name=value``."""
    pairs = F.filter(F.array(*(F.struct((-F.round(F.col(s).cast("double"), 6)).alias("v"), F.lit(s).alias("s")) for s in signals)), lambda p: p["v"] < 0)
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: p["s"]), ",")


def direct_evidence_stop(candidates: DataFrame) -> DataFrame:
    """Passes of a query up to the first that has direct evidence; a chunk counts in its first pass only."""
    first = top_k(candidates, ["query_id", "chunk_id"], ["pass_order", "candidate_id"], 1, "_r").drop("_r")
    stop = first.groupBy("query_id").agg(F.min(F.when(F.col("direct"), F.col("pass_order"))).alias("_stop"))
    return first.join(stop, "query_id").filter(F.col("_stop").isNull() | (F.col("pass_order") <= F.col("_stop"))).drop("_stop")


def merge_duplicates(candidates: DataFrame) -> DataFrame:
    """One row per query and chunk: the fields of the best row, blanks filled from the others, all reasons."""
    order = F.struct(F.col("score"), -F.col("candidate_id"))
    return candidates.groupBy("query_id", "chunk_id").agg(
        F.max_by("candidate_id", order).alias("candidate_id"), F.max("score").alias("score"),
        F.coalesce(F.max_by("title", order), F.max("title")).alias("title"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"),
    )


def query_aware_order(fused: DataFrame, share: float = 0.65) -> DataFrame:
    """If the first three of a query are one document, the best other document that scores ``share`` of the first or
    more moves to place two."""
    q = Window.partitionBy("query_id")
    top = fused.withColumns({"n_top": F.size(F.collect_set(F.when(F.col("rank") <= 3, F.col("document_id"))).over(q)), "lead": F.max(F.when(F.col("rank") == 1, F.struct("document_id", "score"))).over(q)})
    other = (F.col("document_id") != F.col("lead.document_id")) & (F.col("score") >= share * F.col("lead.score"))
    top = top.withColumn("lift", F.min(F.when(other, F.col("rank"))).over(q))
    key = F.when((F.col("n_top") == 1) & (F.col("rank") == F.col("lift")), F.lit(1.5)).otherwise(F.col("rank").cast("double"))
    return top.withColumn("place", F.row_number().over(q.orderBy(key))).drop("n_top", "lead", "lift")


def apply_rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Order by the given scores; rows without one keep their order behind. ``delta``: places gained."""
    joined = candidates.join(scores, ["query_id", "document_id"], "left")
    after = Window.partitionBy("query_id").orderBy(F.col("relevance").desc_nulls_last(), "rank")
    out = joined.withColumns({"new_rank": F.row_number().over(after), "status": F.when(F.col("relevance").isNull(), "missing").otherwise("ranked")})
    return out.withColumn("delta", F.col("rank") - F.col("new_rank"))


def diversify(ranked: DataFrame, limit: int, threshold: float = 0.65) -> DataFrame:
    """Greedy: a row whose terms are like those of a row already chosen (Jaccard of ``threshold`` or more) is skipped;
    ``must_keep`` rows enter in any case, and rows without terms are like no other. Folds over a query's ordered candidates, of which there are a bounded number."""
    item = F.struct("rank", "document_id", "must_keep", search_terms(F.col("text")).alias("terms"))
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def add(chosen: Column, x: Column) -> Column:
        both = lambda c: F.size(F.array_intersect(c["terms"], x["terms"]))
        like = F.exists(chosen, lambda c: (both(c) > 0) & (both(c) >= threshold * F.size(F.array_union(c["terms"], x["terms"]))))
        return F.when(x["must_keep"] | ((F.size(chosen) < limit) & ~like), F.concat(chosen, F.array(x))).otherwise(chosen)

    kept = F.aggregate("items", F.slice("items", 1, 0), add)
    return lists.select("query_id", F.posexplode(kept).alias("place", "x")).select("query_id", "place", "x.document_id", "x.rank")


def at_logical_boundary(text: Column, most: int) -> Column:
    """The first paragraph, if it has ``most`` tokens or fewer; else the first ``most`` words."""
    blank = "[ \\t\\n\\r\\x0b\\x0c]+"
    paragraph = F.get(F.filter(F.transform(F.split(text, "\n\n", -1), stripped), lambda p: p != ""), F.lit(0))
    words = F.array_join(F.slice(F.split(stripped(text), blank), 1, most), " ")
    return F.when(paragraph.isNotNull() & (estimated_tokens(paragraph) <= most), paragraph).otherwise(words)


def assemble_context(ranked: DataFrame, budget: int, hard: int) -> DataFrame:
    """What of a query's candidates goes into its context, each with ``kept``, ``reason``, ``text`` and ``tokens``.

    ``ranked (query_id, rank, document_id, key, text, direct, policy)``: direct evidence comes first, else by rank. In
    order: what has the ``key`` of a row that is in already is a ``duplicate``; a row with a ``policy`` reason is left out
    for it; one that the token budget has no room for is left out (``token_budget``), but direct evidence stays
    (``direct_over_budget``); texts of more than ``hard`` tokens are cut (``truncated``). The budget goes on after a row
    that didn't fit, so this is a fold over a query's candidates, of which there are a bounded number; it carries no texts.
    """
    rows = ranked.withColumn("tokens", estimated_tokens(F.col("text")))
    rows = rows.withColumns({"cut": F.col("tokens") > hard, "text": F.when(F.col("tokens") > hard, at_logical_boundary(F.col("text"), hard)).otherwise(F.col("text"))})
    rows = rows.withColumn("own", F.when(F.col("cut"), estimated_tokens(F.col("text"))).otherwise(F.col("tokens")))
    item = F.struct((~F.col("direct")).alias("later"), "rank", "key", "tokens", "own", "cut", "policy")
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def add(a: Column, x: Column) -> Column:
        over = a["used"] + x["tokens"] > budget
        reason = F.when(F.array_contains(a["seen"], x["key"]), "duplicate").when(x["policy"].isNotNull(), x["policy"])
        reason = reason.when(over & x["later"], "token_budget").when(over, "direct_over_budget").when(x["cut"], "truncated")
        kept = ~F.array_contains(a["seen"], x["key"]) & x["policy"].isNull() & ~(over & x["later"])
        entry = F.struct(x["rank"].alias("rank"), kept.alias("kept"), reason.alias("reason"))
        seen = F.when(kept, F.concat(a["seen"], F.array(x["key"]))).otherwise(a["seen"])
        return F.struct(F.concat(a["out"], F.array(entry)).alias("out"), seen.alias("seen"), F.when(kept, a["used"] + x["own"]).otherwise(a["used"]).alias("used"))

    kind = "array<struct<rank:int,kept:boolean,reason:string>>"
    empty = F.struct(F.array().cast(kind).alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(0).cast("long").alias("used"))
    decided = lists.select("query_id", F.inline(F.aggregate("items", empty, add, lambda a: a["out"])))
    own = rows.select("query_id", "rank", "document_id", "text", "direct", F.col("own").alias("tokens"))
    return decided.join(own, ["query_id", "rank"])


def context_status(assembled: DataFrame) -> DataFrame:
    """Rows and tokens of each query's context; it is grounded if direct evidence is in it."""
    kept = F.col("kept")
    return assembled.groupBy("query_id").agg(
        F.count_if(kept).alias("evidence"), F.coalesce(F.sum(F.when(kept, F.col("tokens"))), F.lit(0)).alias("tokens"), F.count_if(~kept).alias("dropped"),
        F.when(F.bool_or(kept & F.col("direct")), "grounded").otherwise("insufficient_evidence").alias("status"),
    )


def verify_targets(targets: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first evidence of each target word, by rank, or ``not_found``."""
    words = evidence.select("query_id", "rank", "document_id", F.explode(search_terms(F.col("text"))).alias("target"))
    first = words.groupBy("query_id", "target").agg(F.min_by("document_id", "rank").alias("document_id"))
    return targets.join(first, ["query_id", "target"], "left").withColumn("status", F.when(F.col("document_id").isNull(), "not_found").otherwise("confirmed"))


def evidence_answer(evidence: DataFrame, most: int = 5, chars: int = 520) -> DataFrame:
    """A templated answer of the first labelled snippets."""
    snippet = F.substring(F.trim(F.regexp_replace("text", r"[ \t\n\r\x0b\x0c]+", " ")), 1, chars)
    picked = top_k(evidence, ["query_id"], ["rank"], most, "n").withColumn("line", F.concat(F.lit("[S"), F.col("n").cast("string"), F.lit("] "), snippet))
    ordered = F.sort_array(F.collect_list(F.struct("n", "line")))
    return picked.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("answer"))


def ground_answers(answers: DataFrame) -> DataFrame:
    """Cited ``[Sn]`` labels against ``available`` ones: unknown labels, and a status."""
    cited = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[S([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int")))
    unknown = F.filter(cited, lambda x: x > F.col("available"))
    status = F.when(F.size(unknown) > 0, "unknown_citation").when((F.size(cited) == 0) & (F.col("available") > 0), "uncited").otherwise("grounded")
    return answers.select("query_id", F.size(cited).alias("n_cited"), F.size(unknown).alias("n_unknown"), status.alias("status"))


# Precedence of evidence by feature and tool, boosts by feature with their reasons, precedence of lanes.
DIRECT_FEATURES = {"reference_hypothesis": 5, "reference_exact": 100, "arabic_exact": 90, "target_phrase": 80}
DIRECT_TOOLS = {"reference_exact": 70, "reference": 70, "arabic_lexical": 60, "lexical": 60, "pgvector": 20}
DIRECT_DEFAULT = 10
DIRECT_BOOSTS = {"reference_exact": (100.0, "exact_reference_match"), "arabic_exact": (90.0, "direct_arabic_match"), "target_phrase": (80.0, "target_phrase_match")}
LANES = {"metadata": 40, "reference_exact": 40, "arabic_lexical": 35, "lexical": 35, "graph": 30, "pgvector": 20, "native": 10}


def _of(table: dict[str, int], key: Column, default: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(default))


def fuse_candidates(candidates: DataFrame, limit: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of a query's ranked lists with direct evidence before all else.

    ``candidates (query_id, list, rank, tool, tool_rank, candidate_id, chunk_id, runtime_id, document_id, text, base_score,
    final_score, features)``. Rows of one chunk, else of one runtime id, else of one document and text, are one candidate: it
    scores ``1 / (constant + rank)`` for each row, and its fields are those of the row with the highest direct priority,
    score, lane priority and the lowest tool rank, the earliest of equals. A feature of that row can add a direct boost. Order: direct
    priority, score, lane priority, tool rank, then the key. One partial aggregate by query and key, then a top-k by query.
    """
    has = lambda f: F.coalesce(F.array_contains("features", f), F.lit(False))
    direct = _of(DIRECT_TOOLS, F.col("tool"), DIRECT_DEFAULT)
    for feature, points in reversed(DIRECT_FEATURES.items()):
        direct = F.when(has(feature), points).otherwise(direct)
    text_key = F.concat_ws(":", F.lit("text"), F.coalesce(F.col("document_id").cast("string"), F.lit("unknown")), F.sha1(F.lower(stripped(F.coalesce("text", F.lit(""))))))
    key = F.coalesce(F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")), F.concat(F.lit("runtime:"), F.col("runtime_id").cast("string")), text_key)
    own_score = F.coalesce(F.nullif("final_score", F.lit(0.0)), F.col("base_score"), F.lit(0.0))
    rows = candidates.withColumns({"key": key, "direct": direct, "lane_priority": _of(LANES, F.col("tool"), 0), "own_score": own_score})
    best = F.struct("direct", "own_score", "lane_priority", -F.col("tool_rank"), -F.col("list"), -F.col("rank"))
    kept = F.struct("candidate_id", "tool", "tool_rank", "direct", "lane_priority", "features")
    merged = rows.groupBy("query_id", "key").agg(
        F.max_by(kept, best).alias("c"), F.aggregate(F.sort_array(F.collect_list(1 / (constant + F.col("rank")))), F.lit(0.0), lambda a, x: a + x).alias("rrf"),
        F.array_distinct(F.transform(F.sort_array(F.collect_set(F.struct("list", "rank", "tool"))), lambda x: x["tool"])).alias("tools"),
    )
    boost, reason = F.lit(0.0), F.lit(None).cast("string")
    for feature, (points, why) in reversed(DIRECT_BOOSTS.items()):
        found = F.coalesce(F.array_contains("c.features", feature), F.lit(False))
        boost, reason = F.when(found, points).otherwise(boost), F.when(found, why).otherwise(reason)
    scored = merged.select("query_id", "key", "c.candidate_id", "tools", "c.tool_rank", "c.direct", "c.lane_priority", boost.alias("direct_boost"), reason.alias("reason"), F.round(F.col("rrf") + boost, 9).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("direct"), F.desc("score"), F.desc("lane_priority"), "tool_rank", "key"], limit)


def order_for_intent(ranked: DataFrame, plans: DataFrame, share: float = 0.65) -> DataFrame:
    """``ranked (query_id, rank, candidate_id, document_id, score, tool_rank)`` with ``place``: the order that the query's intent asks for.

    ``plans (query_id, intent, documents, limit)``. For a query over several documents whose candidates come from more than
    one: a comparison shows the best candidate of each document first, by score and then the lower tool rank; any other query whose first ``limit``
    are all of one document lifts the best candidate of another one that reaches ``share`` of the first score to place two. Other
    queries keep their order. Windows by query, over a ranked list of bounded length.
    """
    q = Window.partitionBy("query_id")
    rows = ranked.join(plans.select("query_id", "intent", "documents", "limit"), "query_id")
    known = F.col("document_id").isNotNull()
    best = known & (F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "rank")) == 1)
    rows = rows.withColumns({"best": best, "seen": F.min("rank").over(Window.partitionBy("query_id", "document_id")), "top": F.col("rank") <= F.greatest("limit", F.lit(1))})
    rows = rows.withColumns({
        "several": (F.coalesce("documents", F.lit(0)) > 1) & (F.count_if("best").over(q) > 1), "shown": F.collect_set(F.when(F.col("top") & known, F.col("document_id"))).over(q), "lead": F.max(F.when(F.col("rank") == 1, F.col("score"))).over(q),
    })
    compared = F.col("several") & F.coalesce(F.col("intent") == "comparison", F.lit(False))
    other = F.col("several") & ~compared & (F.size("shown") <= 1) & F.col("best") & ~F.array_contains("shown", F.col("document_id")) & (F.col("score") >= F.col("lead") * share)
    order = [F.desc("score"), "tool_rank", "seen"]
    head = F.row_number().over(Window.partitionBy("query_id", "best").orderBy(*order))
    rows = rows.withColumns({"compared": compared, "head": F.when(F.col("best"), head), "other": other})
    lifted = F.col("other") & (F.row_number().over(Window.partitionBy("query_id", "other").orderBy(*order)) == 1)
    rows = rows.withColumn("lifted", lifted)
    group = F.when(F.col("compared"), F.when(F.col("best"), 0).otherwise(1)).when(F.col("rank") == 1, 0).when(F.col("lifted"), 1).otherwise(2)
    within = F.when(F.col("compared") & F.col("best"), F.col("head")).otherwise(F.col("rank"))
    return rows.withColumn("place", F.row_number().over(q.orderBy(group, within))).select(*ranked.columns, "place")
