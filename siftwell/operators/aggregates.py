"""Quality, evaluation and health aggregates: partial aggregates on narrow keys, nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def warning_summary(warnings: DataFrame, suppressed: Column) -> DataFrame:
    """Chunks that carry each code, not counting suppressed warnings."""
    chunk = F.struct("document_id", "chunk_index")
    return warnings.filter(~suppressed).groupBy("code").agg(F.count_distinct(chunk).alias("n_chunks"))


def warning_details(warnings: DataFrame, suppressed: Column, most_pages: int = 20) -> DataFrame:
    """Counts by code with and without suppressed ones, by block type, and the first pages.

    Two steps of partial aggregation (first by page) keep the lists short before they are collected."""
    chunk = F.struct("document_id", "chunk_index")
    marked = warnings.withColumn("_s", suppressed)
    base = marked.groupBy("code").agg(
        F.count(F.lit(1)).alias("raw_warnings"), F.count_if(~F.col("_s")).alias("counted_warnings"), F.count_distinct(chunk).alias("raw_chunks"),
        F.count_distinct(F.when(~F.col("_s"), chunk)).alias("counted_chunks"), F.count_if(F.col("block_type") == "table").alias("in_tables"),
    )
    pages = marked.select("code", "page").distinct().withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("page"))).filter(F.col("r") <= most_pages)
    listed = pages.groupBy("code").agg(F.array_join(F.transform(F.sort_array(F.collect_list("page")), lambda p: p.cast("string")), ",").alias("pages"))
    return base.join(listed, "code")


def dedupe_warnings(warnings: DataFrame) -> DataFrame:
    """One row for each document, code, block type, page and script; a row without a script goes if one with a script
    has the same document, code and page."""
    keys = ["document_id", "code", "block_type", "page", "expected_script"]
    one = warnings.select(*keys).distinct()
    specific = one.filter(F.col("expected_script").isNotNull()).select("document_id", "code", "page").distinct()
    generic = one.filter(F.col("expected_script").isNull()).join(specific, ["document_id", "code", "page"], "left_anti")
    return generic.select(*keys).unionByName(one.filter(F.col("expected_script").isNotNull()))


def warning_groups(warnings: DataFrame, samples: int = 5) -> DataFrame:
    """By document, code and script: the number and the first chunks."""
    keys = ["document_id", "code", "expected_script"]
    ranked = warnings.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_index")))
    few = F.filter(F.sort_array(F.collect_list(F.when(F.col("r") <= samples, F.col("chunk_index")))), lambda x: x.isNotNull())
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(few, lambda x: x.cast("string")), ",").alias("samples"))


def reference_quality(units: DataFrame, required: list[str]) -> DataFrame:
    """Missing scripts of each unit ``(document_id, unit, scripts)``, its status and what it may be used for."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("scripts"))
    status = F.when(F.size("scripts") == 0, "unresolved").when(F.size(missing) == 0, "passed").otherwise("missing")
    return units.select(
        "document_id", "unit", F.array_join(missing, ",").alias("missing"), status.alias("status"), (F.size(missing) == 0).alias("index_vector"), (F.size("scripts") > 0).alias("persist_chunk"),
    )


def chunk_policy(quality: DataFrame) -> DataFrame:
    """A document may do what all its units may; flags are joined."""
    flags = F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") != "passed", F.col("status")))), ",")
    return quality.groupBy("document_id").agg(F.bool_and("index_vector").alias("index_vector"), F.bool_and("persist_chunk").alias("persist_chunk"), flags.alias("flags"))


def quality_report(quality: DataFrame, documents: DataFrame) -> DataFrame:
    """Units by status, coverage and overall status of each document; ``quality_unknown`` without units."""
    sums = quality.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "unresolved").alias("unresolved"),
    )
    joined = documents.select("document_id").join(sums, "document_id", "left").fillna(0, ["units", "passed", "missing", "unresolved"])
    coverage = F.when(F.col("units") > 0, F.round(F.col("passed") / F.col("units"), 6)).otherwise(0.0)
    status = F.when(F.col("units") == 0, "quality_unknown").when(F.col("passed") == F.col("units"), "passed").when(F.col("passed") > 0, "partial").otherwise("failed")
    return joined.withColumns({"coverage": coverage, "status": status})


def largest_counts(*sources: DataFrame) -> DataFrame:
    """The largest of several counts ``(code, n)`` by code."""
    union = sources[0]
    for s in sources[1:]:
        union = union.unionByName(s)
    return union.groupBy("code").agg(F.max("n").alias("n"))


def repair_steps(counts: DataFrame, steps: dict[str, str]) -> DataFrame:
    """One step for each code with a count."""
    table = F.create_map(*(F.lit(x) for pair in steps.items() for x in pair))
    return counts.filter("n > 0").select("code", "n", F.coalesce(F.try_element_at(table, "code"), F.lit("inspect")).alias("step"))


def extraction_contract(chunks: DataFrame, total_pages: DataFrame) -> DataFrame:
    """First failing check of each document: too little text, raw syntax, too few pages, several backends."""
    sums = chunks.groupBy("document_id").agg(
        F.sum(F.char_length("text")).alias("chars"), F.count_distinct("page").alias("pages"), F.bool_or(F.col("text").rlike("(endobj|endstream|/FlateDecode)")).alias("raw"), F.count_distinct("backend").alias("backends"),
    )
    joined = sums.join(total_pages, "document_id")
    failing = (
        F.when(F.col("chars") < 50, "too_short").when(F.col("raw"), "raw_syntax").when(F.col("pages") < 0.5 * F.col("total_pages"), "pages_missing").when(F.col("backends") > 1, "mixed_backends").otherwise("ok")
    )
    return joined.select("document_id", "chars", "pages", failing.alias("result"))


def page_count(ranges: DataFrame) -> DataFrame:
    """Different pages that ``page_start`` to ``page_end`` of a document's rows cover."""
    every = ranges.select("document_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return every.groupBy("document_id").agg(F.count_distinct("page").alias("pages"))


def identity_ranges(refs: DataFrame) -> DataFrame:
    return refs.groupBy("chunk_id", "field").agg(F.min("value").alias("start"), F.max("value").alias("end"))


def contract_validation(pages: DataFrame, contracts: dict[str, str], least_units: int) -> DataFrame:
    """For each contract (name -> pattern) the matched units and pages of a document, and whether it is the best."""
    found = F.array(*(F.struct(F.lit(n).alias("contract"), F.regexp_count("text", F.lit(p)).alias("units")) for n, p in contracts.items()))
    each = pages.select("document_id", "page", F.explode(found).alias("f"))
    sums = each.groupBy("document_id", "f.contract").agg(F.sum("f.units").alias("units"), F.count_if(F.col("f.units") > 0).alias("pages"))
    best = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("units"), F.desc("pages"), "contract"))
    return sums.withColumns({"rejected": F.col("units") < least_units, "place": best})


def experiment_counts(experiments: DataFrame, runs: DataFrame, scores: DataFrame) -> DataFrame:
    n_runs = runs.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("runs"))
    n_scores = runs.join(scores.select("run_id"), "run_id").groupBy("experiment_id").agg(F.count(F.lit(1)).alias("scores"))
    return experiments.select("experiment_id").join(n_runs, "experiment_id", "left").join(n_scores, "experiment_id", "left").fillna(0, ["runs", "scores"])


def score_answers(answers: DataFrame) -> DataFrame:
    """Expected terms, must-include and must-avoid weigh 50, 35 and 15, renormalised over those that are given, 0 to 100."""
    text = F.lower("answer")
    hit = lambda c: F.size(F.filter(c, lambda t: F.contains(text, F.lower(t)))) / F.size(c)
    parts = [(0.5, "expected", hit("expected")), (0.35, "must_include", hit("must_include")), (0.15, "must_avoid", 1 - hit("must_avoid"))]
    total, weight = F.lit(0.0), F.lit(0.0)
    for w, c, share in parts:
        there = F.size(c) > 0
        total, weight = total + F.when(there, w * share).otherwise(0.0), weight + F.when(there, w).otherwise(0.0)
    return answers.withColumns({"score": F.when(weight > 0, F.round(100 * total / weight, 6)), "scoreable": weight > 0})


def optimizer_summary(runs: DataFrame) -> DataFrame:
    """Per experiment and variant: runs, failures, average and total score, best run, and the winner of each experiment."""
    sums = runs.groupBy("experiment_id", "variant_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.sum("score"), 2).alias("total_score"),
        F.max_by("run_id", F.struct("score", -F.col("run_id"))).alias("best_run"),
    )
    order = Window.partitionBy("experiment_id").orderBy(F.desc("avg_score"), "failed", F.desc("runs"), F.desc("total_score"), "variant_id")
    return sums.withColumn("winner", F.row_number().over(order) == 1)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Precision, recall, hit, reciprocal rank and nDCG at k of each query; a document counts at its first place only."""
    first = ranked.groupBy("query_id", "document_id").agg(F.min("rank").alias("rank")).filter(F.col("rank") <= k)
    hits = first.join(relevant.distinct(), ["query_id", "document_id"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.aggregate(F.sort_array(F.collect_list(1 / F.log2(F.col("rank") + 1))), F.lit(0.0), lambda a, x: a + x).alias("dcg")
    )
    wanted = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    shown = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"))
    every = shown.join(wanted, "query_id", "outer").join(hits, "query_id", "left").fillna(0, ["shown", "relevant", "hits"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return every.select(
        "query_id", share(F.col("hits"), F.col("shown")).alias("precision"), share(F.col("hits"), F.col("relevant")).alias("recall"), F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("mrr"), F.when(F.col("hits") > 0, F.round(F.col("dcg") / ideal, 6)).otherwise(0.0).alias("ndcg"),
    )


def quality_gate(metrics: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """Means of the metrics against their minimums."""
    means = metrics.agg(*(F.round(F.avg(m), 6).alias(m) for m in minimums))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("actual"), F.lit(v).alias("minimum")) for m, v in minimums.items()))
    return means.select(F.explode(rows).alias("r")).select("r.*").withColumn("failed", F.coalesce(F.col("actual") < F.col("minimum"), F.lit(True)))


def graded_ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """nDCG at k with gains of ``2**grade - 1`` against the query's own best order."""
    gain = F.pow(F.lit(2.0), "grade") - 1
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))
    rows = ranked.withColumn("best", best)
    value = lambda place: F.round(F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1)).otherwise(0.0)), 9)
    return rows.groupBy("query_id").agg(value("rank").alias("dcg"), value("best").alias("ideal")).select("query_id", F.when(F.col("ideal") > 0, F.round(F.col("dcg") / F.col("ideal"), 6)).otherwise(0.0).alias("ndcg"))


def regression_verdicts(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Rank of the first result that holds the expected text, and whether it is within the required rank."""
    joined = cases.join(results, "query_id", "left").withColumn("hit", F.when(F.contains("text", F.col("expected")), F.col("rank")))
    ranks = joined.groupBy("query_id", "required_rank").agg(F.min("hit").alias("first_rank"))
    return ranks.withColumn("verdict", F.when(F.col("first_rank") <= F.col("required_rank"), "PASS").otherwise("FAIL"))


def stage_rollup(events: DataFrame) -> DataFrame:
    """First and last time, number of events and average value of each job's stages; ``current`` marks the last stage."""
    sums = events.groupBy("job_id", "stage").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))
    latest = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("last_ts"), "stage")) == 1
    return sums.withColumn("current", latest)


#: Of the ranks by which approximate percentiles bound a percentile; their own error is half of it.
RANK_SLACK = 2e-4
#: So many values of a group are put in order as they are; the slack wouldn't be a whole rank.
FEW_VALUES = 100_000


def exact_percentiles(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """``by, n`` and an array ``p`` of interpolated percentiles of each group's values, nulls and NaN aside.

    A group may hold any number of values. Approximate percentiles bound where each wanted rank lies; one more pass counts
    what is below the bounds, and only values between them are put in order, folded to one row for each different value.
    """
    rows = rows.select(by, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    asked = [min(1.0, max(0.0, s + d)) for s in shares for d in (-RANK_SLACK, RANK_SLACK)]
    bounds = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", F.array(*map(F.lit, asked)), F.lit(round(2 / RANK_SLACK))).alias("q"))
    held = rows.join(bounds, by)
    end = lambda at, all_of: F.when(F.col("n") <= FEW_VALUES, F.lit(all_of)).otherwise(F.col("q")[at])
    ends = [(end(2 * k, float("-inf")), end(2 * k + 1, float("inf"))) for k in range(len(shares))]
    below = held.groupBy(by).agg(F.first("n").alias("n"), F.array(*(F.count_if(F.col("v") < low) for low, _ in ends)).alias("below"))
    between = F.array_compact(F.array(*(F.when(F.col("v").between(low, high), F.lit(k)) for k, (low, high) in enumerate(ends))))
    values = held.select(by, "v", F.explode(between).alias("k")).groupBy(by, "k", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by, "k").orderBy("v"))
    placed = values.join(below, by).withColumn("last", F.element_at("below", F.col("k") + 1) + upto - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    at = F.element_at(F.array(*map(F.lit, shares)), F.col("k") + 1) * (F.col("n") - 1)
    low, high = F.floor(at), F.ceil(at)
    pick = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))
    found = placed.withColumns({"at": at, "low": low, "high": high}).groupBy(by, "k", "n", "at", "low").agg(pick(F.col("low")).alias("x"), pick(F.col("high")).alias("y"))
    each = found.withColumn("p", F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.col("low")))
    return each.groupBy(by, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda s: s["p"]).alias("p"))


def latency_percentiles(runs: DataFrame, budget: float) -> DataFrame:
    """P50, P95 and P99 of each lane, and how its P95 stands to the budget."""
    sums = exact_percentiles(runs, "lane", "value", [0.5, 0.95, 0.99])
    sums = sums.select("lane", *(F.round(F.col("p")[k], 6).alias(name) for k, name in enumerate(("p50", "p95", "p99"))), F.col("n").alias("runs"))
    return sums.withColumn("budget", F.when(F.col("p95") >= budget, "over").when(F.col("p95") >= 0.8 * budget, "near").otherwise("healthy"))


def pathway_status(traces: DataFrame, stages: list[str]) -> DataFrame:
    """One row for each run and stage, with what the run's traces say about it."""
    grid = traces.select("run_id").distinct().select("run_id", F.posexplode(F.array(*map(F.lit, stages))).alias("place", "stage"))
    worst = traces.groupBy("run_id", "stage").agg(F.max(F.when(F.col("word").isin("failed", "error"), 2).otherwise(1)).alias("w"))
    joined = grid.join(worst, ["run_id", "stage"], "left")
    return joined.select("run_id", "place", "stage", F.when(F.col("w") == 2, "failed").when(F.col("w") == 1, "done").otherwise("not_run").alias("status"))


def lane_policy(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """A query may use a lane if all its documents allow it; it is blocked if any document blocks."""
    joined = queries.join(docs, "document_id", "left")
    return joined.groupBy("query_id").agg(
        F.bool_and(F.coalesce("vector_ok", F.lit(True))).alias("vector_ok"), F.bool_or(F.coalesce("blocked", F.lit(False))).alias("blocked"), F.count_if(F.col("vector_ok").isNull()).alias("unknown_documents"),
    )


# What each metric has to reach.
GATES = {"exact_reference_hit_rate": 1.0, "source_accuracy": 1.0, "graph_expansion_precision": 0.8, "reranker_ndcg": 0.98, "context_grounding_rate": 1.0}


def baseline_gates(cases: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """``metric, value, gate, passed`` of five metrics over all cases; a metric without anything to judge is 1.

    ``cases (query_id, query_class, expected_references, expected_sources, relevant_graph, required, assembled)``,
    ``results (query_id, rank, chunk_id, source_id, reference_id, lane, grade)``. The first result of a case decides its
    hit and its source; all results of the graph lane of cases with relevant graph chunks count for precision; grades are
    compared with their best order within the first ``k``; required chunks are counted over all cases. Cases and results
    meet once; a row for each case, then one row of sums.
    """
    share = lambda n, of: F.coalesce(F.sum(n) / F.nullif(F.sum(of), F.lit(0)), F.lit(1.0))
    gain = lambda grades: F.aggregate(F.transform(F.slice(grades, 1, k), lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x)
    item = F.struct("rank", "chunk_id", "source_id", "reference_id", "lane", "grade")
    joined = cases.join(results.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("r")), "query_id", "left")
    top, graph = F.get("r", F.lit(0)), F.filter("r", lambda x: x["lane"] == "graph")
    grades = F.transform("r", lambda x: x["grade"])
    ideal = gain(F.sort_array(grades, asc=False))
    exact = F.col("query_class") == "exact_reference"
    judged = F.size("relevant_graph") > 0
    needed = F.array_distinct("required")
    rows = joined.select(
        F.when(exact, F.coalesce(F.array_contains("expected_references", top["reference_id"]), F.lit(False)).cast("int")).alias("hit"), exact.cast("int").alias("asked"),
        F.coalesce(F.array_contains("expected_sources", top["source_id"]), F.lit(False)).cast("int").alias("source"), F.lit(1).alias("one"),
        F.when(judged, F.size(F.filter(graph, lambda x: F.array_contains("relevant_graph", x["chunk_id"])))).alias("relevant"), F.when(judged & F.col("r").isNotNull(), F.size(graph)).alias("expanded"),
        F.when(F.col("r").isNotNull(), F.when(ideal > 0, gain(grades) / ideal).otherwise(1.0)).alias("ndcg"), F.col("r").isNotNull().cast("int").alias("graded"),
        F.size(F.array_intersect(needed, "assembled")).alias("grounded"), F.size(needed).alias("needed"),
    )
    sums = rows.agg(
        share("hit", "asked").alias("exact_reference_hit_rate"), share("source", "one").alias("source_accuracy"), share("relevant", "expanded").alias("graph_expansion_precision"), share("ndcg", "graded").alias("reranker_ndcg"),
        share("grounded", "needed").alias("context_grounding_rate"),
    )
    metrics = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"), F.lit(gate).alias("gate")) for name, gate in GATES.items()))
    return sums.select(F.explode(metrics).alias("m")).select("m.metric", F.round("m.value", 9).alias("value"), "m.gate", (F.col("m.value") >= F.col("m.gate")).alias("passed"))


def quality_repairs(chunks: DataFrame, most: int = 25) -> DataFrame:
    """``document_id, script_repairs, noise_downgrades, requests, statuses, samples`` of each document.

    ``chunks (document_id, chunk_id, script_status, downgraded, requests array<struct<block_id: string, status: string>>)``:
    applied repairs of scripts, downgraded warnings, requests for another reading of blocks with how often each status
    occurs, and the first ``most`` of them. Requests are counted by partial aggregates and cut before they are gathered.
    """
    sums = chunks.groupBy("document_id").agg(
        F.count_if(F.col("script_status") == "applied").alias("script_repairs"), F.coalesce(F.sum("downgraded"), F.lit(0)).cast("long").alias("noise_downgrades"), F.coalesce(F.sum(F.greatest(F.size("requests"), F.lit(0))), F.lit(0)).cast("long").alias("requests"),
    )
    asked = chunks.select("document_id", "chunk_id", F.posexplode("requests").alias("p", "r")).filter("r is not null")
    counts = asked.filter("r.status != ''").groupBy("document_id", "r.status").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "status", "n"))), ",").alias("statuses"))
    first = asked.withColumn("_r", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_id", "p"))).filter(F.col("_r") <= most)
    samples = first.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "r.block_id"))), lambda x: x["block_id"]).alias("samples"))
    out = sums.join(counts, "document_id", "left").join(samples, "document_id", "left")
    return out.select("document_id", "script_repairs", "noise_downgrades", "requests", F.coalesce("statuses", F.lit("")).alias("statuses"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
