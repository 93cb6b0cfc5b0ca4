"""Operators on small fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import aggregates as A
from siftwell.operators import chunking as C
from siftwell.operators import joins as J
from siftwell.operators import ranking as R
from siftwell.operators import windows as W
from siftwell.sources import tables as S
from siftwell.streaming import jobs as X


def test_arabic(spark):
    rows = spark.createDataFrame([("وَالْكِتَابُ  أحمد",)], "t string").select(T.normalise_arabic(F.col("t")).alias("n"), T.arabic_tokens(F.col("t")).alias("k")).first()
    assert rows["n"] == "والكتاب احمد"
    assert rows["k"] == ["والكتاب", "الكتاب", "احمد"]


def test_stitch_joins_a_broken_paragraph(spark):
    df = spark.createDataFrame([("d", 0, "The para-"), ("d", 1, "graph goes pre- and post"), ("d", 2, "on."), ("d", 3, "Next one")], "document_id string, chunk_index int, text string")
    got = {(r["chunk_index"], r["parts"], r["text"]) for r in W.stitch(df).collect()}
    assert got == {(0, 3, "The paragraph goes pre- and post on."), (3, 1, "Next one")}


def test_rows_without_terms_are_like_no_other(spark):
    ranked = spark.createDataFrame([(1, 1, 10, "..", False), (1, 2, 11, "!!", False), (1, 3, 12, "alpha beta", False), (1, 4, 13, "beta alpha", False)], "query_id long, rank int, document_id long, text string, must_keep boolean")
    assert [r["document_id"] for r in R.diversify(ranked, 5).orderBy("place").collect()] == [10, 11, 12]


def test_phrases_in_quotes(spark):
    rows = spark.createDataFrame([('say "one two three four"', "x one two three four y"), ('say "one two"', "one two"), ("one two", "a ONE two")], "q string, t string")
    assert [r[0] for r in rows.select(R.phrase_score(F.col("q"), F.col("t"))).collect()] == [24, 0, 8]


def test_short_texts_have_one_window(spark):
    df = spark.createDataFrame([("one two",), ("a b c d e",), ("",)], "t string")
    assert [r[0] for r in df.select(R._shingles(F.col("t"), 4)).collect()] == [["one two"], ["a b c d", "b c d e"], []]


def test_reading_order_columns(spark):
    boxes = [("p", 0, 0, 1000, 0, 80), ("p", 1, 40, 430, 100, 150), ("p", 2, 560, 950, 100, 150), ("p", 3, 40, 430, 200, 250), ("p", 4, 560, 950, 200, 250), ("p", 5, 0, 1000, 900, 950)]
    df = spark.createDataFrame(boxes, "page_id string, block int, x0 int, x1 int, y0 int, y1 int")
    assert [r["block"] for r in W.reading_order(df).orderBy("place").collect()] == [0, 1, 3, 2, 4, 5]


def test_metrics_fixture(spark):
    ranked = spark.createDataFrame([(1, 12, 1), (1, 13, 2), (1, 14, 3)], "query_id long, document_id long, rank int")
    relevant = spark.createDataFrame([(1, 13), (1, 14)], "query_id long, document_id long")
    row = A.retrieval_metrics(ranked, relevant, 3).first().asDict()
    assert row == {"query_id": 1, "precision": 0.666667, "recall": 1.0, "hit": 1.0, "mrr": 0.5, "ndcg": 0.693426}


def test_duplicate_hits_do_not_inflate(spark):
    ranked = spark.createDataFrame([(1, 13, 1), (1, 13, 2)], "query_id long, document_id long, rank int")
    relevant = spark.createDataFrame([(1, 13), (1, 14)], "query_id long, document_id long")
    row = A.retrieval_metrics(ranked, relevant, 3).first()
    assert row["recall"] == 0.5 and row["precision"] == 1.0


def test_greedy_packing_and_context(spark):
    docs = spark.createDataFrame([("d", "one two three. four five. " + "w " * 7)], "document_id string, text string")
    pieces = [r["n_words"] for r in C.hard_split(docs, 5).orderBy("piece_index").collect()]
    assert pieces == [5, 5, 2]


def test_context_assembly(spark):
    words = lambda n, w: " ".join([w] * n)
    rows = [
        (1, 1, 10, "a", words(60, "aa"), False, None), (1, 2, 11, "b", words(60, "bb"), False, None), (1, 3, 12, "c", words(35, "cc"), False, None), (1, 4, 13, "d", words(2, "dd") + "\n\n" + words(90, "x"), True, None),
        (1, 5, 10, "a", words(60, "aa"), False, None), (1, 6, 14, "e", "e", False, "blocked"), (2, 1, 10, "a", words(300, "aa"), False, None), (2, 2, 15, "f", words(120, "f"), True, None),
    ]
    df = spark.createDataFrame(rows, "query_id long, rank int, document_id long, key string, text string, direct boolean, policy string")
    out = R.assemble_context(df, 100, 80).cache()
    got = {(r["query_id"], r["rank"]): (r["kept"], r["reason"], r["tokens"]) for r in out.collect()}
    # The direct row comes first and is cut to its first paragraph; 60 + 2 fit, the next 60 do not, the 35 after them do.
    assert got[1, 4] == (True, "truncated", 2) and got[1, 1] == (True, None, 60) and got[1, 2] == (False, "token_budget", 60) and got[1, 3] == (True, None, 35)
    assert got[1, 5][:2] == (False, "duplicate") and got[1, 6][:2] == (False, "blocked")
    assert got[2, 2] == (True, "direct_over_budget", 80) and got[2, 1][:2] == (False, "token_budget")
    assert {(r["query_id"], r["evidence"], r["tokens"], r["status"]) for r in R.context_status(out).collect()} == {(1, 3, 97, "grounded"), (2, 1, 80, "grounded")}


def test_graph_expansion_paths(spark):
    """Direct chunks, over one reference, over two; three are too far; a limit keeps the nearest."""
    nodes = spark.createDataFrame([("s", "document"), ("r1", "reference"), ("r2", "reference"), ("r3", "reference"), *((f"k{i}", "chunk") for i in range(9))], "node string, kind string")
    edges = spark.createDataFrame([("s", "k8"), ("r1", "s"), ("r1", "k3"), ("r1", "k8"), ("r2", "r1"), ("k1", "r2"), ("r3", "r2"), ("r3", "k0"), ("k3", "k4")], "source string, target string")
    seeds = spark.createDataFrame([("s",)], "seed string")
    got = [(r["node"], r["path"], r["place"], r["score"]) for r in J.graph_expand(seeds, nodes, edges, 5).orderBy("place").collect()]
    assert got == [("k8", 0, 1, 19.0), ("k3", 1, 2, 18.0), ("k1", 2, 3, 17.0)]
    assert [r["node"] for r in J.graph_expand(seeds, nodes, edges, 2).orderBy("place").collect()] == ["k8", "k3"]


def test_diversify_skips_look_alikes(spark):
    rows = [(1, 1, 10, "alpha beta gamma", False), (1, 2, 11, "alpha beta gamma", False), (1, 3, 12, "delta epsilon", False), (1, 4, 13, "alpha beta gamma", True)]
    df = spark.createDataFrame(rows, "query_id long, rank int, document_id long, text string, must_keep boolean")
    assert [r["document_id"] for r in R.diversify(df, 2).orderBy("place").collect()] == [10, 12, 13]


def test_eval_cases_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("question,must_include,expected_answer\nWhat?,a|b,\n,x,\nWhy?,,\n")
    good, bad = S.read_eval_cases(spark, str(tmp_path / "c.csv"), "csv")
    assert [(r["query"], r["must_include"]) for r in good.collect()] == [("What?", ["a", "b"])] and bad.count() == 2
    (tmp_path / "c.json").write_text('[{"id": "k", "prompt": "P", "sources": "s1|s2"}]')
    assert S.read_eval_cases(spark, str(tmp_path / "c.json"), "json")[0].first()["expected_sources"] == ["s1", "s2"]


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    S.write_table(spark.createDataFrame([(2, "c")], "k int, v string"), path, ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def _events(spark, tmp_path, data):
    rows = spark.read.parquet(f"{data}/events.parquet").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), "ts", "value")
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def _run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_equals_batch(spark, tmp_path, data):
    rows, stream = _events(spark, tmp_path, data)
    _run(X.stage_state(stream), "stages", "complete")
    assert sorted(map(repr, spark.table("stages").collect())) == sorted(map(repr, X.stage_state(rows).collect()))
    named = lambda df: df.withColumnRenamed("stage", "lane")
    _run(X.run_health(named(stream), late="30 days"), "health", "complete")
    assert sorted(map(repr, spark.table("health").collect())) == sorted(map(repr, X.run_health(named(rows), late=None).collect()))


def test_stream_stalled_jobs(spark, tmp_path):
    schema = "event_id long, job_id long, stage string, ts timestamp"
    for i, part in enumerate(([(1, 1, "view", "2024-01-01 00:00:00"), (2, 2, "search", "2024-01-01 00:00:00")], [(3, 1, "click", "2024-01-01 05:00:00")], [(4, 3, "view", "2024-01-02 12:00:00")], [(5, 3, "view", "2024-01-02 12:01:00")])):
        spark.createDataFrame(part, "event_id long, job_id long, stage string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"p{i}"))
    import shutil

    source = tmp_path / "in"
    source.mkdir()
    stream = X.stream_stalled_jobs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), 3 * 3600 * 1000, 3)
    q = stream.writeStream.format("memory").queryName("stalled").outputMode("append").start()
    try:
        for i in range(4):
            for f in sorted((tmp_path / f"p{i}").glob("*.parquet")):
                shutil.copy(f, source / f"{i}-{f.name}")
            q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["job_id"], r["stage"], r["action"]) for r in spark.table("stalled").collect()}
    assert (2, "search", "resume") in got and (1, "click", "retry") in got


def test_stream_ingest(spark, tmp_path):
    """Two batches: a content that stands already is not written again, new content replaces a document, and one batch
    gives what the batch twin gives."""
    folder, out = str(tmp_path / "docs"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("doc_id long, text string").parquet(folder)
        X.stream_ingest(stream, out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return {(r["document_id"], r["text"]) for r in X.ingested(spark, out).collect()}

    first = [(1, "a\nb"), (2, "a\nb"), (3, "c")]
    assert arrive(first) == {(1, "a"), (1, "b"), (3, "c")} == {(r["document_id"], r["text"]) for r in X.ingest(spark.createDataFrame(first, "doc_id long, text string")).collect()}
    assert arrive([(4, "a\nb"), (3, "d\ne"), (5, "f")]) == {(1, "a"), (1, "b"), (3, "d"), (3, "e"), (5, "f")}


@pytest.mark.parametrize("few", [100, 100_000])
def test_percentiles_of_many_equal_values(spark, monkeypatch, few):
    monkeypatch.setattr(A, "FEW_VALUES", few)
    monkeypatch.setattr(A, "RANK_SLACK", 2e-3)
    values = [1.0] * 5000 + [float(i) for i in range(3000)] + [1e9] * 10
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0), ("c", None)], "lane string, value double")
    got = {r["lane"]: r["p"] for r in A.exact_percentiles(df, "lane", "value", [0.0, 0.5, 0.95, 0.99, 1.0]).collect()}
    values.sort()
    at = lambda s: values[int(s * (len(values) - 1))] + (values[min(len(values) - 1, int(s * (len(values) - 1)) + 1)] - values[int(s * (len(values) - 1))]) * (s * (len(values) - 1) % 1)
    assert got["b"] == [7.0] * 5 and set(got) == {"a", "b"}
    assert all(abs(x - at(s)) < 1e-6 * max(1, at(s)) for x, s in zip(got["a"], [0.0, 0.5, 0.95, 0.99, 1.0], strict=True))
