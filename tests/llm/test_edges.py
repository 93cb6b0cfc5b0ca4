"""Every operator on odd rows and on empty tables: defined results, no crash, whole results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.fixtures import documents, empty_documents
from siftwell.llm import chat_format, language_id, licenses, line_dedup, minhash, mixing, packing, quality_cnn, quality_rules, vector_search


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return empty_documents(spark)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_rules(docs, none):
    got = by_id(quality_rules.quality_rules(docs))
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and not got[3]["kept"]
    assert got[7]["n_words"] == 12000 and got[7]["n_repeat_words"] == 12000 and got[7]["base_failed"]
    assert quality_rules.quality_rules(docs).count() == 13 and quality_rules.quality_rules(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 13 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[3] == 0
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_line_dedup(docs, none):
    got = [r for r in line_dedup.dedup_lines(docs).collect()]
    texts = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == 13 and texts[2] == "" and texts[3] is None and texts[4] == "" and texts[5] == " \n \t"
    assert texts[1].startswith("The cat") and texts[9] == "one two" and texts[10] == "One\ttwo"
    assert line_dedup.dedup_lines(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    lengths = {}
    for r in rows:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths[3] == lengths[4] == 1 and lengths[7] > 2048 and max(r["length"] for r in rows) <= 2048
    assert packing.pack_documents(none).count() == 0


def test_minhash(docs, none):
    got = by_id(minhash.near_duplicates(docs, width=4))
    assert got[2]["component_id"] == 1 and not got[2]["kept"] and got[3]["component_id"] == 3 and got[3]["n_shingles"] == 0
    assert got[10]["component_id"] == 9 and got[9]["n_shingles"] == 1 and got[None]["kept"] and got[None]["component_id"] is None
    assert minhash.near_duplicates(docs).count() == 13 and minhash.near_duplicates(none).count() == 0


def test_language_id(docs, none):
    got = by_id(language_id.learn_and_identify(docs))
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[6]["lang_pred"] == "und" and got[3]["score"] == 0
    assert got[8]["lang_pred"] != "und" and 0 <= got[8]["score"] <= 1
    assert language_id.learn_and_identify(none).count() == 0
    assert language_id.identify(docs, None).filter("lang_pred = 'und'").count() == 13


def test_licenses(docs, none):
    got = by_id(licenses.scan_licenses(docs))
    assert (got[11]["n_base"], got[11]["first_word"], got[11]["last_word"], got[11]["labels"]) == (2, 1, 6, "mit")
    assert got[3]["n_words"] == 0 and got[3]["labels"] == "" and got[3]["score"] == 0
    assert licenses.scan_licenses(docs).count() == 13 and licenses.scan_licenses(none).count() == 0


def test_quality_cnn(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (8, 1), (None, 1)], "doc_id long, quality int")
    got = quality_cnn.score(docs.select("doc_id", "text"), quality_cnn.fit(docs, labels))
    rows = got.collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert quality_cnn.score(none, quality_cnn.fit(none, labels.limit(0))).count() == 0
    assert {r["score"] for r in quality_cnn.score(docs, quality_cnn.fit(docs, labels.filter("quality = 1"))).collect()} == {1.0}


def test_chat_format(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (None, 3, "user", "x"), (3, None, "we\nird<s>", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("length", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 1 and got[2]["n_turns"] == 1 and set(got) == {1, 2, 3, None}
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def test_vector_search(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (100, [0.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in vector_search.nearest_neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert vector_search.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns go through each stage; so does an empty table."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (8, 1), (None, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    judged = stages["quality_classifier"](spark, docs, folder)
    assert judged.columns == docs.columns and judged.count() <= 13
    lines = stages["line_dedup"](spark, docs, folder).cache()
    assert lines.columns == docs.columns and lines.count() == 13
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}[2] == ("", 0)
    unique = stages["near_duplicates"](spark, docs, folder).cache()
    ids = sorted((r["doc_id"] for r in unique.collect()), key=lambda i: (i is None, i))
    assert unique.columns == docs.columns and ids == [1, 3, 4, 5, 6, 7, 8, 9, 11, None]
    mixed = stages["source_mixing"](spark, unique, folder).cache()
    assert mixed.columns == docs.columns and mixed.count() > 0 and mixed.filter("text is null or not text rlike '[^ \\\\n\\\\t]'").count() == 0
    pieces = stages["best_fit_packing"](spark, mixed, folder)
    assert pieces.filter("piece = 0").count() == mixed.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


IDS = [2**60 + 1, 2**60 + 2, 2**60 + 3, None, 7]


def test_large_ids_beside_a_null(spark):
    """Ids above 2**53 in one batch with a null come back as they are, from every operator whose tasks see ids."""
    docs = spark.createDataFrame([(i, f"text number {k} of a few words", "en", "s") for k, i in enumerate(IDS)], "doc_id long, text string, lang string, source string").coalesce(1)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(IDS)], "doc_id long, quality int").coalesce(1)
    results = [
        packing.pack_documents(docs), packing.pack_documents(docs, keep_ids=True), minhash.near_duplicates(docs), language_id.learn_and_identify(docs), licenses.scan_licenses(docs),
        quality_cnn.score(docs, quality_cnn.fit(docs, labels)), line_dedup.dedup_lines(docs), mixing.mix_sources(docs), quality_rules.quality_rules(docs),
    ]
    for rows in results:
        assert sorted((r["doc_id"] for r in rows.collect()), key=repr) == sorted(IDS, key=repr)
    turns = spark.createDataFrame([(i, t, r, f"{i} {t}") for i in IDS for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: (2, len(f"{i} 1")) for i in IDS}


def test_equal_rows_are_packed_apart(spark):
    """Copies of one row don't meet in one group: each group has about its share."""
    same = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(700).cast("long").alias("length"))
    rows = packing.pack(same, items_per_group=300).collect()
    assert len(rows) == 3000 and len({r["sequence_id"] for r in rows}) <= 1600
    first = packing._round(same.withColumns({"bin": F.monotonically_increasing_id(), "at": F.lit(0).cast("long"), "going": F.lit(True)}), 0, 10, False, 2048, ["doc_id", "length"])
    assert max(r["count"] for r in first.groupBy("group").count().collect()) < 500
