"""Ingestion with keyed state: batches, restarts, releases; and that earlier output is never read."""

import random
import shutil

from siftwell.streaming import keyed_ingest as K

SCHEMA = "doc_id long, text string, seq long"


def _stream(spark, tmp_path):
    source, out = str(tmp_path / "docs"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = K.stream_keyed_ingest(stream, out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        return sorted((r["document_id"], r["chunk_index"], r["text"]) for r in K.standing(spark, out).collect())

    return arrive, out


def test_contents_change_hands(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", K.ROCKSDB)
    arrive, out = _stream(spark, tmp_path)
    assert arrive([(1, "a\nb", 1), (2, "a\nb", 1), (3, "c", 1), (None, "x", 1), (4, None, 1)]) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]
    # Each arrival is a restart of the query. Document 1 moves on, so 2 owns the old content; 5 repeats what stands.
    assert arrive([(1, "d", 2), (5, "c", 2)]) == [(1, 0, "d"), (2, 0, "a"), (2, 1, "b"), (3, 0, "c")]
    # Earlier output away: state alone decides, and nothing that was there is written again.
    shutil.move(out, str(tmp_path / "earlier"))
    assert arrive([(6, "a\nb", 3), (2, "a\nb", 3), (7, "g", 3), (3, None, 3)]) == [(7, 0, "g")]
    for kind in ("contents", "owners"):
        for f in (tmp_path / "earlier" / kind).iterdir():
            shutil.move(f, tmp_path / "out" / kind / f.name)
    got = sorted((r["document_id"], r["text"]) for r in K.standing(spark, out).collect())
    assert got == [(1, "d"), (2, "a"), (2, "b"), (5, "c"), (7, "g")]


def test_stream_equals_its_batch_twin(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", K.ROCKSDB)
    rng, rows = random.Random(8), []
    arrive, _ = _stream(spark, tmp_path)
    for seq in range(1, 4):
        fresh = [(d, rng.choice((None, *(f"text {t}\nmore" for t in range(12)))), seq) for d in rng.sample(range(20), 14)]
        rows += fresh
        got = arrive(fresh)
        twin = K.batch_standing(spark.createDataFrame(rows, SCHEMA))
        assert got == sorted((r["document_id"], r["chunk_index"], r["text"]) for r in twin.collect())
