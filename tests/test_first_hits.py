"""First chunks with any of a query's terms: against a plain loop, and that neither tokens nor all hits are shuffled."""

import random

from siftwell.operators import joins as J
from siftwell.plans.join_queries import QUERIES


def test_against_a_loop(spark):
    rng = random.Random(3)
    words = ["art", "Artist", "part7", "the", "them", "ab", "a1b2c3", "x-ray", "état", "über1art", "中文art中", "1a1a1a", "", "artartart", "İst"]
    docs = [(rng.choice((i, i, 5, None)), rng.randrange(4), rng.choice((None, " ".join(rng.choices(words, k=rng.randrange(9)))))) for i in range(120)]
    terms = [(1, "art"), (1, "art"), (1, "the"), (2, "1a1"), (2, "rt7"), (3, "b2c3"), (4, "nowhere"), (5, "tat"), (6, "artart"), (None, "them")]
    order = lambda p: (p[0] is None, p[0] or 0, p[1])
    for limit in (1, 7, 1000):
        want = set()
        for q in {q for q, _ in terms}:
            hits = {(d, c) for d, c, text in docs if text and any(t in text.lower() for p, t in terms if p == q)}
            want |= {(q, d, c, i + 1) for i, (d, c) in enumerate(sorted(hits, key=order)[:limit])}
        got = J.first_hits(spark.createDataFrame(terms, "query_id long, term string"), spark.createDataFrame(docs, "document_id long, chunk_index int, text string"), limit)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_no_tokens_are_shuffled(spark, data):
    """Tables of any size are taken for large."""
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert QUERIES["j14_lexical_vector_stub"][0](spark, data).count() > 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (moved := store.executorSummary("driver").totalShuffleWrite() - before) < 500_000, moved
