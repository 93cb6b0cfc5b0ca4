"""Pairs of similar sets against all pairs, in every way that sizes choose, and what is shuffled for them."""

import random

import pytest

from siftwell.plans import evidence_queries

similar_sets = evidence_queries.similar_sets if hasattr(evidence_queries, "similar_sets") else evidence_queries.E.similar_sets


def brute(rows, threshold):
    first = {}
    for i, terms in rows:
        if i is not None and terms:
            key = frozenset(terms)
            first[key] = min(i, first.get(key, i))
    sets, out = list(first.items()), []
    for x, (s, a) in enumerate(sets):
        for t, b in sets[:x]:
            both = len(s & t)
            if a != b and both >= threshold * (len(s) + len(t) - both) - 1e-9:
                out.append((min(a, b), max(a, b), round(both / (len(s) + len(t) - both), 9)))
    return sorted(out)


def families(seed):
    rng, rows = random.Random(seed), []
    words = [f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(4000)]
    for i in range(60):
        base = set(rng.choices(words, k=rng.choice((1, 2, 3, 8, 20, 60, 300))))
        for j in range(rng.choice((1, 1, 3, 6))):
            kept = {t for t in base if rng.random() > 0.12} | set(rng.choices(words, k=max(1, len(base) // 12)))
            rows.append((100 * i + j, sorted(kept, key=lambda _: rng.random())))
    rows += [(7000, rows[3][1]), (-5, list(reversed(rows[3][1]))), (8000, []), (8001, None), (None, rows[4][1]), (9000, rows[10][1]), (9000, rows[20][1] + ["x"]), (9000, rows[30][1])]
    return rows


def got(spark, rows, threshold):
    return sorted(tuple(r) for r in similar_sets(spark.createDataFrame(rows, "id long, terms array<string>").repartition(3), threshold).collect())


@pytest.mark.parametrize("threshold", [0.65, 0.4])
def test_all_pairs(spark, threshold):
    rows = families(1)
    want = brute(rows, threshold)
    assert got(spark, rows, threshold) == want and len(want) > 40


def test_marks_by_shuffle_and_rounds_of_sets(spark, monkeypatch):
    from siftwell.operators import similar_sets as module

    monkeypatch.setattr(module, "LEAST_COUNT", 2)
    rows = families(2)
    want = brute(rows, 0.65)
    for most, frequent in ((20_000, 100), (1, 3)):
        monkeypatch.setattr(module, "BROADCAST_BYTES", most if most > 1 else 4000)
        monkeypatch.setattr(module, "FREQUENT_TERMS", frequent)
        assert got(spark, rows, 0.65) == want
    assert got(spark, [], 0.65) == []


def test_pairs_do_not_move_their_sets(spark):
    """Each two of 300 sets share one term, so thousands of pairs meet; no pair is similar. Tables of any size are taken for large."""
    n = 300
    rows = [(i, [f"{min(i, j)}-{max(i, j)}" for j in range(n) if j != i]) for i in range(n)]
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: store.executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(spark, rows, 0.65) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (moved := shuffled() - before) < 6_000_000, moved
