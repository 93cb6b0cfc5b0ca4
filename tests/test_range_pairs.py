"""Pairs of near ranges: broadcast or shuffled, ranges of all lengths, ids that repeat; and that few seeds leave the rows where they are."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell.operators import joins as J

SCHEMA = "k string, id long, parent_start long, parent_end long, unit_start long, unit_end long"


def made(rng, n, far):
    out = []
    for i in range(n):
        p, u = rng.randrange(-9, 50), rng.randrange(-60, 90)
        p, u = rng.choice(((p, u), (p + far, u), (-far, far)))
        out.append((rng.choice(("a", "b", None)), rng.choice((i, i, 7, None)), p, p + rng.choice((0, 0, 1, 3, 4, 5, 70, far)), u, u + rng.choice((0, 2, 3, 15, 16, 17, 300, far))))
    return out


@pytest.mark.parametrize("most", [J.BROADCAST_BYTES if hasattr(J, "BROADCAST_BYTES") else 0, -1])
def test_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(J, "BROADCAST_BYTES", most, raising=False)
    monkeypatch.setattr(J, "BLOCK_IDS", 30, raising=False)
    rng = random.Random(4)
    rows = made(rng, 250, 3 << 40)
    seeds = made(rng, 60, 3 << 40) + rows[:20]
    want = Counter()
    for s in seeds:
        for r in rows:
            gap = max(0, r[4] - s[5], s[4] - r[5])
            if None not in (s[0], s[1], r[1]) and s[0] == r[0] and s[1] != r[1] and s[2] <= r[3] and r[2] <= s[3] and gap <= 2:
                want[s[0], s[1], r[1], gap] += 1
    got = J.near_range_pairs(spark.createDataFrame(seeds, SCHEMA), spark.createDataFrame(rows, SCHEMA), 2, ["k"])
    assert got.columns == ["k", "seed", "id", "gap"] and Counter(tuple(r) for r in got.collect()) == want and max(want.values()) > 1


def test_few_seeds_leave_rows_unshuffled(spark):
    """Tables of any size are taken for large."""
    n = spark.range(60_000)
    parent, unit = F.col("id") * 7919 % 5000, F.col("id") * 104729 % 9000
    rows = n.select(F.lit("a").alias("k"), "id", parent.alias("parent_start"), (parent + F.col("id") % 3).alias("parent_end"), unit.alias("unit_start"), (unit + F.col("id") % 6).alias("unit_end"))
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert J.near_range_pairs(rows.filter("id % 50 = 0"), rows, 2, ["k"]).count() > 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (moved := store.executorSummary("driver").totalShuffleWrite() - before) < 1_000_000, moved
