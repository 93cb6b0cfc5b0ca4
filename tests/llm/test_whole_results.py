"""What bounded candidates used to drop: results against brute force without the bounds."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftwell.llm import components, line_dedup, minhash


def families(rng):
    """Lists of integers: 60 pairs of near copies, all of them half made of one shared passage."""
    shared = list(range(10**6, 10**6 + 40))
    sets = {}
    for i in range(60):
        own = [rng.randrange(10**5) for _ in range(40)]
        sets[2 * i] = sorted({*shared, *own})
        sets[2 * i + 1] = sorted({*shared, *own[:-2], 2 * 10**6 + i})
    return sets


def test_large_groups_are_whole(spark):
    """One bucket of 60 pairs that are like no hub: each pair must be linked."""
    sets = families(random.Random(2))
    groups = spark.createDataFrame([(7, i) for i in sets], "key long, id long")
    rows = spark.createDataFrame(list(sets.items()), "id long, hashes array<long>").cache()

    def confirm(pairs):
        left, right = (rows.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
        both = F.size(F.array_intersect("ha", "hb"))
        return pairs.join(left, "a").join(right, "b").filter(100 * both >= 80 * (F.size("ha") + F.size("hb") - both)).select("a", "b")

    true = {(a, b) for a in sets for b in sets if a < b and (n := len({*sets[a]} & {*sets[b]})) * 100 >= 80 * (len(sets[a]) + len(sets[b]) - n)}
    assert len(true) == 60
    prefixes = lambda left: minhash.prefix_pairs(rows.join(left.select("id", "component").distinct(), "id"), 80)
    for rest in (prefixes, components.cross_pairs):
        got = {(r["a"], r["b"]) for r in components.link_groups(components.with_hubs(groups), confirm, rest=rest).collect()}
        assert got == true
    found = {(r["a"], r["b"]) for r in minhash.prefix_pairs(rows.withColumn("component", F.col("id")), 80).collect()}
    assert true <= found and len(found) < 400


def test_simhash_of_very_long_lines(spark):
    """Every word of a line of more than two lanes counts: the bits are those of all words."""
    words = [f"w{i % 977}" for i in range(2 * line_dedup.LANE + 11)]
    df = spark.createDataFrame([(1, words), (2, words[:50]), (3, None)], "id long, words array<string>")
    got = {r["id"]: r["sim"] for r in line_dedup.with_simhash(df, F.col("words"), ["id"]).collect()}
    hashes = {r["w"]: r["h"] for r in df.filter("id = 1").select(F.explode("words").alias("w")).distinct().withColumn("h", F.xxhash64("w")).collect()}
    sim = lambda own: sum(1 << b for b in range(64) if sum(hashes[w] >> b & 1 for w in own) > len(own) // 2)
    assert set(got) == {1, 2, 3} and got[3] is None
    assert got[1] % 2**64 == sim(words) and got[2] % 2**64 == sim(words[:50])


def test_large_line_groups_are_whole(spark, monkeypatch):
    """One key shared by 40 pairs of near copies that are like no hub: each pair must be linked."""
    monkeypatch.setattr(line_dedup, "block_keys", lambda hashes: F.array(F.lit(1).cast("long")))
    rng, rows = random.Random(5), []
    for i in range(40):
        w = [f"word{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:50], "other", *w[51:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup.dedup_lines(df).filter("n_dropped > 0").collect()}
    assert got == {2 * i + 1 for i in range(40)}


def test_very_common_passage_in_lines(spark):
    """A passage in 90 lines of their own, 20 variants of one more line that holds it, and pairs elsewhere."""
    rng, rows = random.Random(9), []
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, base = own(20), own(30)
    rows = [(i, " ".join([*own(rng.randrange(30, 90)), *passage, *own(10)])) for i in range(90)]
    for i in range(100, 120):
        text = [*passage, *base]
        text[rng.randrange(50)] = f"x{i}"
        rows.append((i, " ".join(text)))
    for i in range(90):  # each of the lines once more, with two words changed
        text = rows[i][1].split(" ")
        text[3], text[-3] = "y", "z"
        rows.append((200 + i, " ".join(text)))
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_dropped > 0").collect()}
    assert got == {*range(101, 120), *range(200, 290)}


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::5])
def test_an_id_with_two_texts(spark, order):
    """Both texts of the id take part, whatever order the rows come in."""
    rng = random.Random(3)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(80)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*b[:-1], "q"])), (3, " ".join([*a[:-1], "q"]))]
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string")
    got = minhash.near_duplicates(df, width=4).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def _recorded(monkeypatch):
    """What the line dedup writes: lists of the tables by name."""
    written, write = {}, line_dedup.materialise

    def record(df, name):
        written.setdefault(name, []).append(write(df, name))
        return written[name][-1]

    monkeypatch.setattr(line_dedup, "materialise", record)
    return written


def _lines_of_one_passage(rng):
    """60 lines that share two long words and no more, ten in a document, and a near copy of the last."""
    own = lambda: [f"word{rng.randrange(10**9)}" for _ in range(20)]
    lines = [["passage", "shared", *own()] for _ in range(60)]
    rows = [(i, "\n".join(" ".join(w) for w in lines[10 * i : 10 * i + 10])) for i in range(6)]
    return [*rows, (6, " ".join([*lines[-1][:-1], "other"]))]


def test_texts_of_verified_lines_only(spark, monkeypatch):
    """Lines that share a key, but whose SimHashes differ, must not be written with their texts."""
    monkeypatch.setattr(line_dedup, "block_keys", lambda hashes: F.array(F.lit(1).cast("long")))
    written = _recorded(monkeypatch)
    df = spark.createDataFrame(_lines_of_one_passage(random.Random(4)), "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.dedup_lines(df).filter("n_dropped > 0").collect()} == {6}
    close = [t.select(F.explode(F.array("a", "b"))).distinct().count() for t in written["close-lines"]]
    assert [t.count() for t in written["line-texts"]] == close and sum(close) < 20


@pytest.mark.parametrize("most", [None, 0])
def test_places_sent_by_document(spark, monkeypatch, most):
    """The places that a scan of the texts gets have a row for each document, not for each line; nothing changes if they are too many to be broadcast."""
    monkeypatch.setattr(line_dedup, "block_keys", lambda hashes: F.array(F.lit(1).cast("long")))
    if most is not None:
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", most)
    written = _recorded(monkeypatch)
    df = spark.createDataFrame(_lines_of_one_passage(random.Random(4)), "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.dedup_lines(df).filter("n_dropped > 0").collect()} == {6}
    assert written["line-places"][0].count() == 7 and all(t.count() <= 7 for t in written["line-places"])


def test_copies_of_a_document_in_line_dedup(spark):
    """Rows that are equal in id and text keep the same lines, and their lines are described once."""
    rng = random.Random(8)
    own = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(1, " ".join(own[:30]) + "\n" + " ".join(own[30:]))] * 3 + [(2, " ".join([*own[:29], "x"]) + "\n" + " ".join([*own[30:-1], "y"]))]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(1, 0), (1, 0), (1, 0), (2, 2)]
