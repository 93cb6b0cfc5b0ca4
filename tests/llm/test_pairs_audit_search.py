"""Range join of vectors, filter audit and ranked search against plain versions, and on odd rows."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.fixtures import documents, empty_documents
from siftwell.llm import embedding_dedup, filter_audit, lexical_search

BIG = 2**60


def clusters(rng, dim, spread):
    """Families of near copies, one of them a third of all, a chain that only hangs together link by link, and loose vectors."""
    rows = []
    for size in (60, 20, 8, 3):
        centre = rng.normal(size=dim)
        rows += [centre + spread * rng.normal(size=dim) for _ in range(size)]
    a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    rows += [math.cos(x) * a + math.sin(x) * b for x in np.arange(12) * 0.35]
    rows += [x for v in rng.normal(size=(60, dim)) for x in (v, 3 * v)]
    return [list(map(float, r)) for r in rows] + [list(map(float, rows[0]))] * 5


def plain_links(rows, threshold):
    links = defaultdict(set)
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = np.array(rows[i][1]), np.array(rows[j][1])
        if len(a) == len(b) and (a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())) >= threshold:
            links[i].add(j), links[j].add(i)
    return links


def plain_components(rows, links):
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        out[i] = min(rows[j][0] for j in seen)
    return out


@pytest.mark.parametrize(("dim", "spread", "block", "pivots"), [(8, 0.1, 2048, 2048), (8, 0.3, 16, 2048), (32, 0.25, 16, 2048), (4, 0.1, 64, 6), (16, 0.05, 8, 1)])
def test_vectors_against_all_pairs(spark, monkeypatch, dim, spread, block, pivots):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "MAX_PIVOTS", pivots)
    monkeypatch.setattr(embedding_dedup, "SENT", 0)  # cells however small the input is
    rng = np.random.default_rng(dim)
    vectors = clusters(rng, dim, spread)
    ids = [int(i) for i in rng.permutation(len(vectors))]
    rows = [(BIG + i, v) for i, v in zip(ids, vectors, strict=True)]
    links = plain_links(rows, 0.9)
    parts = plain_components(rows, links)
    want = sorted((r[0], len(links[i]), parts[i], r[0] == parts[i]) for i, r in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicate_vectors(df).collect()) == want


def test_cells_hold_all_partners():
    """However pivots lie, a vector is sent to the cell of each vector within reach of it; some are not sent everywhere."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = embedding_dedup.unit_rows(np.concatenate([c + 0.2 * rng.normal(size=(20, 16)) for c in centres]))
    reach = math.acos(0.9)
    cells = embedding_dedup.Cells(x[rng.permutation(len(x))[:50]], reach)
    own, angle = cells.home(x)
    cells.low, cells.high = np.full(50, math.pi), np.zeros(50)
    np.minimum.at(cells.low, own, angle)
    np.maximum.at(cells.high, own, angle)
    rows, to, _ = cells.reached(x, own)
    sent = set(zip(rows.tolist(), to.tolist(), strict=True))
    for i, j in np.argwhere(x @ x.T >= 0.9):
        assert (int(i), int(own[j])) in sent
    assert len(sent) < 50 * len(x) / 2


def test_vectors_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (8, []), (0, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [float("inf"), 1.0]), (0, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit(1), "id": F.lit(2), "kept": F.lit(3)})
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    want = [(0, 3, 0, True), (1, 3, 0, False), (2, 3, 0, False), (50, 1, 0, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (0, 3, 0, True), (None, 0, None, True), (9, 0, 9, True), (0, 1, 0, True)]
    assert got == Counter(want)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_equal_cosines_at_the_threshold(spark):
    """Pairs whose cosine is the threshold itself are judged by the plain formula, in whatever block they meet."""
    rows = [(i, [1.0, 0.0] if i % 2 else [4.0, 3.0]) for i in range(6)] + [(7, [4.0, -3.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.8).collect()}
    links = plain_links(rows, 0.8)
    assert got == {r[0]: (len(links[i]), plain_components(rows, links)[i]) for i, r in enumerate(rows)}


def plain_audit(docs, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1} for k in (0, 1))
    first, rows = {}, []
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    for doc, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(
            k for k, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), doc is not None and doc > first[text]), strict=True) if f
        )
        rows.append((source or "", fails, doc in good, doc in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, own in enumerate(order, 1):
                removed = [r for r in left if own in r[1]]
                redundant = sum(own in r[1] for r in gone)
                left, gone = [r for r in left if own not in r[1]], gone + removed
                shapley[own] += len(removed)
                alone = sum(r[0] == part and r[1] == own for r in rows)
                out[part, order, step] = [len(left), len(removed), redundant, alone, sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_against_plain_filters(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choice((words, words[:20])[k % 2]) for _ in range(rng.choice((10, 60)))) + rng.choice(("", " A", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGH", " 5%", "\n|")) for k in range(40)]
    docs = [(rng.choice((i, i, BIG + i)), rng.choice((rng.choice(texts), None, "", "É à 你好 " * 20)), rng.choice(("a", "a", "b", None, ""))) for i in range(300)]
    docs += [docs[0], docs[0], (None, texts[0], "a"), (None, None, "only")]
    labels = [(d, rng.choice((0, 1, None)), rng.choice((0, 1))) for d, _, _ in rng.sample(docs, 150)] + [(docs[0][0], 1, 1), (docs[0][0], 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"part": F.lit("x"), "good": F.lit(1), "A": F.lit(0), "n": F.lit(3)})
    got = filter_audit.audit_filters(df.repartition(3), spark.createDataFrame([(a, b, c, "z") for a, b, c in labels], "doc_id long, quality int, toxic int, part string"))
    want = plain_audit(docs, [x for x in labels if x[0] is not None])
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in got.collect()} == want
    assert filter_audit.audit_filters(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_contractions_of_one_document():
    """A document that fails B and D only is removed by whichever comes first, and is redundant to the other."""
    tensor = np.zeros((3, 2, 2, 2, 2, 2), np.int64)
    tensor[:, 0, 1, 0, 1, 0] = 1
    got = filter_audit.contract(tensor)
    for i, order in enumerate(filter_audit.ORDERS):
        first, second = (order.index(k) for k in sorted((1, 3), key=order.index))
        assert [got["removed"][i, k] for k in range(5)] == [int(k == first) for k in range(5)]
        assert [got["redundant"][i, k] for k in range(5)] == [int(k == second) for k in range(5)]
        assert got["good_lost"][i, first] == got["toxic_lost"][i, first] == 1 and not got["unique_fails"].any()
        assert [got["shapley"][i, order.index(k)] for k in range(5)] == [0, 60, 0, 60, 0]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, n_docs = sum(n for *_, n in held), len(held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= {*TERM.findall((t or "").translate(LOWER))}
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c, n in held:
            m = 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("width", "block_items", "seed"), [(1024, 1024, 64), (4, 3, 2)])
def test_search_against_plain_scores(spark, monkeypatch, width, block_items, seed):
    """Also with sketches so narrow that most bounds are far off, several blocks of items and many equal scores."""
    for name, value in (("WIDTH", width), ("BLOCK_ITEMS", block_items), ("SEED", seed), ("SLICE", 50), ("CHUNK", 4)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(width)
    words = [f"{rng.choice('aBcÉß你')}{i}" for i in range(60)]
    text = lambda n: rng.choice((" ", "-", "\n_")).join(words[min(int(rng.expovariate(0.1)), 59)] for _ in range(n))
    docs = [(BIG + i if i % 3 else i, text(rng.choice((1, 3, 30, 200)))) for i in range(220)]
    docs += [docs[5], docs[5], (None, text(20)), (7, None), (8, ""), (9, " \n.,;"), (10, "a b c " * 30000)] + [(1000 + i, "same words here") for i in range(40)]
    items = [(i, text(6)) for i in range(9)] + [(3, text(2)), (20, "SAME here"), (21, None), (22, "..."), (None, text(5)), (23, "never-seen"), (BIG, "c a")]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "score": F.lit(2), "n": F.lit("x"), "id": F.lit(0)})
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    got = lexical_search.ranked_search(left.repartition(4), right, k=12)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(docs, items, 12)


def test_search_of_odd_tables(spark):
    docs, none = documents(spark), empty_documents(spark)
    items = spark.createDataFrame([(1, "the CAT"), (1, "the CAT"), (2, "")], "item_id long, text string")
    got = [tuple(r)[:3] for r in lexical_search.ranked_search(docs, items).orderBy("item_id", "rank").collect()]
    assert got[:3] == [(1, 1, 1), (1, 2, 1), (1, 3, 2)]
    assert lexical_search.ranked_search(none, items).count() == 0 and lexical_search.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical_search.ranked_search(docs, items.filter("item_id = 2")).count() == 0


def test_bounds_hold():
    """No document's score is above its bound."""
    rng = np.random.default_rng(1)
    terms = rng.integers(0, 2**63, 300).astype("<u8")
    block = lexical_search.Block({i: rng.choice(terms, 20) for i in range(10)})
    block.weigh({i: int(x) for i, x in enumerate(rng.integers(1, 99, len(block.terms)))}, 100, 5000)
    for _ in range(20):
        own = np.sort(rng.choice(len(block.terms), 40, replace=False))
        impacts = block.impacts(own, rng.integers(1, 9, 40), np.full(40, 77))
        sketch = np.zeros(lexical_search.WIDTH)
        np.maximum.at(sketch, block.slot[own], impacts)
        for j, asked in enumerate(block.of_item):
            assert impacts[np.isin(own, asked)].sum() <= (sketch @ block.lookups)[j]
