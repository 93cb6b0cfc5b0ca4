"""Reading order and ranges on two axes against plain loops; relations of a hand-made page."""

import random

from pyspark.sql import functions as F

from siftwell.operators import joins as J
from siftwell.operators import layout as Y

BOX = "document_id long, page int, block_index int, x0 double, y0 double, x1 double, y1 double, text string"


def plain_order(blocks):
    """Page by page: separators, bands, columns, top to bottom."""
    out = {}
    for doc in {b[0] for b in blocks}:
        own, order = sorted((b for b in blocks if b[0] == doc), key=lambda b: b[2]), []
        for page in sorted({b[1] for b in own}, key=lambda p: (p is None, p)):
            rows = [b for b in own if b[1] == page]
            if any(v is None for b in rows for v in b[3:7]):
                order += rows
                continue
            down = lambda b: (b[2],) if b[1] is None else (b[4], b[3], b[2])
            width = max(1.0, *(max(b[5], b[5] - b[3]) for b in rows))
            wide = sorted((b for b in rows if b[5] - b[3] >= 0.7 * width), key=down)
            narrow = [b for b in rows if b not in wide]
            letters = "".join(b[7] or "" for b in rows)
            rtl = 2 * sum("֐" <= c <= "ࣿ" for c in letters) > sum(c.isalpha() for c in letters)
            if len(narrow) < 2:
                order += sorted(rows, key=down)
                continue
            for band in range(len(wide) + 1):
                columns, right = [], None
                for b in sorted((b for b in narrow if sum((b[4] + b[6]) / 2 >= w[4] for w in wide) == band), key=lambda b: (b[3], b[2])):
                    if right is None or b[3] - right > 0.05 * width:
                        columns.append([])
                    columns[-1].append(b)
                    right = max(right if right is not None else b[5], b[5])
                for c in reversed(columns) if rtl else columns:
                    order += sorted(c, key=down)
                order += wide[band : band + 1]
        out |= {(doc, b[2]): i for i, b in enumerate(order, 1)}
    return out


def test_reading_order_against_plain_rules(spark):
    rng, blocks = random.Random(2), []
    for doc in range(150):
        for i in range(rng.randrange(1, 14)):
            x, y = rng.choice((0, 20, 300, 340, 600)), rng.randrange(0, 12) * 40
            w = rng.choice((900, 180, 200, 250))
            box = (None, None, None, None) if rng.random() < 0.02 else (float(x if w < 900 else 0), float(y), float((x if w < 900 else 0) + w), float(y + 30))
            blocks.append((doc, rng.choice((1, 1, 2, None)), i, *box, rng.choice(("abc", "كتاب", "كتاب باب", "", None)) if doc % 3 else "كتاب"))
    df = spark.createDataFrame(blocks, BOX).repartition(4)
    rows = Y.document_order(df).collect()
    assert {(r["document_id"], r["block_index"]): r["place"] for r in rows} == plain_order(blocks)
    assert any(r["rtl"] for r in rows) and not all(r["rtl"] for r in rows) and Y.document_order(df.limit(0)).count() == 0


def test_two_columns_right_to_left(spark):
    boxes = [("t", 0, 0, 1000, 80), ("l1", 40, 100, 430, 140), ("r1", 560, 100, 950, 140), ("l2", 40, 150, 430, 190), ("r2", 560, 150, 950, 190), ("f", 0, 900, 1000, 940)]
    for text, want in (("latin", ["t", "l1", "l2", "r1", "r2", "f"]), ("نص", ["t", "r1", "r2", "l1", "l2", "f"])):
        df = spark.createDataFrame([(1, 1, i, *map(float, b[1:]), text) for i, b in enumerate(boxes)], BOX)
        assert [boxes[r["block_index"]][0] for r in Y.document_order(df).orderBy("place").collect()] == want


def test_ranges_on_two_axes(spark):
    rng = random.Random(6)

    def make(n):
        out = []
        for i in range(n):
            p, u = rng.randrange(-5, 60), rng.randrange(-40, 200)
            out.append((rng.choice("ab"), i, p, p + rng.choice((0, 0, 1, 7, 40)), u, u + rng.choice((0, 0, 2, 9, 100, 300))))
        return out

    schema = "k string, id long, parent_start long, parent_end long, unit_start long, unit_end long"
    rows = make(300)
    seeds = rows[:40]
    want = set()
    for s in seeds:
        for r in rows:
            gap = max(0, r[4] - s[5], s[4] - r[5])
            if s[0] == r[0] and s[1] != r[1] and s[2] <= r[3] and r[2] <= s[3] and gap <= 3:
                want.add((s[0], s[1], r[1], gap))
    got = [tuple(r) for r in J.near_range_pairs(spark.createDataFrame(seeds, schema), spark.createDataFrame(rows, schema), 3, ["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    points = spark.createDataFrame([("a", 1, 1, 1, 5, 5), ("a", 2, 1, 1, 6, 6), ("a", 3, 2, 2, 6, 6)], schema)
    assert [tuple(r) for r in J.near_range_pairs(points.filter("id = 1"), points, 1, ["k"]).collect()] == [("a", 1, 2, 1)]
    assert J.near_range_pairs(points.limit(0), points, 1, ["k"]).count() == 0


CHUNK = "document_id long, chunk_index int, page int, reference string, groups array<string>, reading_order int, tokens array<string>, x0 double, y0 double, x1 double, y1 double, blocked boolean"


def test_relations_of_a_page(spark):
    tokens = lambda *t: list(t)
    rows = [
        (1, 0, 1, "A", ["g"], 0, tokens("table"), 0.0, 0.0, 10.0, 10.0, False), (1, 1, 1, None, ["g", "h"], 1, tokens("caption"), 0.0, 20.0, 10.0, 30.0, None), (1, 2, 2, "A", [], 9, tokens("text"), 0.0, 0.0, 10.0, 10.0, False),
        (1, 3, 1, None, None, None, tokens("text"), 50.0, 100.0, 60.0, 110.0, False), (1, 4, 1, "A", ["g"], 2, tokens("text"), 0.0, 0.0, 1.0, 1.0, True), (2, 5, 1, None, ["h"], 1, tokens("formula"), 0.0, 900.0, 10.0, 910.0, False),
        (1, 6, 3, None, ["g"], 5, tokens("figure"), None, None, None, None, False), (3, 7, 1, "A", ["g"], 1, tokens("text"), 0.0, 0.0, 1.0, 1.0, False),
    ]
    chunks = spark.createDataFrame(rows, CHUNK)
    contract = "struct<relationships: array<string>, vertical_proximity: double, horizontal_overlap_min: double>"
    seeds = spark.createDataFrame([(1, 1, 0, None), (2, 1, 1, (Y.RELATIONS, 60.0, 0.5)), (2, 2, 5, None), (3, 1, 0, (["equation"], None, None)), (4, 9, 9, None)], f"query_id long, document_id long, chunk_index int, contract {contract}")
    got = {(r["query_id"], r["chunk_index"]): (r["reasons"], r["final_score"]) for r in Y.layout_relations(seeds, chunks, 9).collect()}
    L = "layout_neighbor"
    assert got == {
        (1, 1): ([L, "spatial_proximity", "layout_group", "reading_order_neighbor"], 14.5), (1, 2): ([L], 10.5), (1, 3): ([L, "spatial_proximity"], 11.5), (1, 6): ([L, "layout_group"], 12.5),
        (2, 0): ([L, "spatial_proximity", "bbox_overlap", "layout_group", "reading_order_neighbor", "table_caption"], 17.5), (2, 3): ([L], 10.5), (2, 6): ([L, "layout_group", "figure_caption"], 14.5),
    }
    assert [r["chunk_index"] for r in Y.layout_relations(seeds, chunks, 2).filter("query_id = 1").orderBy("place").collect()] == [1, 2]


def test_tokens_and_captions(spark):
    got = spark.createDataFrame([("Table-Cell", "body/image", None)], "a string, b string, c string").select(Y.layout_tokens(F.col("a"), F.col("b"), F.col("c")).alias("t")).first()["t"]
    assert sorted(got) == ["body", "cell", "image", "table", "table_cell"]
    rows = [(1, 1, 0, ["table"], 0.0, 10.0), (1, 1, 1, ["caption"], 20.0, 30.0), (1, 1, 2, ["image"], 40.0, 50.0), (1, 1, 3, ["caption"], 44.0, 54.0), (1, 2, 4, ["caption"], 0.0, 1.0), (1, 1, 5, ["caption"], None, 3.0), (1, 3, 6, ["caption"], 5.0, 5.0), (1, 3, 7, ["figure"], 90.0, 99.0)]
    df = spark.createDataFrame(rows, "document_id long, page int, chunk_index int, tokens array<string>, y0 double, y1 double")
    assert {(r["chunk_index"], r["target"], r["family"], r["distance"]) for r in Y.assign_captions(df).collect()} == {(1, 0, "table", 20.0), (3, 2, "figure", 4.0), (6, 7, "figure", 89.5)}
