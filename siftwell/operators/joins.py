"""Joins of queries, candidates, chunks, neighbours, vectors and graphs. Every condition has an equality that spreads the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.sources.contracts import written

#: Tables of so many bytes may be broadcast. The driver holds them about twice while it builds the table.
BROADCAST_BYTES = 64_000_000
#: Bytes of a term with its query in such a table.
TERM_BYTES = 100


def lexical_prefilter(terms: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Chunks that hold the terms of a query as substrings: those with all terms, or with any if none has all.

    ``terms (query_id, term)`` have three characters or more and no white space, so a term lies inside one token. The
    different tokens of the corpus and the different terms meet on the term's first three characters, the few pairs that
    contain each other are joined to postings, and the texts themselves are never compared.
    """
    tokens = chunks.select("document_id", "chunk_index", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \t\n\r\x0b\x0c]+"), F.lit(0)))).alias("token"))
    trigrams = F.transform(F.sequence(F.lit(1), F.char_length("token") - 2), lambda i: F.substring(F.col("token"), i, F.lit(3)))
    vocabulary = tokens.select("token").distinct().filter(F.char_length("token") >= 3).withColumn("gram", F.explode(F.array_distinct(trigrams)))
    wanted = terms.select("term").distinct().withColumn("gram", F.substring("term", 1, 3))
    inside = vocabulary.join(wanted, "gram").filter(F.contains("token", F.col("term"))).select("token", "term")
    found = tokens.join(inside, "token").select("document_id", "chunk_index", "term").distinct()
    hits = found.join(terms.distinct(), "term").groupBy("query_id", "document_id", "chunk_index").agg(F.count(F.lit(1)).alias("matched"))
    asked = terms.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    hits = hits.join(asked, "query_id").withColumn("full", F.col("matched") == F.col("asked"))
    some_full = hits.groupBy("query_id").agg(F.bool_or("full").alias("any_full"))
    kept = hits.join(some_full, "query_id").filter(F.col("full") | ~F.col("any_full"))
    order = Window.partitionBy("query_id").orderBy("document_id", "chunk_index")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "document_id", "chunk_index", "matched", "place")


def first_hits(terms: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """``query_id, document_id, chunk_index, rank``: the first ``limit`` chunks, by document and place, that hold any of a
    query's ``terms (query_id, term)`` as substrings.

    ``terms`` are three or more of a to z and 0 to 9, so one lies inside one run of these. Terms are broadcast to a scan of
    the chunks, where each three characters of a run look for terms that begin with them. A task hands on a query's first ``limit``
    chunks only, so neither texts nor tokens nor all hits are shuffled.
    """
    wanted = written(terms.distinct(), "terms").withColumn("gram", F.substring("term", 1, 3))
    hint = F.broadcast if wanted.count() * TERM_BYTES <= BROADCAST_BYTES else lambda df: df
    runs = chunks.select("document_id", "chunk_index", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)))).alias("run"))
    grams = runs.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("run") - 2))).withColumn("gram", F.substring("run", F.col("at"), F.lit(3)))
    found = grams.join(hint(wanted.select("gram", "term").distinct()), "gram").filter(F.substring("run", F.col("at"), F.char_length("term")) == F.col("term"))
    hits = found.select("document_id", "chunk_index", "term").join(hint(wanted.select("term", "query_id")), "term")
    # A chunk may come several times; those are ties, and Spark prunes by the rank before the shuffle (window group limit).
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("document_id"), "chunk_index")
    return hits.select("query_id", "document_id", "chunk_index", F.dense_rank().over(order).alias("rank")).filter(F.col("rank") <= limit).distinct()


def reference_prefilter(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose ``preview_ref`` is one of a query's references, if they are eligible."""
    return references.select("query_id", "reference").distinct().join(chunks.filter("eligible"), F.col("reference") == F.col("preview_ref")).drop("reference", "eligible")


def token_prefilter(variants: DataFrame, tokens: DataFrame) -> DataFrame:
    """Chunks that hold any variant ``(query_id, token)`` of a query among their tokens."""
    return variants.distinct().join(tokens, "token").drop("token").distinct()


def hydrate(candidates: DataFrame, documents: DataFrame, in_scope: Column) -> DataFrame:
    """Candidates with ``status``: hydrated, out_of_scope or missing."""
    joined = candidates.join(documents.withColumn("_in", in_scope).select("document_id", "_in"), "document_id", "left")
    return joined.withColumn("status", F.when(F.col("_in").isNull(), "missing").when(F.col("_in"), "hydrated").otherwise("out_of_scope")).drop("_in")


def vector_hydrate(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """All or nothing: a query's lane fails if any of its rows has no document. The score is ``score``, else
    ``similarity``, else ``1 / (1 + distance)``."""
    known = documents.select("document_id", F.lit(True).alias("_known"))
    joined = candidates.join(known, "document_id", "left")
    whole = joined.groupBy("query_id").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("_whole"))
    score = F.coalesce("score", "similarity", 1 / (1 + F.greatest("distance", F.lit(0.0))))
    return joined.join(whole.filter("_whole"), "query_id").select("query_id", "document_id", score.alias("score"))


def share_warnings(rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """Each row with the codes of all rows of the same document and text (trimmed, lower case)."""
    print_ = F.sha1(F.lower(F.trim("text")))
    marked = rows.withColumn("_print", print_)
    codes = marked.join(warnings.select("document_id", "chunk_index", "code"), ["document_id", "chunk_index"])
    codes = codes.groupBy("document_id", "_print").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    return marked.join(codes, ["document_id", "_print"]).select("document_id", "chunk_index", "codes")


def order_neighbours(seeds: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Chunks of the same document up to ``reach`` places away: seeds are multiplied, so the join is one of equality."""
    steps = F.array(*(F.lit(s) for s in range(-reach, reach + 1) if s))
    moved = seeds.select("document_id", F.col("chunk_index").alias("seed_index"), F.explode(steps).alias("step"))
    moved = moved.withColumn("chunk_index", (F.col("seed_index") + F.col("step")).cast("int"))
    return moved.join(chunks.select("document_id", "chunk_index"), ["document_id", "chunk_index"])


def context_window(seeds: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Neighbours by reading order and by section, with reasons and a score, the best ``limit`` for each seed.

    A section's chunks are numbered in order, and a seed meets those up to ``limit`` places from its own on either side: farther
    ones can't be among its best, so a section of any length costs each seed the same.
    """
    near = order_neighbours(seeds, chunks).select("document_id", "seed_index", "chunk_index", F.lit("adjacent").alias("reason"), F.lit(8).alias("points"))
    section = ["document_id", "section_index"]
    numbered = chunks.select(*section, "chunk_index", F.row_number().over(Window.partitionBy(*section).orderBy("chunk_index")).alias("at"))
    own = seeds.select(*section, F.col("chunk_index").alias("seed_index")).join(numbered.withColumnRenamed("chunk_index", "seed_index"), [*section, "seed_index"])
    steps = F.array(*(F.lit(k) for k in range(-limit, limit + 1) if k))
    same = own.select("document_id", "section_index", "seed_index", F.explode(F.transform(steps, lambda k: F.col("at") + k)).alias("at")).join(numbered, [*section, "at"])
    same = same.select("document_id", "seed_index", "chunk_index", F.lit("same_section").alias("reason"), F.lit(1).alias("points"))
    merged = near.unionByName(same).groupBy("document_id", "seed_index", "chunk_index").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"), F.sum("points").alias("score"))
    order = Window.partitionBy("document_id", "seed_index").orderBy(F.desc("score"), F.abs(F.col("chunk_index") - F.col("seed_index")), "chunk_index")
    return merged.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


# Why a chunk is in the context of a query's seeds, in this order.
CONTEXT_REASONS = ["reading_order_adjacent", "parent_context", "linked_context", "sibling_context", "heading_path_context", "section_path_context", "reference_range_context"]


def context_relations(seeds: DataFrame, chunks: DataFrame, limit: int, distance: int = 1) -> DataFrame:
    """``query_id, document_id, chunk_id, reasons, place``: the first ``limit`` chunks, in reading order, that are related to
    any seed of a query.

    ``seeds (query_id, chunk_id, paths, ranges)``: ``paths`` and ``ranges`` say whether a seed's contract lets its heading and section
    paths, and its reference range, relate. ``chunks (document_id, chunk_id, reading_order, parent_id, previous_id, next_id,
    heading_path, section_path, parent_start, parent_end, unit_start, unit_end)``; paths are strings. Chunks are looked
    for in the documents of the query's seeds.

    Each relation is a join on its own key. A key that many chunks share (a path, a parent) hands on its first chunks of a
    document only: ``limit`` and as many as a query has seeds, which is all that can be among a query's first ``limit``.
    Which of the relations the chunks so found have is then looked up key by key, for those few rows.
    """
    own = seeds.join(chunks, "chunk_id")
    scope = own.select("query_id", "document_id").distinct()
    most = seeds.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    order = [F.asc_nulls_last("reading_order"), "chunk_id"]
    ids = ["query_id", "document_id", "chunk_id"]
    keys_of = lambda df, c: df.select("query_id", F.col(c).alias("key")).filter("key is not null").distinct()
    seed_ids = keys_of(own, "chunk_id")
    linked = keys_of(own, "previous_id").unionByName(keys_of(own, "next_id")).distinct()
    parents = keys_of(own, "parent_id")
    headings, sections = (keys_of(own.filter("paths"), c) for c in ("heading_path", "section_path"))
    orders = own.select("query_id", "document_id", F.explode(F.array(F.col("reading_order") - 1, F.col("reading_order") + 1)).alias("reading_order")).distinct()
    near = own.filter("ranges").select("query_id", F.col("chunk_id").alias("id"), "parent_start", "parent_end", "unit_start", "unit_end").join(scope, "query_id")
    ranged = lambda df: df.filter("parent_start is not null and parent_end is not null and unit_start is not null and unit_end is not null")
    pairs = near_range_pairs(
        ranged(near).select("document_id", F.struct("query_id", "id").alias("id"), "parent_start", "parent_end", "unit_start", "unit_end"), ranged(chunks).select("document_id", F.struct(F.lit(None).cast("long").alias("query_id"), F.col("chunk_id").alias("id")).alias("id"), "parent_start", "parent_end", "unit_start", "unit_end"), distance, ["document_id"],
    )
    in_range = pairs.select(F.col("seed.query_id").alias("query_id"), "document_id", F.col("id.id").alias("chunk_id")).distinct()

    def first_of(column: str, keys: DataFrame) -> DataFrame:
        held = chunks.filter(F.col(column).isNotNull()).select("document_id", "chunk_id", "reading_order", F.col(column).alias("key"))
        held = held.withColumn("_r", F.row_number().over(Window.partitionBy("document_id", "key").orderBy(*order))).filter(F.col("_r") <= limit + most)
        return keys.join(scope, "query_id").join(held, ["document_id", "key"]).select(*ids)

    found = orders.join(chunks.select("document_id", "chunk_id", "reading_order"), ["document_id", "reading_order"]).select(*ids).unionByName(in_range)
    for column, keys in (("chunk_id", parents.unionByName(linked).distinct()), ("parent_id", parents), ("previous_id", seed_ids), ("next_id", seed_ids), ("heading_path", headings), ("section_path", sections)):
        found = found.unionByName(first_of(column, keys))
    found = found.distinct().join(seeds.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti").join(chunks, ["document_id", "chunk_id"])
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("document_id", *order))).filter(F.col("place") <= max(limit, 1))

    def marked(rows: DataFrame, keys: DataFrame, column: str, flag: str) -> DataFrame:
        mine = keys.select(F.col("query_id").alias("_q"), F.col("key").alias("_k"), F.lit(True).alias(flag))
        return rows.join(mine, (F.col("query_id") == F.col("_q")) & (F.col(column) == F.col("_k")), "left").drop("_q", "_k")

    rows = first
    for keys, column, flag in ((parents, "chunk_id", "is_parent"), (linked, "chunk_id", "is_linked"), (parents, "parent_id", "is_sibling"), (seed_ids, "previous_id", "after"), (seed_ids, "next_id", "ahead"), (headings, "heading_path", "heading"), (sections, "section_path", "section")):
        rows = marked(rows, keys, column, flag)
    rows = rows.join(orders.withColumn("adjacent", F.lit(True)), ["query_id", "document_id", "reading_order"], "left").join(in_range.withColumn("near", F.lit(True)), ids, "left")
    flags = [F.col("adjacent"), F.col("is_parent"), F.coalesce("is_linked", "after", "ahead"), F.col("is_sibling"), F.col("heading"), F.col("section"), F.col("near")]
    reasons = F.array_compact(F.array(F.lit("context_window"), *(F.when(f, F.lit(name)) for f, name in zip(flags, CONTEXT_REASONS, strict=True))))
    return rows.select(*ids, reasons.alias("reasons"), "place")


def near_ranges(rows: DataFrame, distance: int) -> DataFrame:
    """Pairs of rows of one parent whose unit ranges are at most ``distance`` apart. Ranges fall into buckets wider than
    the longest range that is asked for, so only neighbouring buckets meet."""
    width = 16
    spread = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("last") + distance) / width))))
    a = spread.select("parent", "bucket", F.col("id").alias("a"), F.col("first").alias("a1"), F.col("last").alias("a2"))
    b = spread.select("parent", "bucket", F.col("id").alias("b"), F.col("first").alias("b1"), F.col("last").alias("b2"))
    gap = F.greatest(F.lit(0), F.col("b1") - F.col("a2"), F.col("a1") - F.col("b2"))
    return a.join(b, ["parent", "bucket"]).filter((F.col("a") < F.col("b")) & (gap <= distance)).select("parent", "a", "b", gap.alias("gap")).distinct()


def bbox_overlap(boxes: DataFrame, most_dy: int = 150, least_overlap: float = 0.5, band: int = 150) -> DataFrame:
    """Pairs of boxes of one page with centres at most ``most_dy`` apart and enough horizontal overlap. Bands of that
    height are compared with their neighbours only."""
    centre = (F.col("y0") + F.col("y1")) / 2
    rows = boxes.withColumns({"cy": centre, "band": F.floor(centre / band)})
    a = rows.select("page_id", F.col("block").alias("a"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), F.col("cy").alias("ay"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    b = rows.select("page_id", F.col("block").alias("b"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("cy").alias("by"), "band")
    shared = F.least("ax1", "bx1") - F.greatest("ax0", "bx0")
    narrow = F.least(F.col("ax1") - F.col("ax0"), F.col("bx1") - F.col("bx0"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.col("ay") - F.col("by")) <= most_dy) & (shared / narrow >= least_overlap)
    return a.join(b, ["page_id", "band"]).filter(near).select("page_id", "a", "b")


def graph_expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Chunk nodes that a seed has an edge to, or reaches over a reference node, or over two that have an edge:
    ``seed, node, path, place, score``; nearest path first, ``limit`` for each seed; the score follows the place.

    ``nodes (node, kind)``, ``edges (source, target)`` in either direction. A node hands on only its first ``limit + 1``
    chunks in the order of the result (one may be the seed), which is all that can be among a seed's first ``limit``, so
    nodes with any number of neighbours never multiply each other.
    """
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    kinds = both.join(nodes.select(F.col("node").alias("target"), "kind"), "target")
    first = lambda rows, by: rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("node"))).filter(F.col("_r") <= limit + 1).drop("_r")
    chunks = first(kinds.filter("kind = 'chunk'").select(F.col("source").alias("from"), F.col("target").alias("node")), "from")
    references = kinds.filter("kind = 'reference'").select("source", F.col("target").alias("from"))
    own = seeds.select("seed").distinct()
    near = own.join(references, F.col("seed") == F.col("source")).select("seed", "from")
    hops = near.select(F.col("from").alias("source")).distinct().join(references, "source").join(chunks, "from").select(F.col("source").alias("from"), "node").distinct()
    paths = [
        own.withColumn("from", F.col("seed")).join(chunks, "from").select("seed", "node", F.lit(0).alias("path")),
        near.join(chunks, "from").select("seed", "node", F.lit(1).alias("path")),
        near.join(first(hops, "from"), "from").select("seed", "node", F.lit(2).alias("path")),
    ]
    reached = paths[0].unionByName(paths[1]).unionByName(paths[2]).filter("node != seed").groupBy("seed", "node").agg(F.min("path").alias("path"))
    placed = reached.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("path", "node"))).filter(F.col("place") <= limit)
    return placed.withColumn("score", F.greatest(F.lit(1.0), F.lit(20.0) - F.col("place")))


def exact_topk(vectors: DataFrame, is_query: Column, k: int, threshold: float, block_rows: int = 8192, block_queries: int = 1024, candidates: Column | None = None) -> DataFrame:
    """Cosine top-k of a stated query set against all rows (or those that are ``candidates``), in blocks: ``query_id, rank, vec_id, score``.

    Rows and queries fall into blocks by hash; each pair of blocks is one small matrix product in a task, and only the
    block's best k for each query are shuffled on.
    """
    rows = vectors.select("vec_id", "embedding", is_query.alias("q"))
    n, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0))).first()
    r, q = max(1, math.ceil(n / block_rows)), max(1, math.ceil(asked / block_queries))
    block = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = rows if candidates is None else rows.filter(candidates)
    left = held.select("vec_id", "embedding", block(r).alias("rb"), every(q).alias("qb"))
    right = rows.filter("q").select("vec_id", "embedding", block(q).alias("qb"), every(r).alias("rb"))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        unit = lambda s: (x := np.stack(s.to_list()).astype(float)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids, near = a["vec_id"].to_numpy(), unit(b["embedding"]) @ unit(a["embedding"]).T
        out = []
        for query, row in zip(b["vec_id"], near, strict=True):
            row = np.where((ids == query) | (row <= threshold), -np.inf, np.round(row, 9))
            best = np.lexsort((ids, -row))[:k]
            out += [(query, ids[j], row[j]) for j in best if np.isfinite(row[j])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(product, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def missing_ids(requested: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(table.select(key), key, "left_anti")


def index_readiness(docs: DataFrame, records: DataFrame) -> DataFrame:
    """Documents without a succeeded index record, with the reason."""
    state = records.groupBy("document_id").agg(F.bool_or(F.col("status") == "succeeded").alias("ready"), F.max_by("status", F.struct("ts", "record_id")).alias("last"))
    joined = docs.select("document_id").join(state, "document_id", "left").filter(~F.coalesce("ready", F.lit(False)))
    return joined.select("document_id", F.coalesce(F.concat(F.lit("latest index is "), F.col("last")), F.lit("no index record")).alias("reason"))


def case_variant_grid(cases: DataFrame, variants: list[str]) -> DataFrame:
    """Each case with each of a few variants; an explode of a literal array, not a join."""
    return cases.select("*", F.explode(F.array(*map(F.lit, variants))).alias("variant"))


def relationship_edges(chunks: DataFrame, references: DataFrame) -> DataFrame:
    """``next_chunk`` edges, and ``references`` edges to documents that exist."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    name = lambda c: F.concat(F.col("document_id").cast("string"), F.lit("#"), c.cast("string"))
    following = chunks.withColumn("n", F.lead("chunk_index").over(order)).filter("n is not null")
    edges = following.select(name(F.col("chunk_index")).alias("source"), name(F.col("n")).alias("target"), F.lit("next_chunk").alias("type"))
    known = chunks.select(F.col("document_id").alias("target_id")).distinct()
    pointing = references.join(known, "target_id", "left_semi")
    return edges.unionByName(pointing.select(name(F.col("chunk_index")).alias("source"), F.col("target_id").cast("string").alias("target"), F.lit("references").alias("type")))


def project_graph(rows: DataFrame, known_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and typed edges of ``(source, alias, target, type)``: aliases with more than one target are dropped, unknown
    types become RELATED."""
    clear = rows.groupBy("alias").agg(F.count_distinct("target").alias("n")).filter("n = 1").select("alias")
    kept = rows.join(clear, "alias", "left_semi")
    edges = kept.select("source", "target", F.when(F.upper("type").isin(known_types), F.upper("type")).otherwise("RELATED").alias("type")).distinct()
    return edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct(), edges


#: Bytes of a range of seeds with its cells, six on average, and how many ids a row of seeds has at most, on average over its hash.
RANGE_BYTES = 600
BLOCK_IDS = 1 << 20


def near_range_pairs(seeds: DataFrame, rows: DataFrame, distance: int, key: list[str]) -> DataFrame:
    """``seed, id, gap``: rows whose parent range overlaps that of a seed of the same key, and whose unit range is at most
    ``distance`` from its own.

    Both have ``(*key, id, parent_start, parent_end, unit_start, unit_end)`` with starts not after ends. On each axis a
    range has the level of the first power of four that is not shorter than it. A pair meets on the level of the longer
    range, in the cell of that size where the row's range starts: a row has one cell for each level on which it meets any
    seed, a seed those where rows that it overlaps can start, three at most, and the join is one of equality. So a
    pair comes once. Which levels occur is read from both tables.

    Seeds of equal ranges are one row with all their ids. Where these rows fit into ``BROADCAST_BYTES`` nothing but the
    seeds is shuffled; beyond, the rows are, once for each of their cells. Pairs are never shuffled.
    """
    axes = ("parent", "unit")
    ends = [f"{a}_{e}" for a in axes for e in ("start", "end")]
    wide = seeds.withColumns({"unit_start": F.col("unit_start") - distance, "unit_end": F.col("unit_end") + distance})

    def levelled(df: DataFrame, *more: Column) -> DataFrame:
        bits = lambda a: F.length(F.bin(F.greatest(F.col(f"{a}_end") - F.col(f"{a}_start"), F.lit(0).cast("long"))))
        own = lambda a: F.when(F.col(f"{a}_end") <= F.col(f"{a}_start"), 0).otherwise(F.least(bits(a) + bits(a) % 2, F.lit(62)))
        df = df.select(*key, *more, *(F.col(c).cast("long").alias(c) for c in ends))
        return df.withColumns({f"{a}_own": own(a) for a in axes})

    def levels(df: DataFrame) -> tuple[int, list[list[int]]]:
        n, *found = df.agg(F.count(F.lit(1)), *(F.collect_set(f"{a}_own") for a in axes)).first()
        return n, [sorted(x) for x in found]

    asked, others = levelled(wide, F.col("id").alias("seed")), levelled(rows, F.col("id"))
    (n, of_seeds), (_, of_rows) = levels(asked), levels(others)
    blocks = F.pmod(F.xxhash64("seed"), F.lit(math.ceil(n / BLOCK_IDS) or 1))
    ranges = asked.groupBy(*key, *ends, *(f"{a}_own" for a in axes), blocks.alias("block")).agg(F.collect_list("seed").alias("seeds")).drop("block")
    ranges = written(ranges.withColumn("range", F.monotonically_increasing_id()), "range-seeds")

    def placed(df: DataFrame, levels: list[list[int]], several: bool) -> DataFrame:
        for a, met in zip(axes, levels, strict=True):
            level = F.array_distinct(F.transform(F.array(*map(F.lit, met)).cast("array<int>"), lambda x: F.greatest(x, f"{a}_own")))  # noqa: B023
            df = df.withColumn(f"{a}_level", F.explode(level))
            cell = lambda c: F.call_function("shiftright", c, F.col(f"{a}_level"))  # noqa: B023, E731
            size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"{a}_level"))
            start, end = F.col(f"{a}_start"), F.col(f"{a}_end")
            df = df.withColumn(f"{a}_cell", F.explode(F.sequence(cell(start - size + 1), cell(end))) if several else cell(start))
        return df

    at = [*key, *(f"{a}_{c}" for a in axes for c in ("level", "cell"))]
    cells = placed(ranges.drop("seeds"), of_rows, True).withColumnsRenamed({f"{a}_{e}": f"seed_{a}_{e}" for a in axes for e in ("start", "end", "own")})
    ids = ranges.select("range", "seeds")
    id_bytes = 8 if dict(seeds.dtypes)["id"] in ("bigint", "int") else 32
    small = ranges.count() * RANGE_BYTES + n * id_bytes <= BROADCAST_BYTES
    met = placed(others, of_seeds, False).join(F.broadcast(cells) if small else cells.join(ids, "range"), at)
    for a in axes:
        met = met.filter((F.col(f"seed_{a}_start") <= F.col(f"{a}_end")) & (F.col(f"{a}_start") <= F.col(f"seed_{a}_end")))
        met = met.filter(F.greatest(f"seed_{a}_own", f"{a}_own") == F.col(f"{a}_level"))
    if small:
        met = met.join(F.broadcast(ids), "range")
    gap = F.greatest(F.lit(0), F.col("unit_start") - (F.col("seed_unit_end") - distance), F.col("seed_unit_start") + distance - F.col("unit_end"))
    return met.select(*key, F.explode("seeds").alias("seed"), "id", gap.alias("gap")).filter("seed != id")
