"""From documents and blocks to chunks, sections and units.

Greedy packings depend on order within one document, so they fold over the ordered array of that document's parts with
a built-in ``aggregate``; documents are never brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import stripped, word_count


def policy_filter(rows: DataFrame, flag: str) -> DataFrame:
    """Rows that a policy flag allows; no policy allows."""
    return rows.filter(F.coalesce(F.col(flag), F.lit(True)))


def sample_positions(chunks: DataFrame, n: int) -> DataFrame:
    """Representative chunks of each document: first, second, middle and last; for ``n > 4``, ``n`` spread evenly."""
    size = F.count(F.lit(1)).over(Window.partitionBy("document_id"))
    counted = chunks.withColumn("_n", size)
    middle = F.floor(F.col("_n") / 2)
    spread = [F.floor(F.col("_n") * k / n) for k in range(n)]
    picks = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), middle, F.col("_n") - 1) if n <= 4 else F.array(*spread, F.col("_n") - 1)
    return counted.filter(F.array_contains(picks, F.col("chunk_index").cast("long"))).drop("_n")


def source_labels(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """``label``: the document's file name and the line."""
    joined = chunks.join(names, "document_id", "left")
    where = F.when(F.col("line").isNotNull(), F.concat(F.lit("line "), F.col("line").cast("string")))
    return joined.select("document_id", "chunk_index", F.array_join(F.array_compact(F.array(F.coalesce("filename", F.lit("unknown")), where)), " · ").alias("label"))


def sections(chunks: DataFrame, starts: Column) -> DataFrame:
    """Runs of chunks from one that starts a section to the next, as one text each."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    number = F.sum(((F.col("chunk_index") == 0) | starts).cast("int")).over(order) - 1
    grouped = chunks.withColumn("section_index", number.cast("int")).groupBy("document_id", "section_index")
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    return grouped.agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "\n").alias("text"))


def _first_items(sizes: Column, target: int, most: int) -> Column:
    """Where bins of items in order begin: a bin closes once it has ``target``, or before it would pass ``most``."""
    start = F.struct(F.array().cast("array<int>").alias("first"), F.lit(0).alias("at"), F.lit(0).alias("fill"))

    def put(a: Column, size: Column) -> Column:
        fresh = (a["at"] == 0) | ((a["fill"] > 0) & ((a["fill"] >= target) | (a["fill"] + size > most)))
        first = F.when(fresh, F.concat(a["first"], F.array(a["at"]))).otherwise(a["first"])
        return F.struct(first.alias("first"), (a["at"] + 1).alias("at"), F.when(fresh, size).otherwise(a["fill"] + size).alias("fill"))

    return F.aggregate(sizes, start, put, lambda a: a["first"])


def _regrouped(docs: DataFrame, parts: Column, target: int, most: int) -> DataFrame:
    """Pieces of consecutive parts. Each is cut out of its document's parts once, so rows never carry a whole text each."""
    with_parts = docs.select("document_id", parts.alias("p")).withColumn("first", _first_items(F.transform("p", lambda t: word_count(t)), target, most))
    piece = lambda at, i: F.array_join(F.slice("p", at + 1, F.coalesce(F.get("first", i + 1), F.size("p")) - at), "\n")
    pieces = with_parts.select("document_id", F.posexplode(F.transform("first", piece)).alias("piece_index", "text"))
    return pieces.withColumn("n_words", word_count(F.col("text")).cast("long"))


def pack_sections(chunks: DataFrame, target_words: int, most_words: int) -> DataFrame:
    """A document's parts in order, filled up to ``target_words`` and never beyond ``most_words`` (but for single parts)."""
    ordered = chunks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return _regrouped(ordered, F.transform("c", lambda c: c["text"]), target_words, most_words)


def hard_split(docs: DataFrame, most_words: int) -> DataFrame:
    """Pieces of at most ``most_words``: whole sentences where they fit, longer sentences cut by words."""
    sentences = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), stripped), lambda s: s != "")
    words = lambda s: F.split(s, r"[ \t\n\r\x0b\x0c]+")
    cut = lambda s: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(words(s)) - 1) / most_words).cast("int")), lambda k: F.array_join(F.slice(words(s), k * most_words + 1, most_words), " ")
    )
    parts = F.flatten(F.transform(sentences, lambda s: F.when(word_count(s) > most_words, cut(s)).otherwise(F.array(s))))
    return _regrouped(docs, parts, most_words, most_words)


# Word targets by kind of document.
PROFILES = {"reference": (500, 900), "book": (1000, 1500), "table": (400, 800), "generic": (1000, 1500)}


def chunk_profile(docs: DataFrame) -> DataFrame:
    """Kind of each document and its word targets."""
    kind = F.when(F.col("text").rlike("[0-9]+:[0-9]+"), "reference").when(F.col("n_chars") > 20_000, "book").when(F.contains("text", F.lit(" | ")), "table").otherwise("generic")
    pick = lambda i: F.coalesce(*(F.when(F.col("profile") == k, F.lit(v[i])) for k, v in PROFILES.items()))
    return docs.select("doc_id", kind.alias("profile")).withColumns({"target_words": pick(0), "most_words": pick(1)})


def ordered_text_groups(blocks: DataFrame, starts: Column) -> DataFrame:
    """Groups of consecutive blocks and where each block's characters lie in its group's text."""
    order = Window.partitionBy("document_id").orderBy("block_index")
    grouped = blocks.withColumn("group_index", (F.sum(((F.col("block_index") == 0) | starts).cast("int")).over(order) - 1).cast("int"))
    before = Window.partitionBy("document_id", "group_index").orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0)).cast("long")
    return grouped.select("document_id", "block_index", "group_index", first.alias("char_start"), (first + F.char_length("text")).alias("char_end"))


def split_reference_units(docs: DataFrame, anchor: str) -> DataFrame:
    """Texts cut at each match of ``anchor``; what stands before the first match joins its unit."""
    parts = F.split(F.regexp_replace("text", f"({anchor})", "\x01$1"), "\x01", -1)
    first = F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    units = F.when(F.size(parts) > 1, F.concat(F.array(first), F.slice(parts, 3, 1_000_000_000))).otherwise(parts)
    return docs.select("doc_id", F.posexplode(units).alias("unit_index", "text"))


def title_candidates(blocks: DataFrame, most_words: int = 18) -> DataFrame:
    """The first two blocks as title, unless they are long or look like a section mark."""
    first = blocks.filter("block_index < 2").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("block_index", "text"))).alias("b"))
    titled = first.select("document_id", F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("title"))
    return titled.filter((F.size(F.split("title", " ")) <= most_words) & ~F.col("title").rlike(r"^(#|[0-9]+\.)"))


def split_metadata(pieces: DataFrame, parent: str = "document_id", order: str = "line") -> DataFrame:
    whole = Window.partitionBy(parent)
    return pieces.withColumns({"split_index": F.row_number().over(whole.orderBy(order)) - 1, "split_count": F.count(F.lit(1)).over(whole)})
