"""Hierarchical residual packing of tokenised documents into sequences of fixed length.

1. Documents become pieces in one pass over the texts; only documents longer than a sequence are cut, with the shorter
   piece first. Pieces of full length are sequences of their own.
2. The rest is dealt by hash into groups of about ``ITEMS_PER_GROUP``, and each is packed best-fit decreasing. Bins that
   are nearly full are emitted; all others go on.
3. A tree of rounds merges the bins that went on, as items of further best-fit rounds, again in groups of about
   ``ITEMS_PER_GROUP`` bins: so many groups of the round before come together in one as their bins leave room for. So a
   group's memory is bounded however large the input is, and no bin is left out. The last round is that of a single
   group, or the one that leaves more than ``STALLED`` of its bins (bins over half full, say, that nothing fits into).
   Each round is written to the shared folder.

Defined results: a null text counts as empty, and an empty text is one piece of one token (the end mark); repeated rows
are packed once each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise

LENGTH = 2048
END_ID = 0
ITEMS_PER_GROUP = 40_000
STALLED = 0.98
#: A bin with so few places left is nearly full.
SLACK = 8

#: Characters on whose classes the two tokenizer libraries agree; a text with any other goes to ``tokenizers``.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞]*")
_loaded: dict[str, tuple] = {}


def _load(json_name: str, ranks_name: str) -> tuple:
    if json_name not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(public_tokenizers.path(json_name))
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks_name), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[json_name] = exact, fast, special
    return _loaded[json_name]


def token_ids(text: str, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """Ids of the vocabulary in ``json_name``. Plain texts are encoded from the same vocabulary as ranks, which gives
    the same ids in a third of the time. Texts that spell a special token get its id, as the library has it by default."""
    exact, fast, special = _load(json_name, ranks_name)
    plain = _PLAIN.fullmatch(text) and not any(t in text for t in special)
    ids = fast.encode_ordinary(text) if plain else exact.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4")


def pieces(docs: DataFrame, length: int = LENGTH, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % length or length
                cuts = [0, *range(first, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype(np.int64)] if keep_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))

    fields = [pa.field("doc_id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if keep_ids:
        fields, schema = [*fields, pa.field("ids", pa.list_(pa.int64()))], schema + ", ids array<long>"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: the bin and the place in it of each item, and the fill of each bin."""
    bins, places, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(length + 1)]  # bins by the room that is left
    there = 0  # bit r: room[r] has bins
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = there >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                there ^= 1 << left
        else:
            left, b = length, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += size
        room[left - size].append(b)
        there |= 1 << (left - size)
    return bins, places, np.array(fills, np.int64)


def _round(rows: DataFrame, turn: int, groups: int, last: bool, length: int, sort_by: list[str]) -> DataFrame:
    """Pack what ``rows`` has in each group. ``bin`` and ``at`` are the bin of the round before (a number of its own for
    each piece at first) and the place in it; pieces of one bin are in one group, and equal rows are dealt out like others.

    Groups are Arrow tables: ids beside a null stay integers."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by([(c, "ascending") for c in sort_by])
        lengths, bin_before = own["length"].to_numpy(), own["bin"].to_numpy()
        _, first, codes = np.unique(bin_before, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first, kind="stable")] = np.arange(len(first))
        codes = rank[codes]  # bins in the order in which they come
        sizes = np.bincount(codes, weights=lengths).astype(np.int64)
        bins, places, fills = best_fit(sizes, length)
        going = (fills < length - SLACK) & (not last)
        new = {"at": own["at"].to_numpy() + places[codes], "bin": (turn << 56) + (key[0].as_py() << 32) + bins[codes], "going": going[bins[codes]]}
        for name, values in new.items():
            own = own.set_column(own.schema.get_field_index(name), own.schema.field(name), pa.array(values, own.schema.field(name).type))
        return own

    by = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups))
    return rows.withColumn("group", by.cast("long")).groupBy("group").applyInArrow(run, rows.withColumn("group", F.lit(0).cast("long")).schema)


def pack(items: DataFrame, length: int = LENGTH, items_per_group: int = ITEMS_PER_GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``length``.

    Other columns are carried along; rows with equal values in all of them are interchangeable.
    """
    sort_by = [f.name for f in items.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    full = items.filter(F.col("length") >= length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = items.filter(F.col("length") < length)
    rows = rest.withColumns({"bin": F.monotonically_increasing_id(), "at": F.lit(0).cast("long"), "going": F.lit(True)})
    n, turn, out = rest.count(), 0, full
    while True:
        groups = max(1, math.ceil(n / items_per_group))
        rows = materialise(_round(rows, turn, groups, groups == 1, length, sort_by).drop("group"), f"pack-{turn}")
        left = rows.filter(F.col("going") & (F.col("at") == 0)).count()  # one row is first in each bin
        over = not left or left > STALLED * n
        done = rows if over else rows.filter(~F.col("going"))
        out = out.unionByName(done.select(*items.columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset")))
        if over:
            return out
        rows, n, turn = rows.filter("going"), left, turn + 1


def pack_documents(docs: DataFrame, length: int = LENGTH, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``."""
    return pack(materialise(pieces(docs, length, keep_ids, id_col, text_col), "pieces"), length)
