"""Ingestion with keyed state: what a micro-batch costs depends on the batch, not on what came before it.

Two stateful steps in one stream, both in the state store of the checkpoint:

1. by document: the hash of its current content. A document that comes with another content releases the old one and
   claims the new one; the same content again is nothing.
2. by content hash: which documents hold it. The first holder owns it; if that one releases it, the next one does, without
   its text being sent again. A content's text is handed on the first time it is ever claimed.

The sink keeps contents (chunks by hash, each written once) apart from owners (a log of who owns a hash from which batch
on), one folder for each micro-batch, so a batch that is run again overwrites its own. :func:`standing` reads both.

Defined results: rows without an id are dropped; a null text releases the document's content; of several rows of a document
in one batch the one with the greatest ``seq`` counts (then the greatest hash). Needs a state store for keyed columns:
``spark.sql.streaming.stateStore.providerClass`` set to Spark's RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftwell.sources.tables import line_chunks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CLAIMS = "sha256 string, document_id long, seq long, claims boolean, text string"
_OUT = "sha256 string, kind string, document_id long, owned boolean, text string"


class CurrentContent(StatefulProcessor):
    """By document: claims and releases of contents."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "sha256 string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        for batch in rows:
            for seq, sha, text in zip(batch["seq"], batch["sha256"], batch["text"], strict=True):
                mine = (int(seq), sha if isinstance(sha, str) else "", text)
                last = mine if last is None or mine[:2] > last[:2] else last
        before = self.current.get()[0] if self.current.exists() else ""
        if last is None or last[1] == before:
            return
        out = []
        if before:
            out.append((before, key[0], last[0], False, None))
            self.current.clear()
        if last[1]:
            out.append((last[1], key[0], last[0], True, last[2]))
            self.current.update((last[1],))
        if out:
            yield pd.DataFrame(out, columns=["sha256", "document_id", "seq", "claims", "text"])

    def close(self) -> None:
        pass


class Holders(StatefulProcessor):
    """By content: its holders, its owner, and whether it was handed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holders = handle.getMapState("holders", "document_id long", "seq long")
        self.owner = handle.getValueState("owner", "document_id long, seq long")
        self.known = handle.getValueState("known", "known boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        owner = tuple(self.owner.get()) if self.owner.exists() else None
        was, text, lost = owner, None, False
        for batch in rows:
            for document, seq, claims, own_text in zip(batch["document_id"], batch["seq"], batch["claims"], batch["text"], strict=True):
                document, seq = int(document), int(seq)
                if claims:
                    self.holders.updateValue((document,), (seq,))
                    text = own_text
                    if owner is None or (seq, document) < owner[::-1]:
                        owner = (document, seq)
                else:
                    self.holders.removeKey((document,))
                    lost = lost or (owner is not None and owner[0] == document)
        if lost:
            left = min(((s[0], d[0]) for d, s in self.holders.iterator()), default=None)
            owner = left[::-1] if left else None
        out = []
        if text is not None and not self.known.exists():
            self.known.update((True,))
            out.append((key[0], "content", owner[0] if owner else 0, True, text))
        if (owner and owner[0]) != (was and was[0]):
            out.append((key[0], "owner", (owner or was)[0], owner is not None, None))
        if owner != was:
            self.owner.update(owner) if owner else self.owner.clear()
        if out:
            yield pd.DataFrame(out, columns=["sha256", "kind", "document_id", "owned", "text"])

    def close(self) -> None:
        pass


def ownership(docs: DataFrame) -> DataFrame:
    """The stream of contents and owners of a stream ``(doc_id, text, seq)``."""
    slim = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("document_id"), F.coalesce(F.col("seq").cast("long"), F.lit(0).cast("long")).alias("seq"), F.sha2("text", 256).alias("sha256"), "text")
    claims = slim.groupBy("document_id").transformWithStateInPandas(CurrentContent(), _CLAIMS, "Append", "None")
    return claims.groupBy("sha256").transformWithStateInPandas(Holders(), _OUT, "Append", "None")


def stream_keyed_ingest(docs: DataFrame, path: str):
    """A writer of :func:`ownership` below ``path``; give it a checkpoint and start it."""

    def batch(df: DataFrame, number: int) -> None:
        rows = df.persist()
        contents = rows.filter("kind = 'content'")
        chunks = line_chunks(contents.select(F.col("sha256").alias("doc_id"), "text")).withColumnRenamed("document_id", "sha256")
        chunks.write.mode("overwrite").parquet(f"{path}/contents/batch={number}")
        rows.filter("kind = 'owner'").select("sha256", "document_id", "owned").write.mode("overwrite").parquet(f"{path}/owners/batch={number}")
        rows.unpersist()

    return ownership(docs).writeStream.outputMode("append").foreachBatch(batch)


def standing(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, sha256, chunk_index, line, text`` of every content that has an owner."""
    owners = spark.read.schema("sha256 string, document_id long, owned boolean, batch long").parquet(f"{path}/owners")
    last = owners.groupBy("sha256").agg(F.max_by(F.struct("document_id", "owned"), "batch").alias("o")).filter("o.owned").select("sha256", "o.document_id")
    chunks = spark.read.schema("sha256 string, chunk_index int, line int, text string, batch long").parquet(f"{path}/contents").drop("batch")
    return chunks.join(last, "sha256").select("document_id", "sha256", "chunk_index", "line", "text")


def batch_standing(docs: DataFrame) -> DataFrame:
    """Batch twin: what stands after all rows ``(doc_id, text, seq)`` came in the order of ``seq``, each ``seq`` as a batch."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("document_id"), "seq", F.sha2("text", 256).alias("sha256"), "text")
    one = Window.partitionBy("document_id", "seq").orderBy(F.desc_nulls_last("sha256"))
    rows = rows.withColumn("_r", F.row_number().over(one)).filter("_r = 1")
    order = Window.partitionBy("document_id").orderBy("seq")
    # A run of one content counts from where it began.
    rows = rows.withColumn("_new", (~F.lag("sha256").over(order).eqNullSafe(F.col("sha256"))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order))
    last = rows.groupBy("document_id").agg(F.max("_run").alias("_run"))
    held = rows.join(last, ["document_id", "_run"]).groupBy("document_id", "sha256").agg(F.min("seq").alias("seq"), F.first("text").alias("text")).filter("sha256 is not null")
    owners = held.groupBy("sha256").agg(F.min(F.struct("seq", "document_id")).alias("o"), F.first("text").alias("text"))
    chunks = line_chunks(owners.select(F.col("sha256").alias("doc_id"), "text")).withColumnRenamed("document_id", "sha256")
    return chunks.join(owners.select("sha256", "o.document_id"), "sha256").select("document_id", "sha256", "chunk_index", "line", "text")
