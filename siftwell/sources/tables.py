"""Reading, writing and maintaining the durable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwell.functions.text import REDACTIONS, redaction_hits, stripped


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def line_chunks(docs: DataFrame) -> DataFrame:
    """One chunk for each non-blank line (``line`` from 1, ``chunk_index`` dense from 0); the whole text if there is none.

    Everything happens inside a row, so nothing is shuffled.
    """
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).cast("int").alias("line"), stripped(x).alias("text")))
    kept = F.filter(numbered, lambda c: c["text"] != "")
    whole = F.array(F.struct(F.lit(1).alias("line"), F.col("text").alias("text")))
    split = docs.withColumn("_kept", kept).select(F.col("doc_id").alias("document_id"), F.posexplode(F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(whole)).alias("chunk_index", "c"))
    return split.select("document_id", "chunk_index", "c.line", "c.text")


def dedupe_uploads(docs: DataFrame) -> DataFrame:
    """Documents with the hash of their content and the document (least id) that stands for it."""
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min("doc_id").alias("canonical_id"))
    return hashed.join(first, "sha256").select("doc_id", "sha256", "canonical_id", (F.col("doc_id") != F.col("canonical_id")).alias("is_duplicate"))


def replace_document_chunks(target: DataFrame, new: DataFrame) -> DataFrame:
    """The table after the chunks of all documents in ``new`` are replaced."""
    return target.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def cleanup_index(records: DataFrame, reindexed: DataFrame) -> DataFrame:
    """Index records after a re-index: those of ``reindexed`` documents become stale if they had succeeded, else go."""
    marked = records.join(reindexed.select("document_id", F.lit(True).alias("again")).distinct(), "document_id", "left")
    again = F.coalesce("again", F.lit(False))
    return marked.filter(~again | (F.col("status") == "succeeded")).select(*[c for c in records.columns if c != "status"], F.when(again, F.lit("stale")).otherwise(F.col("status")).alias("status"))


def build_chunk_rows(pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """Canonical chunk rows; the identity joins document, artifact, preview and index, with ``None`` for what is missing."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    joined = pieces.join(docs.select(F.col("doc_id").alias("document_id"), "source", "lang"), "document_id")
    return joined.select(
        "document_id", "chunk_index", F.coalesce(blank("content_type"), F.lit("text")).alias("content_type"), F.coalesce(blank("preview_ref"), F.concat(F.col("source"), F.lit(":"), F.col("line").cast("string"))).alias("preview_ref"),
        F.when(F.col("searchable"), F.lower("text")).otherwise("").alias("search_text"),
        F.concat_ws("|", F.col("document_id").cast("string"), F.coalesce("artifact", F.lit("None")), F.coalesce(blank("preview_ref"), F.lit("None")), F.col("chunk_index").cast("string")).alias("chunk_identity"),
    )


def read_eval_cases(spark: SparkSession, path: str, fmt: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation cases of a CSV, JSON or JSON-lines file, and the rows that were rejected."""
    if fmt == "csv":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        raw = spark.read.option("multiLine", fmt == "json").json(path)
    return normalise_cases(raw)


def normalise_cases(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alias columns (``question`` or ``prompt`` for ``query``), split ``|`` lists, number cases without an id, and set
    cases without any expected signal apart."""
    have = set(raw.columns)
    text = lambda *names: F.coalesce(*(F.nullif(stripped(F.col(n).cast("string")), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    many = lambda *names: F.filter(F.transform(F.split(F.coalesce(text(*names), F.lit("")), r"\|"), stripped), lambda x: x != "")
    order = F.col("row_number") if "row_number" in have else F.monotonically_increasing_id() + 1
    cases = raw.select(
        F.coalesce(text("id", "case_id"), F.concat(F.lit("case-"), order.cast("string"))).alias("id"), text("query", "question", "prompt").alias("query"),
        text("expected_answer", "answer").alias("expected_answer"), many("expected_sources", "sources").alias("expected_sources"), many("must_include").alias("must_include"), many("must_avoid").alias("must_avoid"),
    )
    good = F.col("query").isNotNull() & (F.col("expected_answer").isNotNull() | (F.size("expected_sources") > 0) | (F.size("must_include") > 0) | (F.size("must_avoid") > 0))
    return cases.filter(good), cases.filter(~good)


def export_evidence(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that no redaction rule matches, and the unsafe rows with the first rule that does."""
    marked = evidence.withColumn("rule", F.get(F.transform(redaction_hits(F.col("text")), lambda h: h["rule"]), F.lit(0)))
    return marked.filter("rule is null").drop("rule"), marked.filter("rule is not null")


RULE_NAMES = [name for name, _ in REDACTIONS]
