"""Tables that queries derive from the given ones, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.tables import line_chunks, read_table

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"

CHUNKS = f"""raw_lines AS (
  SELECT doc_id, text AS whole, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents
), kept_lines AS (
  SELECT doc_id, whole, line, {_TRIM.format("raw")} AS text FROM raw_lines WHERE {_TRIM.format("raw")} <> ''
), chunks AS (
  SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS chunk_index, CAST(line AS INTEGER) AS line, text FROM kept_lines
  UNION ALL
  SELECT doc_id, 0, 1, text FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM kept_lines)
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks(table(spark, sf_dir, "documents"))


#: Blocks of web pages: headings, paragraphs and list items in the order of the HTML.
BLOCK = r"<(?:h1|h2|p|li|td|title)[^>]*>[^<]*</"
BLOCKS = f"""found AS (SELECT page_id, regexp_extract_all(html, '{BLOCK}') AS b FROM pages
), blocks AS (
  SELECT page_id AS document_id, CAST(i - 1 AS INTEGER) AS block_index, regexp_extract(b[i], '^<([a-z0-9]+)', 1) AS tag, regexp_extract(b[i], '>([^<]*)</$', 1) AS text
  FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS i FROM found)
)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(0))).alias("block_index", "b"))
    return found.select("document_id", "block_index", F.regexp_extract("b", "^<([a-z0-9]+)", 1).alias("tag"), F.regexp_extract("b", ">([^<]*)</$", 1).alias("text"))


#: Parser warnings of chunks, from what a chunk's text looks like.
WARNINGS = CHUNKS + """, warnings AS (
  SELECT document_id, chunk_index, code, CASE WHEN chunk_index % 3 = 0 THEN 'table' ELSE 'text' END AS block_type, CAST(chunk_index // 10 + 1 AS INTEGER) AS page, expected_script FROM (
    SELECT *, 'short_chunk' AS code, NULL AS expected_script FROM chunks WHERE length(text) < 12
    UNION ALL SELECT *, 'symbol_noise', NULL FROM chunks WHERE regexp_matches(text, '[#*$%&|]{2}')
    UNION ALL SELECT *, 'missing_script', 'arabic' FROM chunks WHERE regexp_matches(text, '[0-9]')
  )
)"""


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    found = F.array_compact(
        F.array(
            F.when(F.char_length("text") < 12, F.struct(F.lit("short_chunk").alias("code"), F.lit(None).cast("string").alias("expected_script"))),
            F.when(F.col("text").rlike("[#*$%&|]{2}"), F.struct(F.lit("symbol_noise").alias("code"), F.lit(None).cast("string").alias("expected_script"))),
            F.when(F.col("text").rlike("[0-9]"), F.struct(F.lit("missing_script").alias("code"), F.lit("arabic").alias("expected_script"))),
        )
    )
    rows = rows.withColumn("w", F.explode(found))
    kind = F.when(F.col("chunk_index") % 3 == 0, "table").otherwise("text")
    return rows.select("document_id", "chunk_index", "w.code", kind.alias("block_type"), (F.floor(F.col("chunk_index") / 10) + 1).cast("int").alias("page"), "w.expected_script")
