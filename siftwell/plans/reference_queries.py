"""Queries of references: units of anchors, contracts, ranges. SQL folds row after row where the operators use windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.operators import references as R
from siftwell.plans.inputs import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


#: The events of a user as the blocks of a document: signups are anchors, errors have no text, the hour is the page.
ANCHORED = """b AS (SELECT user_id AS document_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS i, event_id, event_type, CASE WHEN event_id % 13 <> 0 THEN (date_diff('hour', TIMESTAMP '2024-01-01', ts))::INT END AS page_start,
  (date_diff('hour', TIMESTAMP '2024-01-01', ts) + event_id % 4)::INT AS page_end FROM events),
blocks AS (SELECT *, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ' ' || event_id END AS text, event_type = 'error' AND event_id % 2 = 0 AS warns, CASE WHEN event_type = 'signup' THEN 'signup:' || event_id END AS reference, event_id % 3 = 0 AS header FROM b),
fold AS (
  SELECT document_id, i, page_end, text, warns, reference, false AS open, NULL::INT AS anchor, NULL::VARCHAR AS owner, NULL::INT AS last_end, false AS pending, NULL::INT AS pending_end, false AS taken, false AS has_body, '' AS class, 0 AS runs FROM (SELECT DISTINCT document_id, -1 AS i, NULL::INT AS page_end, NULL::VARCHAR AS text, false AS warns, NULL::VARCHAR AS reference FROM blocks)
  UNION ALL SELECT b.document_id, b.i, b.page_end, b.text, b.warns, b.reference,
    n.class IN ('anchor', 'body', 'warning') OR n.class = 'nothing' AND f.open, CASE WHEN n.class = 'anchor' THEN b.i ELSE f.anchor END, CASE WHEN n.class = 'anchor' THEN b.reference ELSE f.owner END,
    CASE WHEN n.class = 'anchor' AND n.takes THEN f.pending_end WHEN n.class IN ('anchor', 'body', 'warning') THEN b.page_end ELSE f.last_end END,
    n.class = 'waits' OR f.pending AND n.class = 'nothing', CASE WHEN n.class = 'waits' THEN b.page_end ELSE f.pending_end END, n.takes,
    CASE WHEN n.class = 'anchor' THEN n.takes OR NOT b.header WHEN n.class = 'body' THEN true ELSE f.has_body END,
    CASE WHEN n.class = 'anchor' AND b.header THEN 'reference_header' WHEN n.class = 'anchor' OR n.class = 'body' AND NOT f.has_body THEN 'reference_body' WHEN n.class = 'body' THEN 'reference_continuation' ELSE n.class END,
    f.runs + CASE WHEN n.class IN ('anchor', 'alone', 'gap') THEN 1 ELSE 0 END
  FROM fold f JOIN blocks b ON b.document_id = f.document_id AND b.i = f.i + 1, LATERAL (SELECT CASE WHEN b.reference IS NOT NULL THEN 'anchor' WHEN NOT f.open AND b.text <> '' THEN 'waits' WHEN NOT f.open AND b.warns THEN 'alone'
      WHEN f.open AND coalesce(b.page_start - f.last_end > 12, false) THEN CASE WHEN b.text <> '' OR b.warns THEN 'gap' ELSE 'closes' END WHEN f.open AND b.text <> '' THEN 'body' WHEN f.open AND b.warns THEN 'warning' ELSE 'nothing' END AS class,
      b.reference IS NOT NULL AND f.pending AND NOT coalesce(b.page_start - f.pending_end > 12, false) AS takes) n
), waits AS (SELECT f.*, min(i) OVER (PARTITION BY document_id, runs, class) AS first_of_run FROM fold f WHERE class = 'waits'),
takers AS (SELECT document_id, runs - 1 AS runs, anchor AS its_anchor, owner AS its_owner, taken AS took FROM fold WHERE reference IS NOT NULL AND class LIKE 'reference%' AND i = anchor),
units AS (SELECT document_id, i AS block_index, anchor AS unit_block, owner AS reference, CASE class WHEN 'warning' THEN 'parser_warning' ELSE class END AS role, NULL AS reason FROM fold WHERE class LIKE 'reference%' OR class = 'warning'
  UNION ALL SELECT document_id, i, i, NULL, 'unassigned', CASE class WHEN 'gap' THEN 'max_page_gap_exceeded' ELSE 'unassigned_before_first_reference' END FROM fold WHERE class IN ('gap', 'alone')
  UNION ALL SELECT w.document_id, i, CASE WHEN took THEN its_anchor ELSE first_of_run END, CASE WHEN took THEN its_owner END, CASE WHEN NOT coalesce(took, false) THEN 'unassigned' WHEN i = first_of_run THEN 'reference_body' ELSE 'reference_continuation' END,
    CASE WHEN NOT coalesce(took, false) THEN 'unassigned_before_first_reference' END FROM waits w LEFT JOIN takers t ON t.document_id = w.document_id AND t.runs = w.runs)"""


def anchored_blocks(spark, d):
    e = table(spark, d, "events")
    hour = F.floor((F.unix_timestamp(F.date_trunc("hour", "ts")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    error = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("document_id"), place.alias("block_index"), F.when(F.col("event_id") % 13 != 0, hour.cast("int")).alias("page_start"), (hour + F.col("event_id") % 4).cast("int").alias("page_end"),
        F.when(error, "").otherwise(F.concat_ws(" ", "event_type", "event_id")).alias("text"), (error & (F.col("event_id") % 2 == 0)).alias("has_warning"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("signup:"), F.col("event_id").cast("string"))).alias("reference"), (F.col("event_id") % 3 == 0).alias("is_header"),
    )


@query("w3_assemble_reference_units", f"WITH RECURSIVE {ANCHORED} SELECT * FROM units")
def w3_units(spark, d):
    return R.assemble_reference_units(anchored_blocks(spark, d), 12)


@query("w4_reference_unit_rows", f"""WITH RECURSIVE {ANCHORED}, r AS (SELECT u.document_id, unit_block, block_index, u.reference, reason, role, page_start, page_end, CASE WHEN role <> 'reference_header' AND text <> '' THEN text END AS said FROM units u JOIN blocks b ON b.document_id = u.document_id AND b.i = u.block_index),
g AS (SELECT document_id, unit_block, max(reference) AS reference, max(reason) AS reason, count(*) AS blocks, least(min(page_start), min(page_end)) AS page_start, greatest(max(page_start), max(page_end)) AS page_end,
  coalesce(string_agg(said, chr(10) ORDER BY block_index <> unit_block, block_index), '') AS text, bool_or(role = 'parser_warning') AS has_warning FROM r GROUP BY 1, 2)
SELECT *, CASE WHEN reference IS NULL THEN 'provenance' WHEN text = '' THEN 'header_only' ELSE 'reference' END AS kind FROM g""")
def w4_rows(spark, d):
    blocks = anchored_blocks(spark, d)
    return R.reference_unit_rows(R.assemble_reference_units(blocks, 12), blocks)
