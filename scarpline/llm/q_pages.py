"""Queries op3 and op7 over web pages, and the SQL of op7."""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline.session import scratch_path, through_table

from . import main_text, warc
from .registry import query, read

OP7 = r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
spelled AS (
  SELECT page_id, payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)
      FOR i IN range(0, 32)], '') AS payload_digest
  FROM hashed),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM spelled)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM ranked
"""


@query("op3_main_text")
def op3(spark, sf_dir):
    pages = main_text.with_main_text(read(spark, sf_dir, "pages"), html="html", out="text")
    return pages.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op7_warc", OP7)
def op7(spark, sf_dir):
    path = scratch_path(spark, "archives")
    warc.write(read(spark, sf_dir, "pages"), path, least=0)
    found = through_table(warc.read(spark, path, payload=False).drop("payload"), "records")
    rows = warc.captures(found).select(
        "capture", F.get("metadata", F.lit(0))["fields"]["page-id"].cast("bigint").alias("page_id"),
        "payload_bytes", "payload_digest", F.col("response.kind").alias("record_type"), "payload_of",
    )
    rows = through_table(rows, "captures")
    first = rows.where("record_type = 'response'").select(F.col("capture").alias("payload_of"), F.col("page_id").alias("first"))
    joined = rows.join(first, "payload_of", "left")
    return joined.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("first")).alias("refers_to")
    )
