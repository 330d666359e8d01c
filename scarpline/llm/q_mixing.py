"""Query op10 and its SQL: with one source per document the flow is the target itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import mixing
from .registry import query, read

WEIGHTS = (3.0, 1.0, 2.0)

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [2.0, 3.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) % 3) + 1]::DOUBLE AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (
            ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
leveled AS (SELECT *, min(CASE WHEN cap / w > level THEN cap / w END) OVER () AS first_open FROM filled),
targets AS (
  SELECT source, source_size,
         CASE WHEN first_open IS NULL OR cap / w < first_open THEN cap
              ELSE w * max(CASE WHEN cap / w = first_open THEN level END) OVER () END AS target
  FROM leveled),
plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS whole,
         CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT % source_size END AS rest
  FROM targets),
ordered AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ordered o JOIN plan p ON o.source IS NOT DISTINCT FROM p.source
"""


@query("op10_mixing", OP10)
def op10(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = docs.withColumn("text", F.col("text"))
    mixed, totals = mixing.mix(sized, F.array("source"), lambda i: WEIGHTS[i % 3], share=1.5, repeats=2)
    joined = mixed.join(totals.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    return joined.select("doc_id", "size", "source_size", "target", "taken")
