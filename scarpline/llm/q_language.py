"""Query op6. The base score is tested against plain counting, the model by held-out likelihood."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import class_lm
from .registry import query, read


@query("op6_class_lm")
def op6(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))
    scored = class_lm.score_by(docs.withColumn("held_out", held), F.col("held_out"), keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
