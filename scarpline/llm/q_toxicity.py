"""Query op1. A fitted score is no SQL; its held-out accuracy is tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import toxicity
from .registry import query, read


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.with_score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
