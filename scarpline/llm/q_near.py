"""Query op9. Reachability over bit distances is tested against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import simhash
from .registry import query, read


@query("op9_simhash")
def op9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, radius=3, words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
