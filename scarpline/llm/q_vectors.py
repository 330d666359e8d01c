"""Query op5. Its recall is measured against brute force in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import vector_search
from .registry import query, read


@query("op5_vector_search")
def op5(spark, sf_dir):
    return vector_search.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
