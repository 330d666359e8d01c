"""Queries op2 and op4. A tokenizer's merges are not SQL; they are tested against the libraries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import piece_codec, token_counts
from .registry import query, read


@query("op2_token_counts")
def op2(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op4_piece_codec")
def op4(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.with_round_trip(docs, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
