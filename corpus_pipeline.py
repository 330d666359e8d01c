"""A training corpus from raw documents in five stages, each of one operator.

1. quality: rules and robust outliers; rejected documents go.
2. toxicity: a classifier learnt from the labelled rows; documents it calls toxic go.
3. near_duplicates: components of SimHash fingerprints within three bits, MinHash bands for what
   these miss, and prefixes of the sets for all that both leave out propose; texts whose sets of
   five-word shingles share 0.8 of their union link, without exception. The document of the smallest id of each component stays.
4. mixing: sources by weight; a document appears as often as the mix takes it, or not at all.
5. pieces: SentencePiece ids of the whole text, and the digests of ids and of decoded text.

A stage is (spark, docs, sf_dir) -> DataFrame over what the stage before it kept. The first
four return the columns of documents. Tables of other columns keep them too. Null texts are
too short for the quality rules and go; empty tables give empty results; repeated rows meet as
duplicates, of which one stays; among rows without an id, one of each component stays where no
id is in it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.llm import mixing, piece_codec, q_mixing, q_toxicity, robust_quality, simhash, toxicity
from scarpline.session import scratch_path, through_table

#: The stages decide by fitted models, shingle sets and a tokenizer: no SQL. They are tested
#: against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    table = through_table(robust_quality.with_statistics(docs.withColumn("__doc", F.struct(*columns))).select("__doc", *robust_quality.STATISTICS), "statistics")
    table = table.withColumns({"lang": F.col("__doc.lang"), "source": F.col("__doc.source")})
    return robust_quality.with_verdict(table).where("kept").select("__doc.*").select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, ~q_toxicity.held_out())
    return toxicity.with_score(docs, model, out="__score").where("__score < 0.5").drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    inside = docs.select(F.struct(*columns).alias("__doc"))
    mixed, _ = mixing.mix(
        inside, F.array("__doc.source"), lambda i: q_mixing.WEIGHTS[i % 3], id="__doc.doc_id", text="__doc.text", share=1.5, repeats=2
    )
    copies = mixed.select("__doc", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1, copies) ELSE array() END")))
    return copies.select("__doc.*").select(*columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = piece_codec.with_round_trip(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality), ("toxicity", drop_toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
