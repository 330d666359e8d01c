"""The pipeline's stages against what they promise, and its entry points."""

import corpus_pipeline
from pyspark.sql import functions as F

from scarpline.session import scratch_path


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        path = scratch_path(spark, name)
        stage(spark, before, small).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns
        assert after.join(before, columns, "left_anti").count() == 0  # rows as they were
        if name != "mixing":
            assert 0 < after.count() <= before.count() and after.select("doc_id").distinct().count() == after.count()
        before = after
    copies = before.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 2


def test_stages_on_empty_and_edge_rows(spark, small, docs):
    shaped = docs.select("doc_id", "text", "lang", "source", F.lit(0).cast("bigint").alias("n_chars"), F.lit("x").alias("score"), F.lit("y").alias("size"))
    for frame in (shaped, shaped.limit(0)):
        path = scratch_path(spark, "edge")
        frame.write.parquet(path)
        rows = spark.read.parquet(path)
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, rows, small).columns == frame.columns
            assert stage(spark, rows, small).count() <= 2 * rows.count()
        assert corpus_pipeline.STAGES[4][1](spark, rows, small).count() == rows.count()


def test_run_and_registration(spark, small):
    import __spark_entry__ as driver

    assert driver.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in driver.oracle_sql()
    ops = [k for k in driver.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in ops) == list(range(1, 14))
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0
