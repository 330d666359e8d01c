"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_root: str | None = None


def local_session(app: str = "scarpline", cpus: str | int = "*") -> SparkSession:
    """A session for one machine; a cluster brings its own session instead."""
    parallelism = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(parallelism))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator assumes: UTC clock and adaptive plans."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local run without one gets its own."""
    global _local_root
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            f"{CHECKPOINT_KEY} must name a folder all executors share; "
            "a machine-local folder would be lost with its executor"
        )
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="scarpline-")
    return _local_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a Parquet table once and reading it back.

    For results several later jobs read; the files survive lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files a task keeps open in `write_by`, and the rows in memory of each.
OPEN_FILES, FILE_BUFFER = 32, 16 << 20


def write_by(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """Parquet in a folder per value of a column of few values.

    A partitioned write sorts a task's whole rows by the column first. With a file open per value
    nothing is sorted or held but the files' buffers; beyond OPEN_FILES values in a task the rest is
    sorted as before.
    """
    key, conf = "spark.sql.maxConcurrentOutputFileWriters", df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, str(OPEN_FILES))
    try:
        df.write.mode(mode).option("parquet.block.size", FILE_BUFFER).partitionBy(column).parquet(path)
    finally:
        conf.set(key, before)
