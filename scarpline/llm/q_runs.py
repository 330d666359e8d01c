"""Query op12. The search for runs is not SQL; it is tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .registry import query, read


def with_cycles(docs: DataFrame) -> DataFrame:
    """The query's texts: of a tenth of the ids, chosen by crc32, the words from a place on are
    replaced by the first few of them, over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words").cast("bigint")
    some = some.withColumn("n", n).withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    rest = F.col("n") - F.col("a")
    cycle = F.expr("slice(words, int(a) + 1, int(p))")
    many = F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("p")).cast("int")))
    cycled = F.concat(F.expr("slice(words, 1, int(a))"), F.slice(many, F.lit(1), rest.cast("int")))
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_runs")
def op12(spark, sf_dir):
    found = runs.with_runs(with_cycles(read(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("strongest.start").alias("start"),
        F.col("strongest.length").alias("length"),
        F.col("strongest.period").alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
