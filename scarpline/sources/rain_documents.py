"""Rainfall as landed documents: daily and hourly JSON arrays, granule listings, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions.numbers import is_finite, reasons

DAILY_SCHEMA = "daily STRUCT<time: ARRAY<STRING>, precipitation_sum: ARRAY<DOUBLE>>"
# Hourly values are read as text, so one unparseable entry drops that hour only.
HOURLY_SCHEMA = "hourly STRUCT<time: ARRAY<STRING>, precipitation: ARRAY<STRING>>"


def daily_archive_parse(
    payloads: DataFrame, key: str, end_day: Column, payload: str = "payload",
    days: int = vocab.ANTECEDENT_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """(series, verdicts) of daily documents.

    The series holds the wanted days of accepted documents only. A length mismatch, a
    missing day or a null refuses the whole document; nothing is filled.
    """
    doc = payloads.withColumns({
        "d": F.from_json(payload, DAILY_SCHEMA)["daily"], "end_day": end_day,
    })
    times, totals = F.col("d.time"), F.col("d.precipitation_sum")
    matched = F.coalesce(F.size(times) == F.size(totals), F.lit(False)) & times.isNotNull()
    # A repeated day keeps its last value, so pairs are looked up, not counted.
    pairs = F.arrays_zip(times.alias("day"), totals.alias("mm"))
    wanted = F.transform(
        F.sequence(F.lit(0), F.lit(days - 1)),
        lambda k: F.date_format(F.date_sub("end_day", k), "yyyy-MM-dd"),
    )
    picked = F.transform(
        wanted,
        lambda w: F.struct(
            w.alias("day"),
            F.try_element_at(F.filter("pairs", lambda p: p["day"] == w), F.lit(-1)).alias("hit"),
        ),
    )
    checked = doc.withColumn("pairs", F.when(matched, pairs)).withColumn("picked", picked)
    absent = F.size(F.filter("picked", lambda p: p["hit"].isNull()))
    empty = F.size(F.filter("picked", lambda p: p["hit"].isNotNull() & ~is_finite(p["hit"]["mm"])))
    why = reasons(
        (~matched, "time and value arrays do not match"),
        (matched & (absent > 0), F.format_string("%d day(s) not returned", absent)),
        (matched & (empty > 0), F.format_string("%d day(s) null or not finite", empty)),
    )
    judged = checked.withColumn("reasons", why).withColumn(
        "status", F.when(F.size("reasons") == 0, "OK").otherwise("REFUSED")
    )
    series = (
        judged.where("status = 'OK'")
        .select(key, F.inline(F.transform("picked", lambda p: F.struct(
            F.to_date(p["day"]).alias("day"), p["hit"]["mm"].alias("mm")))))
    )
    return series, judged.select(key, "status", "reasons")


def hourly_parse(payloads: DataFrame, keep: list[str], now: Column, payload: str = "payload") -> DataFrame:
    """(slot, mm) of past hours: null, NaN and unparseable entries are dropped, not read as 0."""
    doc = payloads.withColumn("h", F.from_json(payload, HOURLY_SCHEMA)["hourly"])
    rows = doc.select(
        *keep, F.inline(F.arrays_zip(F.col("h.time").alias("t"), F.col("h.precipitation").alias("v")))
    )
    slot = F.try_to_timestamp(F.substring("t", 1, 16), F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz")
    parsed = rows.select(*keep, slot.alias("slot"), F.col("v").try_cast("double").alias("mm"))
    return parsed.where(
        F.col("slot").isNotNull() & F.col("mm").isNotNull() & ~F.isnan("mm")
        & (F.col("slot") <= F.date_trunc("hour", now).cast("timestamp_ntz"))
    ).withColumn("mm", F.greatest("mm", F.lit(0.0)))


def granule_parse(name: Column | str) -> Column:
    """(slot, run) of a granule name, null when it is not one.

    The start is read from the -S field, never from the sequence number, and must lie
    on a half-hour boundary.
    """
    text = F.trim(F.col(name) if isinstance(name, str) else name)
    part = lambda i: F.regexp_extract(text, vocab.GRANULE_PATTERN, i)
    slot = F.try_to_timestamp(F.concat(part(2), part(3)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    run = F.element_at(
        F.create_map(*[F.lit(v) for r, p in vocab.GRANULE_PREFIX.items() for v in (p, r)]),
        F.nullif(part(1), F.lit("")),
    )
    on_slot = (F.minute(slot) % vocab.SLOT_MINUTES == 0) & (F.second(slot) == 0)
    return F.when(F.rlike(text, F.lit(vocab.GRANULE_PATTERN)) & on_slot, F.struct(slot.alias("slot"), run.alias("run")))


def granule_listing(listings: DataFrame, keep: list[str], run: str | Column, body: str = "body") -> DataFrame:
    """Granules of the wanted run named in directory listings; the last name of a slot wins."""
    tokens = listings.select(
        *keep, F.posexplode(F.regexp_extract_all(body, F.lit(vocab.GRANULE_TOKEN), F.lit(0))).alias("i", "name")
    ).withColumn("g", granule_parse("name"))
    wanted = F.lit(run) if isinstance(run, str) else run
    return (
        tokens.where(F.col("g").isNotNull() & (F.col("g.run") == wanted))
        .groupBy(*keep, F.col("g.slot").alias("slot"))
        .agg(F.max_by("name", "i").alias("name"))
    )


PRECIP_SCHEMA = "lat_idx INT, lon_idx INT, precip DOUBLE, run_type STRING, day DATE"


def write_precip_grid(grid: DataFrame, path: str) -> None:
    """Partitioned by run and day, sorted by index so row-group statistics prune."""
    (
        grid.repartition("run_type", "day", F.floor(F.col("lat_idx") / 64))
        .sortWithinPartitions("run_type", "day", "lat_idx", "lon_idx")
        .write.partitionBy("run_type", "day").parquet(path)
    )


def read_precip_grid(spark: SparkSession, path: str, run_type: str, day: str, box: dict) -> DataFrame:
    """Only the grid cells of a box for one day and run: partition and row-group pruning."""
    index = lambda v, offset, last: min(max(round((v + offset) * 10), 0), last)
    return (
        spark.read.schema(PRECIP_SCHEMA).parquet(path)
        .where((F.col("run_type") == run_type) & (F.col("day") == F.lit(day).cast("date")))
        .where(F.col("lat_idx").between(index(box["min_lat"], 89.95, 1799), index(box["max_lat"], 89.95, 1799)))
        .where(F.col("lon_idx").between(index(box["min_lon"], 179.95, 3599), index(box["max_lon"], 179.95, 3599)))
    )
