"""Half-hour slots, complete accumulations and threshold alerts over a rain stream."""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .. import vocab
from ..functions import clock, risk
from ..functions.numbers import is_finite, rounded
from ..session import scratch_path

PARTITIONS = "spark.sql.shuffle.partitions"
LATE_DELAY = f"{vocab.LATE_LATENCY_MINUTES} minutes"
EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def file_stream(spark: SparkSession, folder: str, schema: str, glob: str) -> DataFrame:
    """Files of one name pattern in a folder as a stream, schema given."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def slot_rain(
    rates: DataFrame, key: str = "aoi", minutes: int = vocab.SLOT_MINUTES, delay: str = LATE_DELAY,
    is_rate: bool = True,
) -> DataFrame:
    """Mean per area and slot, emitted once the watermark passes the slot.

    rates: key, ts (timestamp), rate. A rate in mm/h becomes mm of the slot; hourly
    totals (is_rate=False) are taken as they are. Partial aggregation runs before the
    shuffle, so a busy area costs one row per task. Fill and non-finite values do not
    count; a slot without a valid value is not emitted.
    """
    good = is_finite("rate") & (F.col("rate") > vocab.PRECIP_FILL_FLOOR)
    hundredths = F.rint(F.greatest("rate", F.lit(0.0)) * 100).cast("long")
    factor = minutes / 60.0 if is_rate else 1.0
    return (
        rates.where(good)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{minutes} minutes"), key)
        .agg(F.sum(hundredths).alias("_sum"), F.count("*").alias("readings"))
        .select(
            key, "window", F.col("window.start").alias("slot"), "readings",
            (F.col("_sum") / 100.0 / F.col("readings") * factor).alias("mm"),
        )
    )


def accumulations(
    slots: DataFrame, key: str = "aoi", minutes: int = vocab.SLOT_MINUTES,
    hours=vocab.ACCUMULATION_HOURS,
) -> DataFrame:
    """Totals of the last hours at every slot end, null with a reason unless complete.

    A second stateful operator over the slots: one sliding window of the longest span
    carries the shorter ones too, so there is a single state store.
    """
    longest = max(hours)
    sliding = F.window(F.window_time("window"), f"{longest} hours", f"{minutes} minutes")
    micro = F.rint(F.col("mm") * 1e6).cast("long")
    placed = slots.select(key, "slot", micro.alias("micro"), sliding.alias("span"))
    recent = lambda h: F.col("slot") >= F.col("span.end") - F.expr(f"INTERVAL {h} HOURS")
    grouped = placed.groupBy("span", key).agg(*[
        x for h in hours for x in (
            F.sum(F.when(recent(h), F.col("micro"))).alias(f"_s{h}"),
            F.count_if(recent(h)).alias(f"_n{h}"),
        )
    ])
    out = []
    for h in hours:
        need = round(h * 60 / minutes)
        have = F.col(f"_n{h}")
        out += [
            F.when(have == need, rounded(F.col(f"_s{h}") / 1e6, 4)).alias(f"accum_{h}h_mm"),
            F.when(have < need, clock.window_reason(have, need, h, minutes)).alias(f"accum_{h}h_reason"),
        ]
    return grouped.select(key, F.col("span.end").alias("window_end"), *out)


def trigger_alerts(accumulated: DataFrame, hours=vocab.ACCUMULATION_HOURS) -> DataFrame:
    """One row per completed accumulation at or above its critical intensity; stateless."""
    rows = F.array(*[
        F.struct(F.lit(float(h)).alias("duration_h"), F.col(f"accum_{h}h_mm").alias("mm")) for h in hours
    ])
    opened = accumulated.select(*[c for c in accumulated.columns if not c.startswith("accum_")], F.inline(rows))
    judged = opened.where("mm IS NOT NULL").withColumn("t", risk.rainfall_trigger("mm", "duration_h"))
    return judged.where("t.exceeded").select(
        *[c for c in opened.columns], F.col("t.intensity").alias("intensity_mm_h"),
        F.col("t.critical").alias("critical_mm_h"), F.col("t.ratio").alias("threshold_ratio"), F.col("t.score").alias("trigger_score"),
    )


def alert_cells(alerts: DataFrame, cells: DataFrame, key: str = "aoi") -> DataFrame:
    """Stream-static join: the cells an alert concerns."""
    return alerts.join(cells, key)


class DroppedRows(StreamingQueryListener):
    """Late rows dropped by each run, summed over every one of its batches as they end."""

    def __init__(self):
        self._sums: dict[str, int] = {}
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self._sums[run] = self._sums.get(run, 0) + sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, run: str, seconds: float = 120.0) -> None:
        """Events come in order but later than the run's end; without the last one no sum is known."""
        if not self._end(run).wait(seconds):
            raise TimeoutError(f"no end of run {run} was reported")

    def dropped(self, run: str) -> int:
        return self._sums.get(run, 0)


@contextmanager
def started_with(spark: SparkSession, settings: dict[str, str]):
    """Settings for a query that is started inside: it takes them as it starts, and keeps them."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_counted(
    stream: DataFrame, name: str, mode: str = "append", folder: str | None = None,
    state_partitions: int | None = None, settings: dict[str, str] | None = None,
) -> tuple[DataFrame, int]:
    """Run a stream over everything there is into a Parquet table: (table, late rows dropped).

    folder, a shared one, holds the table and the checkpoint. A later call with the same
    folder resumes: only new input is read, state goes on, and every row is in the table
    once. Without a folder each call is a run of its own in the scratch folder. State is
    partitioned for the life of a checkpoint: state_partitions counts when the folder is
    new, by default the session's shuffle partitions. `settings` hold for this query only.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, name)
    writer = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
    )
    wanted = dict(settings or {})
    if state_partitions:
        wanted[PARTITIONS] = str(state_partitions)
    watch = DroppedRows()
    spark.streams.addListener(watch)
    try:
        with started_with(spark, wanted):
            run = writer.start()
        run.awaitTermination()
        watch.wait(str(run.runId))
    finally:
        spark.streams.removeListener(watch)
    return spark.read.schema(stream.schema).parquet(f"{folder}/table"), watch.dropped(str(run.runId))


def run_each(stream: DataFrame, name: str, write, folder: str | None = None, settings: dict[str, str] | None = None) -> None:
    """Run a stream over everything there is, each batch given to write(batch, number).

    A batch may be given again after a failure, with the same number: `write` must then leave
    what one call leaves. A later call with the same folder resumes.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, name)
    with started_with(spark, settings or {}):
        run = (
            stream.writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
    run.awaitTermination()


def run_available(stream: DataFrame, name: str, mode: str = "append", **options) -> DataFrame:
    """The table of `run_counted`."""
    return run_counted(stream, name, mode, **options)[0]
