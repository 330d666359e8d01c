"""Operators with their own state: the best run per slot and the latest per area.

The only Python on the workers. Arrow batches are reduced before the shuffle, so a busy
area sends one row per batch (and slot) to its key, not all its readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import vocab

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Arbitrary state needs the RocksDB store; pass this to the run.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}


UPGRADE_SCHEMA = "aoi INT, slot TIMESTAMP, source_kind STRING, source_rank INT, mm DOUBLE, previous_rank INT"


def best_per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side combine: the best row per area and slot of each batch."""
    for frame in batches:
        yield frame.sort_values(["source_rank", "mm"]).drop_duplicates(["aoi", "slot"])


def newest_per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side combine: the newest row per area of each batch."""
    for frame in batches:
        yield frame.sort_values(["slot", "mm"]).drop_duplicates(["aoi"], keep="last")


class BestRun(StatefulProcessor):
    """Keeps the best-ranked observation of an (area, slot); emits only improvements."""

    def init(self, handle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "source_rank INT, mm DOUBLE, source_kind STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.best.get() if self.best.exists() else None
        top = None
        for frame in rows:
            first = frame.sort_values(["source_rank", "mm"]).iloc[0]
            candidate = (int(first["source_rank"]), float(first["mm"]), str(first["source_kind"]))
            top = candidate if top is None or candidate < top else top
        if top is None or (known is not None and top[0] >= known[0]):
            return
        self.best.update(top)
        if known is None:
            # Once the watermark is a Late latency past the slot nothing better can come.
            end = int(pd.Timestamp(key[1]).timestamp() * 1000) + vocab.SLOT_MINUTES * 60_000
            self.handle.registerTimer(end)
        yield pd.DataFrame({
            "aoi": [key[0]], "slot": [key[1]], "source_kind": [top[2]], "source_rank": [top[0]],
            "mm": [top[1]], "previous_rank": pd.array([None if known is None else known[0]], dtype="Int32"),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def run_upgrade(observations: DataFrame, delay: str) -> DataFrame:
    """Early over Late over fallback per (aoi, slot); later than the delay is dropped.

    observations: aoi, slot, source_kind, mm. `run_counted` returns how many rows were
    dropped; rows of one batch, area and slot are one row by then.
    """
    rank = F.create_map(*[F.lit(v) for kv in vocab.LIVE_SOURCE_RANK.items() for v in kv])
    ranked = observations.withColumn("source_rank", F.element_at(rank, F.col("source_kind")))
    combined = ranked.where("source_rank IS NOT NULL").mapInPandas(best_per_batch, ranked.schema)
    return (
        combined.withWatermark("slot", delay)
        .groupBy("aoi", "slot")
        .transformWithStateInPandas(
            statefulProcessor=BestRun(), outputStructType=UPGRADE_SCHEMA,
            outputMode="append", timeMode="eventTime",
        )
    )


LATEST_SCHEMA = (
    "aoi INT, observed_at TIMESTAMP, latest_mm DOUBLE, age_minutes DOUBLE, freshness STRING, is_stale BOOLEAN"
)


class Latest(StatefulProcessor):
    """Newest observation per area; a timer reports it STALE when nothing newer came."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "observed_ms BIGINT, mm DOUBLE")

    @staticmethod
    def _row(aoi, observed_ms, mm, now_ms):
        age = max(0.0, round((now_ms - observed_ms) / 60_000.0, 1))
        stale = age > vocab.STALE_MINUTES
        label = "STALE" if stale else "NEAR_REAL_TIME" if age <= vocab.NEAR_REAL_TIME_MINUTES else "RECENT"
        return pd.DataFrame({
            "aoi": [aoi], "observed_at": [pd.Timestamp(observed_ms, unit="ms")], "latest_mm": [mm],
            "age_minutes": [age], "freshness": [label], "is_stale": [stale],
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for frame in rows:
            top = frame.sort_values(["slot", "mm"]).iloc[-1]
            seen = (int(pd.Timestamp(top["slot"]).timestamp() * 1000), float(top["mm"]))
            newest = seen if newest is None or seen > newest else newest
        known = self.last.get() if self.last.exists() else None
        if newest is None or (known is not None and newest[0] <= known[0]):
            return
        self.last.update(newest)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(newest[0] + vocab.STALE_MINUTES * 60_000 + 60_000)
        # Event time is the clock: the age counts from the slot to the watermark.
        now = max(newest[0], int(timerValues.getCurrentWatermarkInMs()))
        yield self._row(key[0], newest[0], newest[1], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            observed, mm = self.last.get()
            now = max(int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs()))
            yield self._row(key[0], int(observed), float(mm), now)

    def close(self) -> None:
        pass


def latest(observations: DataFrame, delay: str) -> DataFrame:
    """observations: aoi, slot, mm."""
    combined = observations.mapInPandas(newest_per_batch, observations.schema)
    return (
        combined.withWatermark("slot", delay).groupBy("aoi")
        .transformWithStateInPandas(
            statefulProcessor=Latest(), outputStructType=LATEST_SCHEMA,
            outputMode="append", timeMode="eventTime",
        )
    )


RUN_HOURS = 12
RUN_SCHEMA = (
    "aoi INT, anchor TIMESTAMP, run_hours INT, latest_mm DOUBLE, "
    + ", ".join(f"accum_{h}h_mm DOUBLE, accum_{h}h_reason STRING" for h in vocab.ACCUMULATION_HOURS)
)
HOUR_MS = 3_600_000


class NewestRun(StatefulProcessor):
    """The hours of an area up to the newest one without a gap, at most RUN_HOURS of them.

    Only hours that could still be in the run are kept, so an area's state is twelve numbers. An
    hour that arrives late closes a gap behind the anchor; a repeated hour keeps its larger value.
    """

    def init(self, handle) -> None:
        self.hours = handle.getMapState("hours", "ms BIGINT", "mm DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {int(k[0]): float(v[0]) for k, v in self.hours.iterator()} if self.hours.exists() else {}
        before = dict(known)
        for frame in rows:
            for slot, mm in zip(frame["slot"], frame["mm"], strict=True):
                if pd.notna(mm):
                    ms = int(pd.Timestamp(slot).timestamp() * 1000)
                    known[ms] = max(known.get(ms, float("-inf")), float(mm))
        if not known or known == before:
            return
        anchor = max(known)
        kept = {ms: mm for ms, mm in known.items() if ms > anchor - RUN_HOURS * HOUR_MS}
        for ms in before.keys() - kept.keys():
            self.hours.removeKey((ms,))
        for ms, mm in kept.items():
            if before.get(ms) != mm:
                self.hours.updateValue((ms,), (mm,))
        run = []
        while anchor - len(run) * HOUR_MS in kept:
            run.append(kept[anchor - len(run) * HOUR_MS])
        row = {"aoi": [key[0]], "anchor": [pd.Timestamp(anchor, unit="ms")], "run_hours": [len(run)], "latest_mm": [run[0]]}
        for h in vocab.ACCUMULATION_HOURS:
            whole = len(run) >= h
            # Summed in whole millionths, so the order of arrival does not matter.
            row[f"accum_{h}h_mm"] = [round(sum(round(mm * 1e6) for mm in run[:h]) / 1e6, 4) if whole else None]
            row[f"accum_{h}h_reason"] = [None if whole else f"{len(run)} contiguous hours up to the newest, {h} needed"]
        yield pd.DataFrame(row).astype({f"accum_{h}h_mm": "float64" for h in vocab.ACCUMULATION_HOURS})

    def close(self) -> None:
        pass


def newest_run(hourly: DataFrame, delay: str) -> DataFrame:
    """hourly: aoi, slot (an hour's start), mm. A row per area and batch that changed its hours."""
    return (
        hourly.withWatermark("slot", delay).groupBy("aoi")
        .transformWithStateInPandas(
            statefulProcessor=NewestRun(), outputStructType=RUN_SCHEMA, outputMode="append", timeMode="none",
        )
    )


def upsert_latest(table: str, key: str = "aoi", order: str = "observed_at"):
    """A foreachBatch sink that keeps the newest row per key in a table of its own.

    Each batch writes one folder, named by its number, with the newest row of each of its keys: a
    batch that is repeated after a failure overwrites its own folder, so every row counts once.
    Rows of one key in one batch are ordered by `order`, then by the age they report.
    """
    def write(batch: DataFrame, number: int) -> None:
        ranked = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(order, "age_minutes")).alias("r")).select("r.*")
        ranked.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number:08d}")

    return write


def read_latest(spark, table: str, key: str = "aoi") -> DataFrame:
    """The row of each key from the last batch that had one."""
    rows = spark.read.parquet(f"{table}/batch=*")
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"], "left_semi").drop("batch")
