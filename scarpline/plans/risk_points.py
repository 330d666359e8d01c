"""Fused risk of points: resolve inputs, gate them, fuse, keep the refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import provenance as prov, risk


def _record(name: str, status: Column, value, reason: str) -> Column:
    why = F.when(status == "UNAVAILABLE", F.array(F.lit(reason))).otherwise(
        F.array().cast("array<string>")
    )
    return prov.input_record(name, status, value, reason=why)


def _known(c: str) -> Column:
    return F.when(F.col(c).isNull(), "UNAVAILABLE").otherwise("REAL")


def _depth_ok(c: str) -> Column:
    return F.coalesce((F.col(c) >= 0) & ~F.isnan(c), F.lit(False))


def rainfall_record(mm: str = "mm_now", live: str = "has_real_rainfall") -> Column:
    """Observed 24 h rainfall; a reanalysis series is usable but only a proxy."""
    status = (
        F.when(~_depth_ok(mm), "UNAVAILABLE").when(F.col(live), "REAL").otherwise("DERIVED_PROXY")
    )
    return _record("current_rainfall_mm", status, mm, "no usable 24 h rainfall")


def input_records(points: DataFrame) -> DataFrame:
    """Points with an `inputs` struct of normalised records, one per input."""
    forecast = F.when(_depth_ok("mm_forecast"), "REAL").otherwise("UNAVAILABLE")
    records = {
        "susceptibility": _record("susceptibility", _known("susceptibility"), "susceptibility", "no usable model score"),
        "slope_deg": _record("slope_deg", _known("slope"), "slope", "no terrain sample"),
        "current_rainfall_mm": rainfall_record(),
        "forecast_rainfall_mm": _record("forecast_rainfall_mm", forecast, "mm_forecast", "no usable forecast"),
        "exposure_score": _record(
            "exposure_score", F.lit("UNAVAILABLE"), F.lit(None).cast("double"),
            "no validated mapping from assets to a score",
        ),
    }
    return points.withColumn("inputs", F.struct(*[c.alias(n) for n, c in records.items()]))


def gate(df: DataFrame, mode: str) -> DataFrame:
    """Blocking inputs and reasons for a mode; exposure never blocks."""
    return df.withColumns({
        "blocking_inputs": prov.blocking_inputs("inputs", mode),
        "blocking_reasons": prov.blocking_reasons("inputs", mode),
    }).withColumn("usable", F.size("blocking_inputs") == 0)


def risk_of(records: DataFrame, mode: str) -> DataFrame:
    """Fused risk of one mode. The current mode asserts no forecast at all."""
    forecast = F.col("mm_forecast") if mode == "forecast" else F.lit(None).cast("double")
    ready = gate(records, mode).withColumns({
        "_forecast": forecast,
        "_dem": F.col("inputs.slope_deg.status").isin(vocab.USABLE_STATUSES),
        "_rain": F.col("inputs.current_rainfall_mm.status") == "REAL",
    })
    fused = risk.with_fused_risk(ready, mm_forecast="_forecast", real_dem="_dem", real_rain="_rain")
    numbers = ["final_risk_score", "warning_level", "confidence"]
    return fused.withColumns({n: F.when(F.col("usable"), F.col(n)) for n in numbers}).withColumn(
        "mode", F.lit(mode)
    )


def current_and_forecast_risk(points: DataFrame) -> DataFrame:
    """Both modes for every point; refused points keep their reasons and no numbers."""
    records = input_records(points)
    return risk_of(records, "current").unionByName(risk_of(records, "forecast"))
