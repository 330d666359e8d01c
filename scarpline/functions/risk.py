"""Rainfall thresholds, warning levels and the fused risk score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .numbers import clamp, col, reasons, rounded, when_chain


def critical_intensity(hours: Column | str | float) -> Column:
    """Threshold intensity in mm/h; durations below an hour count as one hour."""
    d = F.lit(float(hours)) if isinstance(hours, (int, float)) else col(hours)
    raw = F.lit(vocab.THRESHOLD_COEFFICIENT) * F.pow(
        F.greatest(d, F.lit(1.0)), F.lit(vocab.THRESHOLD_EXPONENT)
    )
    return rounded(raw, 4)


def critical_accumulation(hours: Column | str | float) -> Column:
    """Threshold depth in mm; here the duration itself is not clamped."""
    d = F.lit(float(hours)) if isinstance(hours, (int, float)) else col(hours)
    return rounded(critical_intensity(hours) * d, 4)


def rainfall_trigger(mm: Column | str, hours: Column | str | float) -> Column:
    """Trigger struct. A missing or negative depth is not a dry reading."""
    d = F.lit(float(hours)) if isinstance(hours, (int, float)) else col(hours)
    depth = col(mm)
    critical = critical_intensity(hours)
    valid = F.coalesce(depth >= 0, F.lit(False)) & ~F.coalesce(F.isnan(depth), F.lit(False))
    intensity = depth / F.greatest(d, F.lit(1.0))
    ratio = intensity / critical
    return F.struct(
        F.when(valid, "valid").otherwise("missing_data").alias("status"),
        F.when(valid, intensity >= critical).otherwise(False).alias("exceeded"),
        F.when(valid, rounded(clamp(ratio / 1.5, 0.0, 1.0), 4)).otherwise(0.0).alias("score"),
        F.when(valid, rounded(intensity, 4)).otherwise(0.0).alias("intensity"),
        critical.alias("critical"),
        F.when(valid, rounded(ratio, 4)).alias("ratio"),
    )


def warning_level(score: Column | str) -> Column:
    """Band of a score; a missing score has no band."""
    s = col(score)
    chain = F.when(s.isNull(), F.lit(None).cast("string"))
    for name, floor in vocab.WARNING_LEVELS:
        chain = chain.otherwise(name) if floor is None else chain.when(s >= floor, name)
    return chain


def confidence(real_dem, real_rain, trigger_status) -> Column:
    return when_chain(
        [
            (col(real_dem) & col(real_rain) & (col(trigger_status) == "valid"), "HIGH"),
            (col(real_dem), "MEDIUM"),
        ],
        F.lit("LOW"),
    )


def with_fused_risk(
    df, susceptibility="susceptibility", mm_now="mm_now", mm_forecast="mm_forecast",
    slope="slope", exposure=None, real_dem="has_real_dem", real_rain="has_real_rainfall",
):
    """Add the fused score and its parts. Rainfall enters only as a multiplier.

    A null forecast stays unevaluated (null trigger score); exposure is reported and
    never folded into the score; a null susceptibility yields no score at all.
    """
    now = rainfall_trigger(mm_now, vocab.CURRENT_HOURS)
    ahead = rainfall_trigger(mm_forecast, vocab.FORECAST_HOURS)
    out = df.withColumns({"trigger_now": now, "trigger_forecast": ahead})
    hit_now, hit_ahead = F.col("trigger_now.exceeded"), F.col("trigger_forecast.exceeded")
    multiplier = (
        F.lit(1.0)
        + F.when(hit_now, vocab.STEP_CURRENT).otherwise(0.0)
        + F.when(hit_ahead, vocab.STEP_FORECAST).otherwise(0.0)
        + F.when(
            (col(slope) >= vocab.STEEP_SLOPE_DEG) & (hit_now | hit_ahead), vocab.STEP_STEEP
        ).otherwise(0.0)
    )
    s = col(susceptibility)
    out = out.withColumns({
        "susceptibility_score": F.when(s.isNotNull(), rounded(clamp(s, 0.0, 1.0), 4)),
        "current_trigger_score": F.col("trigger_now.score"),
        "forecast_evaluated": col(mm_forecast).isNotNull(),
        "forecast_trigger_score": F.when(
            col(mm_forecast).isNotNull(), F.col("trigger_forecast.score")
        ),
        "trigger_multiplier": multiplier,
        "confidence": confidence(
            real_dem, real_rain, F.col("trigger_now.status")
        ),
    })
    e = col(exposure) if exposure else F.lit(None).cast("double")
    raw = F.col("susceptibility_score") * F.col("trigger_multiplier")
    out = out.withColumns({
        "exposure_score": F.when(e.isNotNull(), rounded(clamp(e, 0.0, 1.0), 4)),
        "exposure_status": F.when(e.isNotNull(), "REAL").otherwise("UNAVAILABLE"),
        "final_risk_score": F.when(raw.isNotNull(), rounded(F.least(raw, F.lit(1.0)), 4)),
    })
    return out.withColumn("warning_level", warning_level("final_risk_score"))


def fusion_input_guard(features: Column | str) -> Column:
    """Why a model's feature list may not feed the fused score; empty when it may."""
    names = col(features)
    rain = F.array_sort(F.array_intersect(names, F.array(*map(F.lit, vocab.RAIN_FEATURES))))
    known = F.array(*map(F.lit, vocab.MODEL_FEATURES))
    unknown = F.array_sort(F.array_except(names, known))
    return reasons(
        (F.coalesce(F.size(names), F.lit(0)) <= 0, "feature list is empty"),
        (F.size(rain) > 0, F.concat(F.lit("rainfall-coupled: "), F.array_join(rain, ", "))),
        (F.size(unknown) > 0, F.concat(F.lit("unsupported: "), F.array_join(unknown, ", "))),
    )
