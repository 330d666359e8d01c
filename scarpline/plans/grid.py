"""Grid prediction: cells, samples, rainfall, scores and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import landcover, risk
from ..functions.numbers import is_finite, rounded
from ..operators import aoi as aoi_ops
from ..operators import rainfall, raster, rasters


def cell_features(boxes: DataFrame, wide: DataFrame, meta: raster.RasterMeta, rain: DataFrame,
                  step: float = 0.05, also: tuple[str, ...] = ()) -> DataFrame:
    """Every grid cell with its 11 features, or UNAVAILABLE and why.

    also: columns of `wide` that come along in the same join; rain: one row per state with the features, rain_status and rain_reasons.
    """
    cells = aoi_ops.grid_build(boxes, step)
    sampled = raster.raster_sample(cells, wide, meta, also=also)
    sampled = sampled.withColumn(vocab.LAND_COVER_FEATURE, landcover.proxy_class("elevation"))
    joined = rainfall.aoi_rain_broadcast(sampled, rain, "state")
    why = F.array_compact(F.concat("reasons", F.array(no_rain())))
    return joined.withColumn("reasons", why).withColumn(
        "status", F.when(F.size("reasons") == 0, "OK").otherwise("UNAVAILABLE")
    ).drop("rain_status", "rain_reasons")


def area_features(boxes: DataFrame, wide: DataFrame, cover: DataFrame, georef: DataFrame, rain: DataFrame,
                  step: float = 0.05, proxied: tuple[str, ...] = ("Sikkim",)) -> DataFrame:
    """The grid cells of every area in one plan, each with its 11 features, or UNAVAILABLE and why.

    wide, cover and georef: the terrain and land-cover cells of many rasters and where they lie;
    rain: one row per state. Land cover is sampled from its rasters; only the areas in `proxied`,
    whose model was trained so, take the elevation's stand-in. `cell` is unique over all areas.
    """
    cells = aoi_ops.grid_build(boxes, step).withColumn("cell", F.concat_ws("/", "state", "cell_id"))
    sampled = rasters.sample(cells, "cell", wide, georef)
    covered = rasters.landcover(sampled, "cell", cover, georef)
    stand_in = F.col("state").isin(*proxied)
    known = F.when(stand_in, landcover.proxy_class("elevation")).otherwise(
        F.nullif(vocab.LAND_COVER_FEATURE, F.lit(vocab.LAND_COVER_UNAVAILABLE)))
    joined = rainfall.aoi_rain_broadcast(covered.withColumn(vocab.LAND_COVER_FEATURE, known), rain, "state")
    why = F.array_compact(F.concat(
        "reasons",
        F.array(F.when(~stand_in & F.col(vocab.LAND_COVER_FEATURE).isNull(), "land cover unavailable")),
        F.array(no_rain()),
    ))
    return joined.withColumn("reasons", why).withColumn(
        "status", F.when(F.size("reasons") == 0, "OK").otherwise("UNAVAILABLE")
    ).drop("rain_status", "rain_reasons", "land_cover_unavailable")


def point_features(points: DataFrame, key: str, wide: DataFrame, cover: DataFrame, georef: DataFrame, rain: DataFrame) -> DataFrame:
    """Resolved points (state, state_reasons) with their 11 features, or UNAVAILABLE and why."""
    sampled = rasters.sample(points, key, wide, georef)
    covered = rasters.landcover(sampled, key, cover, georef)
    joined = rainfall.aoi_rain_broadcast(covered, rain, "state")
    known = F.nullif(vocab.LAND_COVER_FEATURE, F.lit(vocab.LAND_COVER_UNAVAILABLE))
    why = F.array_compact(F.concat(
        "state_reasons", "reasons",
        F.array(F.when(F.col("land_cover_unavailable"), "land cover unavailable")), F.array(no_rain()),
    ))
    return joined.withColumns({"reasons": why, vocab.LAND_COVER_FEATURE: known}).withColumn(
        "status", F.when(F.size("reasons") == 0, "OK").otherwise("UNAVAILABLE")
    ).drop("rain_status", "rain_reasons", "land_cover_unavailable")


def no_rain() -> Column:
    """Why an area's rainfall cannot be used; null when it can."""
    ok = F.coalesce(F.col("rain_status") == "REAL", F.lit(False))
    return F.when(~ok, F.coalesce(F.nullif(F.array_join("rain_reasons", "; "), F.lit("")), F.lit("no rainfall for this area")))


def with_classes(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Rounded probability, class and threshold flag for OK rows; nulls otherwise."""
    p = F.when(F.col("status") == "OK", F.col(probability))
    return df.withColumns({
        "risk_class": risk.warning_level(p),
        "exceeds_decision_threshold": p >= vocab.DECISION_THRESHOLD,
        "susceptibility_probability": rounded(p, 6),
    })


def scored_cells(cells: DataFrame) -> DataFrame:
    """A cell is scored only with status OK, a class and a probability; others lose numbers."""
    scored = F.coalesce(
        (F.col("status") == "OK") & F.col("risk_class").isNotNull()
        & F.col("probability").isNotNull() & ~F.isnan("probability"),
        F.lit(False),
    )
    return cells.withColumn("scored", scored).withColumns({
        "probability": F.when(F.col("scored"), F.col("probability")),
        "risk_class": F.when(F.col("scored"), F.col("risk_class")),
    })


def grid_summary(cells: DataFrame, by: list[str], probability: str = "probability") -> DataFrame:
    """Totals, class counts with zero classes, threshold count, max and mean."""
    p = F.col(probability)
    ok = F.col("status") == "OK"
    classes = [name for name, _ in vocab.WARNING_LEVELS]
    micro = F.rint(p * 1e6).cast("long")
    agg = cells.groupBy(*by).agg(
        F.count("*").alias("cells_total"),
        F.count_if(ok).alias("cells_scored"),
        F.count_if(~ok).alias("cells_unavailable"),
        *[F.count_if(ok & (risk.warning_level(p) == c)).alias(f"n_{c.lower()}") for c in classes],
        F.count_if(ok & (p >= vocab.DECISION_THRESHOLD)).alias("cells_exceeding_threshold"),
        rounded(F.max(F.when(ok, p)), 6).alias("max_probability"),
        F.sum(F.when(ok, micro)).alias("_micro"),
    )
    return agg.withColumn(
        "mean_probability", rounded(F.try_divide(F.col("_micro") / 1e6, "cells_scored"), 6)
    ).drop("_micro")


def class_counts_map() -> Column:
    """The class counts of a grid_summary row as one map, zero classes included."""
    classes = [name for name, _ in vocab.WARNING_LEVELS]
    return F.map_from_arrays(
        F.array(*map(F.lit, classes)), F.array(*[F.col(f"n_{c.lower()}") for c in classes])
    )


def feature_report() -> Column:
    """Features rounded to 4 dp in model order, the category as an integer; null unless finite."""
    return F.struct(*[
        F.col(f).cast("int").alias(f) if f == vocab.LAND_COVER_FEATURE
        else F.when(is_finite(f), rounded(F.col(f).cast("double"), 4)).alias(f)
        for f in vocab.MODEL_FEATURES
    ])


def fused_grid(cells: DataFrame, susceptibility: Column) -> DataFrame:
    """Fused risk of grid cells from a susceptibility column and the area's rainfall."""
    ready = cells.withColumns({
        "susceptibility": F.when(F.col("status") == "OK", susceptibility),
        "mm_forecast": F.lit(None).cast("double"),
        "has_real_dem": F.col("elevation").isNotNull(),
        "has_real_rainfall": F.col("rain_1d").isNotNull(),
    })
    return risk.with_fused_risk(ready, mm_now="rain_1d")


