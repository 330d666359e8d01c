"""Catalogue to training matrix in one plan, written once for the model runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..operators import matrix, rainfall, raster, rasters
from ..session import through_table


def labelled_points(positives: DataFrame, boxes: DataFrame) -> DataFrame:
    """Positives and their buffered negatives: sample_id, state, seed, place, date, target."""
    pos = positives.select(
        F.concat_ws("-", F.lit("p"), "state", F.col("event_id").cast("string")).alias("sample_id"), "state",
        F.col("event_id").alias("seed"), "latitude", "longitude", "event_date",
    )
    neg = matrix.buffered_negatives(positives, boxes).select(
        F.concat_ws("-", F.lit("n"), "state", F.col("positive_id").cast("string"), F.col("attempt").cast("string")).alias("sample_id"), "state",
        (F.col("positive_id") + F.col("attempt")).alias("seed"), "latitude", "longitude", "event_date",
    )
    return matrix.pos_neg_union(pos, neg)


def area_matrix(
    positives: DataFrame, boxes: DataFrame, wide: DataFrame, cover: DataFrame, georef: DataFrame,
    daily: DataFrame, rain_key: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The training matrix with terrain and land cover from many rasters, all states in one plan.

    The samples are written once: five joins read them, and each would make the negatives anew, in
    a plan that alone fills the driver.
    """
    samples = through_table(rain_key(labelled_points(positives, boxes)), "samples")
    placed = rasters.sample(samples, "sample_id", wide, georef).withColumnsRenamed(
        {"status": "terrain_status", "reasons": "terrain_reasons"}
    )
    covered = rasters.landcover(placed, "sample_id", cover, georef)
    full = rainfall.event_rainfall_join(covered, daily)
    return matrix.cast_features(full).select(
        "sample_id", "state", "target", "latitude", "longitude", "event_date", *vocab.MODEL_FEATURES,
        "terrain_status", "rain_status",
    )


def training_matrix(
    positives: DataFrame, boxes: DataFrame, wide: DataFrame, cover: DataFrame, meta: raster.RasterMeta,
    daily: DataFrame, rain_key: Callable[[DataFrame], DataFrame], strict: bool = True,
) -> DataFrame:
    """Positives and buffered negatives with terrain, land cover and antecedent rain.

    All states in one plan. positives, a table: state, event_id, latitude, longitude,
    event_date; boxes: one row per state. A place in two states is a sample of both.
    rain_key adds cell_id and target_day. Rows with masked terrain stay. With strict, a single incomplete rainfall
    window stops the job that reads the matrix; otherwise such rows carry their status.
    """
    samples = rain_key(labelled_points(positives, boxes))
    placed = raster.raster_sample(samples, wide, meta).withColumnsRenamed(
        {"status": "terrain_status", "reasons": "terrain_reasons"}
    )
    covered = raster.landcover_sample(placed, cover, meta)
    full = rainfall.event_rainfall_join(covered, daily)
    if strict:
        full = matrix.complete_rainfall_only(full)
    return matrix.cast_features(full).select(
        "sample_id", "state", "target", "latitude", "longitude", "event_date", *vocab.MODEL_FEATURES,
        "terrain_status", "rain_status",
    )
