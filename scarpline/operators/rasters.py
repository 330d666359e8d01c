"""Many rasters of different origin and resolution in one job.

A georeference is a table, one row per raster:

    raster_id, state (null: any), west, north, res (degrees), priority (smaller wins)

and the cells of all rasters are one table: raster_id, row_idx, col_idx and values. Row 0 is a
raster's northernmost row. Points find the rasters over them through whole-degree tiles, an
equi-join; where rasters overlap, the first usable one in the order of priority counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import geo
from ..functions.landcover import group_of
from ..functions.numbers import reasons
from . import raster

ID = "raster_id"
UNUSABLE = 1 << 40  # added to the priority of a raster without a value at a place


def bounds(georef: DataFrame, cells: DataFrame) -> DataFrame:
    """The georeference with each raster's measured extent and box; rasters without cells go."""
    e = F.col("extent")
    return georef.join(raster.extents(cells, (ID,)), ID).withColumns({
        "min_lat": F.col("north") - (e["last_row"] + 1) * F.col("res"),
        "max_lat": F.col("north") - e["first_row"] * F.col("res"),
        "min_lon": F.col("west") + e["first_col"] * F.col("res"),
        "max_lon": F.col("west") + (e["last_col"] + 1) * F.col("res"),
    })


def tile_index(located: DataFrame, tile_deg: float = 1.0) -> DataFrame:
    """Each raster once per tile it meets: a row per raster and degree, not per cell."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) / tile_deg), F.floor(F.col(high) / tile_deg))
    return located.withColumn("_ti", F.explode(span("min_lat", "max_lat"))).withColumn("_tj", F.explode(span("min_lon", "max_lon")))


def places(points: DataFrame, key: str, located: DataFrame, tile_deg: float = 1.0) -> DataFrame:
    """(key, raster_id, priority, row_idx, col_idx) for every raster over every point.

    A raster with a state serves that state's points only. Points without a finite place
    meet no tile.
    """
    at = points.select(
        key, "state", "latitude", "longitude",
        F.floor(F.col("latitude") / tile_deg).alias("_ti"), F.floor(F.col("longitude") / tile_deg).alias("_tj"),
    )
    tiles = tile_index(located, tile_deg).select(
        ID, F.col("state").alias("_state"), "west", "north", "res", "priority", "extent", "_ti", "_tj"
    )
    # Points exploded from boxes look like a handful of rows to the planner: merge, so that they are
    # never sent to the driver to be broadcast. A crowded tile is split by adaptive execution.
    at = at.hint("merge")
    row = F.floor((F.col("north") - F.col("latitude")) / F.col("res")).cast("int")
    column = F.floor((F.col("longitude") - F.col("west")) / F.col("res")).cast("int")
    met = at.join(tiles, ["_ti", "_tj"]).where(F.col("_state").isNull() | (F.col("_state") == F.col("state")))
    e = F.col("extent")
    return met.withColumns({"row_idx": row, "col_idx": column}).where(
        F.col("row_idx").between(e["first_row"], e["last_row"]) & F.col("col_idx").between(e["first_col"], e["last_col"])
    ).select(key, ID, "priority", "row_idx", "col_idx")


def terrain(cells: DataFrame, georef: DataFrame, block: int = raster.BLOCK) -> DataFrame:
    """Elevation and its derivatives for the cells of every raster, each with its own cell size.

    A cell's side in metres follows from the raster's resolution and mean latitude.
    """
    nine = raster.neighbourhood(cells, block=block, by=(ID,))
    e = F.col("extent")
    mean_lat = F.col("north") - (e["first_row"] + e["last_row"] + 1) * (F.col("res") / 2)
    sized = bounds(georef, cells).select(ID, geo.mean_cell_metres(F.col("res"), mean_lat).alias("_metres"))
    graded = raster.with_gradients(nine.join(sized, ID), F.col("_metres"))
    return graded.select(
        ID, "row_idx", "col_idx", "elevation", raster.slope().alias("slope"), raster.aspect().alias("aspect"),
        raster.roughness().alias("roughness"), raster.tpi().alias("tpi"),
    )


def sample(points: DataFrame, key: str, wide: DataFrame, georef: DataFrame, names=tuple(vocab.TERRAIN_FEATURES), nodata: float = vocab.NODATA) -> DataFrame:
    """Values at points with a unique `key` and a state, from the first raster where all are usable.

    Every point stays once: with values, `raster_id` and status REAL, or with nulls, status
    UNAVAILABLE and the reasons of the first raster over it. The candidates are slim rows; one
    hash aggregation picks among them, so overlaps need no sort.
    """
    cells = wide.select(ID, "row_idx", "col_idx", *[raster.mask_nodata(n, nodata).alias(n) for n in names], F.lit(True).alias("_hit"))
    # A written raster's file may be a hundredth of its rows: its size is no reason to broadcast it.
    found = places(points, key, bounds(georef, wide)).join(cells.hint("merge"), [ID, "row_idx", "col_idx"], "left")
    usable = F.col("_hit").isNotNull()
    for n in names:
        usable = usable & F.col(n).isNotNull()
    rank = F.col("priority").cast("long") * (1 << 16) + F.col(ID) + F.when(usable, 0).otherwise(UNUSABLE)
    best = found.withColumn("_rank", rank).groupBy(key).agg(
        F.min("_rank").alias("_rank"), F.min_by(ID, "_rank").alias(ID), F.min_by("_hit", "_rank").alias("_hit"),
        *[F.min_by(n, "_rank").alias(n) for n in names],
    )
    joined = points.join(best, key, "left")
    over, hit = F.col("_rank").isNotNull(), F.coalesce("_hit", F.lit(False))
    why = reasons(
        (~over, "point is outside every raster"),
        (over & ~hit, "no raster has a cell here"),
        *[(hit & F.col(n).isNull(), f"{n} is nodata or not finite") for n in names],
    )
    ok = F.coalesce(F.col("_rank") < UNUSABLE, F.lit(False))
    return joined.select(
        *points.columns,
        *[F.when(ok, F.col(n)).alias(n) for n in names],
        F.when(ok, F.col(ID)).alias(ID),
        F.when(ok, "REAL").otherwise("UNAVAILABLE").alias("status"),
        why.alias("reasons"),
    )


def landcover(points: DataFrame, key: str, cells: DataFrame, georef: DataFrame) -> DataFrame:
    """Land-cover group at points from the first raster with a known code; -1 and a flag otherwise."""
    group = group_of("code")
    codes = cells.select(ID, "row_idx", "col_idx", group.alias("_group")).hint("merge")  # as in `sample`
    found = places(points, key, bounds(georef, cells)).join(codes, [ID, "row_idx", "col_idx"])
    known = F.col("_group") != vocab.LAND_COVER_UNAVAILABLE
    rank = F.col("priority").cast("long") * (1 << 16) + F.col(ID) + F.when(known, 0).otherwise(UNUSABLE)
    best = found.groupBy(key).agg(F.min_by("_group", rank).alias("_group"))
    at = F.coalesce("_group", F.lit(vocab.LAND_COVER_UNAVAILABLE))
    return points.join(best, key, "left").select(
        *points.columns, at.alias(vocab.LAND_COVER_FEATURE), (at == vocab.LAND_COVER_UNAVAILABLE).alias("land_cover_unavailable")
    )
