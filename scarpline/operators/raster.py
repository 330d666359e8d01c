"""Raster-cell tables: mosaics, 3x3 neighbourhoods, sampling and statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import geo, landcover
from ..functions.numbers import col, is_finite, reasons

BLOCK = 256  # cells per block side: halo overhead 4/BLOCK, at most (BLOCK+2)^2 rows a block


@dataclass(frozen=True)
class RasterMeta:
    """Georeference of a cell table; row 0 is the northernmost row."""

    west: float
    north: float
    res: float
    nodata: float = vocab.NODATA

    def row(self, lat) -> Column:
        return F.floor((F.lit(self.north) - col(lat)) / self.res).cast("int")

    def col(self, lon) -> Column:
        return F.floor((col(lon) - F.lit(self.west)) / self.res).cast("int")


    def window(self, box: dict) -> tuple[int, int, int, int]:
        """First and last row and column whose cells meet a box."""
        near = lambda v: round(v / self.res, 9)
        return (
            max(0, math.floor(near(self.north - box["max_lat"]))),
            math.ceil(near(self.north - box["min_lat"])) - 1,
            max(0, math.floor(near(box["min_lon"] - self.west))),
            math.ceil(near(box["max_lon"] - self.west)) - 1,
        )


def require_cell_size(value) -> float:
    """A cell size must be given, and be a finite positive number of metres."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"cell size must be a number of metres, got {value!r}")
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"cell size must be finite and positive, got {value!r}")
    return float(value)


def mask_nodata(c: Column | str, nodata: float = vocab.NODATA) -> Column:
    """Null for nodata (within float tolerance) and non-finite values; never filled."""
    value = col(c)
    near = 1e-8 + 1e-5 * abs(nodata)
    return F.when(is_finite(value) & (F.abs(value - nodata) > near), value)


def crop(cells: DataFrame, meta: RasterMeta, box: dict) -> DataFrame:
    """Cells that meet a box, as literal index ranges that reach the scan."""
    r0, r1, c0, c1 = meta.window(box)
    return cells.where(F.col("row_idx").between(r0, r1) & F.col("col_idx").between(c0, c1))


def dem_mosaic(tiles: DataFrame, value: str = "elevation", order: str = "tile_order", by: tuple[str, ...] = ()) -> DataFrame:
    """Merge overlapping tiles, the first tile winning per cell. Crop before merging.

    `by` names the columns that tell rasters apart, each with an index of its own.
    """
    return tiles.groupBy(*by, "row_idx", "col_idx").agg(F.min_by(value, order).alias(value))


def landcover_mosaic(tiles: DataFrame, order: str = "tile_order") -> DataFrame:
    """As the elevation mosaic, but a valid code beats nodata whatever the order."""
    missing = F.col("code") == vocab.LAND_COVER_NODATA
    # One number to order by keeps this a hash aggregation.
    rank = F.col(order).cast("long") + F.when(missing, 1 << 40).otherwise(0)
    return tiles.groupBy("row_idx", "col_idx").agg(F.min_by("code", rank).alias("code"))


def _ends() -> Column:
    ends = {
        f"{end}_{axis}": of(f"{axis}_idx")
        for end, of in (("first", F.min), ("last", F.max)) for axis in ("row", "col")
    }
    return F.struct(*[v.alias(k) for k, v in ends.items()])


def extent(cells: DataFrame) -> Column:
    """First and last row and column of a cell table: one scan, one row, one value."""
    return cells.agg(_ends()).scalar()


def extents(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The same of every raster in a cell table: one row per raster, in column `extent`."""
    return cells.groupBy(*by).agg(_ends().alias("extent"))


def neighbourhood(cells: DataFrame, value: str = "elevation", block: int = BLOCK,
                  nodata: float = vocab.NODATA, by: tuple[str, ...] = ()) -> DataFrame:
    """Each cell with its 3x3 values nw..se; the raster's own border replicates.

    The border is the first and last row and column of the table. Beyond it a cell
    repeats its neighbour; any other absent cell is a gap, and its value null. So the
    result does not depend on `block`. Cells are cut into square blocks and only block
    borders are copied to the next block, so one shuffle by block serves both window
    passes and no group exceeds (block+2)^2 cells. `complete` is false when any of the
    nine is nodata or absent. `by` names the columns that tell rasters apart: each then
    has its own border, and all of them share the one shuffle.
    """

    def homes(c):
        # The blocks that need this cell: its own, and a neighbour's if on the border.
        own = F.floor(F.col(c) / block)
        near = F.floor((F.col(c) - 1) / block)
        far = F.floor((F.col(c) + 1) / block)
        return F.array_distinct(F.array(own, near, far))

    masked = cells.select(*by, "row_idx", "col_idx", mask_nodata(value, nodata).alias("z"))
    if by:  # one row per raster
        masked, border = masked.join(extents(cells, by), list(by)), F.col("extent")
        by = (*by, "extent")
    else:
        border = extent(cells)
    blocked = (
        masked.withColumn("_br", F.explode(homes("row_idx")))
        .withColumn("_bc", F.explode(homes("col_idx")))
        .repartition(*by[:-1], "_br", "_bc")
    )
    in_row = Window.partitionBy(*by[:-1], "_br", "_bc", "row_idx").orderBy("col_idx")
    here = F.struct(F.col("col_idx").alias("i"), F.col("z").alias("z"))
    step = blocked.withColumns({
        "_w": F.lag(here).over(in_row), "_e": F.lead(here).over(in_row)
    })

    def beside(neighbour, edge, offset):
        # The border replicates, a gap stays absent.
        found = F.col(f"{neighbour}.i") == F.col("col_idx") + offset
        return F.when(F.col("col_idx") == border[edge], F.col("z")).when(found, F.col(f"{neighbour}.z"))

    band = step.select(
        *by, "_br", "_bc", "row_idx", "col_idx", "z",
        F.struct(
            F.col("row_idx").alias("i"),
            beside("_w", "first_col", -1).alias("w"),
            F.col("z").alias("c"),
            beside("_e", "last_col", 1).alias("e"),
        ).alias("band"),
    )
    in_col = Window.partitionBy(*by[:-1], "_br", "_bc", "col_idx").orderBy("row_idx")
    nine = band.withColumns({
        "_n": F.lag("band").over(in_col), "_s": F.lead("band").over(in_col)
    })

    def above_below(neighbour, edge, offset, part):
        found = F.col(f"{neighbour}.i") == F.col("row_idx") + offset
        return F.when(F.col("row_idx") == border[edge], F.col(f"band.{part}")).when(
            found, F.col(f"{neighbour}.{part}")
        )

    own_block = (F.col("_br") == F.floor(F.col("row_idx") / block)) & (
        F.col("_bc") == F.floor(F.col("col_idx") / block)
    )
    out = nine.where(own_block).select(
        *by[:-1], "row_idx", "col_idx", F.col("z").alias(value),
        *[above_below("_n", "first_row", -1, p).alias(f"n{p}") for p in "wce"],
        *[F.col(f"band.{p}").alias(f"c{p}") for p in "wce"],
        *[above_below("_s", "last_row", 1, p).alias(f"s{p}") for p in "wce"],
    )
    complete = F.lit(True)
    for name in NINE:
        complete = complete & F.col(name).isNotNull()
    return out.withColumn("complete", complete)


NINE = [f"{r}{c}" for r in "ncs" for c in "wce"]


def with_gradients(nine: DataFrame, cell_size) -> DataFrame:
    """Horn's dz/dx and dz/dy per metre; null unless the neighbourhood is complete."""
    if not isinstance(cell_size, Column):
        cell_size = F.lit(require_cell_size(cell_size))
    east = F.col("ne") + 2 * F.col("ce") + F.col("se")
    west = F.col("nw") + 2 * F.col("cw") + F.col("sw")
    south = F.col("sw") + 2 * F.col("sc") + F.col("se")
    north = F.col("nw") + 2 * F.col("nc") + F.col("ne")
    return nine.withColumns({
        "dz_dx": F.when(F.col("complete"), (east - west) / (8 * cell_size)),
        "dz_dy": F.when(F.col("complete"), (south - north) / (8 * cell_size)),
    })


def slope() -> Column:
    dx, dy = F.col("dz_dx"), F.col("dz_dy")
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def aspect() -> Column:
    """Clockwise from north; a flat cell is 270 by convention (no signed zeros here)."""
    dx, dy = F.col("dz_dx"), F.col("dz_dy")
    turned = F.pmod(F.lit(90.0) - F.degrees(F.atan2(dy, -dx)), F.lit(360.0))
    return F.when((dx == 0) & (dy == 0), 270.0).otherwise(turned)


def roughness() -> Column:
    values = [F.col(n) for n in NINE]
    return F.when(F.col("complete"), F.greatest(*values) - F.least(*values))


def tpi() -> Column:
    total = F.col(NINE[0])
    for n in NINE[1:]:
        total = total + F.col(n)
    return F.when(F.col("complete"), F.col("cc") - total / 9)


def terrain(cells: DataFrame, cell_size, block: int = BLOCK) -> DataFrame:
    """Elevation and its four derivatives per cell: the wide table for sampling."""
    nine = with_gradients(neighbourhood(cells, block=block), cell_size)
    return nine.select(
        "row_idx", "col_idx", "elevation", slope().alias("slope"), aspect().alias("aspect"),
        roughness().alias("roughness"), tpi().alias("tpi"),
    )


def terrain_of(cells: DataFrame, meta: RasterMeta, block: int = BLOCK) -> DataFrame:
    """Terrain with the cell size taken from the raster itself: degrees at its mean latitude."""
    rows = cells.agg(F.min("row_idx") + F.max("row_idx") + 1).scalar()
    mean_lat = F.lit(meta.north) - rows * (meta.res / 2)
    return terrain(cells, geo.mean_cell_metres(meta.res, mean_lat), block)


def raster_sample(points: DataFrame, wide: DataFrame, meta: RasterMeta,
                  names=tuple(vocab.TERRAIN_FEATURES), also: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-cell values at points from one wide cell table; all names must be usable.

    `also` names cell columns that come along as they are, usable or not.

    A point off the raster, or on a missing value, keeps its row with null values,
    status UNAVAILABLE and the reasons.
    """
    keyed = points.withColumns({"_r": meta.row("latitude"), "_c": meta.col("longitude")})
    cells = wide.select(
        F.col("row_idx").alias("_r"), F.col("col_idx").alias("_c"),
        *[mask_nodata(n, meta.nodata).alias(n) for n in names], *also, F.lit(True).alias("_hit"),
    )
    # A written raster's file may be a hundredth of its rows: its size is no reason to broadcast it.
    joined = keyed.join(cells.hint("merge"), ["_r", "_c"], "left")
    covered = F.coalesce("_hit", F.lit(False))
    why = reasons(
        (~covered, "point is outside the raster"),
        *[(covered & F.col(n).isNull(), f"{n} is nodata or not finite") for n in names],
    )
    ok = covered
    for n in names:
        ok = ok & F.col(n).isNotNull()
    out = joined.withColumns({"_ok": ok, "reasons": why})
    ok = F.col("_ok")
    return out.select(
        *points.columns,
        *[F.when(ok, F.col(n)).alias(n) for n in names], *also,
        F.when(ok, "REAL").otherwise("UNAVAILABLE").alias("status"),
        "reasons",
    )


def landcover_sample(points: DataFrame, cells: DataFrame, meta: RasterMeta) -> DataFrame:
    """Land-cover group at points: -1 and a flag for nodata, unknown and uncovered."""
    keyed = points.withColumns({"_r": meta.row("latitude"), "_c": meta.col("longitude")})
    codes = cells.select(F.col("row_idx").alias("_r"), F.col("col_idx").alias("_c"), "code")
    group = landcover.group_of("code")
    return keyed.join(codes.hint("merge"), ["_r", "_c"], "left").select(
        *points.columns,
        group.alias(vocab.LAND_COVER_FEATURE),
        (group == vocab.LAND_COVER_UNAVAILABLE).alias("land_cover_unavailable"),
    )


def group_vocabulary(spark) -> DataFrame:
    from .aoi import values_frame

    return values_frame(
        spark, "land_cover_group, label", sorted(vocab.LAND_COVER_GROUP_LABELS.items())
    )


def group_counts(grouped: DataFrame, column: str) -> DataFrame:
    """Count per land-cover group with zero groups listed; unavailable is row -1."""
    spark = grouped.sparkSession
    words = group_vocabulary(spark).unionByName(
        spark.sql(f"SELECT {vocab.LAND_COVER_UNAVAILABLE} AS land_cover_group, 'unavailable' AS label")
    )
    counts = grouped.groupBy(F.col(column).alias("land_cover_group")).agg(F.count("*").alias("n"))
    return words.join(counts, "land_cover_group", "left").select(
        "land_cover_group", "label", F.coalesce("n", F.lit(0)).alias("n")
    )


def landcover_histogram(cells: DataFrame) -> DataFrame:
    """Pixels per raw code and per group in one table; kind says which."""
    codes = cells.groupBy("code").agg(F.count("*").alias("n"))
    raw = codes.where(F.col("code").between(0, 100)).select(
        F.lit("code").alias("kind"), F.col("code").cast("int").alias("key"), "n"
    )
    summed = codes.groupBy(landcover.group_of("code").alias("land_cover_group")).agg(F.sum("n").alias("n"))
    spark = cells.sparkSession
    words = group_vocabulary(spark).select("land_cover_group").union(
        spark.sql(f"SELECT {vocab.LAND_COVER_UNAVAILABLE}")
    )
    grouped = words.join(summed, "land_cover_group", "left").select(
        F.lit("group").alias("kind"), F.col("land_cover_group").alias("key"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    return raw.unionByName(grouped)


def event_landcover(events: DataFrame, cells: DataFrame, meta: RasterMeta) -> DataFrame:
    return group_counts(landcover_sample(events, cells, meta), vocab.LAND_COVER_FEATURE)


def raster_stats(wide: DataFrame, names: list[str], nodata: float = vocab.NODATA) -> DataFrame:
    """min / max / mean over usable cells, one row per raster, in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("raster"), mask_nodata(n, nodata).cast("double").alias("v")) for n in names
    ])
    return wide.select(F.inline(pairs)).groupBy("raster").agg(
        F.min("v").alias("min_value"), F.max("v").alias("max_value"),
        F.avg("v").alias("mean_value"), F.count("v").alias("cells"),
    )


def raster_difference(a: DataFrame, b: DataFrame, name: str,
                      tolerance: float = vocab.BOUNDARY_ARTIFACT_TOLERANCE) -> DataFrame:
    """Largest absolute difference of two derivations of one raster, and its flag."""
    left = a.select("row_idx", "col_idx", F.col(name).alias("_a"))
    right = b.select("row_idx", "col_idx", F.col(name).alias("_b"))
    worst = F.max(F.abs(F.col("_a") - F.col("_b")))
    return left.join(right, ["row_idx", "col_idx"]).agg(
        worst.alias("max_abs_diff"), (worst > tolerance).alias("has_boundary_artifacts")
    )


def raster_coverage(cells: DataFrame, meta: RasterMeta, boxes: DataFrame) -> DataFrame:
    """Extent measured from the cells, and whether it holds each box within one pixel."""
    extent = cells.agg(
        F.struct(
            (F.max("row_idx") - F.min("row_idx") + 1).alias("n_rows"),
            (F.max("col_idx") - F.min("col_idx") + 1).alias("n_cols"),
            (F.lit(meta.north) - (F.max("row_idx") + 1) * meta.res).alias("south"),
            (F.lit(meta.north) - F.min("row_idx") * meta.res).alias("north"),
            (F.lit(meta.west) + F.min("col_idx") * meta.res).alias("west"),
            (F.lit(meta.west) + (F.max("col_idx") + 1) * meta.res).alias("east"),
        )
    ).scalar()
    m = boxes.withColumn("m", extent)
    inside = (
        (F.col("min_lat") >= F.col("m.south") - meta.res)
        & (F.col("max_lat") <= F.col("m.north") + meta.res)
        & (F.col("min_lon") >= F.col("m.west") - meta.res)
        & (F.col("max_lon") <= F.col("m.east") + meta.res)
    )
    return m.select(
        "state", "m.n_rows", "m.n_cols", F.lit(meta.res).alias("pixel_size_deg"),
        "m.south", "m.north", "m.west", "m.east", inside.alias("fully_covers_aoi"),
    )


def nodata_report(df: DataFrame, columns: list[str], nodata: float = vocab.NODATA) -> DataFrame:
    """Missing count per column after masking, as (feature, missing) rows."""
    counts = df.agg(*[F.count_if(mask_nodata(c, nodata).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "feature", "missing")
