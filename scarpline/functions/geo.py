"""Coordinates, boxes, tiles and raster indices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .numbers import col, is_finite, reasons

EDGES = ("min_lat", "max_lat", "min_lon", "max_lon")


def in_box(lat: Column | str, lon: Column | str, box: dict | None = None) -> Column:
    """Inclusive on all four edges. Without a box the edge columns are used."""
    edge = {e: F.lit(box[e]) if box else F.col(e) for e in EDGES}
    return F.coalesce(
        col(lat).between(edge["min_lat"], edge["max_lat"])
        & col(lon).between(edge["min_lon"], edge["max_lon"]),
        F.lit(False),
    )


def coordinate_status(lat: Column | str, lon: Column | str, guard: dict) -> Column:
    """VALID or INVALID against a region guard (a parameter, not a constant)."""
    ok = is_finite(lat) & is_finite(lon) & in_box(lat, lon, guard)
    return F.when(ok, "VALID").otherwise("INVALID")


def coordinate_reasons(lat: Column | str, lon: Column | str, guard: dict) -> Column:
    lat_ok = is_finite(lat) & col(lat).between(guard["min_lat"], guard["max_lat"])
    lon_ok = is_finite(lon) & col(lon).between(guard["min_lon"], guard["max_lon"])
    return reasons(
        (~lat_ok, f"latitude outside {guard['min_lat']:g}..{guard['max_lat']:g}"),
        (~lon_ok, f"longitude outside {guard['min_lon']:g}..{guard['max_lon']:g}"),
    )


def point_box(lat: Column | str, lon: Column | str, half_width: float = 0.05) -> Column:
    """Box of one rainfall cell around a point, clamped to the globe."""
    half = F.lit(float(half_width))
    return F.struct(
        F.greatest(F.lit(-90.0), col(lat) - half).alias("min_lat"),
        F.least(F.lit(90.0), col(lat) + half).alias("max_lat"),
        F.greatest(F.lit(-180.0), col(lon) - half).alias("min_lon"),
        F.least(F.lit(180.0), col(lon) + half).alias("max_lon"),
    )


def centroid(low: Column | str, high: Column | str) -> Column:
    return (col(low) + col(high)) / F.lit(2.0)


def require_edges() -> Column:
    """Error for a box with a missing edge, as a filterable expression."""
    missing = F.lit(False)
    for edge in EDGES:
        missing = missing | F.col(edge).isNull()
    return F.assert_true(~missing, F.lit("bounds are missing an edge")).isNull()


def cell_box(lat, lon, height, width) -> Column:
    """Rectangle around a centre; null when the size is not finite and positive."""
    usable = is_finite(height) & is_finite(width) & (col(height) > 0) & (col(width) > 0)
    return F.when(
        usable,
        F.struct(
            (col(lat) - col(height) / 2).alias("min_lat"),
            (col(lat) + col(height) / 2).alias("max_lat"),
            (col(lon) - col(width) / 2).alias("min_lon"),
            (col(lon) + col(width) / 2).alias("max_lon"),
        ),
    )


def precip_index(lat_or_lon: Column | str, offset: float, last: int) -> Column:
    """Index on the 0.1 degree rainfall grid, half-even and clamped to the grid."""
    raw = F.rint((col(lat_or_lon) + F.lit(offset)) * 10.0)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(last))).cast("int")


def precip_indices() -> list[Column]:
    """The four index columns for a frame that carries box edge columns."""
    return [
        precip_index("min_lat", 89.95, 1799).alias("lat_lo"),
        precip_index("max_lat", 89.95, 1799).alias("lat_hi"),
        precip_index("min_lon", 179.95, 3599).alias("lon_lo"),
        precip_index("max_lon", 179.95, 3599).alias("lon_hi"),
    ]


def floor_to(c: Column | str, step: int) -> Column:
    """Largest multiple of step at or below the value."""
    return (F.floor(col(c) / step) * step).cast("int")


def tile_name(lat_sw: Column | str, lon_sw: Column | str) -> Column:
    """South-west corner as N24E090 / S03W012."""
    lat, lon = col(lat_sw).cast("int"), col(lon_sw).cast("int")
    return F.format_string(
        "%s%02d%s%03d",
        F.when(lat >= 0, "N").otherwise("S"), F.abs(lat),
        F.when(lon >= 0, "E").otherwise("W"), F.abs(lon),
    )


def box_within(outer: str, inner: str, tol: float = 1e-9) -> Column:
    """Struct columns: is inner inside outer, edges allowed within tol."""
    return (
        (F.col(f"{inner}.min_lat") >= F.col(f"{outer}.min_lat") - tol)
        & (F.col(f"{inner}.max_lat") <= F.col(f"{outer}.max_lat") + tol)
        & (F.col(f"{inner}.min_lon") >= F.col(f"{outer}.min_lon") - tol)
        & (F.col(f"{inner}.max_lon") <= F.col(f"{outer}.max_lon") + tol)
    )


def edges_that_differ(a: str, b: str, tol: float = 1e-9) -> Column:
    return reasons(
        *[(F.abs(F.col(f"{a}.{e}") - F.col(f"{b}.{e}")) > tol, e) for e in EDGES]
    )


def box_struct() -> Column:
    return F.struct(*[F.col(e) for e in EDGES])


def segment_meets_box(x1, y1, x2, y2) -> Column:
    """Does the segment (or point, when both ends agree) touch the edge columns' box?

    Clips the segment parameter t in [0, 1] against each slab in turn.
    """
    def slab(start, end, low, high):
        delta = end - start
        ta = F.try_divide(low - start, delta)
        tb = F.try_divide(high - start, delta)
        inside = start.between(low, high)
        enter = F.when(delta == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0)))
        leave = F.when(delta == 0, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0)))
        return (
            enter.otherwise(F.least(ta, tb)),
            leave.otherwise(F.greatest(ta, tb)),
        )

    x_in, x_out = slab(col(x1), col(x2), F.col("min_lon"), F.col("max_lon"))
    y_in, y_out = slab(col(y1), col(y2), F.col("min_lat"), F.col("max_lat"))
    return F.greatest(x_in, y_in, F.lit(0.0)) <= F.least(x_out, y_out, F.lit(1.0))


def mean_cell_metres(res_deg: float | Column, mean_lat: Column) -> Column:
    """Ground size of a raster cell at a mean latitude."""
    side = F.abs(res_deg) * vocab.METRES_PER_DEGREE if isinstance(res_deg, Column) else F.lit(abs(res_deg) * vocab.METRES_PER_DEGREE)
    return side * F.cos(F.radians(mean_lat))
