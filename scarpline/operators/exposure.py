"""Infrastructure assets inside high-hazard cells, without a geometry engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import geo
from ..session import through_table


def segments(assets: DataFrame, coords: str = "coords") -> DataFrame:
    """One row per segment; a point is a segment whose ends agree."""
    c = F.col(coords)
    n = F.size(c)
    pairs = F.when(
        n == 1, F.array(F.struct(c[0].alias("a"), c[0].alias("b")))
    ).when(
        n > 1,
        F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1),
                   lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
    )
    keep = [x for x in assets.columns if x != coords]
    return assets.withColumn("_s", F.explode(pairs)).select(
        *keep,
        F.col("_s.a.lon").alias("lon1"), F.col("_s.a.lat").alias("lat1"),
        F.col("_s.b.lon").alias("lon2"), F.col("_s.b.lat").alias("lat2"),
    )


#: A bucket with more segments than this is cut into four, at most so often.
CROWD, DEPTH = 20_000, 8


def _cells_met(low: Column, high: Column, side: float) -> Column:
    return F.sequence(F.floor(low / side), F.floor(high / side))


def crowded_buckets(parts: DataFrame, bucket_deg: float, crowd: int, depth: int) -> DataFrame:
    """(level, _by, _bx) of the buckets to be cut: those in which too many segments begin.

    Counted once in the finest buckets, with map-side combine, and added up level by level;
    there are at most depth x segments / crowd such buckets, whatever the map looks like.
    """
    fine = bucket_deg / (1 << depth)
    counts = parts.groupBy(F.floor(F.col("lat1") / fine).alias("y"), F.floor(F.col("lon1") / fine).alias("x")).agg(F.count("*").alias("n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")
    up = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(depth) - F.col("level"))
    each = counts.select("n", "x", "y", levels).select(
        "level", F.floor(F.col("y") / up).alias("_by"), F.floor(F.col("x") / up).alias("_bx"), "n"
    )
    return each.groupBy("level", "_by", "_bx").agg(F.sum("n").alias("_n")).where(F.col("_n") > crowd).drop("_n")


def _to_leaves(rows: DataFrame, crowded: DataFrame, bucket_deg: float, depth: int, meets) -> DataFrame:
    """Rows keyed by bucket of level 0 -> by the quadtree's leaves: (level, _by, _bx).

    meets(side) tells whether a row really meets the bucket in its columns; a row moves from a
    cut bucket to those of its four parts that it meets.
    """
    out, rest = None, rows.withColumn("level", F.lit(0))
    rest = through_table(rest, "bucketed") if depth else rest
    marked = crowded.withColumn("_cut", F.lit(True))
    for level in range(depth):
        side = bucket_deg / (1 << (level + 1))
        known = rest.join(marked, ["level", "_by", "_bx"], "left")
        done = known.where(F.col("_cut").isNull()).drop("_cut")
        out = done if out is None else out.unionByName(done)
        parts = known.where("_cut").drop("_cut").withColumn("_y", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_x", F.explode(F.array(F.lit(0), F.lit(1))))
        parts = parts.withColumns({"level": F.lit(level + 1), "_by": F.col("_by") * 2 + F.col("_y"), "_bx": F.col("_bx") * 2 + F.col("_x")}).drop("_x", "_y")
        rest = meets(parts, side)
    return rest if out is None else out.unionByName(rest)


#: Keeps a bucket whose edge was rounded; the exact test comes after.
MARGIN = 1e-9


def _bucket_edges(side: float) -> dict[str, Column]:
    return {
        "min_lat": F.col("_by") * side - MARGIN, "max_lat": (F.col("_by") + 1) * side + MARGIN,
        "min_lon": F.col("_bx") * side - MARGIN, "max_lon": (F.col("_bx") + 1) * side + MARGIN,
    }


def _segment_meets(rows: DataFrame, side: float) -> DataFrame:
    edges = _bucket_edges(side)
    return rows.withColumns(edges).where(geo.segment_meets_box("lon1", "lat1", "lon2", "lat2")).drop(*edges)


def _cell_meets(rows: DataFrame, side: float) -> DataFrame:
    e = _bucket_edges(side)
    return rows.where(
        (F.col("min_lat") <= e["max_lat"]) & (F.col("max_lat") >= e["min_lat"])
        & (F.col("min_lon") <= e["max_lon"]) & (F.col("max_lon") >= e["min_lon"])
    )


def exposure_join_adaptive(
    cells: DataFrame, parts: DataFrame, bucket_deg: float = 0.1, crowd: int = CROWD, depth: int = DEPTH,
    threshold: float = vocab.HAZARD_EXPOSURE_THRESHOLD,
) -> DataFrame:
    """The pairs of `exposure_join`, with buckets that follow the map's density.

    A bucket in which more than `crowd` segments begin is cut into four, again and again at
    most `depth` times, so a city is many small buckets and open country few large ones. Both
    sides are keyed by the leaves of that quadtree, and a bucket's pairs stay near its segments
    times the few cells over it. Segments and cells as tables: they are read once per level.
    """
    crowded = through_table(crowded_buckets(parts, bucket_deg, crowd, depth), "crowded")
    deepest = crowded.agg(F.max("level")).first()[0]  # no level without a cut is looked at
    depth = 0 if deepest is None else deepest + 1
    touching = geo.segment_meets_box("lon1", "lat1", "lon2", "lat2")

    hot = _hot_buckets(cells, bucket_deg, threshold)
    keyed = _segment_buckets(parts, bucket_deg)
    left = _to_leaves(keyed, crowded, bucket_deg, depth, _segment_meets)
    right = _to_leaves(hot, crowded, bucket_deg, depth, _cell_meets)
    # Merged even where the cells are few: a small file of segments is few tasks, and each would join
    # all that its segments became on the way down. By leaf they are dealt out evenly.
    left = left.hint("merge")
    return (
        left.join(right, ["level", "_by", "_bx"]).where(touching)
        .select("osm_id", "asset_name", "asset_type", "state", "cell_id", "hazard")
        .distinct()
    )


def _hot_buckets(cells: DataFrame, bucket_deg: float, threshold: float) -> DataFrame:
    """Cells above the hazard threshold, once per bucket they meet."""
    return (
        cells.where(F.col("hazard") > threshold)
        .withColumn("_by", F.explode(_cells_met(F.col("min_lat"), F.col("max_lat"), bucket_deg)))
        .withColumn("_bx", F.explode(_cells_met(F.col("min_lon"), F.col("max_lon"), bucket_deg)))
    )


def _segment_buckets(parts: DataFrame, bucket_deg: float) -> DataFrame:
    """Segments once per bucket they cross."""
    spread = lambda low, high: F.explode(_cells_met(low, high, bucket_deg))
    # Rows of buckets first, then in each row only the span of longitudes the segment has
    # there: a long diagonal gets as many buckets as it crosses, not its bounding box.
    rows = parts.withColumn("_by", spread(F.least("lat1", "lat2"), F.greatest("lat1", "lat2")))
    slope = F.coalesce(F.try_divide(F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")), F.lit(0.0))
    at = lambda lat: F.col("lon1") + (lat - F.col("lat1")) * slope
    south = at(F.greatest(F.col("_by") * bucket_deg - MARGIN, F.least("lat1", "lat2")))
    north = at(F.least((F.col("_by") + 1) * bucket_deg + MARGIN, F.greatest("lat1", "lat2")))
    flat = F.col("lat1") == F.col("lat2")
    west = F.when(flat, F.least("lon1", "lon2")).otherwise(F.least(south, north)) - MARGIN
    east = F.when(flat, F.greatest("lon1", "lon2")).otherwise(F.greatest(south, north)) + MARGIN
    keyed = rows.withColumn("_bx", spread(west, east))
    return _segment_meets(keyed, bucket_deg)


def exposure_join(
    cells: DataFrame, parts: DataFrame, bucket_deg: float = 0.1,
    threshold: float = vocab.HAZARD_EXPOSURE_THRESHOLD,
) -> DataFrame:
    """(asset, cell) pairs where an asset touches a cell with hazard above threshold.

    cells: state, cell_id, hazard and edge columns; parts: osm_id and segment ends.
    Both sides are keyed by grid bucket, so it is an equi-join with the exact clipping
    test left over. A cell covers few buckets; a hot bucket of assets is split by
    adaptive execution because only the small side must be whole.
    """
    touching = geo.segment_meets_box("lon1", "lat1", "lon2", "lat2")
    keyed, hot = _segment_buckets(parts, bucket_deg), _hot_buckets(cells, bucket_deg, threshold)
    # A long asset meets a cell through several buckets and segments: one row remains.
    return (
        keyed.join(hot, ["_by", "_bx"]).where(touching)
        .select("osm_id", "asset_name", "asset_type", "state", "cell_id", "hazard")
        .distinct()
    )
