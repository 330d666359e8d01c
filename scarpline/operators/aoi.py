"""Area-of-interest dimension and the joins that assign points and boxes to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import geo
from ..functions.numbers import col, reasons


def values_frame(spark: SparkSession, columns: str, rows) -> DataFrame:
    """A small constant table Spark knows the size of (so it can broadcast it)."""
    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return repr(v) + "D"
        return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def aoi_dimension(spark: SparkSession) -> DataFrame:
    """Administrative and pilot boxes as 12 rows; never to be confused by kind."""
    rows = [
        (s, "admin", a, b, c, d, s == vocab.PILOT_FLAGGED_STATE)
        for s, a, b, c, d in vocab.ADMIN_BOXES
    ] + [(s, "pilot", a, b, c, d, True) for s, a, b, c, d in vocab.PILOT_BOXES]
    return values_frame(
        spark, "state, kind, min_lat, max_lat, min_lon, max_lon, is_pilot", rows
    )


def state_id(c) -> F.Column:
    return F.regexp_replace(F.lower(F.trim(col(c))), r"\s+", "_")


def tile_cover(boxes: DataFrame, step: int = 1, centre_only: bool = False) -> DataFrame:
    """One row per box and tile; floor-inclusive on the far edges.

    centre_only keeps the tiles of the 2x2 block around the centre, or the centre
    tile itself when the block misses the cover.
    """
    lat = F.sequence(geo.floor_to("min_lat", step), geo.floor_to("max_lat", step), F.lit(step))
    lon = F.sequence(geo.floor_to("min_lon", step), geo.floor_to("max_lon", step), F.lit(step))
    tiles = boxes.withColumn("tile_lat", F.explode(lat)).withColumn("tile_lon", F.explode(lon))
    if not centre_only:
        return tiles
    c_lat = F.floor(geo.centroid("min_lat", "max_lat")).cast("int")
    c_lon = F.floor(geo.centroid("min_lon", "max_lon")).cast("int")
    # The centre lies inside its own box, so its tile is always part of the cover.
    return tiles.where(
        F.col("tile_lat").between(c_lat, c_lat + 1) & F.col("tile_lon").between(c_lon, c_lon + 1)
    )


def match_boxes(points: DataFrame, boxes: DataFrame, how: str = "left") -> DataFrame:
    """Points against boxes as an equi-join on one-degree tiles plus the exact test.

    No nested loop at any size of either side; a hot tile on the point side is
    split by adaptive execution, and a small box table is broadcast by its size.
    """
    tiles = tile_cover(boxes)
    keyed = points.withColumns({
        "tile_lat": F.floor("latitude").cast("int"),
        "tile_lon": F.floor("longitude").cast("int"),
    })
    p, b = keyed.alias("p"), tiles.alias("b")
    inside = (
        (F.col("p.tile_lat") == F.col("b.tile_lat"))
        & (F.col("p.tile_lon") == F.col("b.tile_lon"))
        & F.col("p.latitude").between(F.col("b.min_lat"), F.col("b.max_lat"))
        & F.col("p.longitude").between(F.col("b.min_lon"), F.col("b.max_lon"))
    )
    return p.join(b, inside, how).select(
        *[F.col(f"p.{c}") for c in points.columns],
        *[F.col(f"b.{c}") for c in boxes.columns if c not in points.columns],
    )


def pilot_boxes(aoi: DataFrame) -> DataFrame:
    return aoi.where("kind = 'pilot'").drop("kind", "is_pilot")


def admin_boxes(aoi: DataFrame) -> DataFrame:
    return aoi.where("kind = 'admin'").drop("kind")


def with_candidates(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with the sorted states whose box contains them, one row per point.

    The boxes of a tile travel as one small array, so each point meets one row and the
    containment test runs in place: no growth of the points and no shuffle to fold them
    back. The array is bounded by the boxes that overlap a one-degree tile.
    """
    packed = tile_cover(boxes.select("state", *geo.EDGES)).groupBy("tile_lat", "tile_lon").agg(
        F.collect_list(F.struct("state", *geo.EDGES)).alias("_boxes")
    )
    keyed = points.withColumns({
        "tile_lat": F.floor("latitude").cast("int"), "tile_lon": F.floor("longitude").cast("int"),
    })
    def holds(b):
        return F.col("latitude").between(b["min_lat"], b["max_lat"]) & F.col("longitude").between(
            b["min_lon"], b["max_lon"]
        )
    names = F.transform(F.filter("_boxes", holds), lambda b: b["state"])
    found = F.coalesce(F.array_sort(F.array_distinct(names)), F.array().cast("array<string>"))
    return keyed.join(packed, ["tile_lat", "tile_lon"], "left").select(
        *points.columns, found.alias("candidates")
    )


def point_in_aoi(
    points: DataFrame, boxes: DataFrame, aliases: DataFrame, key: str,
    requested: str | None = None,
) -> DataFrame:
    """Resolve every point to one state, OUTSIDE, AMBIGUOUS or INVALID.

    Overlapping boxes are never resolved silently; a requested state must exist and
    contain the point.
    """
    keep = [key, "latitude", "longitude"] + ([requested] if requested else [])
    hits = with_candidates(points.select(keep), boxes)
    if requested:
        asked = F.regexp_replace(F.lower(F.trim(F.col(requested))), "-", " ")
        hits = hits.withColumn("alias", F.nullif(asked, F.lit(""))).join(
            aliases, "alias", "left"
        )
    else:
        hits = hits.withColumns({
            "alias": F.lit(None).cast("string"), "resolved": F.lit(None).cast("string")
        })
    named = F.col("alias").isNotNull()
    contains = F.coalesce(F.array_contains("candidates", F.col("resolved")), F.lit(False))
    n = F.size("candidates")
    status = (
        F.when(named & F.col("resolved").isNull(), "INVALID")
        .when(named & ~contains, "INVALID")
        .when(named, "RESOLVED")
        .when(n == 0, "OUTSIDE")
        .when(n == 1, "RESOLVED")
        .otherwise("AMBIGUOUS")
    )
    why = reasons(
        (named & F.col("resolved").isNull(), "unknown state"),
        (named & F.col("resolved").isNotNull() & ~contains, "point lies outside the named state's box"),
        (~named & (n == 0), "no box contains the point"),
        (~named & (n > 1), "several boxes contain the point; name a state"),
    )
    return hits.select(
        *keep,
        status.alias("status"),
        F.when(
            status == "RESOLVED",
            F.when(named, F.col("resolved")).otherwise(F.try_element_at("candidates", F.lit(1))),
        ).alias("state"),
        "candidates",
        why.alias("reasons"),
    )


def aoi_consistency(outer: DataFrame, inner: DataFrame, key: str = "state") -> DataFrame:
    """Is each inner box within its outer one, are they the same, which edges differ."""
    o = outer.select(key, geo.box_struct().alias("outer_box"))
    i = inner.select(key, geo.box_struct().alias("inner_box"))
    differing = geo.edges_that_differ("outer_box", "inner_box")
    return i.join(o, key).select(
        key,
        geo.box_within("outer_box", "inner_box").alias("within"),
        (F.size(differing) == 0).alias("identical"),
        differing.alias("differing_keys"),
    )


def state_for_bounds(bounds: DataFrame, boxes: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Label a box with the state whose box it equals, else UNMATCHED_PILOT_AOI.

    The equi-key is each edge on a grid far coarser than the tolerance; a box edge
    sits on both neighbouring grid lines, so a match across a line is not lost.
    """
    scale = 1e3
    def keys(edge):
        low = F.floor((F.col(edge) - tol) * scale + 0.5)
        high = F.floor((F.col(edge) + tol) * scale + 0.5)
        return F.array_distinct(F.array(low, high))

    keyed = boxes.select("state", *geo.EDGES, *[keys(e).alias(f"_k_{e}") for e in geo.EDGES])
    for e in geo.EDGES:
        keyed = keyed.withColumn(f"_k_{e}", F.explode(f"_k_{e}"))
    names = [f"_k_{e}" for e in geo.EDGES]
    # Boxes that agree on all four keys: as good as identical, so a handful at most.
    packed = keyed.groupBy(names).agg(F.collect_list(F.struct("state", *geo.EDGES)).alias("_boxes"))

    def same(b):
        equal = F.lit(True)
        for e in geo.EDGES:
            equal = equal & (F.abs(F.col(e) - b[e]) <= tol)
        return equal

    q = bounds.withColumns({f"_k_{e}": F.floor(F.col(e) * scale + 0.5) for e in geo.EDGES})
    state = F.array_min(F.transform(F.filter("_boxes", same), lambda b: b["state"]))
    return q.join(packed, names, "left").select(
        *bounds.columns, F.coalesce(state, F.lit(vocab.UNMATCHED_AOI)).alias("state")
    )


def grid_build(
    boxes: DataFrame, step: float = 0.05, max_cells: int | None = None, bounds: tuple[float, float] = (0.02, 0.25),
) -> DataFrame:
    """Tile every box into near-square cells; centres lie strictly inside.

    A step outside `bounds` or more than max_cells per box stops the job; without
    max_cells there is no limit.
    """
    if not bounds[0] <= step <= bounds[1]:
        raise ValueError(f"step {step} is outside {bounds[0]}..{bounds[1]} degrees")
    span_lat, span_lon = F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon")
    n = lambda span: F.greatest(F.rint(span / step), F.lit(1.0)).cast("int")
    sized = boxes.withColumns({"n_lat": n(span_lat), "n_lon": n(span_lon)})
    if max_cells is not None:
        sized = sized.where(
            F.assert_true(
                F.col("n_lat") * F.col("n_lon") <= max_cells,
                F.lit(f"grid exceeds {max_cells} cells; use a coarser step"),
            ).isNull()
        )
    sized = sized.withColumns({
        "cell_height_deg": span_lat / F.col("n_lat"),
        "cell_width_deg": span_lon / F.col("n_lon"),
    })
    cells = sized.withColumn(
        "row", F.explode(F.sequence(F.lit(0), F.col("n_lat") - 1))
    ).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_lon") - 1)))
    low_lat = F.col("min_lat") + F.col("row") * F.col("cell_height_deg")
    low_lon = F.col("min_lon") + F.col("col") * F.col("cell_width_deg")
    r6 = lambda c: F.rint(c * 1e6) / 1e6
    return cells.select(
        "state",
        F.format_string("r%02dc%02d", "row", "col").alias("cell_id"),
        "row", "col",
        r6(low_lat + F.col("cell_height_deg") * 0.5).alias("latitude"),
        r6(low_lon + F.col("cell_width_deg") * 0.5).alias("longitude"),
        F.struct(
            r6(low_lat).alias("min_lat"),
            r6(low_lat + F.col("cell_height_deg")).alias("max_lat"),
            r6(low_lon).alias("min_lon"),
            r6(low_lon + F.col("cell_width_deg")).alias("max_lon"),
        ).alias("bbox"),
        "cell_height_deg", "cell_width_deg",
    )
