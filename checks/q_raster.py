"""Mosaics, neighbourhoods, sampling, land cover."""

from pyspark.sql import functions as F

from scarpline import vocab
from scarpline.operators import matrix, raster

from .fixtures import CELL_METRES, META, SIKKIM, oracle, rnd
from .registry import query

RC = 'row_idx, col_idx'
TILES = """
SELECT row_idx, col_idx, elevation, 1 AS tile_order FROM {dem} WHERE col_idx <= 30
UNION ALL SELECT row_idx, col_idx, elevation + 1e0, 2 FROM {dem} WHERE col_idx >= 20 AND col_idx <= 45
UNION ALL SELECT row_idx, col_idx, elevation + 2e0, 3 FROM {dem} WHERE col_idx >= 40"""


@query("dem_mosaic", oracle("""
SELECT row_idx, col_idx, elevation FROM (SELECT *, row_number() OVER (PARTITION BY row_idx, col_idx ORDER BY tile_order) AS rn FROM tiles) WHERE rn = 1 AND row_idx <= 54 AND col_idx <= 44""", "fx_dem", tiles=TILES.format(dem="fx_dem")))
def dem_mosaic(fx):
    return raster.dem_mosaic(raster.crop(fx.sql(TILES, dem=fx.dem), META, SIKKIM))


COVER_TILES = """
SELECT row_idx, col_idx, code, 1 AS tile_order FROM {lc} WHERE col_idx <= 30
UNION ALL SELECT row_idx, col_idx, CASE WHEN code = 0 THEN 50 WHEN code = 50 THEN 0 ELSE code END, 2 FROM {lc} WHERE col_idx >= 20"""


@query("landcover_mosaic", oracle("""
SELECT row_idx, col_idx, code FROM (SELECT *, row_number() OVER (PARTITION BY row_idx, col_idx ORDER BY code = 0, tile_order) AS rn FROM tiles) WHERE rn = 1""", "fx_landcover", tiles=COVER_TILES.format(lc="fx_landcover")))
def landcover_mosaic(fx):
    return raster.landcover_mosaic(fx.sql(COVER_TILES, lc=fx.landcover))


# Brute-force neighbourhood: border cells repeat themselves; nodata and absent cells, at the borders,
# at the corners of blocks and inside, spoil the stencil.
HOLED = """
SELECT row_idx, col_idx, CASE WHEN row_idx = 3 AND col_idx = 17 THEN -9999e0 WHEN row_idx = 2 AND col_idx = 30 THEN CAST('NaN' AS DOUBLE)
 WHEN col_idx BETWEEN 5 AND 9 THEN 500e0 ELSE elevation END AS elevation FROM {dem}
WHERE NOT (row_idx = 0 AND col_idx = 0) AND NOT (row_idx = 0 AND col_idx = 12) AND NOT (row_idx = 5 AND col_idx = 8) AND NOT (row_idx = 10 AND col_idx = 16)
 AND NOT (row_idx = 15 AND col_idx IN (15, 31)) AND NOT (row_idx = 16 AND col_idx = 16)"""


def _nine_sql():
    picks, joins = [], []
    for dr, r in ((-1, "n"), (0, "c"), (1, "s")):
        for dc, c in ((-1, "w"), (0, "c"), (1, "e")):
            t = f"{r}{c}"
            joins.append(f"LEFT JOIN z {t} ON {t}.row_idx = least(greatest(z.row_idx + {dr}, 0), m.mr) AND {t}.col_idx = least(greatest(z.col_idx + {dc}, 0), m.mc)")
            picks.append(f"{t}.elevation AS {t}")
    return (f"SELECT z.row_idx, z.col_idx, z.elevation, {', '.join(picks)} FROM z CROSS JOIN (SELECT max(row_idx) AS mr, max(col_idx) AS mc FROM z) m " + " ".join(joins))


NINE_NAMES = [f"{r}{c}" for r in "ncs" for c in "wce"]
FULL = " AND ".join(f"{n} IS NOT NULL" for n in NINE_NAMES)
GRADIENTS = f"""
SELECT *, CASE WHEN {FULL} THEN ((ne + 2 * ce + se) - (nw + 2 * cw + sw)) / (8 * {CELL_METRES}e0) END AS dz_dx, CASE WHEN {FULL} THEN ((sw + 2 * sc + se) - (nw + 2 * nc + ne)) / (8 * {CELL_METRES}e0) END AS dz_dy FROM nine"""
Z = "SELECT row_idx, col_idx, CASE WHEN elevation = -9999 OR isnan(elevation) THEN NULL ELSE elevation END AS elevation FROM h"


def grad_oracle(body):
    return oracle(body, "fx_dem", h=HOLED.format(dem="fx_dem"), z=Z, nine=_nine_sql(), g=GRADIENTS)


def gradients(fx):
    holed = fx.sql(HOLED, dem=fx.dem)
    return raster.with_gradients(raster.neighbourhood(holed, block=16), CELL_METRES)


@query("horn_gradients", grad_oracle(f"SELECT {RC}, dz_dx, dz_dy FROM g"))
def horn_gradients(fx):
    return gradients(fx).select("row_idx", "col_idx", "dz_dx", "dz_dy")


SLOPE = rnd("degrees(atan(sqrt(dz_dx * dz_dx + dz_dy * dz_dy)))", 6)
ASPECT = rnd("CASE WHEN dz_dx = 0 AND dz_dy = 0 THEN 270e0 ELSE ((90e0 - degrees(atan2(dz_dy, -dz_dx))) % 360e0 + 360e0) % 360e0 END", 6)
ROUGH = f"CASE WHEN {FULL} THEN greatest({', '.join(NINE_NAMES)}) - least({', '.join(NINE_NAMES)}) END"
TPI = rnd(f"CASE WHEN {FULL} THEN cc - ({' + '.join(NINE_NAMES)}) / 9 END", 6)
r6 = lambda c: F.rint(c * 1e6) / 1e6


@query("slope", grad_oracle(f"SELECT {RC}, {SLOPE} AS slope FROM g"))
def slope(fx):
    return gradients(fx).select("row_idx", "col_idx", r6(raster.slope()).alias("slope"))


@query("aspect", grad_oracle(f"SELECT {RC}, {ASPECT} AS aspect FROM g"))
def aspect(fx):
    return gradients(fx).select("row_idx", "col_idx", r6(raster.aspect()).alias("aspect"))


@query("roughness", grad_oracle(f"SELECT {RC}, {ROUGH} AS roughness FROM g"))
def roughness(fx):
    return gradients(fx).select("row_idx", "col_idx", raster.roughness().alias("roughness"))


@query("tpi", grad_oracle(f"SELECT {RC}, {TPI} AS tpi FROM g"))
def tpi(fx):
    return gradients(fx).select("row_idx", "col_idx", r6(raster.tpi()).alias("tpi"))


TERRAIN = f"SELECT {RC}, elevation, {SLOPE} AS slope, {ASPECT} AS aspect, {ROUGH} AS roughness, {TPI} AS tpi FROM g"


def terrain_ctes(dem="SELECT * FROM fx_dem"):
    """Plain-SQL terrain table `t` over a DEM."""
    return {"h": dem, "z": Z, "nine": _nine_sql(), "g": GRADIENTS, "t": TERRAIN}


def terrain(fx, dem=None):
    wide = raster.terrain(fx.dem if dem is None else dem, CELL_METRES)
    return wide.withColumns({n: r6(F.col(n)) for n in ("slope", "aspect", "tpi")})


SAMPLE_ROW = "CAST(floor((28.1e0 - latitude) / 0.02e0) AS INT)"
SAMPLE_COL = "CAST(floor((longitude - 88e0) / 0.02e0) AS INT)"


@query("raster_sample", oracle("""
SELECT e.event_id, CASE WHEN ok THEN t.elevation END AS elevation, CASE WHEN ok THEN t.slope END AS slope, CASE WHEN ok THEN t.aspect END AS aspect, CASE WHEN ok THEN t.roughness END AS roughness, CASE WHEN ok THEN t.tpi END AS tpi,
 CASE WHEN ok THEN 'REAL' ELSE 'UNAVAILABLE' END AS status,
 CASE WHEN t.row_idx IS NULL THEN 'point is outside the raster' ELSE concat_ws('; ', CASE WHEN t.elevation IS NULL THEN 'elevation is nodata or not finite' END, CASE WHEN t.slope IS NULL THEN 'slope is nodata or not finite' END,
  CASE WHEN t.aspect IS NULL THEN 'aspect is nodata or not finite' END, CASE WHEN t.roughness IS NULL THEN 'roughness is nodata or not finite' END, CASE WHEN t.tpi IS NULL THEN 'tpi is nodata or not finite' END) END AS reasons
FROM (SELECT event_id, %s AS r, %s AS c FROM fx_events) e LEFT JOIN (SELECT *, elevation IS NOT NULL AND slope IS NOT NULL AND aspect IS NOT NULL AND roughness IS NOT NULL AND tpi IS NOT NULL AS ok FROM t) t ON t.row_idx = e.r AND t.col_idx = e.c""" % (SAMPLE_ROW, SAMPLE_COL),
    "fx_events", "fx_dem", **terrain_ctes(HOLED.format(dem="fx_dem"))))
def raster_sample(fx):
    wide = terrain(fx, fx.sql(HOLED, dem=fx.dem))
    points = fx.events.select("event_id", "latitude", "longitude")
    return raster.raster_sample(points, wide, META).drop("latitude", "longitude")


GROUP = "CASE code WHEN 10 THEN 1 WHEN 20 THEN 2 WHEN 30 THEN 2 WHEN 40 THEN 3 WHEN 50 THEN 4 WHEN 60 THEN 5 WHEN 70 THEN 5 WHEN 80 THEN 6 WHEN 90 THEN 6 WHEN 95 THEN 6 WHEN 100 THEN 2 ELSE -1 END"
EVENT_GROUP = f"""
SELECT e.event_id, {GROUP} AS land_cover_class FROM fx_events e LEFT JOIN fx_landcover l ON l.row_idx = {SAMPLE_ROW} AND l.col_idx = {SAMPLE_COL}"""


@query("landcover_sample", oracle("SELECT *, land_cover_class = -1 AS land_cover_unavailable FROM eg", "fx_events", "fx_landcover", eg=EVENT_GROUP))
def landcover_sample(fx):
    points = fx.events.select("event_id", "latitude", "longitude")
    return raster.landcover_sample(points, fx.landcover, META).drop("latitude", "longitude")


VOCAB = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in vocab.LAND_COVER_GROUP_LABELS.items()) + ", (-1, 'unavailable')) AS t(land_cover_group, label)"


@query("landcover_histogram", oracle(f"""
SELECT 'code' AS kind, code AS key, count(*) AS n FROM fx_landcover WHERE code BETWEEN 0 AND 100 GROUP BY code
UNION ALL SELECT 'group', v.land_cover_group, count(l.code) FROM v LEFT JOIN fx_landcover l ON {GROUP} = v.land_cover_group GROUP BY v.land_cover_group""", "fx_landcover", v=VOCAB))
def landcover_histogram(fx):
    return raster.landcover_histogram(fx.landcover)


@query("event_landcover", oracle("""
SELECT v.land_cover_group, v.label, count(e.event_id) AS n FROM v LEFT JOIN eg e ON e.land_cover_class = v.land_cover_group GROUP BY ALL""", "fx_events", "fx_landcover", eg=EVENT_GROUP, v=VOCAB))
def event_landcover(fx):
    return raster.event_landcover(fx.events, fx.landcover, META)


@query("raster_stats", oracle("""
SELECT raster, min(v) AS min_value, max(v) AS max_value, %s AS mean_value, count(v) AS cells FROM (SELECT 'elevation' AS raster, elevation AS v FROM t UNION ALL SELECT 'slope', slope FROM t UNION ALL SELECT 'roughness', roughness FROM t UNION ALL SELECT 'tpi', tpi FROM t) GROUP BY raster
UNION ALL SELECT 'block_difference', 0, 0, 0, 0""" % rnd("avg(v)", 5), "fx_dem", **terrain_ctes(HOLED.format(dem="fx_dem"))))
def raster_stats(fx):
    """Statistics, plus the difference of the slope derived with two block sizes (none)."""
    holed = fx.sql(HOLED, dem=fx.dem)
    stats = raster.raster_stats(terrain(fx, holed), ["elevation", "slope", "roughness", "tpi"]).withColumn(
        "mean_value", F.rint(F.col("mean_value") * 1e5) / 1e5
    )
    other = raster.terrain(holed, CELL_METRES, block=7)
    difference = raster.raster_difference(raster.terrain(holed, CELL_METRES), other, "slope")
    return stats.unionByName(difference.select(
        F.lit("block_difference").alias("raster"), F.col("max_abs_diff").alias("min_value"),
        F.col("has_boundary_artifacts").cast("double").alias("max_value"), F.lit(0.0).alias("mean_value"), F.lit(0).cast("long").alias("cells"),
    ))


@query("raster_coverage", oracle("""
SELECT a.state, m.*, a.min_lat >= m.south - 0.02e0 AND a.max_lat <= m.north + 0.02e0 AND a.min_lon >= m.west - 0.02e0 AND a.max_lon <= m.east + 0.02e0 AS fully_covers_aoi
FROM fx_aoi a, (SELECT max(row_idx) - min(row_idx) + 1 AS n_rows, max(col_idx) - min(col_idx) + 1 AS n_cols, 0.02e0 AS pixel_size_deg, 28.1e0 - (max(row_idx) + 1) * 0.02e0 AS south, 28.1e0 - min(row_idx) * 0.02e0 AS north,
 88e0 + min(col_idx) * 0.02e0 AS west, 88e0 + (max(col_idx) + 1) * 0.02e0 AS east FROM fx_dem) m WHERE a.kind = 'pilot'""", "fx_dem"))
def raster_coverage(fx):
    return raster.raster_coverage(fx.dem, META, fx.pilots)


BAD = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN -9999e0 WHEN p_partkey % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_size * 90e0 END AS elevation,
 CASE WHEN p_partkey % 7 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice END AS slope FROM {part}"""


@query("nodata_mask", oracle("""
SELECT 'elevation' AS feature, count(*) FILTER (WHERE elevation = -9999 OR NOT isfinite(elevation)) AS missing FROM b UNION ALL SELECT 'slope', count(*) FILTER (WHERE slope IS NULL OR NOT isfinite(slope)) FROM b
UNION ALL SELECT 'kept_sum', CAST(sum(CASE WHEN elevation <> -9999 AND isfinite(elevation) THEN elevation END) AS BIGINT) FROM b""", b=BAD.format(part="part")))
def nodata_mask(fx):
    rows = fx.sql(BAD)
    kept = rows.agg(F.sum(raster.mask_nodata("elevation")).cast("long").alias("missing"))
    return raster.nodata_report(rows, ["elevation", "slope"]).unionByName(kept.select(F.lit("kept_sum").alias("feature"), "missing"))


@query("category_guard", oracle("SELECT DISTINCT 'unknown' AS verdict, code FROM fx_landcover WHERE code NOT IN (10,20,30,40,50,60,70,80,90,95,100) UNION ALL SELECT 'kept', count(*) FROM fx_landcover WHERE code IN (10,20,30,40,50,60,70,80,90,95,100)", "fx_landcover"))
def category_guard(fx):
    allowed = sorted(vocab.LAND_COVER_GROUPS)
    unknown = matrix.unknown_categories(fx.landcover, "code", allowed).select(F.lit("unknown").alias("verdict"), F.col("code").cast("long").alias("code"))
    sound = matrix.category_guard(fx.landcover.where(F.col("code").isin(allowed)), "code", allowed)
    return unknown.unionByName(sound.agg(F.count("*").alias("code")).select(F.lit("kept").alias("verdict"), "code"))
