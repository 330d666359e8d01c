"""Boxes, points, tiles, grids and the scalar rules around them."""

from pyspark.sql import functions as F

from scarpline import vocab
from scarpline.functions import clock, geo
from scarpline.operators import aoi

from .fixtures import SIKKIM, oracle, rnd
from .registry import query

GUARD = vocab.REGION_GUARD
IN_BOX = "latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon"


@query("aoi_filter", oracle(
    f"SELECT event_id, latitude, longitude FROM fx_events WHERE latitude >= {SIKKIM['min_lat']}e0 AND latitude <= {SIKKIM['max_lat']}e0 "
    f"AND longitude >= {SIKKIM['min_lon']}e0 AND longitude <= {SIKKIM['max_lon']}e0", "fx_events"))
def aoi_filter(fx):
    return fx.events.where(geo.in_box("latitude", "longitude", SIKKIM)).select("event_id", "latitude", "longitude")


@query("coordinate_check", oracle("""
SELECT point_id, CASE WHEN lat_ok AND lon_ok THEN 'VALID' ELSE 'INVALID' END AS status,
 concat_ws('; ', CASE WHEN NOT lat_ok THEN 'latitude outside 20..35' END, CASE WHEN NOT lon_ok THEN 'longitude outside 80..95' END) AS reasons
FROM (SELECT point_id, latitude >= 20 AND latitude <= 35 AS lat_ok, longitude >= 80 AND longitude <= 95 AS lon_ok FROM fx_points)""", "fx_points"))
def coordinate_check(fx):
    return fx.points.select(
        "point_id", geo.coordinate_status("latitude", "longitude", GUARD).alias("status"),
        geo.coordinate_reasons("latitude", "longitude", GUARD).alias("reasons"),
    )


@query("point_in_aoi", oracle("""
SELECT point_id, CASE WHEN named AND resolved IS NULL THEN 'INVALID' WHEN named AND NOT list_contains(c, resolved) THEN 'INVALID'
  WHEN named THEN 'RESOLVED' WHEN len(c) = 0 THEN 'OUTSIDE' WHEN len(c) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status,
 CASE WHEN named THEN CASE WHEN list_contains(c, resolved) THEN resolved END WHEN len(c) = 1 THEN c[1] END AS state,
 array_to_string(c, '; ') AS candidates
FROM (SELECT p.point_id, p.asked IS NOT NULL AS named, a.resolved,
   coalesce((SELECT list(state ORDER BY state) FROM fx_aoi WHERE kind = 'pilot' AND p.latitude BETWEEN min_lat AND max_lat AND p.longitude BETWEEN min_lon AND max_lon), []) AS c
  FROM (SELECT *, nullif(replace(lower(trim(asked_state)), '-', ' '), '') AS asked FROM fx_points) p
  LEFT JOIN (VALUES ('sikkim','Sikkim'),('assam','Assam'),('arunachal','Arunachal Pradesh'),('arunachal pradesh','Arunachal Pradesh'),
   ('arunachal_pradesh','Arunachal Pradesh'),('meghalaya','Meghalaya')) AS a(alias, resolved) ON a.alias = p.asked)""", "fx_points"))
def point_in_aoi(fx):
    return aoi.point_in_aoi(
        fx.points, fx.pilots.select("state", *geo.EDGES), fx.state_aliases, "point_id", "asked_state"
    ).select("point_id", "status", "state", "candidates")


EVENT_BOXES = f"""
SELECT admin_division_name AS state, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon
FROM fx_events WHERE admin_division_name IS NOT NULL GROUP BY admin_division_name, event_id % 40 = 0"""


def event_boxes(fx):
    """Boxes measured from the data: the extent of each admin name's events, in two parts."""
    return fx.events.where("admin_division_name IS NOT NULL").groupBy(
        F.col("admin_division_name").alias("state"), F.expr("event_id % 40 = 0").alias("part")
    ).agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
    )


@query("tile_cover", oracle("""
SELECT DISTINCT t.state, t.step, t.tile_lat, t.tile_lon, CAST(t.tile_lat BETWEEN c_lat AND c_lat + 1 AND t.tile_lon BETWEEN c_lon AND c_lon + 1 AS INT) AS central,
 (CASE WHEN tile_lat >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(tile_lat) AS STRING), 2, '0') || (CASE WHEN tile_lon >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(tile_lon) AS STRING), 3, '0') AS tile
FROM (SELECT b.state, s.step, CAST(floor((b.min_lat + b.max_lat) / 2e0) AS INT) AS c_lat, CAST(floor((b.min_lon + b.max_lon) / 2e0) AS INT) AS c_lon,
   CAST(la.v AS INT) AS tile_lat, CAST(lo.v AS INT) AS tile_lon
  FROM boxes b, (VALUES (1), (3)) s(step), (SELECT unnest(range(-90, 91)) AS v) la, (SELECT unnest(range(-180, 181)) AS v) lo
  WHERE la.v % s.step = 0 AND lo.v % s.step = 0 AND la.v BETWEEN floor(b.min_lat / s.step) * s.step AND floor(b.max_lat / s.step) * s.step
   AND lo.v BETWEEN floor(b.min_lon / s.step) * s.step AND floor(b.max_lon / s.step) * s.step) t""", "fx_events", boxes=EVENT_BOXES))
def tile_cover(fx):
    boxes = event_boxes(fx)
    c_lat = F.floor(geo.centroid("min_lat", "max_lat"))
    c_lon = F.floor(geo.centroid("min_lon", "max_lon"))
    parts = [
        aoi.tile_cover(boxes, step).select(
            "state", F.lit(step).alias("step"), "tile_lat", "tile_lon",
            (F.col("tile_lat").between(c_lat, c_lat + 1) & F.col("tile_lon").between(c_lon, c_lon + 1)).cast("int").alias("central"),
            geo.tile_name("tile_lat", "tile_lon").alias("tile"),
        )
        for step in (1, vocab.LAND_COVER_TILE_DEG)
    ]
    return parts[0].unionByName(parts[1]).distinct()


@query("tile_name", oracle("""
SELECT (CASE WHEN la >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(la) AS STRING), 2, '0') || (CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(lo) AS STRING), 3, '0') AS tile, count(*) AS n
FROM (SELECT CAST(floor(latitude) AS INT) - CASE WHEN event_id % 5 = 0 THEN 40 ELSE 0 END AS la, CAST(floor(longitude) AS INT) - CASE WHEN event_id % 7 = 0 THEN 100 ELSE 0 END AS lo FROM fx_events) GROUP BY 1""", "fx_events"))
def tile_name(fx):
    la = F.floor("latitude") - F.expr("CASE WHEN event_id % 5 = 0 THEN 40 ELSE 0 END")
    lo = F.floor("longitude") - F.expr("CASE WHEN event_id % 7 = 0 THEN 100 ELSE 0 END")
    return fx.events.groupBy(geo.tile_name(la, lo).alias("tile")).agg(F.count("*").alias("n"))


@query("aoi_consistency", oracle("""
SELECT state, lo_a >= min_lat - 1e-9 AND hi_a <= max_lat + 1e-9 AND lo_o >= min_lon - 1e-9 AND hi_o <= max_lon + 1e-9 AS within,
 d = '' AS identical, d AS differing_keys
FROM (SELECT *, concat_ws('; ', CASE WHEN abs(min_lat - lo_a) > 1e-9 THEN 'min_lat' END, CASE WHEN abs(max_lat - hi_a) > 1e-9 THEN 'max_lat' END,
  CASE WHEN abs(min_lon - lo_o) > 1e-9 THEN 'min_lon' END, CASE WHEN abs(max_lon - hi_o) > 1e-9 THEN 'max_lon' END) AS d
 FROM (SELECT a.state, a.min_lat, a.max_lat, a.min_lon, a.max_lon, min(e.latitude) AS lo_a, max(e.latitude) AS hi_a, min(e.longitude) AS lo_o, max(e.longitude) AS hi_o
  FROM fx_aoi a JOIN fx_events e ON strip_accents(e.admin_division_name) = a.state WHERE a.kind = 'admin' GROUP BY ALL))""", "fx_events"))
def aoi_consistency(fx):
    """Does the extent of each state's events lie in its administrative box?"""
    plain = F.translate("admin_division_name", "ā", "a")
    measured = fx.events.where("admin_division_name IS NOT NULL").groupBy(plain.alias("state")).agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
    )
    return aoi.aoi_consistency(fx.admins, measured)


@query("state_for_bounds", oracle("""
SELECT q.*, coalesce((SELECT min(a.state) FROM fx_aoi a WHERE a.kind = 'pilot' AND abs(a.min_lat - q.min_lat) <= 1e-9 AND abs(a.max_lat - q.max_lat) <= 1e-9
  AND abs(a.min_lon - q.min_lon) <= 1e-9 AND abs(a.max_lon - q.max_lon) <= 1e-9), 'UNMATCHED_PILOT_AOI') AS state
FROM (SELECT r.run_id, b.min_lat + CASE WHEN r.run_id % 3 = 0 THEN 1e-4 WHEN r.run_id % 3 = 1 THEN 4e-10 ELSE 0e0 END AS min_lat, b.max_lat, b.min_lon, b.max_lon
 FROM fx_runs r JOIN fx_aoi b ON b.state = r.state AND b.kind = 'pilot') q""", "fx_runs"))
def state_for_bounds(fx):
    shift = F.expr("CASE WHEN run_id % 3 = 0 THEN 1e-4 WHEN run_id % 3 = 1 THEN 4e-10 ELSE 0e0 END")
    asked = fx.runs.select("run_id", "state").join(fx.pilots, "state").select(
        "run_id", (F.col("min_lat") + shift).alias("min_lat"), "max_lat", "min_lon", "max_lon"
    )
    return aoi.state_for_bounds(asked, fx.pilots)


@query("grid_index", oracle("""
SELECT event_id, CAST(least(greatest(round_even((latitude - 0.05e0 + 89.95e0) * 10e0, 0), 0), 1799) AS INT) AS lat_lo, CAST(least(greatest(round_even((latitude + 0.05e0 + 89.95e0) * 10e0, 0), 0), 1799) AS INT) AS lat_hi,
 CAST(least(greatest(round_even((longitude - 0.05e0 + 179.95e0) * 10e0, 0), 0), 3599) AS INT) AS lon_lo, CAST(least(greatest(round_even((longitude + 0.05e0 + 179.95e0) * 10e0, 0), 0), 3599) AS INT) AS lon_hi FROM fx_events""", "fx_events"))
def grid_index(fx):
    boxed = fx.events.withColumn("cell_box", geo.point_box("latitude", "longitude")).select("event_id", "cell_box.*")
    return boxed.select("event_id", *geo.precip_indices())


@query("grid_build", oracle(f"""
SELECT state, 'r' || lpad(CAST(i AS STRING), 2, '0') || 'c' || lpad(CAST(j AS STRING), 2, '0') AS cell_id, i AS "row", j AS col,
 {rnd('lo_a + h * 0.5e0', 6)} AS latitude, {rnd('lo_o + w * 0.5e0', 6)} AS longitude,
 {rnd('lo_a', 6)} AS bbox_min_lat, {rnd('lo_a + h', 6)} AS bbox_max_lat, {rnd('lo_o', 6)} AS bbox_min_lon, {rnd('lo_o + w', 6)} AS bbox_max_lon, n AS events
FROM (SELECT s.*, CAST(r.v AS INT) AS i, CAST(c.v AS INT) AS j, min_lat + r.v * h AS lo_a, min_lon + c.v * w AS lo_o
 FROM (SELECT *, (max_lat - min_lat) / n_lat AS h, (max_lon - min_lon) / n_lon AS w FROM (
   SELECT state, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon, count(*) AS n,
    CAST(greatest(round_even((max(latitude) - min(latitude)) / 0.05e0, 0), 1) AS INT) AS n_lat, CAST(greatest(round_even((max(longitude) - min(longitude)) / 0.05e0, 0), 1) AS INT) AS n_lon
   FROM (SELECT a.state, e.latitude, e.longitude FROM fx_aoi a JOIN fx_events e ON {IN_BOX} WHERE a.kind = 'pilot') GROUP BY state)) s,
  (SELECT unnest(range(0, 400)) AS v) r, (SELECT unnest(range(0, 400)) AS v) c WHERE r.v < n_lat AND c.v < n_lon)""", "fx_events"))
def grid_build(fx):
    """Grid over the extent the events really have within each pilot box."""
    extent = aoi.match_boxes(fx.events, fx.pilots, "inner").groupBy("state").agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        F.count("*").alias("events"),
    )
    cells = aoi.grid_build(extent.drop("events"))
    return cells.drop("cell_height_deg", "cell_width_deg").join(extent.select("state", "events"), "state")


@query("cell_bounds", oracle("""
SELECT event_id, CASE WHEN ok THEN latitude - h / 2 END AS box_min_lat, CASE WHEN ok THEN latitude + h / 2 END AS box_max_lat,
 CASE WHEN ok THEN longitude - w / 2 END AS box_min_lon, CASE WHEN ok THEN longitude + w / 2 END AS box_max_lon
FROM (SELECT *, h IS NOT NULL AND NOT isnan(h) AND h > 0 AND w > 0 AS ok FROM (SELECT event_id, latitude, longitude,
 CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 0e0 WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE 0.05e0 END AS h, CASE WHEN event_id % 4 = 0 THEN -1e0 ELSE 0.06e0 END AS w FROM fx_events))""", "fx_events"))
def cell_bounds(fx):
    h = F.expr("CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 0e0 WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE 0.05e0 END")
    w = F.expr("CASE WHEN event_id % 4 = 0 THEN -1e0 ELSE 0.06e0 END")
    sized = fx.events.withColumns({"h": h, "w": w})
    return sized.select("event_id", geo.cell_box("latitude", "longitude", "h", "w").alias("box"))


@query("point_bbox", oracle("""
SELECT event_id, greatest(-90e0, la - 0.05e0) AS box_min_lat, least(90e0, la + 0.05e0) AS box_max_lat, greatest(-180e0, lo - 0.05e0) AS box_min_lon, least(180e0, lo + 0.05e0) AS box_max_lon
FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 90e0 WHEN 1 THEN -89.98e0 ELSE latitude END AS la, CASE event_id % 7 WHEN 0 THEN 180e0 WHEN 1 THEN -179.99e0 ELSE longitude END AS lo FROM fx_events)""", "fx_events"))
def point_bbox(fx):
    la = F.expr("CASE event_id % 9 WHEN 0 THEN 90e0 WHEN 1 THEN -89.98e0 ELSE latitude END")
    lo = F.expr("CASE event_id % 7 WHEN 0 THEN 180e0 WHEN 1 THEN -179.99e0 ELSE longitude END")
    return fx.events.select("event_id", geo.point_box(la, lo).alias("box"))


@query("aoi_centroid", oracle("SELECT state, (min_lat + max_lat) / 2e0 AS lat, (min_lon + max_lon) / 2e0 AS lon FROM boxes", "fx_events", boxes=EVENT_BOXES))
def aoi_centroid(fx):
    return event_boxes(fx).where(geo.require_edges()).select(
        "state", geo.centroid("min_lat", "max_lat").alias("lat"), geo.centroid("min_lon", "max_lon").alias("lon")
    )


RUN_WORD = "CASE event_id % 6 WHEN 0 THEN 'early' WHEN 1 THEN ' LATE ' WHEN 2 THEN 'Final' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'eArLy' END"


@query("run_type_normalise", oracle(f"""
SELECT run_type, count(*) AS n FROM (SELECT CASE lower(trim(coalesce(nullif(w, ''), 'early'))) WHEN 'early' THEN 'Early' WHEN 'late' THEN 'Late' WHEN 'final' THEN 'Final' END AS run_type
 FROM (SELECT {RUN_WORD} AS w FROM events)) GROUP BY run_type"""))
def run_type_normalise(fx):
    return fx.table("events").groupBy(clock.run_type_strict(F.expr(RUN_WORD)).alias("run_type")).agg(F.count("*").alias("n"))


@query("slot_floor", oracle("""
SELECT event_id, strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS slot, CAST(date_part('hour', time_bucket(INTERVAL 30 MINUTE, ts)) * 60 + date_part('minute', time_bucket(INTERVAL 30 MINUTE, ts)) AS INT) AS minutes FROM events"""))
def slot_floor(fx):
    slot = clock.slot_floor("ts")
    return fx.table("events").select("event_id", slot.alias("slot"), clock.minutes_of_day(slot).alias("minutes"))


GRANULE_SQL = """
SELECT *, CASE WHEN run = 'Early' THEN '3B-HHR-E' ELSE '3B-HHR-L' END || '.MS.MRG.3IMERG.' || strftime(slot, '%Y%m%d') || '-S' || strftime(slot, '%H%M%S') || '-E' || strftime(slot + INTERVAL 1799 SECOND, '%H%M%S')
 || '.' || lpad(CAST(CAST(date_part('hour', slot) * 60 + date_part('minute', slot) AS INT) AS STRING), 4, '0') AS stem
FROM (SELECT *, CASE WHEN aoi % 2 = 0 THEN 'Early' ELSE 'Late' END AS run FROM fx_slots)"""


@query("granule_name", oracle("""
SELECT aoi, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, stem || '.V07B.HDF5' AS name,
 CASE WHEN run = 'Early' THEN 'GPM_3IMERGHHE.07' ELSE 'GPM_3IMERGHHL.07' END || '/' || strftime(slot, '%Y') || '/' || strftime(slot, '%j') AS directory FROM named""", "fx_slots", named=GRANULE_SQL))
def granule_name(fx):
    run = F.expr("CASE WHEN aoi % 2 = 0 THEN 'Early' ELSE 'Late' END")
    return fx.slots.select(
        "aoi", "slot", clock.granule_name(run, "slot").alias("name"), clock.granule_directory(run, "slot").alias("directory")
    )


NOW_SQL = "TIMESTAMP '2024-01-20 12:10:00'"


@query("freshness", oracle(f"""
SELECT event_id, age AS age_seconds, {rnd('age / 60e0', 1)} AS age_minutes, CASE WHEN age IS NULL THEN NULL WHEN {rnd('age / 60e0', 1)} > 360 THEN 'STALE' WHEN {rnd('age / 60e0', 1)} <= 90 THEN 'NEAR_REAL_TIME' ELSE 'RECENT' END AS label
FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(date_diff('second', TIMESTAMP '1970-01-01', {NOW_SQL}) - date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS DOUBLE) END AS age FROM events)"""))
def freshness(fx):
    seen = F.expr("CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END")
    now = F.expr("TIMESTAMP_NTZ '2024-01-20 12:10:00'")
    aged = fx.table("events").select("event_id", clock.age_seconds(seen, now).alias("age_seconds"))
    aged = aged.withColumn("age_minutes", clock.age_minutes("age_seconds"))
    return aged.withColumn("label", clock.freshness("age_minutes"))


@query("observation_lag", oracle("""
SELECT event_id, lag, CASE WHEN lag IS NULL THEN NULL WHEN lag <= 0 THEN 'same day' WHEN lag = 1 THEN '1 day behind the requested date' ELSE CAST(lag AS STRING) || ' days behind the requested date' END AS label
FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-01-16') AS INT) END AS lag FROM events)"""))
def observation_lag(fx):
    seen = F.expr("CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(ts AS DATE) END")
    lagged = fx.table("events").select("event_id", F.datediff(F.lit("2024-01-16").cast("date"), seen).alias("lag"))
    return lagged.withColumn("label", clock.lag_label("lag"))


@query("age_label", oracle("""
SELECT event_id, CASE WHEN s IS NULL THEN NULL WHEN w < 90 THEN CAST(CAST(w AS BIGINT) AS STRING) || 's ago' WHEN floor(w / 60e0 + 0.5e0) < 90 THEN CAST(CAST(floor(w / 60e0 + 0.5e0) AS BIGINT) AS STRING) || ' min ago'
  WHEN w / 3600e0 < 48 THEN printf('%.1f', floor(w / 3600e0 * 10 + 0.5e0) / 10) || ' h ago' ELSE printf('%.1f', floor(w / 3600e0 / 24 * 10 + 0.5e0) / 10) || ' d ago' END AS age,
 CASE WHEN value IS NULL THEN '—' ELSE printf('%.2f', floor(value * 100 + 0.5e0) / 100) || ' mm' END AS mm
FROM (SELECT *, floor(greatest(s, 0e0) + 0.5e0) AS w FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST((event_id * 7919) % 400000 AS DOUBLE) / CASE WHEN event_id % 3 = 0 THEN 100e0 ELSE 1e0 END END AS s,
 CASE WHEN event_id % 10 = 1 THEN NULL ELSE value END AS value FROM events))"""))
def age_label(fx):
    s = F.expr("CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST((event_id * 7919) % 400000 AS DOUBLE) / CASE WHEN event_id % 3 = 0 THEN 100e0 ELSE 1e0 END END")
    v = F.expr("CASE WHEN event_id % 10 = 1 THEN NULL ELSE value END")
    return fx.table("events").select("event_id", clock.age_label(s).alias("age"), clock.mm_label(v).alias("mm"))
