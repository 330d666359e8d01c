"""Catalogue cleaning, grading and counting."""

from pyspark.sql import functions as F

from scarpline import vocab
from scarpline.operators import aoi, catalog, evaluate
from scarpline.session import scratch_path
from scarpline.sources import catalog_files

from .fixtures import SIKKIM, oracle, rnd
from .registry import query

BOX = (f"latitude BETWEEN {SIKKIM['min_lat']}e0 AND {SIKKIM['max_lat']}e0 AND longitude BETWEEN {SIKKIM['min_lon']}e0 AND {SIKKIM['max_lon']}e0")
DATED = "nullif(trim(event_date), '') IS NOT NULL AND lower(trim(event_date)) <> 'nan'"
PARSED = "TRY_CAST(event_date AS TIMESTAMP)"
PRECISE = "coalesce(lower(trim(location_accuracy)) IN ('1km', 'exact', '100m'), false)"
PILOT_EVENTS = """
SELECT a.state, e.* FROM fx_aoi a JOIN fx_events e ON e.latitude BETWEEN a.min_lat AND a.max_lat AND e.longitude BETWEEN a.min_lon AND a.max_lon WHERE a.kind = 'pilot'"""
ADMIN_EVENTS = PILOT_EVENTS.replace("'pilot'", "'admin'")
FIRST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude, trim(event_date) ORDER BY event_id) AS rn FROM fx_events
 WHERE nullif(trim(event_date), '') IS NOT NULL AND lower(trim(event_date)) <> 'nan') WHERE rn = 1"""

LAT_TEXT = "CASE WHEN event_id % 71 = 0 THEN 'n/a' WHEN event_id % 73 = 0 THEN '' ELSE CAST(latitude AS STRING) END"
FATAL_TEXT = "CASE event_id % 7 WHEN 0 THEN '3' WHEN 1 THEN '2.0' WHEN 2 THEN 'x' WHEN 3 THEN ' ' WHEN 4 THEN '12.9' ELSE NULL END"


def raw_catalog(fx):
    """The events as the catalogue file has them: text columns, blanks and odd numbers kept."""
    return fx.events.select(
        F.col("event_id").cast("string").alias("event_id"), F.expr(LAT_TEXT).alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"), F.coalesce("event_date", F.lit("")).alias("event_date"),
        F.coalesce("location_accuracy", F.lit("")).alias("location_accuracy"),
        F.coalesce("landslide_trigger", F.lit(" ")).alias("landslide_trigger"), F.expr(FATAL_TEXT).alias("fatality_count"),
        "admin_division_name", "country_name", F.lit("not read").alias("extra"),
    )


@query("catalog_scan", oracle(f"""
SELECT CAST(event_id AS STRING) AS event_id, latitude, longitude, event_date, nullif(trim(location_accuracy), '') AS location_accuracy, landslide_trigger,
 CASE event_id % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 4 THEN 12 END AS fatality_count FROM fx_events WHERE event_id % 71 <> 0 AND event_id % 73 <> 0""", "fx_events"))
def catalog_scan(fx):
    """Written as CSV files with a header and read back by the catalogue's reader."""
    path = scratch_path(fx.spark, "catalog")
    raw_catalog(fx).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return catalog_files.read_catalog(fx.spark, path).drop("admin_division_name", "country_name")


MIXED = """CASE event_id % 8 WHEN 0 THEN strftime(CAST(event_date AS DATE), '%m/%d/%Y') WHEN 1 THEN event_date || ' 13:45:00' WHEN 2 THEN event_date || 'T06:07:08'
 WHEN 3 THEN strftime(CAST(event_date AS DATE), '%Y/%m/%d') WHEN 4 THEN ' ' WHEN 5 THEN 'NaN' WHEN 6 THEN 'soon' ELSE event_date END"""


@query("date_coerce", oracle("""
SELECT event_id, strftime(CASE event_id % 8 WHEN 1 THEN CAST(event_date AS TIMESTAMP) + INTERVAL 49500 SECOND WHEN 2 THEN CAST(event_date AS TIMESTAMP) + INTERVAL 22028 SECOND
 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE CAST(event_date AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS event_ts
FROM (SELECT event_id, nullif(event_date, 'nan') AS event_date FROM fx_events)""", "fx_events"))
def date_coerce(fx):
    text = F.expr("""CASE event_id % 8 WHEN 0 THEN date_format(CAST(d AS DATE), 'MM/dd/yyyy') WHEN 1 THEN d || ' 13:45:00' WHEN 2 THEN d || 'T06:07:08'
      WHEN 3 THEN date_format(CAST(d AS DATE), 'yyyy/MM/dd') WHEN 4 THEN ' ' WHEN 5 THEN 'NaN' WHEN 6 THEN 'soon' ELSE d END""")
    mixed = fx.events.withColumn("d", F.expr("nullif(event_date, 'nan')")).select("event_id", text.alias("t"))
    return mixed.select("event_id", catalog.parse_date("t").alias("event_ts"))


@query("accuracy_class", oracle(f"SELECT event_id, CASE WHEN {PRECISE} THEN 'precise_lt_5km' ELSE 'approximate_ge_5km' END AS spatial_uncertainty FROM fx_events", "fx_events"))
def accuracy_class(fx):
    return fx.events.select("event_id", catalog.accuracy_class("location_accuracy").alias("spatial_uncertainty"))


@query("diacritic_match", oracle("""
SELECT event_id, coalesce(contains(lower(strip_accents(admin_division_name)), 'arunachal'), false) AS is_arunachal, coalesce(contains(lower(strip_accents(admin_division_name)), 'meghalaya'), false) AS is_meghalaya FROM fx_events""", "fx_events"))
def diacritic_match(fx):
    return fx.events.select(
        "event_id", catalog.name_contains("admin_division_name", "arunachal").alias("is_arunachal"),
        catalog.name_contains("admin_division_name", "meghalaya").alias("is_meghalaya"),
    )


ALIAS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{n}')" for s, n in vocab.ADMIN_NAME_ALIASES) + ") AS t(state, name)"


@query("admin_alias_match", oracle("""
SELECT DISTINCT e.event_id, a.state FROM fx_events e JOIN aliases a ON contains(lower(e.admin_division_name), a.name) WHERE e.country_name = 'India'""", "fx_events", aliases=ALIAS_SQL))
def admin_alias_match(fx):
    return catalog.admin_alias_match(fx.events, fx.admin_aliases).select("event_id", "state")


@query("event_dedup", oracle(f"""
SELECT 'raw' AS key, event_id FROM first UNION ALL
SELECT 'parsed', min(event_id) FROM fx_events WHERE {PARSED} IS NOT NULL GROUP BY latitude, longitude, {PARSED}""", "fx_events", first=FIRST))
def event_dedup(fx):
    parts = [
        catalog.event_dedup(fx.events, "event_id", key).select(F.lit(key).alias("key"), "event_id")
        for key in ("raw", "parsed")
    ]
    return parts[0].unionByName(parts[1])


def pilot_events(fx):
    return aoi.match_boxes(fx.events, fx.pilots.select("state", "min_lat", "max_lat", "min_lon", "max_lon"), "inner").drop(
        "min_lat", "max_lat", "min_lon", "max_lon"
    )


@query("snapshot_scan", oracle(f"""
SELECT state, event_id, latitude, longitude, CASE WHEN {PRECISE} THEN 'precise_lt_5km' ELSE 'approximate_ge_5km' END AS spatial_uncertainty FROM pe WHERE event_id % 59 <> 0""", "fx_events", pe=PILOT_EVENTS))
def snapshot_scan(fx):
    """Snapshot shards with wrong stored labels, bad coordinates and strays outside the box."""
    rows = pilot_events(fx).unionByName(
        fx.events.where("event_id % 101 = 0 AND latitude < 23").withColumn("state", F.lit("Sikkim")), allowMissingColumns=True
    )
    bad = F.expr("CASE WHEN event_id % 59 = 0 THEN 'unknown' ELSE CAST(latitude AS STRING) END")
    doc = rows.withColumn("latitude", bad).withColumn("spatial_uncertainty", F.lit("precise_lt_5km"))
    # Event ids are unique, so a shard holds a bounded number of events.
    shards = doc.groupBy("state", F.expr("event_id div 400").alias("shard")).agg(
        F.to_json(F.struct(F.first("state").alias("state"), F.collect_list(F.struct(
            F.col("event_id").cast("string").alias("event_id"), "latitude", F.col("longitude").cast("string").alias("longitude"),
            "event_date", "location_accuracy", "spatial_uncertainty")).alias("events"))).alias("doc")
    )
    return catalog_files.snapshot_events(shards.select("doc"), fx.pilots, extra=["event_id"]).select(
        "state", F.col("event_id").cast("long").alias("event_id"), "latitude", "longitude", "spatial_uncertainty"
    )


@query("source_preference", oracle("""
SELECT a.state, CASE WHEN s.n > 0 THEN 'validated_snapshot' WHEN c.n > 0 THEN 'raw_glc_catalog' ELSE 'NONE' END AS source, CASE WHEN s.n > 0 THEN s.n ELSE coalesce(c.n, 0) END AS events
FROM fx_aoi a LEFT JOIN (SELECT state, count(*) AS n FROM pe WHERE event_id % 3 = 0 AND state IN ('Sikkim', 'Meghalaya') GROUP BY state) s ON s.state = a.state
LEFT JOIN (SELECT state, count(*) AS n FROM pe GROUP BY state) c ON c.state = a.state WHERE a.kind = 'admin'""", "fx_events", pe=PILOT_EVENTS))
def source_preference(fx):
    events = pilot_events(fx).select("state", "event_id")
    snapshot = events.where("event_id % 3 = 0 AND state IN ('Sikkim', 'Meghalaya')")
    chosen = catalog.source_preference(snapshot, events, fx.admins)
    return chosen.groupBy("state", "source").agg(F.count("event_id").alias("events"))


@query("snapshot_sink", oracle(f"""
SELECT state, count(*) AS stored_rows, count(*) AS count, count(*) FILTER (WHERE {PRECISE}) AS precise_lt_5km, count(*) FILTER (WHERE NOT {PRECISE}) AS approximate_ge_5km,
 {rnd(f'100e0 * count(*) FILTER (WHERE NOT {PRECISE}) / count(*)', 1)} AS pct_approximate_ge_5km, min(min_lat) AS aoi_min_lat, max(max_lon) AS aoi_max_lon
FROM (SELECT f.*, a.state, a.min_lat, a.max_lon FROM first f JOIN fx_aoi a ON f.latitude BETWEEN a.min_lat AND a.max_lat AND f.longitude BETWEEN a.min_lon AND a.max_lon AND a.kind = 'pilot') GROUP BY state""", "fx_events", first=FIRST))
def snapshot_sink(fx):
    path = scratch_path(fx.spark, "snapshot")
    catalog_files.write_snapshot(catalog.event_dedup(fx.events, "event_id"), fx.pilots, path)
    header, rows = catalog_files.read_written_snapshot(fx.spark, path)
    stored = rows.groupBy("state").agg(F.count("*").alias("stored_rows"))
    return header.join(stored, "state").select(
        "state", "stored_rows", "count", "uncertainty.*", F.col("aoi.min_lat").alias("aoi_min_lat"), F.col("aoi.max_lon").alias("aoi_max_lon")
    )


QUALITY = f"""
SELECT a.state, coalesce(n, 0) AS inventory_events, coalesce(u, 0) AS usable_events,
 CASE WHEN n IS NULL THEN 'Poor' WHEN p / n > 0.5 THEN 'Good' ELSE 'Moderate/Poor' END AS spatial_quality, CASE WHEN n IS NULL THEN 'Poor' WHEN u / n > 0.8 THEN 'Good' ELSE 'Moderate/Poor' END AS temporal_quality
FROM fx_aoi a LEFT JOIN (SELECT state, count(*) AS n, count(*) FILTER (WHERE location_accuracy IN ('1km', 'exact', '100m')) AS p,
  count(DISTINCT CASE WHEN {PARSED} IS NOT NULL THEN CAST(latitude AS STRING) || '|' || CAST(longitude AS STRING) || '|' || event_date END) AS u FROM ae GROUP BY state) s ON s.state = a.state WHERE a.kind = 'admin'"""


@query("inventory_quality", oracle(QUALITY, "fx_events", ae=ADMIN_EVENTS))
def inventory_quality(fx):
    return catalog.inventory_quality(fx.events, fx.admins.drop("is_pilot"))


@query("inventory_funnel", oracle(f"""
SELECT a.state, (SELECT count(*) FROM fx_events WHERE country_name = 'India') AS raw_india, coalesce(n, 0) AS bbox, coalesce(m, 0) AS admin, coalesce(n, 0) AS valid_coords, coalesce(u, 0) AS deduplicated
FROM fx_aoi a LEFT JOIN (SELECT state, count(*) AS n, count(DISTINCT CASE WHEN {PARSED} IS NOT NULL THEN CAST(latitude AS STRING) || '|' || CAST(longitude AS STRING) || '|' || event_date END) AS u FROM ae GROUP BY state) s ON s.state = a.state
LEFT JOIN (SELECT state, count(DISTINCT event_id) AS m FROM fx_events e JOIN aliases l ON contains(lower(e.admin_division_name), l.name) WHERE country_name = 'India' GROUP BY state) d ON d.state = a.state WHERE a.kind = 'admin'""", "fx_events", ae=ADMIN_EVENTS, aliases=ALIAS_SQL))
def inventory_funnel(fx):
    return catalog.inventory_funnel(fx.events, fx.admins.drop("is_pilot"), fx.admin_aliases)


@query("label_gate", oracle(f"""
SELECT state, n AS total_usable_events, d AS exact_day_events, i AS independent_events, i >= 50 AS use_temporal_ml, CASE WHEN i >= 50 THEN 'Option A: Temporal ML' ELSE 'Option C: Static ML + IMERG Thresholds' END AS recommended_approach
FROM (SELECT state, count(*) AS n, count({PARSED}) AS d, count(DISTINCT {PARSED}) AS i FROM pe GROUP BY state)""", "fx_events", pe=PILOT_EVENTS))
def label_gate(fx):
    return catalog.label_gate(pilot_events(fx), ["state"])


@query("catalog_quality", oracle(f"""
SELECT state, {rnd("count(*) FILTER (WHERE NOT coalesce(trim(location_accuracy) IN ('1km', 'exact', '100m'), false)) / CAST(count(*) AS DOUBLE) * 100e0", 4)} AS pct_low_accuracy,
 count(DISTINCT CAST({PARSED} AS DATE)) AS independent_events, count(*) AS total_usable_events FROM pe GROUP BY state""", "fx_events", pe=PILOT_EVENTS))
def catalog_quality(fx):
    return catalog.catalog_quality(pilot_events(fx), ["state"])


@query("catalog_profile", oracle(f"""
SELECT state, count(*) AS raw_events, count(*) - count({PARSED}) AS unparseable_dates, count({PARSED}) AS usable_dates, count(DISTINCT CASE WHEN {PARSED} IS NOT NULL THEN CAST(latitude AS STRING) || '|' || CAST(longitude AS STRING) || '|' || event_date END) AS deduplicated,
 count(DISTINCT CAST({PARSED} AS DATE)) AS independent_dates, strftime(min({PARSED}), '%Y-%m-%d') AS first_date, strftime(max({PARSED}), '%Y-%m-%d') AS last_date,
 count({PARSED}) - count(DISTINCT CASE WHEN {PARSED} IS NOT NULL THEN CAST(latitude AS STRING) || '|' || CAST(longitude AS STRING) || '|' || event_date END) AS duplicates_removed FROM pe GROUP BY state""", "fx_events", pe=PILOT_EVENTS))
def catalog_profile(fx):
    return catalog.catalog_profile(pilot_events(fx), ["state"])


@query("uncertainty_summary", oracle(f"""
SELECT state, count(*) FILTER (WHERE {PRECISE}) AS precise_lt_5km, count(*) FILTER (WHERE NOT {PRECISE}) AS approximate_ge_5km, {rnd(f'100e0 * count(*) FILTER (WHERE NOT {PRECISE}) / count(*)', 1)} AS pct_approximate_ge_5km FROM pe GROUP BY state""", "fx_events", pe=PILOT_EVENTS))
def uncertainty_summary(fx):
    return catalog.uncertainty_summary(pilot_events(fx), ["state"])


@query("jurisdiction_counts", oracle("""
SELECT 'admin' AS dimension, coalesce(admin_division_name, '<blank>') AS name, count(*) AS n FROM fx_events GROUP BY ALL
UNION ALL SELECT 'country', coalesce(country_name, '<blank>'), count(*) FROM fx_events GROUP BY ALL""", "fx_events"))
def jurisdiction_counts(fx):
    return catalog.jurisdiction_counts(fx.events)


@query("independent_dates", oracle(f"SELECT state, count(DISTINCT CASE WHEN {DATED} THEN trim(event_date) END) AS independent_dates FROM pe GROUP BY state", "fx_events", pe=PILOT_EVENTS))
def independent_dates(fx):
    return catalog.independent_dates(pilot_events(fx), ["state"])


@query("top_values", oracle("""
SELECT "column", value, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS rank FROM (
 SELECT 'event_date' AS "column", event_date AS value, count(*) AS n FROM fx_events GROUP BY ALL UNION ALL
 SELECT 'landslide_trigger', landslide_trigger, count(*) FROM fx_events GROUP BY ALL UNION ALL SELECT 'location_accuracy', location_accuracy, count(*) FROM fx_events GROUP BY ALL)) WHERE rank <= 8""", "fx_events"))
def top_values(fx):
    return catalog.top_values(fx.events, ["event_date", "landslide_trigger", "location_accuracy"])


DIMS = [f"dim_{i}" for i in range(64)]


@query("feature_ranking", oracle(f"""
SELECT feature, {rnd('avg(abs(CAST(v AS DOUBLE)))', 6)} AS importance FROM (SELECT unnest({DIMS!r}) AS feature, unnest(embedding) AS v FROM embeddings) GROUP BY feature"""))
def feature_ranking(fx):
    """Whole vectors as contributions; rows one element too long are not aligned and drop out."""
    vectors = fx.table("embeddings").select(F.col("embedding").alias("contributions"))
    misaligned = vectors.select(F.array_append("contributions", F.lit(9.0).cast("float")).alias("contributions"))
    return evaluate.feature_ranking(vectors.union(misaligned), DIMS)
