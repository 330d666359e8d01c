"""Inputs derived from the given tables, as SQL both engines run unchanged."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from scarpline import vocab
from scarpline.operators import aoi as aoi_ops
from scarpline.operators.raster import RasterMeta
from scarpline.session import prepare

META = RasterMeta(west=88.0, north=28.1, res=0.02)
SIKKIM = dict(zip(("min_lat", "max_lat", "min_lon", "max_lon"), vocab.PILOT_BOXES[0][1:]))
CELL_METRES = 2000.0
TODAY = "2024-01-28"
FEATURES_OK = ",".join(vocab.MODEL_FEATURES)
FEATURES_SWAPPED = ",".join(["slope", "elevation"] + vocab.MODEL_FEATURES[2:])
FEATURES_SHORT = ",".join(vocab.MODEL_FEATURES[:-2])
FEATURES_STATIC = ",".join(vocab.STATIC_FEATURES)
FEATURES_TWICE = ",".join(vocab.MODEL_FEATURES[:-1] + ["slope"])

#: A usual size of each feature, in model order, for stored models.
SCALES = (4500, 30, 360, 4500, 2000, 6, 900, 2700, 6300, 12600, 900)


def feature_of(i: str) -> str:
    return f"CASE {i} " + " ".join(f"WHEN {n} THEN '{f}'" for n, f in enumerate(vocab.MODEL_FEATURES)) + " END"


def scale_of(i: str) -> str:
    return f"CASE {i} " + " ".join(f"WHEN {n} THEN {v}e0" for n, v in enumerate(SCALES)) + " ELSE 1e0 END"


VIEWS = {
    "fx_events": """
WITH b AS (
 SELECT o_orderkey AS event_id,
  22e0 + CAST((o_orderkey*7919) % 7000 AS DOUBLE)/1e3 AS latitude,
  88e0 + CAST((o_orderkey*104729) % 9500 AS DOUBLE)/1e3 AS longitude,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'nan' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS event_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'exact' WHEN '2-HIGH' THEN '1km' WHEN '3-MEDIUM' THEN ' 1KM ' WHEN '4-NOT SPECIFIED' THEN '25km' ELSE NULL END AS location_accuracy,
  CASE o_orderkey % 5 WHEN 0 THEN 'Arunāchal Pradesh' WHEN 1 THEN 'Assam' WHEN 2 THEN 'Meghālaya' WHEN 3 THEN 'Sikkim' ELSE NULL END AS admin_division_name,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Bhutan' ELSE 'India' END AS country_name,
  CASE o_orderstatus WHEN 'F' THEN 'downpour' WHEN 'O' THEN 'monsoon' ELSE NULL END AS landslide_trigger
 FROM {orders})
 SELECT * FROM b UNION ALL SELECT event_id + 1000000000, latitude, longitude, event_date, location_accuracy, admin_division_name, country_name, landslide_trigger FROM b WHERE event_id % 50 = 0""",
    "fx_rain_daily": """
SELECT CAST(user_id % 30 AS INT) AS cell_id, CAST(ts AS DATE) AS day,
 CAST(SUM(CAST(ROUND(value*1e2) AS BIGINT)) AS DOUBLE)/1e2 AS mm FROM {events}
 WHERE NOT (user_id % 30 = 7 AND EXTRACT(DAY FROM ts) = 12)
 GROUP BY CAST(user_id % 30 AS INT), CAST(ts AS DATE)""",
    "fx_dem": """
SELECT CAST(FLOOR(p_partkey/50e0) AS INT) AS row_idx, CAST(p_partkey % 50 AS INT) AS col_idx, CAST(p_size*90 AS DOUBLE) AS elevation FROM {part}""",
    "fx_landcover": """
SELECT CAST(FLOOR(p_partkey/50e0) AS INT) AS row_idx, CAST(p_partkey % 50 AS INT) AS col_idx,
 CAST(CASE p_partkey % 13 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30 WHEN 4 THEN 40 WHEN 5 THEN 50 WHEN 6 THEN 60 WHEN 7 THEN 70 WHEN 8 THEN 80 WHEN 9 THEN 90 WHEN 10 THEN 95 WHEN 11 THEN 100 ELSE 77 END AS INT) AS code FROM {part}""",
    "fx_precip_grid": """
SELECT CAST(1120 + l_orderkey % 70 AS INT) AS lat_idx, CAST(2680 + l_partkey % 95 AS INT) AS lon_idx, CAST(l_shipdate AS DATE) AS day,
 CASE WHEN (l_orderkey + l_linenumber) % 101 = 0 THEN CAST('NaN' AS DOUBLE) WHEN (l_orderkey + l_linenumber) % 53 = 0 THEN -9999.9e0 ELSE l_quantity END AS precip FROM {lineitem}""",
    "fx_scores": """
SELECT l_orderkey*10 + l_linenumber AS sample_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target,
 CAST((l_orderkey*31 + l_linenumber*17) % 1000 AS DOUBLE)/1e3 AS score FROM {lineitem}""",
    "fx_assets": """
SELECT s_suppkey AS osm_id, s_name AS asset_name, 'hospital' AS asset_type,
 88e0 + CAST((s_suppkey*104729) % 900 AS DOUBLE)/1e3 AS lon1, 27e0 + CAST((s_suppkey*7919) % 1100 AS DOUBLE)/1e3 AS lat1, CAST(NULL AS DOUBLE) AS lon2, CAST(NULL AS DOUBLE) AS lat2 FROM {supplier}
 UNION ALL SELECT c_custkey + 1000000000, c_name, 'road', 88e0 + CAST((c_custkey*104729) % 900 AS DOUBLE)/1e3, 27e0 + CAST((c_custkey*7919) % 1100 AS DOUBLE)/1e3,
 88e0 + CAST((c_custkey*104729) % 900 + 40 AS DOUBLE)/1e3, 27e0 + CAST((c_custkey*7919) % 1100 + 25 AS DOUBLE)/1e3 FROM {customer}""",
    # Half-hour slots per area: rate in mm/h as the mean of the hundredths.
    "fx_rain_slots": """
SELECT CAST(user_id % 4 AS INT) AS aoi,
 CAST(FLOOR((EXTRACT(DAY FROM ts) * 1440 + EXTRACT(HOUR FROM ts) * 60 + EXTRACT(MINUTE FROM ts)) / 30) AS INT) AS slot_of_month,
 CAST(SUM(CAST(ROUND(value*1e2) AS BIGINT)) AS DOUBLE)/1e2/COUNT(*) AS rate FROM {events}
 GROUP BY 1, 2""",
    # Points asking for a risk answer, with every input sometimes missing.
    "fx_points": """
SELECT o_orderkey AS point_id,
 22e0 + CAST((o_orderkey*7919) % 7000 AS DOUBLE)/1e3 AS latitude,
 88e0 + CAST((o_orderkey*104729) % 9500 AS DOUBLE)/1e3 AS longitude,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 1000 AS DOUBLE)/1e3 END AS susceptibility,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN -1e0 ELSE CAST((o_orderkey*37) % 1500 AS DOUBLE)/10e0 END AS mm_now,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST((o_orderkey*53) % 3000 AS DOUBLE)/10e0 END AS mm_forecast,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST((o_orderkey*11) % 600 AS DOUBLE)/10e0 END AS slope,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 13 AS DOUBLE)/10e0 ELSE NULL END AS exposure,
 o_orderkey % 7 <> 0 AS has_real_dem, o_orderkey % 4 <> 0 AS has_real_rainfall,
 CASE o_orderkey % 9 WHEN 0 THEN 'Assam' WHEN 1 THEN ' arunachal ' WHEN 2 THEN 'arunachal-pradesh' WHEN 3 THEN 'atlantis' WHEN 4 THEN '' ELSE NULL END AS asked_state
FROM {orders}""",
    # Model-run records: feature lists, metric documents, artifact flags.
    "fx_runs": f"""
SELECT c_custkey AS run_id,
 CASE c_custkey % 4 WHEN 0 THEN 'Sikkim' WHEN 1 THEN 'Assam' WHEN 2 THEN 'Arunachal Pradesh' ELSE 'Meghalaya' END AS state,
 split(CASE c_custkey % 7 WHEN 1 THEN '{FEATURES_SWAPPED}' WHEN 2 THEN '{FEATURES_SHORT}' WHEN 3 THEN '{FEATURES_STATIC}' WHEN 4 THEN '{FEATURES_TWICE}' WHEN 5 THEN '{FEATURES_STATIC},ndvi' ELSE '{FEATURES_OK}' END, ',') AS feature_names,
 split(CASE WHEN c_custkey % 11 = 0 THEN '{FEATURES_SHORT}' ELSE '{FEATURES_OK}' END, ',') AS documented,
 split(CASE WHEN c_custkey % 5 = 0 THEN '{FEATURES_SHORT}' ELSE '{FEATURES_OK}' END, ',') AS provenance_features,
 CASE WHEN c_custkey % 8 = 3 THEN NULL ELSE CAST(11 AS INT) END AS n_features,
 c_custkey % 13 <> 0 AS has_model, c_custkey % 17 <> 0 AS has_schema,
 CAST(300 + c_custkey*7 % 600 AS DOUBLE)/1e3 AS pr_auc, CAST(500 + c_custkey*13 % 450 AS DOUBLE)/1e3 AS roc_auc,
 CASE c_custkey % 10 WHEN 1 THEN 'true' WHEN 2 THEN '"0.7"' WHEN 3 THEN 'NaN' WHEN 4 THEN 'null'
  WHEN 5 THEN '0.7762' ELSE CAST(CAST(300 + c_custkey*7 % 600 AS DOUBLE)/1e3 AS STRING) END AS pr_text,
 CASE WHEN c_custkey % 10 = 5 THEN '0.919' ELSE CAST(CAST(500 + c_custkey*13 % 450 AS DOUBLE)/1e3 AS STRING) END AS roc_text,
 CASE WHEN c_custkey % 6 = 0 THEN 'copied' ELSE 'computed_from_validation_run' END AS metrics_source,
 CASE c_custkey % 5 WHEN 0 THEN 'REAL' WHEN 1 THEN 'DERIVED_PROXY' WHEN 2 THEN 'GUESSED' ELSE 'NOT_USED' END AS rain_word,
 CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'GBTClassifier' END AS model_type
FROM {{customer}}""",
    # Stored status reports, many per region, under differing spellings.
    "fx_reports": """
SELECT s_suppkey AS report_id,
 CASE s_suppkey % 5 WHEN 0 THEN ' Sikkim ' WHEN 1 THEN 'assam' WHEN 2 THEN 'Arunachal  Pradesh' WHEN 3 THEN 'Manipur' ELSE 'tripura' END AS state_key,
 CASE s_suppkey % 5 WHEN 0 THEN 'Sikkim' WHEN 1 THEN 'Assam' WHEN 2 THEN 'Arunachal Pradesh' WHEN 3 THEN 'Manipur' ELSE 'Tripura' END AS state,
 CASE s_suppkey % 4 WHEN 0 THEN 'VALIDATED_PILOT' WHEN 1 THEN 'DATA UNAVAILABLE' WHEN 2 THEN 'VALIDATION IN PROGRESS' ELSE NULL END AS overall_status,
 CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 7 = 0 THEN 'Trained & Validated' ELSE 'Not Trained' END AS model_status,
 CASE WHEN s_suppkey % 3 = 0 THEN 'Available' ELSE 'Missing (Requires Download)' END AS dem_status,
 'Missing (Requires Download)' AS exposure_status,
 CAST(FLOOR(ABS(s_acctbal)) AS INT) AS inventory_events,
 CAST(s_suppkey % 100 AS DOUBLE)/1e2 AS pr_auc
FROM {supplier}""",
    # Which artifact files exist, by size.
    "fx_files": """
SELECT c_custkey AS file_id,
 CASE c_custkey % 9 WHEN 0 THEN 'Sikkim' WHEN 1 THEN 'Arunachal Pradesh' WHEN 2 THEN 'Assam' WHEN 3 THEN 'Manipur' WHEN 4 THEN 'Meghalaya' WHEN 5 THEN 'Mizoram' WHEN 6 THEN 'Nagaland' ELSE 'Elsewhere' END AS state,
 CASE c_custkey % 3 WHEN 0 THEN 'dem' WHEN 1 THEN 'exposure' ELSE 'rainfall' END AS kind,
 CASE c_custkey % 5 WHEN 0 THEN 'elevation' WHEN 1 THEN 'slope' WHEN 2 THEN 'aspect' WHEN 3 THEN 'roughness' ELSE 'tpi' END AS feature,
 CASE WHEN c_custkey % 9 = 2 AND c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 9 = 4 AND c_custkey % 5 = 2 THEN 0
  WHEN c_custkey % 9 = 5 THEN c_custkey % 90 ELSE c_custkey % 4000 END AS length
FROM {customer}""",
    # The cells of five rasters, forty columns each, and their land cover.
    "fx_cells": """
SELECT CAST(o_orderkey % 5 AS INT) AS raster_id, CAST(FLOOR(o_orderkey/200e0) AS INT) AS row_idx, CAST(FLOOR((o_orderkey % 200)/5e0) AS INT) AS col_idx,
 CASE WHEN o_orderkey % 211 = 0 THEN -9999e0 ELSE CAST((o_orderkey*37) % 100 AS DOUBLE)*45e0 END AS elevation FROM {orders}""",
    "fx_covers": """
SELECT CAST(o_orderkey % 5 AS INT) AS raster_id, CAST(FLOOR(o_orderkey/200e0) AS INT) AS row_idx, CAST(FLOOR((o_orderkey % 200)/5e0) AS INT) AS col_idx,
 CAST(CASE o_orderkey % 17 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30 WHEN 4 THEN 40 WHEN 5 THEN 50 WHEN 6 THEN 60 WHEN 7 THEN 70 WHEN 8 THEN 80 WHEN 9 THEN 90 WHEN 10 THEN 95 WHEN 11 THEN 100 ELSE 10 END AS INT) AS code FROM {orders}""",
    "fx_georef": """
SELECT * FROM (VALUES (0, 'Sikkim', 88e0, 28.1e0, 0.0225e0, 1), (1, 'Assam', 91.3e0, 26.6e0, 0.06e0, 1), (2, 'Arunachal Pradesh', 92e0, 28e0, 0.0625e0, 1), (3, 'Meghalaya', 91e0, 26e0, 0.045e0, 1),
 (4, CAST(NULL AS STRING), 88e0, 28.2e0, 0.17e0, 2)) AS t(raster_id, state, west, north, res, priority)""",
    # Stored models: one tree of seven splits and eight leaves per supplier, and linear terms from the parts.
    "fx_trees": " UNION ALL ".join(f"""
SELECT CASE s_suppkey % 4 WHEN 0 THEN 'Sikkim' WHEN 1 THEN 'Assam' WHEN 2 THEN 'Meghalaya' ELSE 'Arunachal Pradesh' END AS key, s_suppkey AS tree, 1e0 AS weight, 'logistic' AS link, {n} AS node,
 {feature_of(f'(s_suppkey*7 + {n}*3) % 11') if n < 7 else 'CAST(NULL AS STRING)'} AS feature, {f"CASE WHEN (s_suppkey*7 + {n}*3) % 11 <> 5 THEN CAST((s_suppkey*13 + {n}*29) % 100 AS DOUBLE)/1e2 * {scale_of(f'(s_suppkey*7 + {n}*3) % 11')} END" if n < 7 else 'CAST(NULL AS DOUBLE)'} AS cut,
 {f"CASE WHEN (s_suppkey*7 + {n}*3) % 11 = 5 THEN CAST(CASE WHEN (s_suppkey + {n}) % 2 = 0 THEN 84 ELSE 42 END AS BIGINT) END" if n < 7 else 'CAST(NULL AS BIGINT)'} AS mask,
 {2 * n + 1 if n < 7 else 'CAST(NULL AS INT)'} AS left, {2 * n + 2 if n < 7 else 'CAST(NULL AS INT)'} AS right, CAST((s_suppkey*31 + {n}*17) % 200 - 100 AS DOUBLE)/1e3 AS value, CAST(NULL AS BIGINT) AS samples FROM {{supplier}}""" for n in range(15)),
    "fx_terms": f"""
SELECT key, {feature_of('i')} AS feature, CAST(sum(p) AS DOUBLE)/count(*)/({scale_of('i')}*1e2) AS weight FROM (
 SELECT CASE p_partkey % 4 WHEN 0 THEN 'Sikkim' WHEN 1 THEN 'Assam' WHEN 2 THEN 'Meghalaya' ELSE 'Arunachal Pradesh' END AS key, CAST(FLOOR(p_partkey/4e0) AS INT) % 12 AS i, (p_partkey*37) % 200 - 100 AS p FROM {{part}}) GROUP BY key, i""",
}
DEPENDS = {}


def aoi_sql() -> str:
    rows = [
        f"('{s}', 'admin', {a}e0, {b}e0, {c}e0, {d}e0, {str(s == vocab.PILOT_FLAGGED_STATE).lower()})"
        for s, a, b, c, d in vocab.ADMIN_BOXES
    ] + [f"('{s}', 'pilot', {a}e0, {b}e0, {c}e0, {d}e0, true)" for s, a, b, c, d in vocab.PILOT_BOXES]
    return (
        "SELECT * FROM (VALUES " + ", ".join(rows)
        + ") AS t(state, kind, min_lat, max_lat, min_lon, max_lon, is_pilot)"
    )


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Inputs:
    """The given tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **frames) -> DataFrame:
        given = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **given, **frames)

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in VIEWS:
            return self.view(f"fx_{name}")
        raise AttributeError(name)

    @cached_property
    def aoi(self) -> DataFrame:
        return aoi_ops.aoi_dimension(self.spark)

    @property
    def pilots(self) -> DataFrame:
        return aoi_ops.pilot_boxes(self.aoi)

    @property
    def admins(self) -> DataFrame:
        return aoi_ops.admin_boxes(self.aoi)

    @property
    def state_aliases(self) -> DataFrame:
        return aoi_ops.values_frame(self.spark, "alias, resolved", vocab.STATE_ALIASES)

    @property
    def admin_aliases(self) -> DataFrame:
        return aoi_ops.values_frame(self.spark, "state, name", vocab.ADMIN_NAME_ALIASES)

    @property
    def slots(self) -> DataFrame:
        """Half-hour slots of January with mm per slot."""
        return self.rain_slots.select(
            "aoi",
            F.expr("timestampadd(MINUTE, (slot_of_month - 48) * 30, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("slot"),
            "rate", (F.col("rate") * 0.5).alias("mm"),
        )

    @property
    def sikkim_events(self) -> DataFrame:
        """Dated, distinct events of the Sikkim pilot with their rain key and day."""
        from scarpline.functions import geo
        from scarpline.operators import catalog

        inside = self.events.where(geo.in_box("latitude", "longitude", SIKKIM))
        return with_rain_key(catalog.event_dedup(inside, "event_id"))


def with_rain_key(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.withColumns({
        "cell_id": (F.col(key) % 30).cast("int"),
        "target_day": F.date_add(F.lit("2024-01-15").cast("date"), (F.col(key) % 14).cast("int")),
    })


SLOTS_SQL = """
SELECT aoi, TIMESTAMP '2024-01-01 00:00:00' + to_minutes((slot_of_month - 48) * 30) AS slot, rate, rate * 0.5e0 AS mm
FROM fx_rain_slots"""


def oracle(body: str, *views: str, **extra: str) -> str:
    """DuckDB text: the named views, then extra CTEs in order, then the body."""
    parts = []
    if "fx_aoi" in body or any("fx_aoi" in t for t in extra.values()):
        parts.append(f"fx_aoi AS ({aoi_sql()})")
    names = {t: t for t in TABLES}
    for v in views:
        if v == "fx_slots":
            parts.append(f"fx_rain_slots AS ({VIEWS['fx_rain_slots'].format(**names)})")
            parts.append(f"fx_slots AS ({SLOTS_SQL})")
        else:
            parts.append(f"{v} AS ({VIEWS[v].format(**names)})")
    parts += [f"{n} AS ({t})" for n, t in extra.items()]
    head = "WITH RECURSIVE " if "recursive" in body.lower() else "WITH "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body


def rnd(expression: str, digits: int) -> str:
    """Half-to-even rounding of the scaled value, in DuckDB."""
    return f"(CAST(round_even(({expression}) * 1e{digits}, 0) AS DOUBLE) / 1e{digits})"


def flat(df: DataFrame) -> DataFrame:
    """Plain columns only: arrays joined, dates and times as text, structs opened."""
    out = []
    def add(name, column, dtype):
        if isinstance(dtype, T.ArrayType):
            out.append(F.array_join(column.cast("array<string>"), "; ").alias(name))
        elif isinstance(dtype, T.DateType):
            out.append(F.date_format(column, "yyyy-MM-dd").alias(name))
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name))
        elif isinstance(dtype, T.StructType):
            for f in dtype.fields:
                add(f"{name}_{f.name}", column[f.name], f.dataType)
        elif isinstance(dtype, T.MapType):
            out.append(F.to_json(column).alias(name))
        else:
            out.append(column.alias(name))
    for f in df.schema.fields:
        add(f.name, F.col(f"`{f.name}`"), f.dataType)
    return df.select(*out)
