"""Training matrix, models, grid and point scores, and the flagship question."""

from pyspark.sql import functions as F

from scarpline import vocab
from scarpline.operators import rainfall
from scarpline.plans import flagship, training
from scarpline.session import scratch_path, through_table
from scarpline.sources import documents

from . import q_catalog, q_matrix, q_raster, q_rain
from .fixtures import META, oracle, rnd, with_rain_key
from .registry import query

TREES = 100  # boosting rounds and forest size


def wide_table(fx):
    """The terrain table, written once: sampling then reads plain columns, not a stencil."""
    return through_table(q_raster.terrain(fx), "terrain")


def rain_key(samples):
    return with_rain_key(samples, "seed").drop("seed")


def sample_matrix(fx, strict=False):
    return training.training_matrix(
        q_matrix.positives(fx), fx.pilots, wide_table(fx), fx.landcover, META, fx.rain_daily, rain_key, strict
    )


SAMPLES = """
SELECT 'p-' || state || '-' || CAST(event_id AS STRING) AS sample_id, state, 1 AS target, event_id AS seed, latitude, longitude, event_date FROM pos
UNION ALL SELECT 'n-' || state || '-' || CAST(positive_id AS STRING) || '-' || CAST(attempt AS STRING), state, 0, positive_id + attempt, latitude, longitude, event_date FROM neg"""
KEYED = "SELECT *, CAST(seed % 30 AS INT) AS cell_id, DATE '2024-01-15' + CAST(seed % 14 AS INT) AS target_day FROM samples"
TERRAIN_OK = "t.elevation IS NOT NULL AND t.slope IS NOT NULL"
F32 = lambda e, n: f"CAST({e} AS FLOAT) AS {n}"
MATRIX = f"""
SELECT s.sample_id, s.state, CAST(s.target AS BIGINT) AS target, s.latitude, s.longitude, s.event_date, {', '.join(F32(f'CASE WHEN {TERRAIN_OK} THEN t.{n} END', n) for n in vocab.TERRAIN_FEATURES)},
 CAST({q_raster.GROUP.replace('code', 'l.code')} AS INT) AS land_cover_class, {', '.join(F32('w.' + n, n) for n in vocab.RAIN_FEATURES)}, CASE WHEN {TERRAIN_OK} THEN 'REAL' ELSE 'UNAVAILABLE' END AS terrain_status, w.rain_status
FROM keyed s LEFT JOIN t ON t.row_idx = {q_raster.SAMPLE_ROW} AND t.col_idx = {q_raster.SAMPLE_COL} LEFT JOIN fx_landcover l ON l.row_idx = {q_raster.SAMPLE_ROW} AND l.col_idx = {q_raster.SAMPLE_COL}
LEFT JOIN w ON w.cell_id = s.cell_id AND w.target_day = s.target_day"""
MATRIX_CTES = dict(**q_matrix.NEGATIVE_CTES, samples=SAMPLES, keyed=KEYED, **q_raster.terrain_ctes(), w=q_rain.window_sql("keyed"), m=MATRIX)
MATRIX_VIEWS = ("fx_events", "fx_dem", "fx_landcover", "fx_rain_daily")


@query("training_matrix", oracle("SELECT * FROM m", *MATRIX_VIEWS, **MATRIX_CTES))
def training_matrix(fx):
    return sample_matrix(fx)


@query("matrix_io", oracle("""
SELECT target, count(*) AS n, count(elevation) AS with_terrain, count(rain_1d) AS with_rain, max(slope) AS max_slope, min(rain_3d) AS min_rain_3d, CAST(sum(land_cover_class) AS BIGINT) AS classes, 'float,int,bigint' AS stored FROM m GROUP BY target""", *MATRIX_VIEWS, **MATRIX_CTES))
def matrix_io(fx):
    path = scratch_path(fx.spark, "matrix")
    documents.write_matrix(sample_matrix(fx), path)
    back = documents.read_matrix(fx.spark, path)
    types = ",".join(back.schema[c].dataType.simpleString() for c in ("slope", "land_cover_class", "target"))
    return back.groupBy("target").agg(
        F.count("*").alias("n"), F.count("elevation").alias("with_terrain"), F.count("rain_1d").alias("with_rain"), F.max("slope").alias("max_slope"),
        F.min("rain_3d").alias("min_rain_3d"), F.sum("land_cover_class").alias("classes"), F.lit(types).alias("stored"),
    )


# --- the flagship grid ------------------------------------------------------------------------

STATE_OF_CELL = "CASE cell_id % 4 WHEN 0 THEN 'Sikkim' WHEN 1 THEN 'Assam' WHEN 2 THEN 'Meghalaya' ELSE 'Arunachal Pradesh' END"
STATE_DAILY = f"SELECT {STATE_OF_CELL} AS state, day, CAST(SUM(CAST(ROUND(mm*1e2) AS BIGINT)) AS DOUBLE)/1e2 AS mm FROM {{d}} GROUP BY 1, day"
TARGET_DAY = "2024-01-20"
SUSCEPTIBILITY = "SELECT CAST(FLOOR(p_partkey/50e0) AS INT) AS row_idx, CAST(p_partkey % 50 AS INT) AS col_idx, CAST((p_partkey*37) % 1000 AS DOUBLE)/1e3 AS susceptibility FROM {part}"


def state_rain(fx):
    """One antecedent row per pilot state; a state without a full window stays, refused."""
    daily = fx.sql(STATE_DAILY, d=fx.rain_daily)
    asked = fx.pilots.select("state", F.lit(TARGET_DAY).cast("date").alias("target_day"))
    return rainfall.antecedent_for(asked, daily, key="state").drop("target_day", "days_present")


def raster_box(fx):
    """The DEM's own extent as one box, so the grid grows with the raster."""
    # The state is aggregated, not a literal, so later joins on it stay equi-joins.
    m = fx.dem.agg(F.max("row_idx").alias("r"), F.max("col_idx").alias("c"), F.max(F.lit("Sikkim")).alias("state"))
    return m.select(
        "state", (F.lit(META.north) - (F.col("r") + 1) * META.res).alias("min_lat"), F.lit(META.north).alias("max_lat"),
        F.lit(META.west).alias("min_lon"), (F.lit(META.west) + (F.col("c") + 1) * META.res).alias("max_lon"),
    )


def fused(fx):
    wide = wide_table(fx).join(fx.sql(SUSCEPTIBILITY), ["row_idx", "col_idx"])
    return flagship.fused_cells(raster_box(fx), wide, META, state_rain(fx), step=META.res)


GRID_CELLS = f"""
SELECT {rnd('lo_a + h * 0.5e0', 6)} AS latitude, {rnd('lo_o + w * 0.5e0', 6)} AS longitude FROM (SELECT *, min_lat + r.v * h AS lo_a, min_lon + c.v * w AS lo_o FROM (
 SELECT *, (max_lat - min_lat) / n_lat AS h, (max_lon - min_lon) / n_lon AS w FROM (SELECT *, greatest(round_even((max_lat - min_lat) / 0.02e0, 0), 1) AS n_lat, greatest(round_even((max_lon - min_lon) / 0.02e0, 0), 1) AS n_lon FROM (
  SELECT 28.1e0 - (max(row_idx) + 1) * 0.02e0 AS min_lat, 28.1e0 AS max_lat, 88e0 AS min_lon, 88e0 + (max(col_idx) + 1) * 0.02e0 AS max_lon FROM fx_dem))) b, (SELECT unnest(range(0, 5000)) AS v) r, (SELECT unnest(range(0, 50)) AS v) c WHERE r.v < n_lat AND c.v < n_lon)"""
STATE_WINDOW = f"""
SELECT count(mm) = 14 AS ok, CASE WHEN count(mm) = 14 THEN max(mm) FILTER (WHERE day = DATE '{TARGET_DAY}' - 1) END AS rain_1d FROM sd WHERE state = 'Sikkim' AND day BETWEEN DATE '{TARGET_DAY}' - 14 AND DATE '{TARGET_DAY}' - 1"""
FLAG_IN = f"""
SELECT t.slope, x.susceptibility AS raw_s, w.rain_1d AS mm_now, CAST(NULL AS DOUBLE) AS none, CAST(NULL AS DOUBLE) AS exposure, t.row_idx IS NOT NULL AND t.slope IS NOT NULL AS has_real_dem, w.rain_1d IS NOT NULL AS has_real_rainfall, w.ok, w.rain_1d,
 CASE WHEN t.row_idx IS NOT NULL AND t.slope IS NOT NULL AND w.ok THEN 'OK' ELSE 'UNAVAILABLE' END AS status, CASE WHEN t.row_idx IS NOT NULL AND t.slope IS NOT NULL AND w.ok THEN x.susceptibility END AS susceptibility
FROM gc LEFT JOIN t ON t.row_idx = {q_raster.SAMPLE_ROW} AND t.col_idx = {q_raster.SAMPLE_COL} LEFT JOIN x ON x.row_idx = t.row_idx AND x.col_idx = t.col_idx, sw w"""


def flagship_oracle():
    from .q_risk import fused_sql

    return oracle("""
SELECT 'Sikkim' AS state, status, warning_level, count(*) AS cells, max(slope) AS max_slope, max(final_risk_score) AS max_risk, min(rain_1d) AS rain_1d, CAST(sum(CAST(round_even(final_risk_score * 1e4, 0) AS BIGINT)) AS BIGINT) AS risk_sum_e4
FROM f GROUP BY status, warning_level""", "fx_dem", "fx_rain_daily", **q_raster.terrain_ctes(), x=SUSCEPTIBILITY.format(part="part"), sd=STATE_DAILY.format(d="fx_rain_daily"), sw=STATE_WINDOW, gc=GRID_CELLS, fi=FLAG_IN, f=fused_sql("fi", "none"))


@query("fused_grid_overview", flagship_oracle())
def fused_grid_overview(fx):
    """The flagship question over the whole raster."""
    return flagship.risk_overview(fused(fx))
