"""Thresholds, fusion, input gates and provenance."""

from pyspark.sql import functions as F

from scarpline import vocab
from scarpline.functions import landcover, provenance as prov, risk
from scarpline.plans import risk_points

from .fixtures import oracle, rnd
from .registry import query


def crit(d):
    return rnd(f"14.2e0 * pow(greatest({d}, 1e0), -0.62e0)", 4)


D = "CAST(o_orderkey % 80 AS DOUBLE) / 2e0"


@query("critical_intensity", oracle(f"SELECT o_orderkey AS id, {crit(D)} AS critical FROM orders"))
def critical_intensity(fx):
    return fx.table("orders").select(F.col("o_orderkey").alias("id"), risk.critical_intensity(F.expr(D)).alias("critical"))


@query("critical_accumulation", oracle(f"SELECT o_orderkey AS id, {rnd(f'{crit(D)} * {D}', 4)} AS critical FROM orders"))
def critical_accumulation(fx):
    return fx.table("orders").select(F.col("o_orderkey").alias("id"), risk.critical_accumulation(F.expr(D)).alias("critical"))


def trigger_sql(mm, hours, name):
    """CTE columns of one trigger in plain SQL."""
    d, c = f"greatest({hours}, 1e0)", crit(hours)
    ok = f"coalesce({mm} >= 0, false)"
    return {
        f"{name}_status": f"CASE WHEN {ok} THEN 'valid' ELSE 'missing_data' END",
        f"{name}_exceeded": f"CASE WHEN {ok} THEN {mm} / {d} >= {c} ELSE false END",
        f"{name}_score": f"CASE WHEN {ok} THEN {rnd(f'least(greatest({mm} / {d} / {c} / 1.5e0, 0e0), 1e0)', 4)} ELSE 0e0 END",
        f"{name}_intensity": f"CASE WHEN {ok} THEN {rnd(f'{mm} / {d}', 4)} ELSE 0e0 END",
        f"{name}_critical": c,
        f"{name}_ratio": f"CASE WHEN {ok} THEN {rnd(f'{mm} / {d} / {c}', 4)} END",
    }


H = "CASE point_id % 3 WHEN 0 THEN 24e0 WHEN 1 THEN 72e0 ELSE 0.5e0 END"


@query("rainfall_trigger", oracle("SELECT point_id, " + ", ".join(f"{e} AS {n}" for n, e in trigger_sql("mm_now", f"({H})", "t").items()) + " FROM fx_points", "fx_points"))
def rainfall_trigger(fx):
    return fx.points.select("point_id", risk.rainfall_trigger("mm_now", F.expr(H)).alias("t"))


LEVEL = lambda s: f"CASE WHEN {s} IS NULL THEN NULL WHEN {s} >= 0.85 THEN 'EXTREME' WHEN {s} >= 0.65 THEN 'HIGH' WHEN {s} >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END"


@query("warning_level", oracle(f"SELECT sample_id, {LEVEL('score')} AS level FROM (SELECT sample_id, CASE WHEN sample_id % 40 = 0 THEN NULL ELSE score END AS score FROM fx_scores)", "fx_scores"))
def warning_level(fx):
    s = F.expr("CASE WHEN sample_id % 40 = 0 THEN NULL ELSE score END")
    return fx.scores.select("sample_id", risk.warning_level(s).alias("level"))


def fused_sql(source, forecast="mm_forecast"):
    now, ahead = trigger_sql("mm_now", "24e0", "n"), trigger_sql(forecast, "72e0", "a")
    base = ", ".join(f"{e} AS {n}" for n, e in {**now, **ahead}.items())
    mult = ("1e0 + CASE WHEN n_exceeded THEN 0.4e0 ELSE 0e0 END + CASE WHEN a_exceeded THEN 0.3e0 ELSE 0e0 END"
            " + CASE WHEN slope >= 35 AND (n_exceeded OR a_exceeded) THEN 0.2e0 ELSE 0e0 END")
    s = rnd("least(greatest(susceptibility, 0e0), 1e0)", 4)
    return f"""
SELECT *, {LEVEL('final_risk_score')} AS warning_level FROM (
 SELECT *, CASE WHEN susceptibility_score IS NOT NULL THEN {rnd('least(susceptibility_score * trigger_multiplier, 1e0)', 4)} END AS final_risk_score FROM (
  SELECT *, CASE WHEN susceptibility IS NOT NULL THEN {s} END AS susceptibility_score, n_score AS current_trigger_score, {forecast} IS NOT NULL AS forecast_evaluated,
   CASE WHEN {forecast} IS NOT NULL THEN a_score END AS forecast_trigger_score, {mult} AS trigger_multiplier,
   CASE WHEN has_real_dem AND has_real_rainfall AND n_status = 'valid' THEN 'HIGH' WHEN has_real_dem THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
   CASE WHEN exposure IS NOT NULL THEN {rnd('least(greatest(exposure, 0e0), 1e0)', 4)} END AS exposure_score, CASE WHEN exposure IS NOT NULL THEN 'REAL' ELSE 'UNAVAILABLE' END AS exposure_status
  FROM (SELECT *, {base} FROM {source})))"""


FUSED_COLUMNS = ["point_id", "susceptibility_score", "current_trigger_score", "forecast_evaluated", "forecast_trigger_score",
                 "trigger_multiplier", "confidence", "exposure_score", "exposure_status", "final_risk_score", "warning_level"]


@query("risk_fusion", oracle(f"SELECT {', '.join(FUSED_COLUMNS)} FROM fused", "fx_points", fused=fused_sql("fx_points")))
def risk_fusion(fx):
    return risk.with_fused_risk(fx.points, exposure="exposure").select(*FUSED_COLUMNS)


@query("confidence", oracle("""
SELECT confidence, count(*) AS n FROM (SELECT CASE WHEN has_real_dem AND has_real_rainfall AND coalesce(mm_now >= 0, false) THEN 'HIGH' WHEN has_real_dem THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM fx_points) GROUP BY confidence""", "fx_points"))
def confidence(fx):
    status = risk.rainfall_trigger("mm_now", 24.0)["status"]
    return fx.points.groupBy(
        risk.confidence("has_real_dem", "has_real_rainfall", status).alias("confidence")
    ).agg(F.count("*").alias("n"))


Z = "CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_size * 100e0 END"


@query("landcover_proxy", oracle(f"""
SELECT p_partkey AS id, CAST(CASE WHEN z IS NULL OR isnan(z) THEN NULL WHEN z < 3000 THEN 1 WHEN z < 4200 THEN 2 ELSE 3 END AS INT) AS proxy FROM (SELECT p_partkey, {Z} AS z FROM part)"""))
def landcover_proxy(fx):
    return fx.table("part").select(F.col("p_partkey").alias("id"), landcover.proxy_class(F.expr(Z)).alias("proxy"))


@query("landcover_group", oracle("""
SELECT row_idx, col_idx, code, CASE code WHEN 10 THEN 1 WHEN 20 THEN 2 WHEN 30 THEN 2 WHEN 40 THEN 3 WHEN 50 THEN 4 WHEN 60 THEN 5 WHEN 70 THEN 5 WHEN 80 THEN 6 WHEN 90 THEN 6 WHEN 95 THEN 6 WHEN 100 THEN 2 ELSE -1 END AS land_cover_group FROM fx_landcover""", "fx_landcover"))
def landcover_group(fx):
    return fx.landcover.withColumn("land_cover_group", landcover.group_of("code"))


# --- gates ----------------------------------------------------------------------------

INPUTS = """
SELECT point_id, latitude, longitude, susceptibility, slope, mm_now, mm_forecast, exposure,
 CASE WHEN susceptibility IS NULL THEN 'UNAVAILABLE' ELSE 'REAL' END AS s_status, CASE WHEN slope IS NULL THEN 'UNAVAILABLE' ELSE 'REAL' END AS d_status,
 CASE WHEN NOT coalesce(mm_now >= 0, false) THEN 'UNAVAILABLE' WHEN has_real_rainfall THEN 'REAL' ELSE 'DERIVED_PROXY' END AS r_status,
 CASE WHEN NOT coalesce(mm_forecast >= 0, false) THEN 'UNAVAILABLE' ELSE 'REAL' END AS f_status FROM fx_points"""
NAMED = [("s_status", "susceptibility", "no usable model score"), ("d_status", "slope_deg", "no terrain sample"), ("r_status", "current_rainfall_mm", "no usable 24 h rainfall")]


def gate_sql(mode, extra=()):
    names = NAMED + list(extra)
    bad = lambda c: f"{c} NOT IN ('REAL', 'DERIVED_PROXY')"
    b = "concat_ws('; ', " + ", ".join(f"CASE WHEN {bad(c)} THEN '{n}' END" for c, n, _ in names) + ")"
    r = "concat_ws('; ', " + ", ".join(f"CASE WHEN {bad(c)} THEN '{n}: {t}' END" for c, n, t in names) + ")"
    return f"SELECT point_id, '{mode}' AS mode, {b} AS blocking_inputs, {r} AS blocking_reasons, {b} = '' AS usable FROM inputs"


@query("required_inputs_gate", oracle(
    gate_sql("current") + " UNION ALL " + gate_sql("forecast", [("f_status", "forecast_rainfall_mm", "no usable forecast")]), "fx_points", inputs=INPUTS))
def required_inputs_gate(fx):
    records = risk_points.input_records(fx.points)
    parts = [risk_points.gate(records, mode).select("point_id", F.lit(mode).alias("mode"), "blocking_inputs", "blocking_reasons", "usable") for mode in ("current", "forecast")]
    return parts[0].unionByName(parts[1])


@query("input_record", oracle("""
SELECT point_id, 'current_rainfall_mm' AS rec_name, r_status AS rec_status, CASE WHEN r_status IN ('REAL', 'DERIVED_PROXY') THEN mm_now END AS rec_value,
 CASE WHEN r_status = 'UNAVAILABLE' THEN 'no usable 24 h rainfall' ELSE '' END AS rec_reasons FROM inputs""", "fx_points", inputs=INPUTS))
def input_record(fx):
    record = risk_points.rainfall_record()
    return fx.points.select("point_id", record.alias("r")).select(
        "point_id", F.col("r.name").alias("rec_name"), F.col("r.status").alias("rec_status"), F.col("r.value").alias("rec_value"), F.col("r.reasons").alias("rec_reasons")
    )


RISK_COLUMNS = ["point_id", "mode", "usable", "blocking_reasons", "final_risk_score", "warning_level", "confidence"]
RISK_SQL = """
SELECT g.point_id, g.mode, g.usable, g.blocking_reasons, CASE WHEN usable THEN f.final_risk_score END AS final_risk_score, CASE WHEN usable THEN f.warning_level END AS warning_level, CASE WHEN usable THEN f.confidence END AS confidence
FROM (%s) g JOIN %s f ON f.point_id = g.point_id"""


@query("current_and_forecast_risk", oracle(
    RISK_SQL % (gate_sql("current"), "now_only") + " UNION ALL " + RISK_SQL % (gate_sql("forecast", [("f_status", "forecast_rainfall_mm", "no usable forecast")]), "fused_both"),
    "fx_points", inputs=INPUTS,
    pts="SELECT * REPLACE (slope IS NOT NULL AS has_real_dem, has_real_rainfall AND coalesce(mm_now >= 0, false) AS has_real_rainfall), CAST(NULL AS DOUBLE) AS none FROM fx_points",
    now_only=fused_sql("pts", "none"), fused_both=fused_sql("pts")))
def current_and_forecast_risk(fx):
    return risk_points.current_and_forecast_risk(fx.points).select(*RISK_COLUMNS)


@query("rain_coupling_guard", oracle("""
SELECT run_id, concat_ws('; ', CASE WHEN len(rain) > 0 THEN 'rainfall-coupled: ' || array_to_string(rain, ', ') END, CASE WHEN len(odd) > 0 THEN 'unsupported: ' || array_to_string(odd, ', ') END) AS refusals
FROM (SELECT run_id, list_sort(list_distinct(list_filter(feature_names, lambda n: n LIKE '%rain%'))) AS rain, list_sort(list_distinct(list_filter(feature_names, lambda n: n = 'ndvi'))) AS odd FROM fx_runs)""", "fx_runs"))
def rain_coupling_guard(fx):
    return fx.runs.select("run_id", risk.fusion_input_guard("feature_names").alias("refusals"))


# --- provenance ---------------------------------------------------------------------------

PROV = """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'IMERG_Early' WHEN 1 THEN 'Open-Meteo ERA5 archive (FALLBACK)' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'gauge' END AS source,
 CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'IMERG' END WHEN 1 THEN 'OPEN_METEO_FALLBACK' WHEN 2 THEN 'IMERG' WHEN 3 THEN NULL ELSE 'GAUGE' END AS source_kind,
 CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'FALLBACK' WHEN 2 THEN 'UNAVAILABLE' WHEN 3 THEN CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE 'REAL' END ELSE NULL END AS data_quality_status,
 CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey % 2 = 0 END AS is_fallback,
 CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS requested_date,
 CASE WHEN o_orderkey % 5 = 4 THEN '2024-01-09' END AS target_date, CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE 'mm' END AS units FROM {orders}"""
PROV_DUCK = PROV.format(orders="orders")


def provenance_rows(fx):
    return fx.sql(PROV)


@query("provenance_tone", oracle("""
SELECT id, CASE WHEN coalesce(is_fallback, false) OR data_quality_status = 'FALLBACK' OR source_kind = 'OPEN_METEO_FALLBACK' THEN 'fallback' WHEN data_quality_status = 'UNAVAILABLE' THEN 'unavailable'
  WHEN data_quality_status = 'REAL' OR source_kind = 'IMERG' THEN 'real' ELSE 'unreported' END AS tone,
 CASE WHEN data_quality_status = 'UNAVAILABLE' THEN 'unavailable' WHEN data_quality_status = 'FALLBACK' OR source_kind = 'OPEN_METEO_FALLBACK' THEN 'fallback'
  WHEN data_quality_status = 'REAL' AND source_kind = 'IMERG' THEN 'real' ELSE 'unreported' END AS live_tone FROM prov""", prov=PROV_DUCK))
def provenance_tone(fx):
    live_kind = F.when(F.col("source_kind") == "IMERG", "IMERG_HHR_EARLY").otherwise(F.col("source_kind"))
    return provenance_rows(fx).select(
        "id", prov.rain_tone("is_fallback", "data_quality_status", "source_kind").alias("tone"),
        prov.live_tone("data_quality_status", live_kind).alias("live_tone"),
    )


@query("source_label", oracle("""
SELECT id, CASE WHEN coalesce(is_fallback, false) THEN 'earlier rain: stand-in series ' || coalesce(source, 'Open-Meteo ERA5 archive') || ', quality ' || coalesce(data_quality_status, 'FALLBACK') || ', no satellite product'
 WHEN source_kind = 'IMERG' OR (source_kind IS NULL AND source IS NOT NULL) THEN 'earlier rain: satellite product ' || coalesce(source, 'IMERG')
 WHEN source_kind IS NOT NULL THEN 'earlier rain: ' || coalesce(source, source_kind) || ', quality ' || coalesce(data_quality_status, 'UNKNOWN')
 ELSE 'earlier rain: origin not stated' END AS label FROM prov""", prov=PROV_DUCK))
def source_label(fx):
    return provenance_rows(fx).select("id", prov.source_label("source", "source_kind", "data_quality_status", "is_fallback").alias("label"))


@query("provenance_block", oracle(f"""
SELECT id, CASE WHEN any_set THEN source END AS block_source, CASE WHEN any_set THEN source_kind END AS block_source_kind, CASE WHEN any_set THEN coalesce(is_fallback, false) END AS block_is_fallback,
 CASE WHEN any_set THEN data_quality_status END AS block_data_quality_status, CASE WHEN any_set THEN requested_date END AS block_requested_date, CASE WHEN any_set THEN target_date END AS block_rainfall_observation_date,
 CAST(NULL AS STRING) AS block_fetched_at_utc, CASE WHEN any_set THEN units END AS block_units, CASE WHEN is_fallback THEN '{vocab.FALLBACK_WARNING}' END AS block_fallback_warning
FROM (SELECT *, coalesce(source, source_kind, data_quality_status, requested_date, target_date, units) IS NOT NULL OR is_fallback IS NOT NULL AS any_set FROM prov)""", prov=PROV_DUCK))
def provenance_block(fx):
    rows = provenance_rows(fx)
    return rows.select("id", prov.provenance_block(rows.columns).alias("block"))


@query("rainfall_view", oracle("""
SELECT id, source AS view_source, source_kind AS view_source_kind, is_fallback AS view_is_fallback, data_quality_status AS view_data_quality_status, units AS view_units, requested_date AS view_requested_date FROM prov""", prov=PROV_DUCK))
def rainfall_view(fx):
    kept = ["source", "source_kind", "is_fallback", "data_quality_status", "requested_date", "units"]
    record = F.struct(*kept, F.array(F.lit(1.0), F.lit(2.0)).alias("daily_series_mm"), F.lit(3.0).alias("features"))
    fields = kept + ["daily_series_mm", "features"]
    return provenance_rows(fx).select("id", record.alias("rainfall")).select("id", prov.rain_view("rainfall", fields).alias("view"))


WORDS = ["VALIDATED_PILOT", "DATA UNAVAILABLE", "Available", "Unavailable (auth missing)", "Missing (Requires Download)", "Trained & Validated", "Not Trained", "DERIVED_PROXY", "pending review", "VALIDATION IN PROGRESS", "unknown", "OK"]
WORD = "CASE s_suppkey % 13 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " ELSE NULL END"


@query("status_tone", oracle(f"""
SELECT id, word, CASE WHEN regexp_matches(w, 'MISSING|UNAVAILABLE|FAIL|ERROR|ABSENT|NONE|NOT[_ ]|INVALID|INCOMPLETE') THEN 'bad' WHEN regexp_matches(w, 'READY|COMPLETE|AVAILABLE|PRESENT|VALID|TRAINED|PASS|REAL|OK\\b') THEN 'good'
 WHEN regexp_matches(w, 'PROXY|DERIVED|PARTIAL|PENDING|LIMITED|LOW') THEN 'partial' ELSE 'neutral' END AS tone, CASE WHEN contains(w, 'VALIDATED_PILOT') THEN 'pilot' ELSE 'pending' END AS region_tone
FROM (SELECT s_suppkey AS id, {WORD} AS word, upper(coalesce({WORD}, '')) AS w FROM supplier)"""))
def status_tone(fx):
    rows = fx.table("supplier").select(F.col("s_suppkey").alias("id"), F.expr(WORD).alias("word"))
    return rows.select("id", "word", prov.status_tone("word").alias("tone"), prov.region_tone("word").alias("region_tone"))


@query("scored_cells", oracle("""
SELECT sample_id, scored, CASE WHEN scored THEN probability END AS probability, CASE WHEN scored THEN risk_class END AS risk_class FROM (SELECT *, status = 'OK' AND risk_class IS NOT NULL AND probability IS NOT NULL AS scored FROM (
 SELECT sample_id, CASE WHEN sample_id % 9 = 0 THEN 'UNAVAILABLE' ELSE 'OK' END AS status, CASE WHEN sample_id % 8 = 0 THEN NULL ELSE score END AS probability, CASE WHEN sample_id % 7 = 0 THEN NULL WHEN score >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS risk_class FROM fx_scores))""", "fx_scores"))
def scored_cells(fx):
    from scarpline.plans import grid

    cells = fx.sql("""SELECT sample_id, CASE WHEN sample_id % 9 = 0 THEN 'UNAVAILABLE' ELSE 'OK' END AS status, CASE WHEN sample_id % 8 = 0 THEN NULL ELSE score END AS probability,
      CASE WHEN sample_id % 7 = 0 THEN NULL WHEN score >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS risk_class FROM {scores}""", scores=fx.scores)
    return grid.scored_cells(cells).select("sample_id", "scored", "probability", "risk_class")


