"""Rainfall windows, completeness, probes, ladders and landed documents."""

import datetime

from pyspark.sql import functions as F

from scarpline.functions import provenance as prov
from scarpline.operators import rainfall
from scarpline.session import scratch_path
from scarpline.sources import rain_documents

from . import q_places
from .fixtures import oracle, rnd, with_rain_key
from .registry import query

CENTS = "CAST(round(mm * 1e2) AS BIGINT)"


def cents(days, extra="true"):
    return f"CAST(sum({CENTS}) FILTER (WHERE k <= {days} AND {extra}) AS DOUBLE) / 1e2"


def window_sql(requests, key="cell_id", date="target_day", source="fx_rain_daily"):
    """Antecedent features of (key, date) requests, brute force in SQL."""
    ok = "n = 14"
    return f"""
SELECT {key}, {date}, n AS days_present, CASE WHEN {ok} THEN r1 END AS rain_1d, CASE WHEN {ok} THEN r3 END AS rain_3d, CASE WHEN {ok} THEN r7 END AS rain_7d,
 CASE WHEN {ok} THEN r14 END AS antecedent_rain_14d, CASE WHEN {ok} THEN rm END AS rain_intensity_max_3d, CASE WHEN {ok} THEN 'REAL' ELSE 'UNAVAILABLE' END AS rain_status,
 CASE WHEN {ok} THEN '' ELSE CAST(n AS STRING) || ' of 14 antecedent days observed' END AS rain_reasons
FROM (SELECT {key}, {date}, count(mm) AS n, {cents(1)} AS r1, {cents(3)} AS r3, {cents(7)} AS r7, {cents(14)} AS r14, max(mm) FILTER (WHERE k <= 3) AS rm
 FROM (SELECT q.{key}, q.{date}, d.mm, date_diff('day', d.day, q.{date}) AS k FROM (SELECT DISTINCT {key}, {date} FROM {requests}) q
  LEFT JOIN {source} d ON d.cell_id = q.{key} AND date_diff('day', d.day, q.{date}) BETWEEN 1 AND 14) GROUP BY {key}, {date})"""


FEATURE_COLUMNS = ["days_present", "rain_1d", "rain_3d", "rain_7d", "antecedent_rain_14d", "rain_intensity_max_3d", "rain_status", "rain_reasons"]


@query("antecedent_features", oracle(
    f"SELECT cell_id, strftime(day, '%Y-%m-%d') AS day, {', '.join(FEATURE_COLUMNS)} FROM w",
    "fx_rain_daily", w=window_sql("fx_rain_daily", date="day")))
def antecedent_features(fx):
    return rainfall.antecedent_features(fx.rain_daily, chunk=16)


# Every fifth cell reports one day twice and lacks the day after: neither counts as observed.
DOUBLED = """
SELECT cell_id, day, mm FROM {d} WHERE NOT (cell_id % 5 = 0 AND day = DATE '2024-01-09') UNION ALL SELECT cell_id, day, mm + 1e0 FROM {d} WHERE cell_id % 5 = 0 AND day = DATE '2024-01-08'"""
ONCE = "SELECT cell_id, day, CASE WHEN count(*) = 1 THEN min(mm) END AS mm, count(*) > 1 AS twice FROM doubled GROUP BY cell_id, day"


@query("repeated_days", oracle(
    f"SELECT w.cell_id, strftime(w.day, '%Y-%m-%d') AS day, {', '.join('w.' + c for c in FEATURE_COLUMNS[:-1])}, coalesce(bool_or(o.twice), false) AS repeated FROM w LEFT JOIN once o ON o.cell_id = w.cell_id AND date_diff('day', o.day, w.day) BETWEEN 1 AND 14 GROUP BY ALL",
    "fx_rain_daily", doubled=DOUBLED.format(d="fx_rain_daily"), once=ONCE, w=window_sql("once", date="day", source="once")))
def repeated_days(fx):
    rows = rainfall.antecedent_features(fx.sql(DOUBLED, d=fx.rain_daily), chunk=16)
    return rows.select("cell_id", "day", *FEATURE_COLUMNS[:-1], F.array_contains("rain_reasons", rainfall.REPEATED).alias("repeated"))


def inclusive(n):
    return f"CASE WHEN count(mm) FILTER (WHERE k < {n}) = {n} THEN {rnd(f'CAST(sum({CENTS}) FILTER (WHERE k < {n}) AS DOUBLE) / 1e2', 4)} END AS accumulation_{n}d_mm"


@query("inclusive_accumulations", oracle(f"""
SELECT cell_id, strftime(day, '%Y-%m-%d') AS day, {inclusive(1)}, {inclusive(3)}, {inclusive(7)} FROM (SELECT a.cell_id, a.day, b.mm, date_diff('day', b.day, a.day) AS k
 FROM fx_rain_daily a JOIN fx_rain_daily b ON a.cell_id = b.cell_id AND date_diff('day', b.day, a.day) BETWEEN 0 AND 6) GROUP BY cell_id, day""", "fx_rain_daily"))
def inclusive_accumulations(fx):
    return rainfall.inclusive_accumulations(fx.rain_daily, chunk=16)


EVENT_KEYS = "SELECT event_id, CAST(event_id % 30 AS INT) AS cell_id, CASE WHEN event_id % 43 = 0 THEN NULL ELSE DATE '2024-01-15' + CAST(event_id % 14 AS INT) END AS target_day FROM fx_events"


@query("event_rainfall_join", oracle(f"""
SELECT e.event_id, e.cell_id, strftime(e.target_day, '%Y-%m-%d') AS target_day, {', '.join('w.' + c for c in FEATURE_COLUMNS[:-2])}, coalesce(w.rain_status, 'UNAVAILABLE') AS rain_status, coalesce(w.rain_reasons, 'no usable date') AS rain_reasons
FROM ev e LEFT JOIN w ON w.cell_id = e.cell_id AND w.target_day = e.target_day""", "fx_events", "fx_rain_daily", ev=EVENT_KEYS, w=window_sql("(SELECT * FROM ev WHERE target_day IS NOT NULL)")))
def event_rainfall_join(fx):
    keyed = with_rain_key(fx.events.select("event_id")).withColumn("target_day", F.expr("CASE WHEN event_id % 43 = 0 THEN NULL ELSE target_day END"))
    return rainfall.event_rainfall_join(keyed, fx.rain_daily)


GRID_CELLS = """
SELECT a.state, CAST(la.v AS INT) AS lat_idx, CAST(lo.v AS INT) AS lon_idx FROM fx_aoi a, (SELECT unnest(range(1000, 1300)) AS v) la, (SELECT unnest(range(2600, 2900)) AS v) lo
WHERE a.kind = 'pilot' AND la.v BETWEEN round_even((a.min_lat + 89.95e0) * 10e0, 0) AND round_even((a.max_lat + 89.95e0) * 10e0, 0) AND lo.v BETWEEN round_even((a.min_lon + 179.95e0) * 10e0, 0) AND round_even((a.max_lon + 179.95e0) * 10e0, 0)"""


# Months stand for days and halves of the cells for runs, so that one partition has rows.
RUN_OF_CELL = "CASE WHEN (lat_idx + lon_idx) % 2 = 0 THEN 'Early' ELSE 'Late' END"


@query("precip_grid_scan", oracle(f"""
SELECT g.lat_idx, g.lon_idx, '1995-03-01' AS day, 'Early' AS run_type, g.precip, c.state FROM fx_precip_grid g JOIN cells c USING (lat_idx, lon_idx) WHERE date_trunc('month', g.day) = DATE '1995-03-01' AND {RUN_OF_CELL} = 'Early'""", "fx_precip_grid", cells=GRID_CELLS))
def precip_grid_scan(fx):
    """Written in partitions of run and day, then one run and one day of it read."""
    path = scratch_path(fx.spark, "precip-grid")
    months = fx.precip_grid.withColumns({"day": F.trunc("day", "month"), "run_type": F.expr(RUN_OF_CELL)})
    rain_documents.write_precip_grid(months, path)
    stored = fx.spark.read.schema(rain_documents.PRECIP_SCHEMA).parquet(path)
    return rainfall.precip_grid_scan(stored, fx.pilots, day=datetime.date(1995, 3, 1), run_type="Early")


VALID = "isfinite(precip) AND precip > -100"


@query("aoi_mean_precip", oracle(f"""
SELECT state, strftime(day, '%Y-%m-%d') AS day, count(*) AS cells, count(*) FILTER (WHERE {VALID}) AS valid_cells,
 CASE WHEN count(*) FILTER (WHERE {VALID}) > 0 THEN greatest(CAST(sum(CASE WHEN {VALID} THEN CAST(round(precip * 1e2) AS BIGINT) END) AS DOUBLE) / 1e2 / count(*) FILTER (WHERE {VALID}), 0e0) END AS mean_mm,
 CASE WHEN count(*) FILTER (WHERE {VALID}) > 0 THEN 'REAL' ELSE 'UNAVAILABLE' END AS status, CASE WHEN count(*) FILTER (WHERE {VALID}) > 0 THEN '' ELSE 'no valid precipitation cell' END AS reasons
FROM (SELECT c.state, g.day, g.precip FROM fx_precip_grid g JOIN cells c USING (lat_idx, lon_idx)) GROUP BY state, day""", "fx_precip_grid", cells=GRID_CELLS))
def aoi_mean_precip(fx):
    return rainfall.aoi_mean_precip(fx.precip_grid, fx.pilots, ["day"])


SPOILT = """
SELECT cell_id, day, CASE WHEN cell_id = 3 AND day = DATE '2024-01-10' THEN CAST('NaN' AS DOUBLE) WHEN cell_id = 4 AND day = DATE '2024-01-11' THEN -5e0 WHEN cell_id = 5 AND day = DATE '2024-01-12' THEN NULL ELSE mm END AS mm
FROM {d} WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-18'"""


@query("series_validate", oracle("""
SELECT *, CASE WHEN reasons = '' THEN 'VALID' ELSE 'REFUSED' END AS status FROM (SELECT cell_id, n AS days, f AS non_finite, g AS negative,
 concat_ws('; ', CASE WHEN n <> 14 THEN CAST(n AS STRING) || ' of 14 days returned' END, CASE WHEN f > 0 THEN 'a day is missing or not finite' END, CASE WHEN g > 0 THEN 'a day is negative' END) AS reasons
 FROM (SELECT cell_id, count(*) AS n, count(*) FILTER (WHERE mm IS NULL OR isnan(mm)) AS f, count(*) FILTER (WHERE mm < 0) AS g FROM s GROUP BY cell_id))""", "fx_rain_daily", s=SPOILT.format(d="fx_rain_daily")))
def series_validate(fx):
    return rainfall.series_validate(fx.sql(SPOILT, d=fx.rain_daily), ["cell_id"])


@query("rainfall_features_validate", oracle("""
SELECT cell_id, strftime(day, '%Y-%m-%d') AS day, concat_ws('; ', CASE WHEN rain_1d IS NULL THEN 'rain_1d' END, CASE WHEN rain_3d IS NULL THEN 'rain_3d' END, CASE WHEN rain_7d IS NULL THEN 'rain_7d' END,
 CASE WHEN rain_14d IS NULL THEN 'antecedent_rain_14d' END, CASE WHEN rain_3d IS NULL THEN 'rain_intensity_max_3d' END) AS refused
FROM (SELECT *, CASE WHEN n = 14 AND cell_id <> 2 THEN 1 END AS rain_1d, CASE WHEN n = 14 THEN 1 END AS rain_3d, CASE WHEN n = 14 THEN 1 END AS rain_7d, CASE WHEN n = 14 AND cell_id <> 9 THEN 1 END AS rain_14d FROM (SELECT cell_id, day, days_present AS n FROM w))""",
    "fx_rain_daily", w=window_sql("fx_rain_daily", date="day")))
def rainfall_features_validate(fx):
    from scarpline import vocab

    rows = rainfall.antecedent_features(fx.rain_daily).withColumns({
        "rain_1d": F.expr("CASE WHEN cell_id = 2 THEN CAST('NaN' AS DOUBLE) ELSE rain_1d END"),
        "antecedent_rain_14d": F.expr("CASE WHEN cell_id = 9 THEN CAST('Infinity' AS DOUBLE) ELSE antecedent_rain_14d END"),
    })
    return rows.select("cell_id", "day", prov.non_finite_names(vocab.RAIN_FEATURES).alias("refused"))


FORECAST = "SELECT user_id % 500 AS point_id, event_id, ts AS time, CASE WHEN user_id % 11 = 3 OR event_id % 9 = 0 THEN NULL ELSE value END AS mm FROM {e}"


@query("forecast_accumulation", oracle("""
SELECT point_id, count(mm) AS finite_hours, CASE WHEN count(mm) > 0 THEN greatest(CAST(sum(CAST(round(mm * 1e2) AS BIGINT)) AS DOUBLE) / 1e2, 0e0) END AS forecast_mm, CASE WHEN count(mm) > 0 THEN 'REAL' ELSE 'UNAVAILABLE' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY time) AS rn FROM f WHERE time > TIMESTAMP '2024-01-20 12:10:00') WHERE rn <= 12 GROUP BY point_id""", f=FORECAST.format(e="events")))
def forecast_accumulation(fx):
    hourly = fx.sql(FORECAST.replace("{e}", "{events}")).drop("event_id")
    return rainfall.forecast_accumulation(hourly, "point_id", F.expr("TIMESTAMP_NTZ '2024-01-20 12:10:00'"), hours=12)


# --- probes and ladder ----------------------------------------------------------------

REQUESTS = """
SELECT DISTINCT CAST(o_orderkey % 30 AS INT) AS cell_id, DATE '2024-01-10' + CAST(o_orderkey % 25 AS INT) AS target_day,
 CASE o_orderkey % 3 WHEN 0 THEN 'Early' WHEN 1 THEN 'Late' ELSE 'Final' END AS run_type, CASE WHEN o_orderkey % 4 = 0 THEN DATE '2024-01-29' WHEN o_orderkey % 4 = 1 THEN DATE '2024-06-01' ELSE DATE '2024-02-02' END AS now_day FROM {orders}"""
HOLES = "SELECT * FROM {d} WHERE NOT (cell_id = 11 AND day BETWEEN DATE '2024-01-20' AND DATE '2024-01-25') AND NOT (cell_id = 12 AND day > DATE '2024-01-02')"
PLAN = """
SELECT *, CASE WHEN first_offset > 30 THEN first_offset - 1 WHEN recent THEN least(first_offset + 2, 30) ELSE 30 END AS last_offset FROM (
 SELECT *, greatest(1, CASE run_type WHEN 'Final' THEN 105 ELSE 1 END - date_diff('day', target_day, now_day)) AS first_offset, date_diff('day', target_day, now_day) <= 2 AS recent FROM req)"""


@query("probe_window_asof", oracle("""
SELECT cell_id, strftime(target_day, '%Y-%m-%d') AS target_day, run_type, strftime(now_day, '%Y-%m-%d') AS now_day, CAST(first_offset AS INT) AS first_offset, CAST(last_offset AS INT) AS last_offset, CASE WHEN recent THEN 'NEAR_REAL_TIME' ELSE 'HISTORICAL' END AS probe_mode,
 strftime(obs, '%Y-%m-%d') AS observation_day, CAST(date_diff('day', obs, target_day) AS INT) AS observation_lag_days, CASE WHEN n = 14 THEN r1 END AS rain_1d, CASE WHEN n = 14 THEN r14 END AS antecedent_rain_14d, CASE WHEN n = 14 THEN 'OK' ELSE 'FAILED' END AS status,
 CASE WHEN last_offset < first_offset THEN 'nothing can be published within the probe reach' WHEN obs IS NULL THEN 'no observation in the candidate days' WHEN n < 14 THEN CAST(n AS STRING) || ' of 14 window days observed' ELSE '' END AS reasons
FROM (SELECT p.*, o.obs, (SELECT count(*) FROM holes h WHERE h.cell_id = p.cell_id AND h.day BETWEEN o.obs - 13 AND o.obs) AS n, (SELECT max(mm) FROM holes h WHERE h.cell_id = p.cell_id AND h.day = o.obs) AS r1,
  (SELECT CAST(sum(CAST(round(mm * 1e2) AS BIGINT)) AS DOUBLE) / 1e2 FROM holes h WHERE h.cell_id = p.cell_id AND h.day BETWEEN o.obs - 13 AND o.obs) AS r14
 FROM plan p JOIN (SELECT p.cell_id, p.target_day, p.run_type, p.now_day, max(h.day) AS obs FROM plan p LEFT JOIN holes h ON h.cell_id = p.cell_id AND date_diff('day', h.day, p.target_day) BETWEEN p.first_offset AND p.last_offset GROUP BY ALL) o USING (cell_id, target_day, run_type, now_day))""",
    "fx_rain_daily", req=REQUESTS.format(orders="orders"), holes=HOLES.format(d="fx_rain_daily"), plan=PLAN))
def probe_window_asof(fx):
    return rainfall.probe_window_asof(fx.sql(REQUESTS), fx.sql(HOLES, d=fx.rain_daily))


LADDER_REQ = "SELECT DISTINCT CAST(o_orderkey % 30 AS INT) AS cell_id, DATE '2024-01-15' + CAST(o_orderkey % 14 AS INT) AS target_day FROM {orders}"
PRIMARY = "SELECT * FROM {d} WHERE NOT (cell_id % 3 = 0 AND day > DATE '2024-01-08')"
FALLBACK = "SELECT cell_id, day, mm + 0.25e0 AS mm FROM {d} WHERE cell_id % 6 <> 0"
PICK = lambda c: f"CASE WHEN p.n = 14 THEN p.{c} WHEN f.n = 14 THEN f.{c} END"


@query("source_ladder", oracle(f"""
SELECT cell_id, strftime(target_day, '%Y-%m-%d') AS target_day, CASE WHEN p.n = 14 THEN 'IMERG_Early' WHEN f.n = 14 THEN 'Open-Meteo ERA5 archive (FALLBACK)' END AS source, CASE WHEN p.n = 14 THEN 'IMERG' WHEN f.n = 14 THEN 'OPEN_METEO_FALLBACK' END AS source_kind,
 p.n <> 14 AND f.n = 14 AS is_fallback, CASE WHEN p.n = 14 THEN 'REAL' WHEN f.n = 14 THEN 'FALLBACK' ELSE 'UNAVAILABLE' END AS data_quality_status, {PICK('rain_1d')} AS rain_1d, {PICK('antecedent_rain_14d')} AS antecedent_rain_14d,
 CAST(CASE WHEN p.n = 14 THEN 1 ELSE 2 END AS INT) AS attempts, CASE WHEN p.n <> 14 AND f.n <> 14 THEN 'IMERG: ' || p.rain_reasons || '; OPEN_METEO_FALLBACK: ' || f.rain_reasons END AS unavailable_reason
FROM (SELECT *, days_present AS n FROM pw) p JOIN (SELECT *, days_present AS n FROM fw) f USING (cell_id, target_day)""",
    "fx_rain_daily", req=LADDER_REQ.format(orders="orders"), pri=PRIMARY.format(d="fx_rain_daily"), fal=FALLBACK.format(d="fx_rain_daily"), pw=window_sql("req", source="pri"), fw=window_sql("req", source="fal")))
def source_ladder(fx):
    asked, ids = fx.sql(LADDER_REQ), ["cell_id", "target_day"]
    primary = rainfall.antecedent_for(asked, fx.sql(PRIMARY, d=fx.rain_daily))
    fallback = rainfall.antecedent_for(asked, fx.sql(FALLBACK, d=fx.rain_daily))
    return rainfall.source_ladder(asked, primary, fallback, ids).select(
        *ids, "source", "source_kind", "is_fallback", "data_quality_status", "rain_1d", "antecedent_rain_14d", F.size("attempts").alias("attempts"), "unavailable_reason"
    )


AREA_RAIN = "SELECT CASE cell_id % 4 WHEN 0 THEN 'Sikkim' WHEN 1 THEN 'Assam' WHEN 2 THEN 'Meghalaya' ELSE 'Nagaland' END AS state, day, avg_cents FROM (SELECT cell_id % 4 AS cell_id, day, CAST(SUM(CAST(ROUND(mm*1e2) AS BIGINT)) AS DOUBLE)/1e2 AS avg_cents FROM {d} GROUP BY cell_id % 4, day)"


@query("aoi_rain_broadcast", oracle("""
SELECT e.event_id, e.state, r.mm FROM (SELECT a.state, f.event_id FROM fx_aoi a JOIN fx_events f ON f.latitude BETWEEN a.min_lat AND a.max_lat AND f.longitude BETWEEN a.min_lon AND a.max_lon WHERE a.kind = 'pilot') e
LEFT JOIN (SELECT state, avg_cents AS mm FROM area WHERE day = DATE '2024-01-10') r ON r.state = e.state""", "fx_events", "fx_rain_daily", area=AREA_RAIN.format(d="fx_rain_daily")))
def aoi_rain_broadcast(fx):
    from .q_catalog import pilot_events

    rain = fx.sql(AREA_RAIN, d=fx.rain_daily).where("day = DATE '2024-01-10'").select("state", F.col("avg_cents").alias("mm"))
    return rainfall.aoi_rain_broadcast(pilot_events(fx).select("event_id", "state"), rain)


# --- live slots -----------------------------------------------------------------------

NOW = "2024-01-20 12:10:00"
now = lambda: F.expr(f"TIMESTAMP_NTZ '{NOW}'")


@query("latest_granule_asof", oracle(f"""
SELECT aoi, strftime(max(slot), '%Y-%m-%d %H:%M:%S') AS latest_slot FROM fx_slots WHERE slot <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY aoi""", "fx_slots"))
def latest_granule_asof(fx):
    return rainfall.latest_granule_asof(fx.slots, ["aoi"], now())


# Every area at every asked moment: runs differ in length where slots are missing.
MOMENTS = "SELECT s.aoi, s.slot, s.mm, m.moment FROM {s} s JOIN (SELECT DISTINCT aoi, slot AS moment FROM {s}) m ON m.aoi = s.aoi WHERE s.slot <= m.moment AND s.slot > m.moment - INTERVAL 360 MINUTE"
RUNS = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi, moment ORDER BY slot DESC) - 1 AS back FROM m) WHERE slot = moment - to_minutes(30 * back)"""


def moments(fx):
    """(area, moment) pairs with the slots of the six hours up to the moment."""
    slots = fx.slots.select("aoi", "slot", "mm")
    ahead = F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.timestamp_add("MINUTE", (k * 30).cast("int"), F.col("slot"))))
    asked = slots.select("aoi", F.col("slot").alias("moment"))
    return slots.withColumn("moment", ahead).join(asked, ["aoi", "moment"])


@query("contiguous_run", oracle("SELECT aoi, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, mm, CAST(back AS INT) AS steps_back FROM r", "fx_slots", m=MOMENTS.format(s="fx_slots"), r=RUNS))
def contiguous_run(fx):
    return rainfall.contiguous_run(moments(fx), ["aoi", "moment"], F.col("moment")).select("aoi", "moment", "slot", "mm", "steps_back")


def total_sql(h, k):
    short = f"'incomplete window: ' || CAST(count(*) AS STRING) || ' of {k} contiguous 30-minute intervals, so a {h} h total would be partial'"
    return (f"CASE WHEN count(*) >= {k} THEN {rnd(f'CAST(sum(CAST(round_even(mm * 1e6, 0) AS BIGINT)) FILTER (WHERE back < {k}) AS DOUBLE) / 1e6', 4)} END AS accum_{h}h_mm, "
            f"CASE WHEN count(*) < {k} THEN {short} END AS accum_{h}h_reason")


@query("complete_accumulation", oracle(f"""
SELECT aoi, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, strftime(max(slot), '%Y-%m-%d %H:%M:%S') AS observed_at, count(*) AS intervals, {rnd('max(mm) FILTER (WHERE back = 0)', 4)} AS latest_mm, {total_sql(3, 6)}, {total_sql(6, 12)} FROM r GROUP BY aoi, moment""", "fx_slots", m=MOMENTS.format(s="fx_slots"), r=RUNS))
def complete_accumulation(fx):
    run = rainfall.contiguous_run(moments(fx), ["aoi", "moment"], F.col("moment"))
    return rainfall.complete_accumulation(run, ["aoi", "moment"])


# --- landed documents ---------------------------------------------------------------------

@query("daily_archive_parse", oracle("""
SELECT v.cell_id, v.status, v.reasons, CASE WHEN v.status = 'OK' THEN v.n END AS days, CASE WHEN v.status = 'OK' THEN v.total END AS total_mm FROM (
 SELECT cell_id, n, total, CASE WHEN cell_id % 10 = 3 THEN 'time and value arrays do not match' ELSE concat_ws('; ', CASE WHEN n < 14 THEN CAST(14 - n AS STRING) || ' day(s) not returned' END, CASE WHEN cell_id % 10 = 4 AND spoilt > 0 THEN '1 day(s) null or not finite' END) END AS reasons,
  CASE WHEN cell_id % 10 = 3 OR n < 14 OR (cell_id % 10 = 4 AND spoilt > 0) THEN 'REFUSED' ELSE 'OK' END AS status
 FROM (SELECT cell_id, count(*) FILTER (WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-28') AS n, count(*) FILTER (WHERE day = DATE '2024-01-20') AS spoilt, CAST(sum(CAST(round(mm * 1e2) AS BIGINT)) FILTER (WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-28') AS DOUBLE) / 1e2 AS total FROM fx_rain_daily GROUP BY cell_id)) v""", "fx_rain_daily"))
def daily_archive_parse(fx):
    # One row per cell and day, so a payload is bounded by the days of the month.
    packed = fx.rain_daily.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("day", "mm"))).alias("s"))
    value = lambda x: F.when((F.col("cell_id") % 10 == 4) & (x["day"] == F.lit("2024-01-20").cast("date")), F.lit(None).cast("double")).otherwise(x["mm"])
    values = F.transform("s", value)
    cut = F.when(F.col("cell_id") % 10 == 3, F.slice(values, F.lit(1), F.size("s") - 1)).otherwise(values)
    payload = F.to_json(F.struct(F.struct(
        F.transform("s", lambda x: F.date_format(x["day"], "yyyy-MM-dd")).alias("time"), cut.alias("precipitation_sum")).alias("daily")))
    docs = packed.select("cell_id", payload.alias("payload"))
    series, verdicts = rain_documents.daily_archive_parse(docs, "cell_id", F.lit("2024-01-28").cast("date"))
    totals = series.groupBy("cell_id").agg(F.count("*").alias("days"), (F.sum(F.rint(F.col("mm") * 100).cast("long")) / 100.0).alias("total_mm"))
    return verdicts.join(totals, "cell_id", "left")


@query("hourly_parse", oracle("""
SELECT aoi, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, CASE WHEN slot_no % 11 = 5 THEN 0e0 ELSE mm END AS mm FROM (SELECT *, date_diff('minute', TIMESTAMP '2024-01-01', slot) // 30 AS slot_no FROM fx_slots)
WHERE slot <= TIMESTAMP '2024-01-20 12:00:00' AND slot_no % 7 <> 3 AND slot_no % 13 <> 2 AND slot_no % 17 <> 4""", "fx_slots"))
def hourly_parse(fx):
    n = F.timestamp_diff("MINUTE", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), F.col("slot")) / 30
    value = F.when(n % 7 == 3, F.lit(None).cast("string")).when(n % 13 == 2, "x").when(n % 11 == 5, "-1.5").otherwise(F.col("mm").cast("string"))
    stamp = F.when(n % 17 == 4, "soon").otherwise(F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss"))
    # At most 48 slots per area and day.
    docs = fx.slots.withColumns({"n": n, "v": value, "t": stamp}).groupBy("aoi", F.to_date("slot").alias("d")).agg(
        F.collect_list(F.struct("t", "v")).alias("s"))
    payload = F.to_json(F.struct(F.struct(
        F.transform("s", lambda x: x["t"]).alias("time"), F.transform("s", lambda x: x["v"]).alias("precipitation")).alias("hourly")))
    return rain_documents.hourly_parse(docs.select("aoi", payload.alias("payload")), ["aoi"], now())


@query("granule_listing", oracle("""
SELECT aoi, run, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, stem || '.V07B.RT-H5' AS name FROM named WHERE date_diff('minute', TIMESTAMP '2024-01-01', slot) // 30 % 5 NOT IN (1, 2)""", "fx_slots", named=q_places.GRANULE_SQL))
def granule_listing(fx):
    from scarpline.functions import clock

    run = F.expr("CASE WHEN aoi % 2 = 0 THEN 'Early' ELSE 'Late' END")
    other = F.expr("CASE WHEN aoi % 2 = 0 THEN 'Late' ELSE 'Early' END")
    n = F.timestamp_diff("MINUTE", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), F.col("slot")) / 30
    late_start = F.timestamp_add("MINUTE", F.lit(7), F.col("slot"))
    name = (
        F.when(n % 5 == 1, clock.granule_name(other, "slot", "V07B.RT-H5"))
        .when(n % 5 == 2, clock.granule_name(run, late_start, "V07B.RT-H5"))
        .otherwise(clock.granule_name(run, "slot", "V07B.RT-H5"))
    )
    lines = fx.slots.withColumns({"run": run, "line": F.concat(F.lit('<a href="'), name, F.lit('">x</a>'))})
    listings = lines.groupBy("aoi", "run", F.to_date("slot").alias("d")).agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    return rain_documents.granule_listing(listings, ["aoi", "run"], F.col("run"))




# --- live records -------------------------------------------------------------------------

# Early is gappy, Late older, the fallback hourly; area 3 has only the fallback, area 9 nothing.
LIVE = """
SELECT aoi, 'IMERG_HHR_EARLY' AS source_kind, slot, mm FROM {s} WHERE aoi IN (0, 1) AND NOT (aoi = 1 AND slot_no % 5 = 2)
UNION ALL SELECT aoi, 'IMERG_HHR_LATE', slot, mm FROM {s} WHERE aoi IN (1, 2) AND slot_no < 880
UNION ALL SELECT aoi, 'OPEN_METEO_FALLBACK', slot, mm * 2 FROM {s} WHERE slot_no % 2 = 0"""
LIVE_RUN = """
SELECT *, CASE source_kind WHEN 'IMERG_HHR_EARLY' THEN 1 WHEN 'IMERG_HHR_LATE' THEN 2 ELSE 3 END AS rank, CASE source_kind WHEN 'OPEN_METEO_FALLBACK' THEN 60 ELSE 30 END AS step FROM lv WHERE slot <= TIMESTAMP '2024-01-20 12:10:00'"""
LIVE_BACK = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi, source_kind ORDER BY slot DESC) - 1 AS back, max(slot) OVER (PARTITION BY aoi, source_kind) AS anchor FROM lr) WHERE slot = anchor - to_minutes(step * back) AND back < 12"""


def live_total(h):
    need = f"({h} * 60 // step)"
    return (f"CASE WHEN n >= {need} THEN {rnd(f's{h} / 1e6', 4)} END AS accum_{h}h_mm, CASE WHEN anchor IS NULL THEN 'no observation was retrieved, so no accumulation exists' WHEN n < {need} THEN 'incomplete window: ' || CAST(n AS STRING) || ' of ' || CAST({need} AS STRING) "
            f"|| ' contiguous ' || CAST(step AS STRING) || '-minute intervals, so a {h} h total would be partial' END AS accum_{h}h_reason")


LIVE_SUM = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY rank) AS rn FROM (SELECT aoi, source_kind, rank, step, anchor, count(*) AS n, max(mm) FILTER (WHERE back = 0) AS last_mm,
 CAST(sum(CAST(round_even(mm * 1e6, 0) AS BIGINT)) FILTER (WHERE back < 180 // step) AS DOUBLE) AS s3, CAST(sum(CAST(round_even(mm * 1e6, 0) AS BIGINT)) FILTER (WHERE back < 360 // step) AS DOUBLE) AS s6 FROM lb GROUP BY ALL)) WHERE rn = 1"""


@query("live_records", oracle(f"""
SELECT aoi, source_kind, strftime(anchor, '%Y-%m-%d %H:%M:%S') AS observed_at, n AS intervals, {rnd('last_mm', 4)} AS latest_mm, CAST(step AS INT) AS interval_minutes, {live_total(3)}, {live_total(6)}, age AS age_minutes,
 CASE WHEN age > 360 THEN 'STALE' WHEN age <= 90 THEN 'NEAR_REAL_TIME' WHEN age IS NOT NULL THEN 'RECENT' END AS freshness_label, age > 360 AS is_stale, CASE WHEN anchor IS NULL THEN 'UNAVAILABLE' WHEN rank = 3 THEN 'FALLBACK' ELSE 'REAL' END AS data_quality_status,
 CASE WHEN anchor IS NULL THEN 'no satellite slot and no fallback observation' END AS unavailable_reason
FROM (SELECT a.aoi, s.* EXCLUDE (aoi), {rnd("CAST(date_diff('second', s.anchor, TIMESTAMP '2024-01-20 12:10:00') AS DOUBLE) / 60e0", 1)} AS age FROM (VALUES (0), (1), (2), (3), (9)) AS a(aoi) LEFT JOIN ls s ON s.aoi = a.aoi)""",
    "fx_slots", sn="SELECT *, date_diff('minute', TIMESTAMP '2024-01-01', slot) // 30 AS slot_no FROM fx_slots", lv=LIVE.format(s="sn"), lr=LIVE_RUN, lb=LIVE_BACK, ls=LIVE_SUM))
def live_records(fx):
    from scarpline.plans import live

    numbered = fx.slots.withColumn("slot_no", F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ '2024-01-01 00:00:00', slot) div 30"))
    areas = fx.spark.sql("SELECT * FROM VALUES (0), (1), (2), (3), (9) AS t(aoi)")
    return live.live_records(areas, fx.sql(LIVE, s=numbered), now())
