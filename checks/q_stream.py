"""The live series as streams, run over all given events and read back."""

from pyspark.sql import functions as F

from scarpline.session import scratch_path
from scarpline.streaming import slots, state

from .fixtures import oracle, rnd
from .registry import query


def rates(fx):
    """The events table as a stream of rates per area."""
    raw = slots.file_stream(fx.spark, fx.sf_dir, slots.EVENTS_SCHEMA, "events.parquet")
    return raw.select(
        (F.col("user_id") % 4).cast("int").alias("aoi"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("rate"), "event_id", "user_id",
    )


def slot_sql(minutes, factor):
    return f"""
SELECT CAST(user_id % 4 AS INT) AS aoi, time_bucket(INTERVAL {minutes} MINUTE, ts) AS slot, count(*) AS readings, CAST(sum(CAST(round(value * 1e2) AS BIGINT)) AS DOUBLE) / 1e2 / count(*) * {factor}e0 AS mm FROM events GROUP BY ALL"""


CLOSED = "SELECT *, (SELECT max(ts) - INTERVAL 840 MINUTE FROM events) AS mark FROM s"


@query("stream_slot_rain", oracle("SELECT aoi, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, readings, mm FROM c WHERE slot + INTERVAL 30 MINUTE <= mark", s=slot_sql(30, 0.5), c=CLOSED))
def stream_slot_rain(fx):
    out = slots.slot_rain(rates(fx)).drop("window")
    return slots.run_available(out, "slot-rain")


def total(h, minutes):
    need = h * 60 // minutes
    return (f"CASE WHEN n{h} = {need} THEN {rnd(f's{h} / 1e6', 4)} END AS accum_{h}h_mm, CASE WHEN n{h} < {need} THEN 'incomplete window: ' || CAST(n{h} AS STRING) || ' of {need} contiguous {minutes}-minute intervals, so a {h} h total would be partial' END AS accum_{h}h_reason")


def windows(minutes):
    """Every sliding six-hour window with at least one closed slot, itself closed."""
    return f"""
SELECT c.aoi, e.window_end, count(*) FILTER (WHERE c.slot >= e.window_end - INTERVAL 3 HOUR) AS n3, count(*) AS n6, CAST(coalesce(sum(CAST(round_even(mm * 1e6, 0) AS BIGINT)) FILTER (WHERE c.slot >= e.window_end - INTERVAL 3 HOUR), 0) AS DOUBLE) AS s3, CAST(sum(CAST(round_even(mm * 1e6, 0) AS BIGINT)) AS DOUBLE) AS s6
FROM c, (SELECT unnest(range(1, {360 // minutes} + 1)) AS k) k, LATERAL (SELECT c.slot + to_minutes(CAST({minutes} * k.k AS BIGINT)) AS window_end) e WHERE e.window_end <= c.mark GROUP BY ALL"""


ACCUM = f"SELECT aoi, window_end, {total(3, 30)}, {total(6, 30)} FROM w"


@query("stream_accum", oracle("SELECT * REPLACE (strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end) FROM a", s=slot_sql(30, 0.5), c=CLOSED, w=windows(30), a=ACCUM))
def stream_accum(fx):
    return slots.run_available(slots.accumulations(slots.slot_rain(rates(fx))), "accum")


def crit(h):
    return rnd(f"14.2e0 * pow({h}e0, -0.62e0)", 4)


def alert_sql(h):
    return f"""
SELECT aoi, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, {h}e0 AS duration_h, accum_{h}h_mm AS mm, {rnd(f'accum_{h}h_mm / {h}e0', 4)} AS intensity_mm_h, {crit(h)} AS critical_mm_h, {rnd(f'accum_{h}h_mm / {h}e0 / {crit(h)}', 4)} AS threshold_ratio,
 {rnd(f'least(greatest(accum_{h}h_mm / {h}e0 / {crit(h)} / 1.5e0, 0e0), 1e0)', 4)} AS trigger_score, CASE aoi WHEN 0 THEN 'Sikkim' WHEN 1 THEN 'Assam' WHEN 2 THEN 'Meghalaya' ELSE 'Arunachal Pradesh' END AS state FROM a WHERE accum_{h}h_mm / {h}e0 >= {crit(h)}"""


@query("stream_trigger_alert", oracle(alert_sql(3) + " UNION ALL " + alert_sql(6), s=slot_sql(30, 0.5), c=CLOSED, w=windows(30), a=ACCUM))
def stream_trigger_alert(fx):
    areas = fx.spark.sql("SELECT * FROM VALUES (0, 'Sikkim'), (1, 'Assam'), (2, 'Meghalaya'), (3, 'Arunachal Pradesh') AS t(aoi, state)")
    alerts = slots.trigger_alerts(slots.accumulations(slots.slot_rain(rates(fx))))
    return slots.run_available(slots.alert_cells(alerts, areas), "alerts")


@query("stream_fallback_hours", oracle("SELECT * REPLACE (strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end) FROM a", s=slot_sql(60, 1), c=CLOSED, w=windows(60),
    a=f"SELECT aoi, window_end, {total(3, 60)}, {total(6, 60)} FROM w"))
def stream_fallback_hours(fx):
    hourly = slots.slot_rain(rates(fx), minutes=60, is_rate=False)
    return slots.run_available(slots.accumulations(hourly, minutes=60), "fallback-hours")


KIND = "CASE WHEN user_id % 10 < 3 THEN 'IMERG_HHR_LATE' WHEN user_id % 10 < 6 THEN 'OPEN_METEO_FALLBACK' WHEN user_id % 10 < 9 THEN 'IMERG_HHR_EARLY' ELSE 'UNKNOWN' END"


@query("stream_run_upgrade", oracle(f"""
SELECT aoi, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, source_kind, source_rank, mm FROM (SELECT *, row_number() OVER (PARTITION BY aoi, slot ORDER BY source_rank, mm) AS rn FROM (
 SELECT CAST(user_id % 4 AS INT) AS aoi, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, {KIND} AS source_kind, value * 0.5e0 AS mm, CAST(CASE {KIND} WHEN 'IMERG_HHR_EARLY' THEN 1 WHEN 'IMERG_HHR_LATE' THEN 2 ELSE 3 END AS INT) AS source_rank FROM events WHERE user_id % 10 < 9)) WHERE rn = 1"""))
def stream_run_upgrade(fx):
    seen = rates(fx).select(
        "aoi", F.window("ts", "30 minutes")["start"].alias("slot"), F.expr(KIND).alias("source_kind"), (F.col("rate") * 0.5).alias("mm")
    )
    return slots.run_available(state.run_upgrade(seen, slots.LATE_DELAY), "upgrade", settings=state.SETTINGS).drop("previous_rank")


# One batch: the newest slot per area, aged from a clock that has not passed it yet.
@query("stream_latest", oracle("""
SELECT aoi, strftime(slot, '%Y-%m-%d %H:%M:%S') AS observed_at, mm AS latest_mm, 0e0 AS age_minutes, 'NEAR_REAL_TIME' AS freshness, false AS is_stale FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY slot DESC, mm DESC) AS rn FROM (
 SELECT CAST(user_id % 4 AS INT) AS aoi, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, value * 0.5e0 AS mm FROM events)) WHERE rn = 1"""))
def stream_latest(fx):
    seen = rates(fx).select("aoi", F.window("ts", "30 minutes")["start"].alias("slot"), (F.col("rate") * 0.5).alias("mm"))
    return slots.run_available(state.latest(seen, slots.LATE_DELAY), "latest", settings=state.SETTINGS)


# --- several batches -------------------------------------------------------------------------------

def batches(fx, parts, limit=1):
    """The frames as files of one folder, written one after the other and read one per batch."""
    path = scratch_path(fx.spark, "landing")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return fx.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", limit).parquet(path)


def observed(fx):
    raw = fx.table("events").select(
        (F.col("user_id") % 4).cast("int").alias("aoi"), F.window(F.col("ts").cast("timestamp"), "30 minutes")["start"].alias("slot"),
        F.expr(KIND).alias("source_kind"), (F.col("value") * 0.5).alias("mm"))
    return raw


RANKED = f"""
SELECT CAST(user_id % 4 AS INT) AS aoi, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, {KIND} AS source_kind, min(value * 0.5e0) AS mm, CAST(CASE {KIND} WHEN 'IMERG_HHR_EARLY' THEN 1 WHEN 'IMERG_HHR_LATE' THEN 2 ELSE 3 END AS INT) AS source_rank
FROM events WHERE user_id % 10 < 9 GROUP BY ALL"""


@query("stream_upgrade_batches", oracle("""
SELECT aoi, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, source_kind, source_rank, mm, lag(source_rank) OVER (PARTITION BY aoi, slot ORDER BY source_rank DESC) AS previous_rank FROM r""", r=RANKED))
def stream_upgrade_batches(fx):
    """The fallback comes first, then the late run, then the early one: each better run replaces the last.

    A run that arrives after a better one is not shown; here they come in the order of their rank.
    """
    seen = observed(fx)
    kinds = ["OPEN_METEO_FALLBACK", "IMERG_HHR_LATE", "IMERG_HHR_EARLY"]
    stream = batches(fx, [seen.where(F.col("source_kind") == k) for k in kinds])
    return slots.run_available(state.run_upgrade(stream, "60 days"), "upgrades", settings=state.SETTINGS)


HOURLY = "SELECT CAST(user_id % 4 AS INT) AS aoi, time_bucket(INTERVAL 60 MINUTE, ts) AS slot, max(value) AS mm FROM events WHERE NOT (user_id % 4 = 1 AND EXTRACT(HOUR FROM ts) = 20) GROUP BY ALL"
NEWEST = """
SELECT aoi, max(slot) AS anchor FROM h GROUP BY aoi"""
KEPT = """
SELECT aoi, anchor, k, mm, min(CASE WHEN mm IS NULL THEN k END) OVER (PARTITION BY aoi) AS gap FROM (
 SELECT n.aoi, n.anchor, k.k, h.mm FROM n, (SELECT unnest(range(0, 12)) AS k) k LEFT JOIN h ON h.aoi = n.aoi AND h.slot = n.anchor - to_minutes(60 * k.k))"""


def run_total(h):
    return (f"CASE WHEN run >= {h} THEN {rnd(f's{h} / 1e6', 4)} END AS accum_{h}h_mm, CASE WHEN run < {h} THEN CAST(run AS STRING) || ' contiguous hours up to the newest, {h} needed' END AS accum_{h}h_reason")


@query("stream_newest_run", oracle(f"""
SELECT aoi, strftime(anchor, '%Y-%m-%d %H:%M:%S') AS anchor, CAST(run AS INT) AS run_hours, latest_mm, {run_total(3)}, {run_total(6)} FROM (
 SELECT aoi, anchor, coalesce(min(gap), 12) AS run, max(mm) FILTER (WHERE k = 0) AS latest_mm, {', '.join(f"CAST(sum(CAST(round_even(mm * 1e6, 0) AS BIGINT)) FILTER (WHERE k < {h}) AS DOUBLE) AS s{h}" for h in (3, 6))} FROM kept GROUP BY aoi, anchor)""",
    h=HOURLY, n=NEWEST, kept=KEPT))
def stream_newest_run(fx):
    """Hours in two batches, odd days after even ones: the late hours close gaps behind the anchor."""
    raw = fx.table("events").where("NOT (user_id % 4 = 1 AND hour(ts) = 20)").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = raw.groupBy((F.col("user_id") % 4).cast("int").alias("aoi"), F.window("ts", "60 minutes")["start"].alias("slot")).agg(F.max("value").alias("mm"))
    odd = F.dayofmonth("slot") % 2 == 1
    stream = batches(fx, [hourly.where(~odd), hourly.where(odd)])
    rows = slots.run_available(state.newest_run(stream, "60 days"), "newest-run", settings=state.SETTINGS)
    last = rows.groupBy("aoi").agg(F.max(F.struct("anchor", "run_hours")).alias("last"))
    return rows.join(last, "aoi").where((F.col("anchor") == F.col("last.anchor")) & (F.col("run_hours") == F.col("last.run_hours"))).drop("last").distinct()


LATEST = f"""
SELECT aoi, slot, mm, aoi = 3 AS silent FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY slot DESC, mm DESC) AS rn FROM (
 SELECT CAST(user_id % 4 AS INT) AS aoi, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, value * 0.5e0 AS mm FROM events WHERE user_id % 4 <> 3 OR EXTRACT(DAY FROM ts) < 10)) WHERE rn = 1"""
CLOCK = "SELECT max(time_bucket(INTERVAL 30 MINUTE, ts)) AS mark FROM events WHERE user_id % 4 <> 3 AND EXTRACT(DAY FROM ts) BETWEEN 10 AND 19"


@query("stream_latest_table", oracle("""
SELECT aoi, strftime(slot, '%Y-%m-%d %H:%M:%S') AS observed_at, mm AS latest_mm, CASE WHEN silent THEN CAST(date_diff('minute', slot, mark) AS DOUBLE) ELSE 0e0 END AS age_minutes,
 CASE WHEN silent THEN 'STALE' ELSE 'NEAR_REAL_TIME' END AS freshness, silent AS is_stale FROM l, c""", l=LATEST, c=CLOCK))
def stream_latest_table(fx):
    """The newest observation per area in a table that each batch updates; one area falls silent.

    Its state's timer runs out as the others' time goes on, and its row becomes STALE.
    """
    day = F.dayofmonth("slot")
    seen, silent = observed(fx).select("aoi", "slot", "mm"), F.col("aoi") == 3
    parts = [seen.where(day < 10), seen.where(~silent & day.between(10, 19)), seen.where(~silent & (day >= 20))]
    table = scratch_path(fx.spark, "latest-table")
    slots.run_each(state.latest(batches(fx, parts), "0 minutes"), "latest-table", state.upsert_latest(table), settings=state.SETTINGS)
    return state.read_latest(fx.spark, table)
