"""Rainfall: grids, daily windows, completeness, as-of probes and the source ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import clock, geo
from ..functions.numbers import col, is_finite, reasons, rounded

CHUNK_DAYS = 64  # days per window group; a group never exceeds CHUNK_DAYS + window rows


def usable_precip(c: Column | str) -> Column:
    """Value of a valid grid cell, null for NaN, infinite and fill."""
    return F.when(is_finite(c) & (col(c) > vocab.PRECIP_FILL_FLOOR), col(c))


def precip_grid_scan(grid: DataFrame, boxes: DataFrame, day=None, run_type: str | None = None) -> DataFrame:
    """Grid cells of each box, as an equi-join on the cell indices of the boxes.

    The overall index range is also filtered as literals when the boxes are few, so
    it reaches the Parquet scan together with the partition filters.
    """
    cells = aoi_grid_cells(boxes)
    scan = grid
    if run_type is not None:
        scan = scan.where(F.col("run_type") == run_type)
    if day is not None:
        scan = scan.where(F.col("day") == F.lit(day))
    span = boxes.select(*geo.precip_indices())
    for axis, index in (("lat", "lat_idx"), ("lon", "lon_idx")):
        scan = scan.where(
            F.col(index).between(
                span.agg(F.min(f"{axis}_lo")).scalar(), span.agg(F.max(f"{axis}_hi")).scalar()
            )
        )
    return scan.join(cells, ["lat_idx", "lon_idx"])


def aoi_grid_cells(boxes: DataFrame) -> DataFrame:
    """(state, lat_idx, lon_idx) for every rainfall cell of every box."""
    ranged = boxes.select("state", *geo.precip_indices())
    return (
        ranged.withColumn("lat_idx", F.explode(F.sequence("lat_lo", "lat_hi")))
        .withColumn("lon_idx", F.explode(F.sequence("lon_lo", "lon_hi")))
        .select("state", "lat_idx", "lon_idx")
    )


def aoi_mean_precip(grid: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over valid cells per box and time; no valid cell refuses instead of 0.

    Values are summed as whole hundredths first, so the mean does not depend on the
    order in which tasks finish.
    """
    value = usable_precip("precip")
    stats = precip_grid_scan(grid, boxes).groupBy("state", *keys).agg(
        F.sum(F.rint(value * 100).cast("long")).alias("hundredths"),
        F.count(value).alias("valid_cells"),
        F.count("*").alias("cells"),
    )
    mean = F.try_divide(F.col("hundredths") / 100.0, F.col("valid_cells"))
    ok = F.col("valid_cells") > 0
    return stats.select(
        "state", *keys, "cells", "valid_cells",
        F.when(ok, F.greatest(mean, F.lit(0.0))).alias("mean_mm"),
        F.when(ok, "REAL").otherwise("UNAVAILABLE").alias("status"),
        reasons((~ok, "no valid precipitation cell")).alias("reasons"),
    )


REPEATED = "a day is reported more than once"


def one_per_day(daily: DataFrame, key: str) -> DataFrame:
    """(key, day, mm, repeated): a day that comes twice has no value, whatever the rows say.

    Which of two reports is right cannot be known, and counting both would hide a
    missing day.
    """
    days = daily.groupBy(key, "day").agg(F.count("*").alias("_n"), F.min("mm").alias("mm"))
    repeated = F.col("_n") > 1
    return days.select(key, "day", F.when(~repeated, F.col("mm")).alias("mm"), repeated.alias("repeated"))


def _chunked(daily: DataFrame, key: str, days_before: int, chunk: int) -> DataFrame:
    """Copy the last days of a chunk into the next one, so windows stay within chunks."""
    day_no = F.unix_date("day")
    own = F.floor(day_no / chunk)
    reach = F.floor((day_no + days_before) / chunk)
    return daily.withColumn("_day_no", day_no).withColumn("_chunk", F.explode(F.sequence(own, reach)))


def antecedent_features(
    daily: DataFrame, key: str = "cell_id", window_days: int = vocab.ANTECEDENT_DAYS,
    chunk: int = CHUNK_DAYS,
) -> DataFrame:
    """Features of the days before each day in the table; the day itself never counts.

    Fewer than window_days observed days leave every number null with a reason, and a
    repeated day counts as none. There is one row per cell and day. A cell's history is cut into chunks with an overlap, so a long or very hot series
    is still many small window groups.
    """
    if window_days < 3:
        raise ValueError("window_days must be at least 3")
    pieces = _chunked(one_per_day(daily, key), key, window_days, chunk)
    w = Window.partitionBy(key, "_chunk").orderBy("_day_no")
    span = lambda n: w.rangeBetween(-n, -1)
    hundredths = F.rint(F.col("mm") * 100).cast("long")
    total = lambda n: F.sum(hundredths).over(span(n)) / 100.0
    usable = F.count(F.when(is_finite("mm") & (F.col("mm") >= 0), 1)).over(span(window_days))
    out = pieces.withColumns({
        "days_present": usable,
        "_1": total(1), "_3": total(3), "_7": total(7), "_14": total(window_days),
        "_m": F.max("mm").over(span(3)),
        "_repeated": F.max("repeated").over(span(window_days)),
    }).where(F.col("_chunk") == F.floor(F.col("_day_no") / chunk))
    return _features(out, [key, "day"], window_days)


def _features(df: DataFrame, keep: list[str], window_days: int) -> DataFrame:
    ok = F.col("days_present") == window_days
    pick = dict(zip(vocab.RAIN_FEATURES, ["_1", "_3", "_7", "_14", "_m"]))
    return df.select(
        *keep, "days_present",
        *[F.when(ok, F.col(c)).alias(name) for name, c in pick.items()],
        F.when(ok, "REAL").otherwise("UNAVAILABLE").alias("rain_status"),
        reasons(
            (~ok, F.format_string(f"%d of {window_days} antecedent days observed", "days_present")),
            (F.coalesce("_repeated", F.lit(False)), REPEATED),
        ).alias("rain_reasons"),
    )


def antecedent_for(
    requests: DataFrame, daily: DataFrame, key: str = "cell_id", date: str = "target_day",
    window_days: int = vocab.ANTECEDENT_DAYS,
) -> DataFrame:
    """The same features for arbitrary (key, date) requests, also without that day's rain.

    An interval join made equi: every distinct request asks for its own days. Repeated
    requests are answered once.
    """
    asked = requests.select(key, date).where(F.col(date).isNotNull()).distinct()
    days = asked.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(window_days)))).withColumn(
        "day", F.date_sub(date, F.col("_k"))
    )
    joined = days.join(one_per_day(daily, key), [key, "day"], "left")
    good = is_finite("mm") & (F.col("mm") >= 0)
    hundredths = F.rint(F.col("mm") * 100).cast("long")
    total = lambda n: F.sum(F.when(good & (F.col("_k") <= n), hundredths)) / 100.0
    grouped = joined.groupBy(key, date).agg(
        F.count_if(good).alias("days_present"),
        total(1).alias("_1"), total(3).alias("_3"), total(7).alias("_7"),
        total(window_days).alias("_14"),
        F.max(F.when(good & (F.col("_k") <= 3), F.col("mm"))).alias("_m"),
        F.max("repeated").alias("_repeated"),
    )
    return _features(grouped, [key, date], window_days)


def event_rainfall_join(
    samples: DataFrame, daily: DataFrame, key: str = "cell_id", date: str = "target_day",
) -> DataFrame:
    """Samples with the rainfall of the 14 days before their date; gaps refuse."""
    features = antecedent_for(samples, daily, key, date)
    return samples.join(features, [key, date], "left").withColumns({
        "rain_status": F.coalesce("rain_status", F.lit("UNAVAILABLE")),
        "rain_reasons": F.coalesce("rain_reasons", F.array(F.lit("no usable date"))),
    })


def inclusive_accumulations(daily: DataFrame, key: str = "cell_id", windows=(1, 3, 7),
                            chunk: int = CHUNK_DAYS) -> DataFrame:
    """Sums that include the day itself; null unless every day of the window is there once."""
    longest = max(windows)
    pieces = _chunked(one_per_day(daily, key), key, longest - 1, chunk)
    w = Window.partitionBy(key, "_chunk").orderBy("_day_no")
    hundredths = F.rint(F.col("mm") * 100).cast("long")
    sums = {}
    for n in windows:
        span = w.rangeBetween(-(n - 1), 0)
        sums[f"accumulation_{n}d_mm"] = F.when(
            F.count("mm").over(span) == n, rounded(F.sum(hundredths).over(span) / 100.0, 4)
        )
    return (
        pieces.withColumns(sums)
        .where(F.col("_chunk") == F.floor(F.col("_day_no") / chunk))
        .select(key, "day", *sums)
    )


def series_validate(daily: DataFrame, key: list[str], window_days: int = vocab.ANTECEDENT_DAYS) -> DataFrame:
    """A window is valid only if complete, finite, not negative, and has no day twice.

    Days are counted per key and day first, so a long key still sums in parts.
    """
    finite, below = F.count_if(~is_finite("mm")), F.count_if(is_finite("mm") & (F.col("mm") < 0))
    per_day = daily.groupBy(*key, "day").agg(
        F.count("*").alias("_n"), finite.alias("_f"), below.alias("_g")
    )
    stats = per_day.groupBy(*key).agg(
        F.count("*").alias("days"),
        F.sum("_f").alias("non_finite"),
        F.sum("_g").alias("negative"),
        F.count_if(F.col("_n") > 1).alias("_repeated"),
    )
    why = reasons(
        (F.col("days") != window_days, F.format_string(f"%d of {window_days} days returned", "days")),
        (F.col("non_finite") > 0, "a day is missing or not finite"),
        (F.col("negative") > 0, "a day is negative"),
        (F.col("_repeated") > 0, REPEATED),
    )
    return stats.withColumn("reasons", why).drop("_repeated").withColumn(
        "status", F.when(F.size("reasons") == 0, "VALID").otherwise("REFUSED")
    )


def forecast_accumulation(hourly: DataFrame, key: str, now, hours: int = 72) -> DataFrame:
    """Sum over the first `hours` future rows per key; all-null refuses, gaps add nothing.

    The horizon is cut by row count, whatever the times of the rows are.
    """
    w = Window.partitionBy(key).orderBy("time")
    ahead = hourly.where(F.col("time") > now).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= hours)
    good = is_finite("mm")
    return ahead.groupBy(key).agg(
        F.count_if(good).alias("finite_hours"),
        (F.sum(F.when(good, F.rint(F.col("mm") * 100).cast("long"))) / 100.0).alias("_mm"),
    ).select(
        key, "finite_hours",
        F.when(F.col("finite_hours") > 0, F.greatest("_mm", F.lit(0.0))).alias("forecast_mm"),
        F.when(F.col("finite_hours") > 0, "REAL").otherwise("UNAVAILABLE").alias("status"),
    )


def probe_plan(target: Column | str, run: Column | str, now: Column | str,
               reach: int = vocab.MAX_PROBE_DAYS) -> Column:
    """(first, last, mode): which days before the target may be probed."""
    latency = F.create_map(*[F.lit(v) for kv in vocab.RUN_LATENCY_DAYS.items() for v in kv])
    age = F.datediff(col(now), col(target))
    first = F.greatest(F.lit(1), F.element_at(latency, col(run)) - age)
    recent = age <= vocab.RECENT_GRACE_DAYS
    last = F.when(recent, first + vocab.RECENT_PROBE_DAYS - 1).otherwise(F.lit(reach))
    last = F.when(first > reach, first - 1).otherwise(F.least(last, F.lit(reach)))
    return F.struct(
        first.cast("int").alias("first"), last.cast("int").alias("last"),
        F.when(recent, "NEAR_REAL_TIME").otherwise("HISTORICAL").alias("mode"),
    )


def probe_window_asof(
    requests: DataFrame, daily: DataFrame, key: str = "cell_id", now: str = "now_day",
    window_days: int = vocab.ANTECEDENT_DAYS, reach: int = vocab.MAX_PROBE_DAYS,
) -> DataFrame:
    """Newest observed day within reach, then the complete window ending on it.

    Requests carry key, target_day, run_type and now. The reach is at most 30 days,
    so the range condition becomes an equi-join on the candidate days.
    """
    ids = [key, "target_day", "run_type", now]
    asked = requests.select(ids).distinct().withColumn(
        "plan", probe_plan("target_day", "run_type", now, reach)
    )
    steps = F.when(F.col("plan.last") >= F.col("plan.first"), F.sequence("plan.first", "plan.last"))
    probed = asked.withColumn("_k", F.explode_outer(steps)).withColumn("day", F.date_sub("target_day", F.col("_k")))
    daily = one_per_day(daily, key)
    observed = daily.where(is_finite("mm")).select(key, "day", F.lit(True).alias("_seen"))
    newest = probed.join(observed, [key, "day"], "left").groupBy(ids + ["plan"]).agg(
        F.max(F.when(F.col("_seen"), F.col("day"))).alias("observation_day")
    )
    window = newest.withColumn(
        "_k", F.explode_outer(F.when(F.col("observation_day").isNotNull(), F.sequence(F.lit(0), F.lit(window_days - 1))))
    ).withColumn("day", F.date_sub("observation_day", F.col("_k")))
    full = window.join(daily, [key, "day"], "left").groupBy(
        ids + ["plan", "observation_day"]
    ).agg(
        F.count_if(is_finite("mm") & (F.col("mm") >= 0)).alias("days_present"),
        F.sum(F.rint(F.col("mm") * 100).cast("long")).alias("_sum"),
        F.max(F.when(F.col("_k") == 0, F.col("mm"))).alias("_first"),
        F.max("repeated").alias("_repeated"),
    )
    complete = F.col("days_present") == window_days
    why = reasons(
        (F.col("plan.last") < F.col("plan.first"), "nothing can be published within the probe reach"),
        ((F.col("plan.last") >= F.col("plan.first")) & F.col("observation_day").isNull(),
         "no observation in the candidate days"),
        (F.col("observation_day").isNotNull() & ~complete,
         F.format_string(f"%d of {window_days} window days observed", "days_present")),
        (F.coalesce("_repeated", F.lit(False)), REPEATED),
    )
    return full.withColumn("reasons", why).select(
        *ids,
        F.col("plan.first").alias("first_offset"), F.col("plan.last").alias("last_offset"),
        F.col("plan.mode").alias("probe_mode"),
        "observation_day",
        F.datediff("target_day", "observation_day").alias("observation_lag_days"),
        F.when(complete, F.col("_first")).alias("rain_1d"),
        F.when(complete, F.col("_sum") / 100.0).alias("antecedent_rain_14d"),
        F.when(F.size("reasons") == 0, "OK").otherwise("FAILED").alias("status"),
        "reasons",
    )


def source_ladder(
    requests: DataFrame, primary: DataFrame, fallback: DataFrame | None, ids: list[str],
    run_type: str = "Early",
) -> DataFrame:
    """First source with a complete window wins; every attempt is recorded.

    primary and fallback carry ids, the features, rain_status and rain_reasons. A
    fallback is always labelled; without one its attempt reads DISABLED. With neither
    source there is no number at all.
    """
    disabled = fallback is None
    if disabled:
        fallback = primary.where(F.lit(False))
    def side(df, tag):
        return df.select(
            *ids,
            F.struct(*vocab.RAIN_FEATURES).alias(f"{tag}_f"),
            F.col("rain_status").alias(f"{tag}_s"),
            F.array_join("rain_reasons", "; ").alias(f"{tag}_r"),
        )

    j = requests.join(side(primary, "p"), ids, "left").join(side(fallback, "f"), ids, "left")
    p_ok = F.coalesce(F.col("p_s") == "REAL", F.lit(False))
    f_ok = F.coalesce(F.col("f_s") == "REAL", F.lit(False))

    def attempt(kind, ok, reason):
        return F.struct(
            F.lit(kind).alias("source_kind"),
            F.when(ok, "OK").otherwise("FAILED").alias("status"),
            F.when(~ok, F.coalesce(F.col(reason), F.lit("no series"))).alias("reason"),
        )

    first = attempt(vocab.SOURCE_IMERG, p_ok, "p_r")
    second = attempt(vocab.SOURCE_FALLBACK, f_ok, "f_r")
    if disabled:
        second = F.struct(
            F.lit(vocab.SOURCE_FALLBACK).alias("source_kind"), F.lit("DISABLED").alias("status"),
            F.lit("the fallback is disabled").alias("reason"),
        )
    pick = lambda a, b: F.when(p_ok, a).when(f_ok, b)
    attempts = F.when(p_ok, F.array(first)).otherwise(F.array(first, second))
    failed = F.transform(
        F.filter(attempts, lambda a: a["reason"].isNotNull()),
        lambda a: F.concat_ws(": ", a["source_kind"], a["reason"]),
    )
    return j.select(
        *requests.columns,
        pick(F.lit(f"IMERG_{run_type}"), F.lit(vocab.FALLBACK_LABEL)).alias("source"),
        pick(F.lit(vocab.SOURCE_IMERG), F.lit(vocab.SOURCE_FALLBACK)).alias("source_kind"),
        (~p_ok & f_ok).alias("is_fallback"),
        F.when(p_ok, "REAL").when(f_ok, "FALLBACK").otherwise("UNAVAILABLE").alias("data_quality_status"),
        *[pick(F.col(f"p_f.{n}"), F.col(f"f_f.{n}")).alias(n) for n in vocab.RAIN_FEATURES],
        attempts.alias("attempts"),
        F.when(~p_ok & ~f_ok, F.array_join(failed, "; ")).alias("unavailable_reason"),
    )


def aoi_rain_broadcast(cells: DataFrame, rain: DataFrame, key: str = "state") -> DataFrame:
    """One rainfall row per area applied to all its cells; areas without rain keep nulls.

    The rain side has one row per area; its size, not a hint, decides the broadcast,
    and adaptive execution splits a very large area otherwise.
    """
    return cells.join(rain, key, "left")


# --- live half-hourly series -------------------------------------------------------

def latest_granule_asof(slots: DataFrame, key: list[str], now: Column, minutes: int = vocab.SLOT_MINUTES) -> DataFrame:
    """Newest slot at or before now floored to the slot; future slots are ignored."""
    ceiling = clock.slot_floor(now, minutes)
    return slots.where(F.col("slot") <= ceiling).groupBy(*key).agg(F.max("slot").alias("latest_slot"))


def contiguous_run(
    slots: DataFrame, key: list[str], now: Column, minutes: int = vocab.SLOT_MINUTES,
    at_most: int = vocab.WINDOW_SLOTS,
) -> DataFrame:
    """Slots from the newest backward while exactly one interval apart, at most 12.

    Only the last `at_most` intervals before each anchor can belong to the run, so the
    window sees at most that many rows per key.
    """
    number = clock.slot_number("slot", minutes)
    past = slots.withColumn("_no", number).where(F.col("_no") <= clock.slot_number(now, minutes))
    anchor = past.groupBy(*key).agg(F.max("_no").alias("_anchor"))
    near = past.join(anchor, key).where(F.col("_no") > F.col("_anchor") - at_most)
    w = Window.partitionBy(*key).orderBy(F.col("_no").desc())
    return (
        near.withColumn("steps_back", F.row_number().over(w) - 1)
        .where(F.col("_no") == F.col("_anchor") - F.col("steps_back"))
        .drop("_no", "_anchor")
    )


def complete_accumulation(run: DataFrame, key: list[str], minutes: int = vocab.SLOT_MINUTES,
                          hours=vocab.ACCUMULATION_HOURS) -> DataFrame:
    """Totals over the newest hours of a contiguous run, only when every interval is there."""
    micro = F.rint(F.col("mm") * 1e6).cast("long")
    need = {h: round(h * 60 / minutes) for h in hours}
    grouped = run.groupBy(*key).agg(
        F.count("*").alias("intervals"),
        F.max("slot").alias("observed_at"),
        F.max_by("mm", "slot").alias("latest_mm"),
        *[F.sum(F.when(F.col("steps_back") < n, micro)).alias(f"_t{h}") for h, n in need.items()],
    )
    totals = {h: F.col(f"_t{h}") / 1e6 for h in hours}
    return grouped.select(
        *key, "observed_at", "intervals", rounded("latest_mm", 4).alias("latest_mm"),
        *[c.alias(n) for n, c in clock.accumulation(totals, F.col("intervals"), minutes).items()],
    )
