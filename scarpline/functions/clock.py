"""Slots, lags, ages and granule names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .numbers import col, rounded

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH), col(ts).cast("timestamp_ntz"))


def slot_number(ts: Column | str, minutes: int = vocab.SLOT_MINUTES) -> Column:
    return F.floor(epoch_seconds(ts) / (60 * minutes)).cast("long")


def slot_from_number(number: Column | str, minutes: int = vocab.SLOT_MINUTES) -> Column:
    return F.timestamp_add("MINUTE", (col(number) * minutes).cast("int"), F.expr(EPOCH))


def slot_floor(ts: Column | str, minutes: int = vocab.SLOT_MINUTES) -> Column:
    return slot_from_number(slot_number(ts, minutes), minutes)


def minutes_of_day(ts: Column | str) -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


def as_text(ts: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(col(ts), pattern)


def run_type(c: Column | str) -> Column:
    """Early / Late / Final from any spelling; a missing value means Early."""
    name = F.initcap(F.lower(F.trim(F.coalesce(F.nullif(col(c), F.lit("")), F.lit("Early")))))
    return F.when(name.isin(vocab.RUN_TYPES), name)


def run_type_strict(c: Column | str) -> Column:
    """As run_type, but an unknown word stops the job."""
    return F.coalesce(
        run_type(c),
        F.raise_error(F.concat(F.lit("unknown run type: "), F.coalesce(col(c), F.lit("null")))).cast("string"),
    )


def granule_name(run: Column | str, slot: Column | str, suffix: str = "V07B.HDF5") -> Column:
    """Half-hourly file name; the end stamp is the slot's last second."""
    prefix = F.create_map(*[F.lit(v) for kv in vocab.GRANULE_PREFIX.items() for v in kv])
    end = F.timestamp_add("SECOND", F.lit(vocab.SLOT_MINUTES * 60 - 1), col(slot))
    return F.format_string(
        f"%s.MS.MRG.3IMERG.%s-S%s-E%s.%04d.{suffix}",
        F.element_at(prefix, col(run)),
        as_text(slot, "yyyyMMdd"), as_text(slot, "HHmmss"), as_text(end, "HHmmss"),
        minutes_of_day(slot),
    )


def granule_directory(run: Column | str, slot: Column | str) -> Column:
    """<collection>/<year>/<day of year>."""
    collection = F.create_map(*[F.lit(v) for kv in vocab.GRANULE_COLLECTION.items() for v in kv])
    return F.concat_ws(
        "/", F.element_at(collection, col(run)), as_text(slot, "yyyy"), as_text(slot, "DDD")
    )


def age_seconds(observed: Column | str, fetched: Column | str) -> Column:
    return (epoch_seconds(fetched) - epoch_seconds(observed)).cast("double")


def age_minutes(seconds: Column | str) -> Column:
    return rounded(col(seconds) / 60.0, 1)


def freshness(
    minutes: Column | str,
    stale_after: float = vocab.STALE_MINUTES,
    near_real_time: float = vocab.NEAR_REAL_TIME_MINUTES,
) -> Column:
    """Stale is tested first, so the label can never contradict the stale flag."""
    m = col(minutes)
    return F.when(
        m.isNotNull(),
        F.when(m > stale_after, "STALE")
        .when(m <= near_real_time, "NEAR_REAL_TIME")
        .otherwise("RECENT"),
    )


def lag_label(days: Column | str) -> Column:
    d = col(days)
    return F.when(
        d.isNotNull(),
        F.when(d <= 0, vocab.LAG_SAME_DAY)
        .when(d == 1, vocab.LAG_ONE_DAY)
        .otherwise(F.format_string(vocab.LAG_MANY_DAYS, d)),
    )


def age_label(seconds: Column | str) -> Column:
    """Human age; an unknown age stays null and never reads as zero."""
    whole = F.floor(F.greatest(col(seconds), F.lit(0.0)) + 0.5)
    minutes = F.floor(whole / 60.0 + 0.5)
    hours = whole / 3600.0
    tenth = lambda c: F.format_string("%.1f", F.floor(c * 10 + 0.5) / 10)
    return F.when(
        col(seconds).isNotNull() & ~F.isnan(col(seconds)),
        F.when(whole < 90, F.concat(whole.cast("long").cast("string"), F.lit("s ago")))
        .when(minutes < 90, F.concat(minutes.cast("long").cast("string"), F.lit(" min ago")))
        .when(hours < 48, F.concat(tenth(hours), F.lit(" h ago")))
        .otherwise(F.concat(tenth(hours / 24), F.lit(" d ago"))),
    )


def mm_label(mm: Column | str) -> Column:
    """Two decimals and the unit, or a dash; never 0 for unknown."""
    known = col(mm).isNotNull() & ~F.isnan(col(mm))
    text = F.format_string("%.2f mm", F.floor(col(mm) * 100 + 0.5) / 100)
    return F.when(known, text).otherwise("—")


def window_reason(have: Column | str, need: int, hours: int, minutes: int) -> Column:
    return F.format_string(
        f"incomplete window: %d of {need} contiguous {minutes}-minute intervals, "
        f"so a {hours} h total would be partial",
        col(have),
    )


def accumulation(total_by_hours: dict, have: Column, minutes: int) -> dict:
    """accum_<n>h_mm and its reason, only when every interval is present."""
    out = {}
    for hours, total in total_by_hours.items():
        need = round(hours * 60 / minutes)
        out[f"accum_{hours}h_mm"] = F.when(have >= need, rounded(total, 4))
        out[f"accum_{hours}h_reason"] = F.when(
            have < need, window_reason(have, need, hours, minutes)
        )
    return out
