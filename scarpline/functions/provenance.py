"""Where a number came from, in words: status, tone, label and reasons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .numbers import col, is_finite, reasons, text_list, when_chain


def input_record(name, status, value, source=None, reason=None) -> Column:
    """One normalised input. An unknown status stops the job; an unusable one has no value."""
    checked = F.when(
        F.coalesce(col(status).isin(vocab.INPUT_STATUSES), F.lit(False)), col(status)
    ).otherwise(
        F.raise_error(
            F.concat(F.lit("unknown input status: "), F.coalesce(col(status), F.lit("null")))
        ).cast("string")
    )
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("name"),
        checked.alias("status"),
        F.when(col(status).isin(vocab.USABLE_STATUSES), col(value)).alias("value"),
        (col(source) if source is not None else F.lit(None).cast("string")).alias("source"),
        (col(reason) if reason is not None else F.array().cast("array<string>")).alias("reasons"),
    )


def _blocked(inputs: str, name: str) -> Column:
    usable = F.col(f"{inputs}.{name}.status").isin(vocab.USABLE_STATUSES)
    return ~F.coalesce(usable, F.lit(False))


def blocking_inputs(inputs: str, mode: str) -> Column:
    """Names of required inputs that are not usable, in the mode's order.

    inputs: a struct column of records keyed by input name.
    """
    return reasons(*[(_blocked(inputs, n), n) for n in vocab.REQUIRED_INPUTS[mode]])


def blocking_reasons(inputs: str, mode: str) -> Column:
    """'<input>: <reason>' of every blocking input, without repeats."""
    def told(name):
        texts = F.transform(F.col(f"{inputs}.{name}.reasons"), lambda r: F.concat(F.lit(f"{name}: "), r))
        return F.when(_blocked(inputs, name), texts)

    listed = [told(n) for n in vocab.REQUIRED_INPUTS[mode]]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*listed))))


def missing_names(present: Column | str, required: list[str]) -> Column:
    return F.array_except(text_list(required), col(present))


def has_duplicates(names: Column | str) -> Column:
    return F.size(F.array_distinct(col(names))) != F.size(col(names))


def non_finite_names(columns: list[str]) -> Column:
    """Names of the columns that are null, NaN or infinite in this row."""
    return reasons(*[(~is_finite(c), c) for c in columns])


def status_tone(value: Column | str) -> Column:
    """Tone of a free-text status; the negative words are tested first."""
    text = F.upper(F.coalesce(col(value), F.lit("")))
    return when_chain(
        [(text.rlike(pattern), tone) for tone, pattern in vocab.TONE_PATTERNS], F.lit("neutral")
    )


def region_tone(overall: Column | str) -> Column:
    hit = F.upper(F.coalesce(col(overall), F.lit(""))).contains("VALIDATED_PILOT")
    return F.when(hit, "pilot").otherwise("pending")


def rain_tone(is_fallback, quality, source_kind) -> Column:
    """A fallback flag wins; nothing defaults to real."""
    q, k = F.coalesce(col(quality), F.lit("")), F.coalesce(col(source_kind), F.lit(""))
    return when_chain(
        [
            (F.coalesce(col(is_fallback), F.lit(False)), "fallback"),
            ((q == "FALLBACK") | (k == vocab.SOURCE_FALLBACK), "fallback"),
            (q == "UNAVAILABLE", "unavailable"),
            ((q == "REAL") | (k == vocab.SOURCE_IMERG), "real"),
        ],
        F.lit("unreported"),
    )


def live_tone(quality, source_kind) -> Column:
    """Live records need both a REAL status and a satellite source to read as real."""
    q = F.upper(F.coalesce(col(quality), F.lit("")))
    k = F.coalesce(col(source_kind), F.lit(""))
    satellite = [n for n, rank in vocab.LIVE_SOURCE_RANK.items() if rank < 3]
    return when_chain(
        [
            (q == "UNAVAILABLE", "unavailable"),
            ((q == "FALLBACK") | (k == vocab.SOURCE_FALLBACK), "fallback"),
            ((q == "REAL") & k.isin(satellite), "real"),
        ],
        F.lit("unreported"),
    )


def source_label(source, source_kind, quality, is_fallback) -> Column:
    """Short clause naming the series really used; a fallback never reads as satellite."""
    s, k, q = col(source), col(source_kind), col(quality)
    return when_chain(
        [
            (
                F.coalesce(col(is_fallback), F.lit(False)),
                F.format_string(
                    vocab.LABEL_FALLBACK,
                    F.coalesce(s, F.lit(vocab.FALLBACK_SERIES)),
                    F.coalesce(q, F.lit("FALLBACK")),
                ),
            ),
            (
                F.coalesce(k == vocab.SOURCE_IMERG, F.lit(False)) | (k.isNull() & s.isNotNull()),
                F.format_string(vocab.LABEL_SATELLITE, F.coalesce(s, F.lit(vocab.SOURCE_IMERG))),
            ),
            (
                k.isNotNull(),
                F.format_string(
                    vocab.LABEL_OTHER,
                    F.coalesce(s, k), F.coalesce(q, F.lit("UNKNOWN")),
                ),
            ),
        ],
        F.lit(vocab.LABEL_UNREPORTED),
    )


PROVENANCE_FIELDS = [
    "source", "source_kind", "is_fallback", "data_quality_status", "requested_date",
    "rainfall_observation_date", "fetched_at_utc", "units",
]


def provenance_block(available: list[str]) -> Column:
    """One field list from whatever columns a producer has; all null means no block.

    Producers that call the observation day target_date are understood too.
    """
    def field(name):
        if name == "rainfall_observation_date" and "target_date" in available:
            own = F.col(name) if name in available else F.lit(None)
            return F.coalesce(own.cast("string"), F.col("target_date").cast("string"))
        return F.col(name) if name in available else F.lit(None).cast("string")

    present = [field(n).isNotNull() for n in PROVENANCE_FIELDS]
    any_present = present[0]
    for p in present[1:]:
        any_present = any_present | p
    fallback = F.coalesce(field("is_fallback").cast("boolean"), F.lit(False))
    members = [
        (fallback if n == "is_fallback" else field(n)).alias(n) for n in PROVENANCE_FIELDS
    ]
    warning = F.when(fallback, vocab.FALLBACK_WARNING).alias("fallback_warning")
    return F.when(any_present, F.struct(*members, warning))


RAIN_VIEW_FIELDS = [
    "source", "source_kind", "run_type", "is_fallback", "data_quality_status", "units",
    "requested_date", "rainfall_observation_date", "fetched_at_utc", "freshness",
    "window_days", "aoi_uniform", "note", "caveats",
]


def rain_view(record: str, fields: list[str]) -> Column:
    """Allow-listed projection of a rainfall struct; the series and features are left out."""
    kept = [n for n in RAIN_VIEW_FIELDS if n in fields]
    some = F.lit(False)
    for n in kept:
        some = some | F.col(f"{record}.{n}").isNotNull()
    return F.when(some, F.struct(*[F.col(f"{record}.{n}").alias(n) for n in kept]))
