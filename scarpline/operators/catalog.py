"""Event catalogue: coercion, de-duplication, quality gates and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.numbers import blank_to_null, col, rounded
from . import aoi as aoi_ops

# Shape of a date text -> its pattern; ISO shapes go through the cast, which is fastest.
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
OTHER_SHAPES = [
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2} [AP]M$", "MM/dd/yyyy hh:mm:ss a"),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}(:\d{2})?$", "MM/dd/yyyy HH:mm[:ss]"),
    (r"^\d{2}-[A-Z][a-z]{2}-\d{4}$", "dd-MMM-yyyy"),
]


def parse_date(c: Column | str) -> Column:
    """Timestamp of a mixed-format text; blank, 'nan' and anything else become null.

    The shape picks one parser, so no row pays for failed attempts.
    """
    text = F.trim(col(c))
    shaped = lambda shape: F.rlike(text, F.lit(shape))
    chain = F.when(shaped(ISO_SHAPE), text.try_cast("timestamp_ntz"))
    for shape, pattern in OTHER_SHAPES:
        chain = chain.when(
            shaped(shape), F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
        )
    return chain


def has_date_text(c: Column | str) -> Column:
    """The rule of the event list: neither blank nor the literal 'nan'."""
    text = blank_to_null(c)
    return text.isNotNull() & (F.lower(text) != "nan")


def is_precise(c: Column | str, raw: bool = False) -> Column:
    """Trimmed and case-folded by default; raw compares the stored label as it is."""
    label = col(c) if raw else F.lower(F.trim(col(c)))
    return F.coalesce(label.isin(vocab.PRECISE_ACCURACY), F.lit(False))


def accuracy_class(c: Column | str) -> Column:
    return F.when(is_precise(c), vocab.PRECISE_LABEL).otherwise(vocab.APPROXIMATE_LABEL)


def coerce_catalog(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """All-text catalogue rows to typed ones; rows without parseable coordinates go."""
    text = [c for c in vocab.EVENT_TEXT_FIELDS if c in raw.columns]
    lat = F.col("latitude").try_cast("double")
    lon = F.col("longitude").try_cast("double")
    extra = [F.col(c) for c in keep if c in raw.columns]
    fatal = (
        [F.col("fatality_count").try_cast("double").try_cast("int").alias("fatality_count")]
        if "fatality_count" in raw.columns else []
    )
    return raw.where(lat.isNotNull() & lon.isNotNull()).select(
        *extra,
        lat.alias("latitude"), lon.alias("longitude"),
        blank_to_null("event_date").alias("event_date"),
        *[blank_to_null(c).alias(c) for c in text],
        *fatal,
    )


def first_rows(df: DataFrame, group: list[str], position: str, last: bool = False) -> DataFrame:
    """The whole row of each group with the smallest (largest) position, which is unique.

    Only the position is aggregated, in a hash table and before the shuffle; the rows then
    meet the chosen positions in a semi-join, which is a broadcast where groups are few.
    """
    best = df.groupBy(*group).agg((F.max if last else F.min)(position).alias(position))
    return df.join(best.select(position), position, "left_semi").select(*df.columns)


def event_dedup(
    events: DataFrame, position: str, key: str = "raw", partition: list[str] = ()
) -> DataFrame:
    """First row by source position wins per (place, date).

    key='raw' compares the date text, key='parsed' the timestamp; undated rows drop.
    The position must be unique. It is aggregated with map-side combine, so a much-repeated
    event is no hot group, and no row is sorted.
    """
    if key == "raw":
        dated = events.where(has_date_text("event_date")).withColumn("_date", F.trim("event_date"))
    else:
        dated = events.withColumn("_date", parse_date("event_date")).where("_date IS NOT NULL")
    return first_rows(dated, [*partition, "latitude", "longitude", "_date"], position).drop("_date")


def source_preference(snapshot: DataFrame, catalog: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of the best source per state; states with neither keep one NONE row.

    The best source is found by aggregation, so no state is gathered in one task.
    """
    both = snapshot.withColumn("priority", F.lit(1)).unionByName(
        catalog.withColumn("priority", F.lit(2)), allowMissingColumns=True
    )
    best = (
        both.groupBy("state").agg(F.min("priority").alias("best"))
        .join(states.select("state"), "state")
    )
    # Inner join with one row per state: the small side can be broadcast, and a state
    # holding most rows is split; an outer join from the dimension could do neither.
    chosen = both.join(best, "state").where(F.col("priority") == F.col("best"))
    empty = states.select("state").join(best, "state", "left_anti")
    name = F.when(F.col("best") == 1, vocab.SNAPSHOT_SOURCE).otherwise(vocab.CATALOG_SOURCE)
    return chosen.withColumn("source", name).drop("priority", "best").unionByName(
        empty.withColumn("source", F.lit("NONE")), allowMissingColumns=True
    )


def uncertainty_summary(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precise and approximate counts and the share of approximate ones, 0.0 when empty."""
    precise = F.count_if(is_precise("location_accuracy"))
    n = F.count("*")
    return events.groupBy(*by).agg(
        precise.alias("precise_lt_5km"),
        (n - precise).alias("approximate_ge_5km"),
        F.coalesce(
            rounded(F.try_divide(F.lit(100.0) * (n - precise), n), 1), F.lit(0.0)
        ).alias("pct_approximate_ge_5km"),
    )


def inventory_quality(events: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per state: events in the box, usable ones and the two quality words.

    The precise share is over all events in the box (raw labels), not the distinct
    ones; a state without events reads Poor/Poor.
    """
    parsed = parse_date("event_date")
    hit = aoi_ops.match_boxes(events, boxes, "inner").withColumn("_date", parsed)
    stats = hit.groupBy("state").agg(
        F.count("*").alias("total"),
        F.count_distinct(
            F.when(F.col("_date").isNotNull(), F.struct("latitude", "longitude", "_date"))
        ).alias("usable"),
        F.count_if(is_precise("location_accuracy", raw=True)).alias("precise"),
    )
    none = F.col("total").isNull()
    word = lambda share, floor: (
        F.when(none, "Poor").when(share > floor, "Good").otherwise("Moderate/Poor")
    )
    return boxes.select("state").join(stats, "state", "left").select(
        "state",
        F.coalesce("total", F.lit(0)).alias("inventory_events"),
        F.coalesce("usable", F.lit(0)).alias("usable_events"),
        word(F.try_divide("precise", "total"), 0.5).alias("spatial_quality"),
        word(F.try_divide("usable", "total"), 0.8).alias("temporal_quality"),
    )


def admin_alias_match(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """(event, state) pairs whose admin name contains an alias, country India.

    Distinct admin names are few next to the events, so the substring test runs on
    them once and the result returns to the events by an equi-join.
    """
    names = (
        events.where(F.col("admin_division_name").isNotNull())
        .select("admin_division_name").distinct()
    )
    by_state = aliases.groupBy("state").agg(F.collect_set("name").alias("names"))
    packed = by_state.agg(F.collect_list(F.struct("state", "names"))).scalar()
    text = F.lower("admin_division_name")
    matched = names.withColumn("_all", packed).withColumn(
        "state",
        F.explode(
            F.transform(
                F.filter("_all", lambda s: F.exists(s["names"], lambda a: F.contains(text, a))),
                lambda s: s["state"],
            )
        ),
    ).drop("_all")
    return events.where("country_name = 'India'").join(matched, "admin_division_name")


def inventory_funnel(events: DataFrame, boxes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per state: India rows, rows in box, admin-name matches, dated distinct places."""
    in_box = aoi_ops.match_boxes(events, boxes, "inner").withColumn(
        "_date", parse_date("event_date")
    ).groupBy("state").agg(
        F.count("*").alias("bbox"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("valid_coords"),
        F.count_distinct(
            F.when(F.col("_date").isNotNull(), F.struct("latitude", "longitude", "_date"))
        ).alias("deduplicated"),
    )
    by_name = admin_alias_match(events, aliases).groupBy("state").agg(F.count("*").alias("admin"))
    india = events.agg(F.count_if(F.col("country_name") == "India")).scalar()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        boxes.select("state").join(in_box, "state", "left").join(by_name, "state", "left")
        .select("state", india.alias("raw_india"), zero("bbox"), zero("admin"),
                zero("valid_coords"), zero("deduplicated"))
    )


def label_gate(events: DataFrame, by: list[str] = (), minimum: int = vocab.MIN_DATES_TEMPORAL_GATE) -> DataFrame:
    """Counts that decide whether dated labels can carry a temporal model."""
    dated = events.withColumn("_date", parse_date("event_date"))
    out = dated.groupBy(*by).agg(
        F.count("*").alias("total_usable_events"),
        F.count("_date").alias("exact_day_events"),
        F.count_distinct("_date").alias("independent_events"),
    )
    ok = F.col("independent_events") >= minimum
    return out.withColumns({
        "use_temporal_ml": ok,
        "recommended_approach": F.when(ok, vocab.GATE_OPTION_A).otherwise(vocab.GATE_OPTION_C),
    })


def catalog_quality(positives: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of low-accuracy labels, independent dates (time stripped), usable count."""
    n = F.count("*")
    low = F.count_if(~is_precise(F.trim("location_accuracy"), raw=True))
    return positives.groupBy(*by).agg(
        F.coalesce(rounded(F.try_divide(low, n) * 100.0, 4), F.lit(0.0)).alias("pct_low_accuracy"),
        F.count_distinct(parse_date("event_date").cast("date")).alias("independent_events"),
        n.alias("total_usable_events"),
    )


def catalog_profile(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """Raw, unparseable, usable and distinct counts with the date range."""
    dated = events.withColumn("_date", parse_date("event_date"))
    place = F.when(F.col("_date").isNotNull(), F.struct("latitude", "longitude", "_date"))
    out = dated.groupBy(*by).agg(
        F.count("*").alias("raw_events"),
        F.count_if(F.col("_date").isNull()).alias("unparseable_dates"),
        F.count("_date").alias("usable_dates"),
        F.count_distinct(place).alias("deduplicated"),
        F.count_distinct(F.col("_date").cast("date")).alias("independent_dates"),
        F.date_format(F.min("_date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("_date"), "yyyy-MM-dd").alias("last_date"),
    )
    return out.withColumn("duplicates_removed", F.col("usable_dates") - F.col("deduplicated"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of several columns in one pass, nulls counted."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 8) -> DataFrame:
    """The k most frequent values per column; ties by value, null last.

    row_number <= k lets Spark keep k rows per column before the shuffle.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return value_counts(df, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def jurisdiction_counts(events: DataFrame) -> DataFrame:
    """Counts by admin name and by country in one pass; blanks are named."""
    named = events.select(*[
        F.coalesce(blank_to_null(c), F.lit("<blank>")).alias(c)
        for c in ("admin_division_name", "country_name")
    ])
    out = (
        named.groupingSets(
            [["admin_division_name"], ["country_name"]], "admin_division_name", "country_name"
        )
        .agg(F.count("*").alias("n"), F.grouping("admin_division_name").alias("_g"))
    )
    return out.select(
        F.when(F.col("_g") == 0, "admin").otherwise("country").alias("dimension"),
        F.coalesce("admin_division_name", "country_name").alias("name"),
        "n",
    ).orderBy("dimension", F.col("n").desc(), "name")


def independent_dates(events: DataFrame, by: list[str] = ()) -> DataFrame:
    return events.groupBy(*by).agg(
        F.count_distinct(F.when(has_date_text("event_date"), F.trim("event_date"))).alias("independent_dates")
    )


def name_contains(c: Column | str, fragment: str) -> Column:
    """Accent- and case-insensitive substring test; null never matches."""
    return F.coalesce(
        F.contains(F.collate(col(c), "UNICODE_CI_AI"), F.collate(F.lit(fragment), "UNICODE_CI_AI")),
        F.lit(False),
    )
