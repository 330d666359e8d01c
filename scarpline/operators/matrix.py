"""Training-matrix assembly: negatives, unions, guards and leakage controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions.numbers import col, is_finite
from ..session import through_table
from . import catalog, prefix

# The position formula: for each axis a prime modulus near 2^31 and two rounds of multiplying,
# so every product is exact in 64-bit integers and ids do not share their positions.
AXES = {
    "lat": (2_147_483_647, 1_500_450_271, 715_827_883, 1_103_515_245),
    "lon": (2_147_483_629, 1_299_709_843, 1_190_494_759, 1_664_525_071),
}
BOX = ("min_lat", "max_lat", "min_lon", "max_lon")


def candidate_point(seed: Column, k: Column) -> tuple[Column, Column]:
    """A position in the row's box from integer arithmetic alone, so any partitioning agrees."""
    out = []
    for axis, (prime, by_seed, by_attempt, again) in AXES.items():
        mixed = F.pmod(F.pmod(seed, F.lit(prime)) * by_seed + k.cast("long") * by_attempt + 12345, F.lit(prime))
        frac = F.pmod(mixed * again + 6789, F.lit(prime)).cast("double") / float(prime)
        low, high = F.col(f"min_{axis}"), F.col(f"max_{axis}")
        out.append(low + frac * (high - low))
    return tuple(out)


def far_from(candidates: DataFrame, places: DataFrame, buffer_deg: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidates at least buffer_deg (Euclidean, in degrees) from every place (of the same `by`).

    Equi anti-join on buffer-sized buckets, places copied to the 3x3 around them.
    Two thinnings come first, both exact: places repeat only once, and a candidate
    sharing a fine bucket (diagonal below the buffer) with any place is certainly too
    near, which keeps the pairwise test to the rims of dense clusters.
    """
    fine = buffer_deg / 2
    fine_key = lambda c: F.floor(F.col(c) / fine)
    occupied = places.select(*by, fine_key("latitude").alias("_fr"), fine_key("longitude").alias("_fc")).distinct()
    open_air = candidates.withColumns({"_fr": fine_key("latitude"), "_fc": fine_key("longitude")}).join(
        occupied, [*by, "_fr", "_fc"], "left_anti"
    ).drop("_fr", "_fc")

    key = lambda c: F.floor(F.col(c) / buffer_deg)
    around = lambda c: F.sequence(key(c) - 1, key(c) + 1)
    # Distinct once more after the copies: what adaptive execution measures, and may broadcast, is
    # then the nine rows a place. From the places alone, or their file, it would take them for one.
    near = (
        places.select(*by, "latitude", "longitude").distinct()
        .withColumn("_br", F.explode(around("latitude")))
        .withColumn("_bc", F.explode(around("longitude")))
        .distinct()
    )
    c = open_air.withColumns({"_br": key("latitude"), "_bc": key("longitude")}).alias("c")
    p = near.alias("p")
    d_lat = F.col("p.latitude") - F.col("c.latitude")
    d_lon = F.col("p.longitude") - F.col("c.longitude")
    too_near = (
        (F.col("c._br") == F.col("p._br")) & (F.col("c._bc") == F.col("p._bc"))
        & (F.sqrt(d_lat * d_lat + d_lon * d_lon) < buffer_deg)
    )
    for name in by:
        too_near = too_near & (F.col(f"c.{name}") == F.col(f"p.{name}"))
    return c.join(p, too_near, "left_anti").drop("_br", "_bc")


def buffered_negatives(
    positives: DataFrame, boxes: DataFrame | dict, key: str = "event_id", ratio: int = 3,
    buffer_deg: float = 0.05, attempts_per_negative: int = 50, first_round: int = 12,
) -> DataFrame:
    """`ratio` accepted points per positive, each positive trying attempts_per_negative x ratio.

    boxes has one row per state, and positives a state; a point lies in its positive's
    box and keeps the distance to that state's positives. One box may be given as a dict
    instead. Pass positives as a table: they are read for the seeds and for the distances.

    Every positive keeps its first accepted candidates in attempt order, so there is
    no global sort or limit. Most positives are served by a short first round; the
    remaining attempts are only generated for those it left short, with the same
    result. The budget is each positive's own: in a crowded place it can run out before
    `ratio` points are found, which `negatives_report` counts. A negative takes the date
    of its positive, so the dates follow the positives' distribution.
    """
    tries = ratio * attempts_per_negative
    first_round = min(first_round, tries)
    if isinstance(boxes, dict):
        by = ()
        seeds = positives.withColumns({c: F.lit(float(boxes[c])) for c in BOX})
    else:
        by = ("state",)
        seeds = positives.join(boxes.select("state", *BOX), "state")
    places = positives.select(*by, "latitude", "longitude")
    seeds = seeds.select(*by, F.col(key).alias("positive_id"), "event_date", *BOX)
    w = Window.partitionBy(*by, "positive_id").orderBy("attempt")

    def attempt_range(base: DataFrame, low: int, high: int) -> DataFrame:
        lat, lon = candidate_point(F.col("positive_id"), F.col("attempt"))
        points = base.withColumn(
            "attempt", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))
        ).withColumns({"latitude": lat, "longitude": lon}).drop(*BOX)
        return far_from(points, places, buffer_deg, by)

    # Written, as the rows it serves and the positives it leaves short are both read from it.
    early = through_table(attempt_range(seeds, 0, first_round), "first-round")
    accepted = early
    if first_round < tries:
        served = early.groupBy(*by, "positive_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= ratio)
        short = seeds.join(served, [*by, "positive_id"], "left_anti")
        accepted = early.unionByName(attempt_range(short, first_round, tries))
    return (
        accepted.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= ratio)
        .select(*by, "positive_id", "attempt", "latitude", "longitude", "event_date")
    )


ROUNDS = (6, 12, 24, 48, 96)  # attempts per positive after each round but the last
DRAW = (1_103_515_245, 12_345, 2_147_483_647)


def budgeted_negatives(
    positives: DataFrame, boxes: DataFrame, key: str = "event_id", ratio: int = 3,
    buffer_deg: float = 0.05, attempts_per_negative: int = 50,
) -> DataFrame:
    """`ratio` points per positive of a state, all from one budget of attempts per state.

    Attempt k of a state is a place in its box; attempts are taken in their order until
    ratio x positives of them keep the distance to every positive, or until
    attempts_per_negative x ratio x positives were made. So a crowded place costs attempts,
    never a negative, while the budget lasts. The i-th negative takes the date of a positive
    drawn by i with replacement: the dates follow the positives' distribution.

    positives, a table: state, key (unique in a state), latitude, longitude, event_date.
    Attempts are numbered by the positives' ranks, so they are made where the positives are;
    which come first is cut by range totals, not by a sort. Later rounds of attempts are made
    only for the states that still lack negatives, with the same result.
    """
    tries = ratio * attempts_per_negative
    ranked = through_table(prefix.running_totals(positives.withColumn("_one", F.lit(1)), key, ["_one"], by=("state",)).drop("_one"), "ranked")
    totals = ranked.groupBy("state").agg(F.count("*").alias("_n"))
    seeds = ranked.select("state", F.col("before__one").alias("_rank")).join(totals, "state").join(boxes.select("state", *BOX), "state")
    places = positives.select("state", "latitude", "longitude")
    accepted, low = None, 0
    for high in [*(w for w in ROUNDS if w < tries), tries]:
        wide = high - low
        lat, lon = candidate_point(F.lit(0).cast("long"), F.col("attempt"))
        points = seeds.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))).withColumn(
            "attempt", F.col("_n") * low + F.col("_rank") * wide + F.col("_j")
        ).withColumns({"latitude": lat, "longitude": lon}).select("state", "attempt", "latitude", "longitude")
        found = through_table(far_from(points, places, buffer_deg, ("state",)), "accepted")
        accepted, low = found if accepted is None else accepted.unionByName(found), high
        served = accepted.groupBy("state").agg(F.count("*").alias("_got"))
        short = totals.join(served, "state", "left").where(F.coalesce("_got", F.lit(0)) < F.col("_n") * ratio)
        short = through_table(short.select("state"), "short")
        if short.isEmpty():  # one row per state
            break
        seeds = seeds.join(short, "state", "left_semi")
    numbered = prefix.running_totals(accepted.withColumn("_one", F.lit(1)), "attempt", ["_one"], by=("state",)).join(totals, "state")
    chosen = numbered.where(F.col("before__one") < F.col("_n") * ratio).withColumn("number", F.col("before__one"))
    dated = ranked.where(catalog.has_date_text("event_date")).select("state", key, "event_date", F.lit(1).alias("_one"))
    dated = prefix.running_totals(dated, key, ["_one"], by=("state",)).select("state", F.col("before__one").alias("_draw"), "event_date")
    many = dated.groupBy("state").agg(F.count("*").alias("_dates"))
    times, plus, prime = DRAW
    drawn = F.pmod(F.pmod(F.col("number") * times + plus, F.lit(prime)), F.col("_dates"))
    return chosen.join(many, "state", "left").withColumn("_draw", drawn).join(dated, ["state", "_draw"], "left").select(
        "state", "number", "attempt", "latitude", "longitude", "event_date"
    )


def negatives_report(
    positives: DataFrame, negatives: DataFrame, key: str = "event_id", ratio: int = 3,
    attempts_per_negative: int = 50, by: tuple[str, ...] = ("state",),
) -> DataFrame:
    """Per state: positives, points wanted, accepted and attempted, and positives left short.

    A positive stops at its last point, or has used its whole budget.
    """
    tries = ratio * attempts_per_negative
    got = negatives.groupBy(*by, "positive_id").agg(F.count("*").alias("_n"), F.max("attempt").alias("_last"))
    each = positives.select(*by, F.col(key).alias("positive_id")).join(got, [*by, "positive_id"], "left")
    full = F.coalesce(F.col("_n") >= ratio, F.lit(False))
    return each.groupBy(*by).agg(
        F.count("*").alias("positives"),
        (F.count("*") * ratio).alias("wanted"),
        F.sum(F.coalesce("_n", F.lit(0))).alias("accepted"),
        F.sum(F.when(full, F.col("_last") + 1).otherwise(tries)).alias("attempted"),
        F.count_if(~full).alias("positives_short"),
    )


def pos_neg_union(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    return positives.withColumn("target", F.lit(1).cast("long")).unionByName(
        negatives.withColumn("target", F.lit(0).cast("long")), allowMissingColumns=True
    )


def feature_bad(name: str) -> Column:
    """A feature is missing when not finite, or -1 for the land-cover label."""
    if name == vocab.LAND_COVER_FEATURE:
        return F.coalesce(F.col(name) == vocab.LAND_COVER_UNAVAILABLE, F.lit(True))
    return ~is_finite(name)


def any_bad(names: list[str]) -> Column:
    bad = F.lit(False)
    for n in names:
        bad = bad | feature_bad(n)
    return bad


def drop_missing_features(matrix: DataFrame, features: list[str]) -> DataFrame:
    return matrix.where(~any_bad(features))


def drop_report(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Rows in and out and both reasons (a row may have both), in one pass."""
    numeric = any_bad([f for f in features if f != vocab.LAND_COVER_FEATURE])
    cover = feature_bad(vocab.LAND_COVER_FEATURE)
    return matrix.agg(
        F.count("*").alias("rows_in"),
        F.count_if(numeric | cover).alias("rows_dropped"),
        F.count_if(~(numeric | cover)).alias("rows_out"),
        F.count_if(numeric).alias("dropped_nonfinite_numeric"),
        F.count_if(cover).alias("dropped_landcover_unavailable"),
    )


def missing_report(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Missing count per feature, plus rows with any and rows without land cover."""
    counts = {f: F.count_if(feature_bad(f)) for f in features}
    counts["_rows_with_any_missing_feature"] = F.count_if(any_bad(features))
    counts["_landcover_unavailable_rows"] = F.count_if(feature_bad(vocab.LAND_COVER_FEATURE))
    wide = matrix.agg(*[c.alias(n) for n, c in counts.items()])
    return wide.unpivot([], list(counts), "feature", "missing")


def unknown_categories(df: DataFrame, column: str, allowed: list[int]) -> DataFrame:
    """Distinct values outside the vocabulary; empty when the column is sound."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).select(column).distinct()


def category_guard(df: DataFrame, column: str, allowed: list[int]) -> DataFrame:
    """The frame itself; a value outside the vocabulary stops the job that reads it."""
    ok = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return df.where(F.assert_true(ok, F.lit(f"{column} holds a value outside its vocabulary")).isNull())


def cast_features(df: DataFrame) -> DataFrame:
    """float features, int category, long target: the stored matrix types."""
    types = {f: "float" for f in vocab.MODEL_FEATURES}
    types[vocab.LAND_COVER_FEATURE] = "int"
    types["target"] = "long"
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def complete_rainfall_only(matrix: DataFrame) -> DataFrame:
    """Abort the job that reads this if any sample's rainfall window is incomplete."""
    ok = F.col("rain_status") == "REAL"
    return matrix.where(F.assert_true(ok, F.lit("a sample has no complete rainfall window")).isNull())


def spatial_holdout(df: DataFrame, split: float | None = None) -> DataFrame:
    """train at or south of the exact latitude median, test north of it."""
    at = F.lit(float(split)) if split is not None else prefix.exact_median(df, "latitude").scalar()
    return df.withColumn("lat_split", at).withColumn(
        "split",
        F.when(F.col("latitude") <= F.col("lat_split"), "train").when(
            F.col("latitude") > F.col("lat_split"), "test"
        ),
    )


def temporal_holdout(df: DataFrame, date: Column | str = "event_date", cutoff_year: int = 2014) -> DataFrame:
    """train up to the cutoff year, test after; an undated row is in neither."""
    year = F.year(col(date))
    return df.withColumn("split", F.when(year <= cutoff_year, "train").when(year > cutoff_year, "test"))


def leakage_audit(samples: DataFrame, by: list[str] = ()) -> DataFrame:
    """Duplicate positives and the years on either side of the temporal split.

    Duplicates are counted on (place, date text), the key of the de-duplication.
    """
    dated = temporal_holdout(
        samples.withColumn("_ts", catalog.parse_date("event_date")), "_ts"
    )
    year = F.year("_ts")
    pos = F.col("target") == 1
    return dated.groupBy(*by).agg(
        F.count_if(pos).alias("positives"),
        F.count_distinct(F.when(pos, F.struct("latitude", "longitude", "event_date"))).alias("unique_positives"),
        F.max(F.when(F.col("split") == "train", year)).alias("train_last_year"),
        F.min(F.when(F.col("split") == "test", year)).alias("test_first_year"),
        F.count_if(F.col("split").isNull()).alias("undated"),
    ).withColumn("duplicate_positives", F.col("positives") - F.col("unique_positives"))
