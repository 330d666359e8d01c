"""Exact running totals and medians without a single-task window.

A plain cumulative window needs one partition for the whole order. Here the order is
first cut into ranges at sampled boundaries; totals per range give each range its
offset, and the rows inside a range are accumulated independently. The sample only
decides where the cuts lie, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DEFAULT_RANGES = 256


def running_totals(
    df: DataFrame, key: str, values: list[str], descending: bool = False,
    ranges: int = DEFAULT_RANGES, by: tuple[str, ...] = (),
) -> DataFrame:
    """Add before_<v>: the total of v over keys strictly earlier in the order (of the same `by`).

    `key` must be unique in df (in each `by`), so rows per range are bounded by the distinct keys
    and stay balanced however the original rows were skewed. `ranges` is how many tasks
    can share the order: raise it with the distinct keys. It cannot change the result.
    """
    if ranges & (ranges - 1):
        raise ValueError("ranges must be a power of two")
    listed = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    fractions = F.expr(f"array({listed})")
    cuts = df.agg(F.percentile_approx(key, fractions, 10_000)).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length() - 1))])
    # Binary search among the cuts. The coalesce makes the range provably non-null, so
    # no derived null test is pushed below the aggregation that made the keys distinct.
    place = F.aggregate(
        steps, F.lit(0),
        lambda at, step: at + F.when(F.element_at("_cuts", at + step) < F.col(key), step).otherwise(0),
    )
    ranged = df.withColumn("_cuts", cuts).withColumn(
        "_range", F.coalesce(place, F.lit(0))
    ).drop("_cuts")

    order = F.col("_range").desc() if descending else F.col("_range").asc()
    # At most `ranges` rows (of each `by`) reach this window: it accumulates totals, not data.
    across = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    offsets = offsets.select(
        *by, "_range",
        *[F.coalesce(F.sum(f"_t_{v}").over(across), F.lit(0)).alias(f"_o_{v}") for v in values],
    )
    inner_order = F.col(key).desc() if descending else F.col(key).asc()
    within = (
        Window.partitionBy(*by, "_range").orderBy(inner_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = ranged.join(offsets, [*by, "_range"])
    return out.select(
        *df.columns,
        *[
            (F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(f"before_{v}")
            for v in values
        ],
    )


def exact_median(df: DataFrame, value: str, name: str = "median", ranges: int = DEFAULT_RANGES) -> DataFrame:
    """One row: the averaged exact median of a column, nulls ignored.

    Works on counts per distinct value, so memory does not grow with the rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    placed = running_totals(counts, value, ["n"], ranges=ranges).withColumn("total", total)
    covers = lambda rank: (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
    middle = lambda rank: F.max(F.when(covers(rank), F.col(value)))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return placed.agg(((middle(low) + middle(high)) / 2).alias(name))
