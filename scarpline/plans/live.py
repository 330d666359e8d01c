"""The live record of every area: newest observation, totals, age, source, or why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import clock
from ..operators import rainfall


def live_records(areas: DataFrame, observations: DataFrame, now: Column, key: str = "aoi") -> DataFrame:
    """One record per area from the best-ranked source that has any observation.

    observations: key, source_kind, slot, mm, with half-hour slots for the satellite
    kinds and hours for the fallback. Runs of different sources are never mixed in one
    sum. An area without any observation keeps its row, all numbers null, with a reason.
    """
    def of(kinds: list[str], minutes: int) -> DataFrame:
        mine = observations.where(F.col("source_kind").isin(kinds))
        keys = [key, "source_kind"]
        run = rainfall.contiguous_run(mine, keys, now, minutes)
        return rainfall.complete_accumulation(run, keys, minutes).withColumn(
            "interval_minutes", F.lit(minutes)
        )

    satellite = [k for k in vocab.LIVE_SOURCE_RANK if k != vocab.SOURCE_FALLBACK]
    found = of(satellite, vocab.SLOT_MINUTES).unionByName(
        of([vocab.SOURCE_FALLBACK], vocab.FALLBACK_INTERVAL_MINUTES)
    )
    rank = F.create_map(*[F.lit(v) for kv in vocab.LIVE_SOURCE_RANK.items() for v in kv])
    values = [c for c in found.columns if c != key]
    best = found.groupBy(key).agg(
        F.min_by(F.struct(*values), F.element_at(rank, F.col("source_kind"))).alias("_best")
    ).select(key, "_best.*")
    joined = areas.join(best, key, "left")
    age = clock.age_minutes(clock.age_seconds("observed_at", now))
    nothing = F.col("observed_at").isNull()
    none_text = "no observation was retrieved, so no accumulation exists"
    return joined.withColumns({
        "age_minutes": age,
        "freshness_label": clock.freshness(age),
        "is_stale": age > vocab.STALE_MINUTES,
        "data_quality_status": F.when(nothing, "UNAVAILABLE")
        .when(F.col("source_kind") == vocab.SOURCE_FALLBACK, "FALLBACK").otherwise("REAL"),
        "unavailable_reason": F.when(nothing, "no satellite slot and no fallback observation"),
        **{
            f"accum_{h}h_reason": F.when(nothing, none_text).otherwise(F.col(f"accum_{h}h_reason"))
            for h in vocab.ACCUMULATION_HOURS
        },
    })
