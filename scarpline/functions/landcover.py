"""Land-cover codes are labels; every mapping here is a lookup, never arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .numbers import col, is_finite


def group_of(code: Column | str) -> Column:
    """Group 1..6 of a raw code, or -1 for nodata, unknown, null and non-finite."""
    table = F.create_map(
        *[F.lit(v) for pair in sorted(vocab.LAND_COVER_GROUPS.items()) for v in pair]
    )
    value = col(code).cast("double")
    usable = is_finite(value) & (F.abs(value) < 1e6)
    found = F.when(usable, F.try_element_at(table, F.rint(value).cast("int")))
    return F.coalesce(found, F.lit(vocab.LAND_COVER_UNAVAILABLE))


def proxy_class(elevation: Column | str) -> Column:
    """Elevation-binned stand-in; an unusable elevation stays null."""
    low, high = vocab.PROXY_BREAKS_M
    z = col(elevation)
    return F.when(is_finite(z), F.when(z < low, 1).when(z < high, 2).otherwise(3))
