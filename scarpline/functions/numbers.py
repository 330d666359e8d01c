"""Number and text helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int) -> Column:
    """Round half to even on the scaled value, as array libraries do."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def is_finite(c: Column | str) -> Column:
    """False for null, NaN and both infinities.

    NaN compares as larger than everything in Spark, so one comparison covers all.
    The operand appears once, which keeps long compositions small.
    """
    return F.coalesce(F.abs(col(c).cast("double")) < F.lit(float("inf")), F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def when_chain(pairs, otherwise=None) -> Column:
    """First condition that holds wins; pairs are (condition, value)."""
    chain = F
    for condition, value in pairs:
        chain = chain.when(condition, value if isinstance(value, Column) else F.lit(value))
    return chain.otherwise(otherwise) if otherwise is not None else chain


def reasons(*pairs) -> Column:
    """Array of the texts whose condition holds, in order; empty when none does."""
    return F.array_compact(
        F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs])
    )


def text_list(names) -> Column:
    return F.array(*[F.lit(n) for n in names])
