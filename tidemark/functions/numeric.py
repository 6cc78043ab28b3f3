"""Small numeric column helpers: missing is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """Text to a finite double; anything else is null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clamp(x: Column, low, high) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def band_score(x: Column, low: float, high: float, tolerance: float) -> Column:
    """100 within the band, falling linearly to 0 at ``tolerance`` beyond it; null for null."""
    gap = F.greatest(F.lit(low) - x, x - F.lit(high), F.lit(0.0))
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), 100.0 * (1 - gap / tolerance)))


def cap_score(x: Column, cap: float, tolerance: float) -> Column:
    """100 up to the cap, falling linearly to 0 at ``tolerance`` above it; null for null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), 100.0 * (1 - F.greatest(x - cap, F.lit(0.0)) / tolerance)))


def weighted_present(parts: dict[str, float]) -> Column:
    """The mean of the columns that are there, by weight."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    return F.try_divide(top, present_weight(parts))


def present_weight(parts: dict[str, float]) -> Column:
    return sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))


def over_full(agg: Column, n: int, by: str = "ticker", order: str = "d") -> Column:
    """An aggregate over the last n rows, null while there are fewer."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - n, 0)
    return F.when(F.count(F.lit(1)).over(w) == n, agg.over(w))
