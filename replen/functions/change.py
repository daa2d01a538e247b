"""Change ratios and their bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FROM_NOTHING = 999.0


def percent_change(now: Column, before: Column) -> Column:
    """Percent change; 999 when there was nothing before and something now, 0 when neither."""
    return F.when(before > 0, (now - before) / before * 100).otherwise(F.when(now > 0, FROM_NOTHING).otherwise(0.0))


def yearly_change(now: Column, before: Column) -> Column:
    """Percent change of yearly totals; 100 when there was nothing before."""
    return F.when(before > 0, (now - before) / before * 100).otherwise(F.when(now > 0, 100.0).otherwise(0.0))


def banded(value: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The name of the first bound above value."""
    out = F.lit(last)
    for bound, name in reversed(bounds):
        out = F.when(value < bound, name).otherwise(out)
    return out


def trend(change: Column) -> Column:
    """rising above 10 percent, falling under -10, else steady."""
    return F.when(change > 10, "rising").when(change < -10, "falling").otherwise("steady")
