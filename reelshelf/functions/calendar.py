"""Broadcast seasons on the Japanese calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv


def month_season(month: Column) -> Column:
    """Season of a month number, NULL outside 1 to 12."""
    names = F.array(*[F.lit(s) for s in fv.SEASONS])
    quarter = F.ceil(month / 3).cast("int")
    return F.when(month.between(1, 12), F.try_element_at(names, quarter))


def _japan_clock(ts: Column) -> Column:
    # Shifting a UTC wall clock keeps the result independent of the session zone.
    return ts.cast("timestamp_ntz") + F.expr("INTERVAL 9 HOURS")


def current_season(ts: Column) -> Column:
    """Struct(year, season) in which a UTC time falls in Japan."""
    local = _japan_clock(ts)
    return F.struct(F.year(local).alias("year"), month_season(F.month(local)).alias("season"))


def next_season(ts: Column) -> Column:
    """Struct(year, season) one quarter after :func:`current_season`."""
    # Start of the quarter first, so that adding months cannot skip a short one.
    local = F.add_months(F.trunc(_japan_clock(ts).cast("date"), "quarter"), 3)
    return F.struct(F.year(local).alias("year"), month_season(F.month(local)).alias("season"))
