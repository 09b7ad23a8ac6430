"""Numeric and date columns: ordered pairs, ranges, rounding, status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered(low: Column, high: Column) -> tuple[Column, Column]:
    """The pair, swapped if both are there and out of order."""
    wrong = low.isNotNull() & high.isNotNull() & (low > high)
    return F.when(wrong, high).otherwise(low), F.when(wrong, low).otherwise(high)


def overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Ranges meet; a one-sided range is a point, an empty one meets nothing."""
    al, ah = F.coalesce(a_low, a_high), F.coalesce(a_high, a_low)
    bl, bh = F.coalesce(b_low, b_high), F.coalesce(b_high, b_low)
    return F.coalesce((al <= bh) & (bl <= ah), F.lit(False))


def half_up(c: Column) -> Column:
    """Rounds halves up, as JavaScript does."""
    return F.floor(c + 0.5)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def mean_of(scores: Column) -> Column:
    """Mean of a map's values, to 4 places; 0 if it is empty or null."""
    values = F.map_values(F.coalesce(scores, F.create_map().cast("map<string,double>")))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.when(F.size(values) > 0, F.round(total / F.size(values), 4)).otherwise(F.lit(0.0))


def status(notes: Column, kind: Column, deadline: Column, as_of: Column) -> Column:
    """Status of a record: notes first, then deadline."""
    text = F.lower(F.array_join(F.coalesce(notes, F.array().cast("array<string>")), " "))
    return (
        F.when(text.contains("suspended"), "suspended")
        .when(text.contains("archived") | text.contains("closed"), "closed")
        .when(kind.isin("Open", "Rolling"), "active")
        .when(deadline.isNull(), "unknown")
        .when(deadline < as_of, "closed")
        .otherwise("active")
    )


def view_status(kind: Column, deadline: Column, as_of: Column) -> Column:
    """Status that the catalogue shows: closing soon within 14 days."""
    days = F.datediff(deadline, as_of)
    return (
        F.when(deadline.isNull(), F.when(kind.isin("Open", "Rolling"), "active").otherwise("draft"))
        .when(days < 0, "closed")
        .when(days <= 14, "closing_soon")
        .otherwise("active")
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds, null where either is missing or the end is first."""
    d = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    return F.when(d >= 0, d / 1000.0)


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage; 0 of nothing."""
    return F.when(whole > 0, half_up(part * 100.0 / whole)).otherwise(F.lit(0))
