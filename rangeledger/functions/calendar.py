"""Months and marks of a timeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeledger.functions.text import stable_id

MOST_MONTHS = 240


def added_months(date: Column, months: int) -> Column:
    """The same day some months on, at most the last of that month."""
    return F.add_months(date, months)


def months_between(start: Column, end: Column) -> Column:
    """Months (yyyy-MM) from start to end, at most 240; none if end is earlier."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    named = F.transform(months, lambda d: F.date_format(d, "yyyy-MM"))
    return F.when(F.trunc(end, "month") >= F.trunc(start, "month"), F.slice(named, 1, MOST_MONTHS)).otherwise(F.array().cast("array<string>"))


def clamped(date: Column, low: Column, high: Column) -> Column:
    return F.when(date < low, low).when(date > high, high).otherwise(date)


def is_iso_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def month_fraction(date: Column) -> Column:
    """How far into its month a day is: 0 on the first."""
    return (F.day(date) - 1) / F.greatest(F.lit(1), F.day(F.last_day(date)) - 1)


def signed_jitter(seed: Column, amplitude: Column) -> Column:
    """A repeatable shift within the amplitude, by the seed's hash."""
    value = F.conv(stable_id(seed), 16, 10).cast("long") % 10_000 / 10_000.0
    return (value - 0.5) * 2 * amplitude


def every_kth(number: Column, total: Column, most: Column) -> Column:
    """Whether tick ``number`` (from 0) of ``total`` is shown: every k-th and the last."""
    step = F.greatest(F.lit(1), F.ceil(total / most))
    return (number % step == 0) | (number == total - 1)
