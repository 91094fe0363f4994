"""Value ranges: a struct of label, min, max and midpoint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeledger.functions.fixed import AMOUNT_SPAN, BRACKETS, OVER_TOP

RANGE = "struct<label:string,min:double,max:double,midpoint:double>"


def _range(label: Column, low: Column, high: Column, mid: Column) -> Column:
    return F.struct(label.alias("label"), low.cast("double").alias("min"), high.cast("double").alias("max"), mid.cast("double").alias("midpoint"))


def zero_range(label: str | Column = "$0") -> Column:
    zero = F.lit(0.0)
    return _range(F.lit(label) if isinstance(label, str) else label, zero, zero, zero)


def normal_label(value: Column) -> Column:
    """Dashes, spaces, commas and ``US$`` made alike, in upper case."""
    plain = F.regexp_replace(value, "[–—]", "-")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[\s,]+", ""), r"(?i)US\$", r"\$")
    return F.upper(plain)


def parse_range(value: Column) -> Column:
    """A bracket by its label, else any ``a-b`` range, else over 50 million, else zero.

    A label in its usual form is looked up as it stands."""
    usual = None
    for name, low, high, mid in BRACKETS:
        bracket = _range(F.lit(name), F.lit(low), F.lit(high), F.lit(mid))
        usual = F.when(value == name, bracket) if usual is None else usual.when(value == name, bracket)
    label = normal_label(F.coalesce(value, F.lit("")))
    known = None
    for name, low, high, mid in BRACKETS:
        bracket = _range(F.lit(name), F.lit(low), F.lit(high), F.lit(mid))
        known = F.when(label == name.replace(",", "").replace(" ", "").upper(), bracket) if known is None else known.when(label == name.replace(",", "").replace(" ", "").upper(), bracket)
    low, high = (F.regexp_extract(label, AMOUNT_SPAN, i).try_cast("double") for i in (1, 2))
    canonical = F.concat(F.lit("$"), F.format_number(low, 0), F.lit("-$"), F.format_number(high, 0))
    spread = F.when((low > 0) & (high >= low), _range(canonical, low, high, (low + high) / 2))
    top = BRACKETS[-1]
    over = F.when(F.coalesce(value, F.lit("")).rlike(OVER_TOP), _range(*(F.lit(x) for x in top)))
    unknown = zero_range(F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("Unknown")))
    return F.coalesce(usual, known, spread, over, unknown)


def bracket_of(amount: Column) -> Column:
    """The bracket an amount falls in; below the first, a zero range."""
    found = F.when(amount < 1001, zero_range("None (or less than $1,001)"))
    for name, low, high, mid in BRACKETS[:-1]:
        found = found.when(amount <= high, _range(F.lit(name), F.lit(low), F.lit(high), F.lit(mid)))
    return found.otherwise(_range(*(F.lit(x) for x in BRACKETS[-1])))


def bracket_number(amount: Column) -> Column:
    """Which bracket an amount falls in, from 1; 0 below the first.  A number is what a
    row carries through a shuffle, :func:`numbered_range` makes the range of it."""
    found = F.when(amount < 1001, 0)
    for n, (_, _, high, _) in enumerate(BRACKETS[:-1], 1):
        found = found.when(amount <= high, n)
    return found.otherwise(len(BRACKETS))


def numbered_range(number: Column) -> Column:
    found = F.when(number == 0, zero_range("None (or less than $1,001)"))
    for n, bracket in enumerate(BRACKETS[:-1], 1):
        found = found.when(number == n, _range(*(F.lit(x) for x in bracket)))
    return found.otherwise(_range(*(F.lit(x) for x in BRACKETS[-1])))


def sum_range(value: str, when: Column | None = None, label: str = "Total") -> Column:
    """Component-wise sum over a group; rows outside ``when`` add nothing."""

    def part(name: str) -> Column:
        field = F.col(f"{value}.{name}")
        return F.coalesce(F.sum(F.when(when, field) if when is not None else field), F.lit(0.0))

    return _range(F.lit(label), part("min"), part("max"), part("midpoint"))


def plus(left: str, right: str, label: str) -> Column:
    return _range(F.lit(label), *(F.coalesce(F.col(f"{left}.{n}"), F.lit(0.0)) + F.coalesce(F.col(f"{right}.{n}"), F.lit(0.0)) for n in ("min", "max", "midpoint")))


def minus_clamped(left: Column, right: Column, label: str) -> Column:
    """Interval difference that does not fall below zero."""
    zero = F.lit(0.0)
    pairs = (("min", "max"), ("max", "min"), ("midpoint", "midpoint"))
    return _range(F.lit(label), *(F.greatest(zero, left[a] - right[b]) for a, b in pairs))


def net_range(purchases: Column, sales: Column, label: str = "Net") -> Column:
    return _range(F.lit(label), purchases["min"] - sales["max"], purchases["max"] - sales["min"], purchases["midpoint"] - sales["midpoint"])


def net_direction(midpoint: Column) -> Column:
    return F.when(midpoint > 0, "Net buy").when(midpoint < 0, "Net sale").otherwise("Hold")


def round1(x: Column) -> Column:
    """One decimal, halves up."""
    return F.floor(x * 10 + 0.5) / 10


def compact_money(value: Column) -> Column:
    """Short US dollars with at most one decimal: $1.5K, $2M, -$3.1B."""
    size = F.abs(value)
    units = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]
    text = None
    for i, (unit, name) in enumerate(units):
        # What would round up to a thousand of the smaller unit takes the larger one.
        least = unit if i + 1 > len(units) - 1 else unit * 0.99995
        short = F.concat(F.regexp_replace(F.format_string("%.1f", F.floor(size / unit * 10 + 0.5) / 10), r"\.0$", ""), F.lit(name))
        text = F.when(size >= least, short) if text is None else text.when(size >= least, short)
    small = F.regexp_replace(F.format_string("%.1f", F.floor(size * 10 + 0.5) / 10), r"\.0$", "")
    return F.concat(F.when(value < 0, "-$").otherwise("$"), text.otherwise(small))


def short_money(value: Column) -> Column:
    """Dollars in millions with one decimal, in whole thousands, or whole."""
    rounded = lambda x, scale: F.floor(x * scale + 0.5) / scale
    millions = F.format_string("$%.1fM", rounded(value / 1_000_000, 10))
    return F.when(value >= 1_000_000, millions).when(value >= 1_000, F.format_string("$%.0fK", rounded(value / 1_000, 1))).otherwise(F.format_string("$%.0f", rounded(value, 1)))
