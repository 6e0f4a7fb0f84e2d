"""Column functions: guarded arithmetic, trend arrows, fiscal labels, implied moves and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative differences under this are flat.
FLAT = 0.005


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is zero or null."""
    return F.try_divide(x, F.nullif(y, F.lit(0)))


def growth(now: Column, before: Column) -> Column:
    """(now - before) / |before|, null where before is zero."""
    return F.try_divide(now - before, F.nullif(F.abs(before), F.lit(0)))


def arrow(x: Column, y: Column) -> Column:
    """How x compares with the longer-run y: up, down or flat within FLAT of the larger magnitude."""
    gap = F.coalesce(F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y))), F.lit(0.0))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(gap < FLAT, "→").when(x > y, "↑").otherwise("↓")


def arrows(short: Column, middle: Column, long: Column) -> Column:
    """Two arrows: short against middle, middle against long."""
    return F.concat(arrow(short, middle), arrow(middle, long))


def arrow_colour(pair: Column) -> Column:
    return F.when(pair == "↑↑", "green").when(pair == "↓↓", "red").when(pair.isNotNull(), "yellow")


def implied_move(iv: Column, monthly: bool = False) -> Column:
    """Percent move that an annual volatility implies for a week, or a month."""
    return iv * F.sqrt(F.lit(1.0) / F.lit(12.0 if monthly else 52.0)) * 100


def fiscal_label(end: Column, year_end_month: Column) -> Column:
    """q<n>-<yyyy>, or q<n>-fy<yyyy> where the fiscal year doesn't end in December."""
    month = F.month(end)
    quarter = F.floor(F.pmod(month - year_end_month - 1, F.lit(12)) / 3) + 1
    year = F.year(end) + F.when(month <= year_end_month, 0).otherwise(1)
    return F.concat(F.lit("q"), quarter.cast("string"), F.when(year_end_month == 12, "-").otherwise("-fy"), year.cast("string"))


def quarter_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, "q([1-4])", 1), F.lit("")).cast("int")


def fiscal_year(label: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(label, F.lit(r"(\d{4})"), F.lit(1)), F.lit(-1)).cast("int")


def iso_date(text: Column) -> Column:
    """The date in the first ten characters, null where there is none."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def accession(text: Column) -> Column:
    """18 digits as 10-2-6."""
    return F.concat_ws("-", F.substring(text, 1, 10), F.substring(text, 11, 2), F.substring(text, 13, 6))


def short_lag(settled: Column, end: Column) -> Column:
    return F.date_diff(settled, end)


def epoch_day(seconds: Column) -> Column:
    """The UTC date of seconds since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def short_snapshot(payload: Column) -> Column:
    """The newest short interest in a vendor's JSON: null without shares short.

    pct_float is a fraction of the float, worked out from the float's shares where the vendor leaves it out; as_of is the settlement's UTC day.
    """
    j = F.from_json(payload, "sharesShort double, shortPercentOfFloat double, floatShares double, sharesShortPriorMonth double, shortRatio double, dateShortInterest long")
    pct = F.coalesce(j.shortPercentOfFloat, ratio(j.sharesShort, j.floatShares))
    as_of = epoch_day(F.nullif(j.dateShortInterest, F.lit(0)))
    return F.when(F.coalesce(j.sharesShort, F.lit(0.0)) != 0, F.struct(pct.alias("pct_float"), j.sharesShort.alias("shares_short"), j.sharesShortPriorMonth.alias("prior_shares_short"), j.shortRatio.alias("days_to_cover"), as_of.alias("as_of")))


def bar_move(open_: Column, close: Column) -> Column:
    """By how much a bar's close lies over its open."""
    return close - open_
