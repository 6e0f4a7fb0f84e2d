"""How figures are shown: money, volumes, percents, multiples and ranges as text. Missing figures have a mark of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING, NO_MULTIPLE, HOLE = "—", "n/m", "·"


def _told(value: Column, text: Column, missing: str) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(missing)).otherwise(text)


def fixed(value: Column, digits: int) -> Column:
    """Thousands parted by commas, digits decimals."""
    return F.format_string(f"%,.{digits}f", value.cast("double"))


def money(value: Column) -> Column:
    """$1.23B, $45M or $6,789."""
    size = F.abs(value)
    text = F.when(size >= 1e9, F.format_string("$%.2fB", value / 1e9)).when(size >= 1e6, F.format_string("$%.0fM", value / 1e6)).otherwise(F.format_string("$%,.0f", value.cast("double")))
    return _told(value, text, MISSING)


def millions(value: Column, digits: int = 1) -> Column:
    return _told(value, fixed(value / 1e6, digits), MISSING)


def volume(value: Column) -> Column:
    """1.6M, 949K or 42."""
    size = F.abs(value)
    text = F.when(size >= 1e6, F.format_string("%.1fM", value / 1e6)).when(size >= 1e3, F.format_string("%.0fK", value / 1e3)).otherwise(F.format_string("%.0f", value.cast("double")))
    return _told(value, text, HOLE)


def price(value: Column) -> Column:
    return _told(value, F.format_string("%.2f", value.cast("double")), MISSING)


def short_price(value: Column) -> Column:
    """Four places: 1234, 12.3 or 1.23."""
    x = value.cast("double")
    text = F.when(x >= 100, F.format_string("%4.0f", x)).when(x >= 10, F.format_string("%4.1f", x)).otherwise(F.format_string("%4.2f", x))
    return _told(value, text, HOLE)


def price_chain(values: list[Column]) -> Column:
    """Prices with > (not less) or < between neighbours; n/a without any, a hole drops the signs beside it."""
    out = short_price(values[0])
    for before, now in zip(values, values[1:]):
        sign = F.when(before.isNull() | now.isNull(), " ").when(before >= now, " > ").otherwise(" < ")
        out = F.concat(out, sign, short_price(now))
    return F.when(F.coalesce(*values).isNull(), "n/a").otherwise(out)


def percent(fraction: Column, digits: int = 1, missing: str = MISSING) -> Column:
    """A fraction with its sign: +2.9%."""
    return _told(fraction, F.format_string(f"%+.{digits}f%%", fraction * 100), missing)


def share(fraction: Column, provisional: Column | None = None) -> Column:
    """A whole percent without sign, in brackets while its period is still running."""
    text = F.format_string("%.0f%%", fraction * 100)
    return _told(fraction, text if provisional is None else F.when(provisional, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), HOLE)


def multiple(value: Column) -> Column:
    return _told(value, F.format_string("%.1fx", value), NO_MULTIPLE)


def multiple_range(low: Column, high: Column) -> Column:
    """5.3x where both ends round to it, else 1.4–1.5x."""
    a, b = F.format_string("%.1f", low), F.format_string("%.1f", high)
    return F.when(low.isNull() | high.isNull(), NO_MULTIPLE).when(a == b, F.concat(a, F.lit("x"))).otherwise(F.concat(a, F.lit("–"), b, F.lit("x")))


def money_range(low: Column, high: Column, hint: Column | None = None) -> Column:
    """Whole millions, one figure for an empty range; else the hint why there is none, else a mark."""
    a, b = F.least(low, high) / 1e6, F.greatest(low, high) / 1e6
    text = F.when(b - a < 1e-9, fixed(b, 0)).otherwise(F.concat(fixed(a, 0), F.lit("–"), fixed(b, 0)))
    return F.when(a.isNotNull(), text).otherwise(F.coalesce(hint, F.lit(MISSING)) if hint is not None else F.lit(MISSING))


def short_interest(shares: Column, lag: Column) -> Column:
    """Millions, with the days by which the settlement lies off the period's end."""
    off = F.when(F.coalesce(lag, F.lit(0)) != 0, F.format_string(" (%+dd)", lag)).otherwise("")
    return _told(shares, F.concat(fixed(shares / 1e6, 1), off), MISSING)


def day(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yy-MM-dd"), F.lit(MISSING))


def significant(value: Column) -> Column:
    """Three significant digits without trailing zeros, with an exponent below 1e-4 and from 1e3 on."""
    ten = lambda n: F.pow(F.lit(10.0), n)
    x = value.cast("double")
    rough = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
    digits = F.bround(x / ten(rough - 2))
    exponent = F.when(F.abs(digits) >= 1000, rough + 1).otherwise(rough)
    trimmed = lambda t: F.regexp_replace(t, r"\.?0+$", "")
    plain = trimmed((digits * ten(rough - 2)).cast("decimal(30,6)").cast("string"))
    power = F.concat(trimmed(F.format_string("%.2f", digits * ten(rough - 2) / ten(exponent))), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when((exponent < -4) | (exponent >= 3), power).otherwise(plain)


def affine(gain: Column, offset: Column) -> Column:
    """×gain +offset in three significant digits, empty without a map."""
    sign = F.when(offset >= 0, "+").otherwise("−")
    return F.when(gain.isNull(), "").otherwise(F.concat(F.lit("×"), significant(gain), F.lit(" "), sign, significant(F.abs(offset))))
