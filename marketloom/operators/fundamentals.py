"""Quarter records: year-to-date differencing, trailing sums, fiscal years, guidance and multiples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import growth, ratio

KEY = ["sym"]
#: Factors of the units that money is reported in.
UNITS = {"thousands": 1e3, "millions": 1e6, "units": 1.0}


def family_of(quarters: DataFrame, lines: dict[str, str], name: str = "ytd_capex") -> DataFrame:
    """A map of the lines that a quarter has, from columns that are null where it has none."""
    own = F.create_map(*(x for line, c in lines.items() for x in (F.lit(line), F.col(c).cast("double"))))
    return quarters.withColumn(name, F.map_filter(own, lambda _, v: v.isNotNull()))


def standalone(quarters: DataFrame, columns: list[str], family: str = "ytd_capex") -> DataFrame:
    """q_<column>: a quarter's own part of a year-to-date value; null where the quarter before is missing.

    A column named family is a map of lines, and q_<family> a map of their parts: a line that the quarter before lacks is null.
    """
    order = Window.partitionBy(*KEY, "fy").orderBy("qn")
    follows = F.lag("qn").over(order) == F.col("qn") - 1
    out = quarters.withColumns({f"q_{c}": F.when(F.col("qn") == 1, F.col(c)).when(follows, F.col(c) - F.lag(c).over(order)) for c in columns})
    if family in quarters.columns:
        out = out.withColumns({"__before": F.when(follows, F.lag(family).over(order))})
        part = F.transform_values(family, lambda k, v: F.when(F.col("qn") == 1, v).otherwise(v - F.col("__before")[k]))
        out = out.withColumn(f"q_{family}", part).drop("__before")
    return out


def sum_present(quarters: DataFrame, family: str = "ytd_capex") -> DataFrame:
    """capex_lines and capex_total: the lines that a quarter has, ppe first, and the sum of their parts: zero without lines, null if a part can't be told."""
    names = F.array_sort(F.map_keys(F.coalesce(family, F.create_map().cast("map<string,double>"))))
    lines = F.concat(F.filter(names, lambda x: x == "ppe"), F.filter(names, lambda x: x != "ppe"))
    total = F.aggregate(F.map_values(F.coalesce(f"q_{family}", F.create_map().cast("map<string,double>"))), F.lit(0.0), lambda a, x: a + x)
    return quarters.withColumns({"capex_lines": F.array_join(lines, ","), "capex_total": total})


def line_label(line: Column) -> Column:
    """How a capex line is shown."""
    return F.when(line == "ppe", "PP&E").otherwise(line)


def trailing(quarters: DataFrame, columns: list[str], count: int = 4, needs: str = "revenue") -> DataFrame:
    """ttm_<column>: the sum over the last count quarters, null where one lacks the value or the column needs."""
    w = Window.partitionBy(*KEY).orderBy("end_date").rowsBetween(1 - count, 0)
    return quarters.withColumns({f"ttm_{c}": F.when((F.count(c).over(w) == count) & (F.count(needs).over(w) == count), F.sum(c).over(w)) for c in columns})


def latest_trailing(quarters: DataFrame, columns: list[str], count: int = 4) -> DataFrame:
    """One row a symbol: ttm_<column> over its newest count quarters, each null on its own where one lacks the value."""
    newest = quarters.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("end_date")))).where(F.col("__n") <= count)
    whole = lambda c: F.when((F.count(c) == count) & (F.count("*") == count), F.sum(c))
    return newest.groupBy(*KEY).agg(*(whole(c).alias(f"ttm_{c}") for c in columns))


def latest_lines(quarters: DataFrame, count: int = 4, family: str = "q_ytd_capex") -> DataFrame:
    """(symbol, line, value): each capex line over the newest count quarters, null where one lacks it."""
    newest = quarters.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("end_date")))).where(F.col("__n") <= count)
    own = newest.select(*KEY, F.explode(family).alias("line", "x"))
    return own.groupBy(*KEY, "line").agg(F.when(F.count("x") == count, F.sum("x")).alias("value"))


def fiscal_years(quarters: DataFrame, family: str = "ytd_capex") -> DataFrame:
    """One row a fiscal year: revenue of the quarters, flows and levels of the fourth, the last guidance and estimate of the first three.

    capex_total is the sum of the fourth quarter's lines, null ones left out, and null without lines.
    """
    fourth = lambda c: F.max(F.when(F.col("qn") == 4, F.col(c)))
    has = lambda c: c in quarters.columns
    told = lambda p: F.when((F.col("qn") < 4) & F.coalesce(f"{p}_low", f"{p}_high").isNotNull(), F.col("qn"))
    lines = F.max_by(family, F.when(F.col("qn") == 4, F.lit(1)))
    ranges = [F.max_by(F.col(f"{p}_{end}"), told(p)).alias(f"{name}_{end}") for p, name in (("fy", "guide"), ("est", "est")) if has(f"{p}_low") for end in ("low", "high")]
    levels = [fourth(c).alias(c) for c in ("cash", "debt", "shares", "shares_short", "end_date", "report_date") if has(c)]
    got = quarters.groupBy(*KEY, "fy").agg(
        (F.count_distinct("qn") == 4).alias("complete"), F.nullif(F.sum("revenue"), F.lit(0.0)).alias("revenue"), fourth("ytd_ocf").alias("ocf"), lines.alias("__lines"), fourth("ytd_sbc").alias("sbc"), *levels, *ranges)
    values = F.filter(F.map_values("__lines"), lambda x: x.isNotNull())
    total = F.when(F.size("__lines") > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x))
    return got.withColumns({"ppe": F.col("__lines")["ppe"], "capex_total": total}).withColumnRenamed("__lines", "lines")


def self_match(rows: DataFrame, keys: dict[str, Column], columns: list[str], prefix: str) -> DataFrame:
    """Left self join: keys give, for each key column of the other row, its value from this one."""
    other = rows.select(*(F.col(k).alias(f"__{k}") for k in [*KEY, *keys]), *(F.col(c).alias(f"{prefix}{c}") for c in columns))
    left = rows.withColumns({f"__{k}": e for k, e in keys.items()}).withColumn("__sym", F.col("sym"))
    names = [f"__{k}" for k in [*KEY, *keys]]
    return left.join(other, names, "left").drop(*names)


def year_over_year(quarters: DataFrame, columns: list[str]) -> DataFrame:
    got = self_match(quarters, {"fy": F.col("fy") - 1, "qn": F.col("qn")}, columns, "prior_")
    return got.withColumns({f"{c}_yoy": growth(F.col(c), F.col(f"prior_{c}")) for c in columns})


def midpoint(low: Column, high: Column) -> Column:
    """The middle of a range; one end alone is both."""
    return (F.least(low, high) + F.greatest(low, high)) / 2


def next_quarter_accuracy(quarters: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """The next quarter's revenue over the middle of what this one guided, less one; with shown (sym, fy, qn) only among these quarters."""
    own = quarters if shown is None else quarters.join(shown.select("sym", "fy", "qn"), ["sym", "fy", "qn"], "left_semi")
    keyed = own.withColumn("n", F.col("fy") * 4 + F.col("qn"))
    got = self_match(keyed, {"n": F.col("n") + 1}, ["revenue"], "next_")
    return got.withColumn("accuracy", ratio(F.col("next_revenue"), midpoint(F.col("nq_low"), F.col("nq_high"))) - 1)


def year_accuracy(quarters: DataFrame) -> DataFrame:
    """The fiscal year's revenue over guidance; the fourth quarter guides the year after."""
    years = fiscal_years(quarters).where("complete").select("sym", F.col("fy").alias("target"), F.col("revenue").alias("actual"))
    got = quarters.withColumn("target", F.col("fy") + F.when(F.col("qn") == 4, 1).otherwise(0)).join(years, ["sym", "target"], "left")
    return got.withColumn("accuracy", ratio(F.col("actual"), midpoint(F.col("fy_low"), F.col("fy_high"))) - 1)


def display_columns(quarters: DataFrame, years: int = 2) -> DataFrame:
    """Columns in display order: the newest year's quarters where it isn't complete, newest first, then each of the last complete years before its quarters.

    A symbol without a complete year shows its newest one; incomplete years but the newest aren't shown.
    """
    counts = quarters.groupBy("sym", "fy").agg((F.count_distinct("qn") == 4).alias("complete"))
    newest = counts.where("complete").withColumn("r", F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("fy")))).where(F.col("r") <= years).select("sym", "fy")
    open_ = counts.groupBy("sym").agg(F.max("fy").alias("fy"), F.max_by("complete", "fy").alias("complete")).where("NOT complete").select("sym", "fy")
    cells = quarters.join(newest.unionByName(open_), ["sym", "fy"]).select("sym", "fy", "qn", F.lit(0).alias("is_fy")).unionByName(newest.select("sym", "fy", F.lit(0).alias("qn"), F.lit(1).alias("is_fy")))
    return cells.withColumn("position", F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("fy"), F.desc("is_fy"), F.desc("qn"))))


def money_factor(unit: Column) -> Column:
    return F.create_map(*(x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))))[F.coalesce(unit, F.lit("thousands"))]


def with_fx(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """fx (units of a currency for a dollar) and mult (of the unit reported in); rates has a row a currency: currency, rate.

    RMB is CNY; a currency without a rate, and the dollar, are at one.
    """
    name = F.upper(F.coalesce("currency", F.lit("USD")))
    keyed = rows.withColumn("__currency", F.when(name == "RMB", "CNY").otherwise(name))
    fx = F.when(F.col("__currency") == "USD", 1.0).otherwise(F.coalesce("__rate", F.lit(1.0)))
    return keyed.join(rates.select(F.upper("currency").alias("__currency"), F.col("rate").alias("__rate")), "__currency", "left").withColumns({"fx": fx, "mult": money_factor(F.col("unit"))}).drop("__currency", "__rate")


def flow_columns(ocf: Column, ppe: Column, capex: Column, sbc: Column, revenue: Column) -> dict[str, Column]:
    co, strict = ocf - ppe, ocf - capex
    return {"fcf": co, "fcf_strict": strict, "fcf_ex_sbc": co - sbc, "fcf_strict_ex_sbc": strict - sbc, "fcf_margin": ratio(co, revenue)}


def free_cash_flow(quarters: DataFrame) -> DataFrame:
    """fcf, fcf_strict and both less stock compensation, from standalone columns."""
    return quarters.withColumns(flow_columns(F.col("q_ytd_ocf"), F.col("q_ytd_ppe"), F.col("capex_total"), F.col("q_ytd_sbc"), F.col("revenue")))


def quarter_flows(quarters: DataFrame) -> DataFrame:
    """Standalone flows, capex sums and free cash flows of quarters with ytd_ocf, ytd_sbc and the map ytd_capex."""
    own = sum_present(standalone(quarters, ["ytd_ocf", "ytd_sbc"]))
    return free_cash_flow(own.withColumn("q_ytd_ppe", F.col("q_ytd_capex")["ppe"]))


def multiples(rows: DataFrame, cap: Column, factor: Column) -> DataFrame:
    """ps, and price to each free cash flow, of a market value over trailing columns times factor: null without a positive flow.

    Those on strict flows need the flow before capex beyond plant too, as it is the company's that is cut.
    """
    flow = lambda c: F.col(f"ttm_{c}") * factor
    given = F.col("ttm_fcf").isNotNull()
    strict = {n: F.when(given, multiple(cap, flow(c))) for n, c in (("pfcf_strict", "fcf_strict"), ("pfcf_strict_ex_sbc", "fcf_strict_ex_sbc"))}
    return rows.withColumns({"ps": ratio(cap, flow("revenue")), "pfcf": multiple(cap, flow("fcf")), "pfcf_ex_sbc": multiple(cap, flow("fcf_ex_sbc")), **strict})


def ps_range(cap: Column, low: Column, high: Column, factor: Column, base: Column | None = None) -> list[Column]:
    """The lower and the upper price to sales on a range of revenue, after base where it is given; one end alone is both."""
    more = F.lit(0.0) if base is None else base
    return [ratio(cap, (more + F.greatest(low, high)) * factor), ratio(cap, (more + F.least(low, high)) * factor)]


def priced_quarters(quarters: DataFrame, closes: DataFrame) -> DataFrame:
    """All that a valuation shows of a quarter: flows, trailing sums, multiples and forward ranges at the close of its report's day.

    quarters has sym, fy, qn, end_date, report_date, revenue, ytd_ocf, ytd_sbc, ytd_capex, shares, cash, debt, nq_, fy_ and est_low
    and _high, fx and mult; closes has sym, d, c. A quarter without a close at or before its report's day has no multiples.
    """
    from marketloom.operators.series import asof

    own = trailing(trailing(quarter_flows(quarters), ["revenue"], 3).withColumnRenamed("ttm_revenue", "rev3"), ["revenue", "fcf", "fcf_strict", "fcf_ex_sbc", "fcf_strict_ex_sbc"])
    own = asof(own, closes, "sym", "report_date", "d", ["c"]).withColumnRenamed("bar_c", "price").drop("bar_d")
    cap, factor = F.nullif(F.col("price") * F.col("shares") * F.col("mult"), F.lit(0.0)), F.col("mult") / F.col("fx")
    own = multiples(own, cap, factor).withColumns({"cap": cap, "show_val": F.col("price").isNotNull(), "cash_value": F.col("cash") * factor, "debt_value": F.col("debt") * factor})
    ranges = {"nq_ps": ("nq", F.col("rev3")), "fy_ps": ("fy", None), "est_ps": ("est", None)}
    return own.withColumns({f"{n}_{end}": x for n, (p, base) in ranges.items() for end, x in zip(("low", "high"), ps_range(cap, F.col(f"{p}_low"), F.col(f"{p}_high"), factor, base))})


def priced_today(quarters: DataFrame, prices: DataFrame) -> DataFrame:
    """One row a symbol: trailing sums in dollars over its newest four quarters, multiples and forward ranges at prices (sym, price)."""
    flows = trailing(quarter_flows(quarters), ["revenue"], 3).withColumnRenamed("ttm_revenue", "rev3")
    sums = latest_trailing(flows, ["revenue", "q_ytd_ocf", "q_ytd_ppe", "q_ytd_sbc", "fcf", "fcf_strict", "fcf_ex_sbc", "fcf_strict_ex_sbc"])
    newest = flows.groupBy("sym").agg(F.max_by(F.struct("id", "shares", "cash", "debt", "rev3", "nq_low", "nq_high", "fy_low", "fy_high", "est_low", "est_high", "fx", "mult"), "end_date").alias("q"))
    own = newest.select("sym", "q.*").join(sums, "sym").join(prices.select("sym", "price"), "sym", "left")
    cap, factor = F.nullif(F.col("price") * F.col("shares") * F.col("mult"), F.lit(0.0)), F.col("mult") / F.col("fx")
    own = multiples(own, cap, factor).withColumns({"cap": cap, "cash_value": F.col("cash") * factor, "debt_value": F.col("debt") * factor})
    ranges = {"nq_ps": ("nq", F.col("rev3")), "fy_ps": ("fy", None), "est_ps": ("est", None)}
    return own.withColumns({f"{n}_{end}": x for n, (p, base) in ranges.items() for end, x in zip(("low", "high"), ps_range(cap, F.col(f"{p}_low"), F.col(f"{p}_high"), factor, base))})


def multiple(cap: Column, flow: Column) -> Column:
    """cap / flow, only for a positive flow."""
    return F.when(flow > 0, ratio(cap, flow))


def split_ratio(rows: DataFrame, splits: DataFrame, settled: str) -> DataFrame:
    """ratio: the product of the ratios of splits strictly after the settled day, one if there are none. splits is a small dimension: a symbol's are one array."""
    own = splits.groupBy("sym").agg(F.array_sort(F.collect_list(F.struct("effective", "split"))).alias("__splits"))
    later = F.filter("__splits", lambda x: x.effective > F.col(settled))
    ratio_ = F.aggregate(later, F.lit(1.0), lambda a, x: a * x.split)
    return rows.join(own, "sym", "left").withColumn("ratio", F.coalesce(ratio_, F.lit(1.0))).drop("__splits")


#: A short share of shares outstanding over this is not believed (fixed value).
IMPLAUSIBLE = 0.5


def adjusted_short(rows: DataFrame, qty: str = "qty") -> DataFrame:
    """shares_short as it is stored: the quantity on today's split basis, in the file's unit with three decimals, whole where the unit is one.

    Halves go to the even digit. rows has ratio (split_ratio) and unit.
    """
    share, unit = F.col(qty) * F.col("ratio"), money_factor(F.col("unit"))
    return rows.withColumn("adjusted", F.when(unit > 1, F.bround(share / unit, 3)).otherwise(F.bround(share)))


def implausible_short(short: Column, shares: Column, ratio_: Column) -> Column:
    """Whether a short share is too large to believe: only where no split explains it."""
    return F.coalesce((ratio_ == 1.0) & (ratio(short, shares) > IMPLAUSIBLE), F.lit(False))


def short_share(short: Column, shares: Column, listed_share: Column | None = None) -> Column:
    """Percent of shares outstanding sold short; a vendor's share of the float, a fraction, stands in where it can't be told."""
    own = ratio(short, shares) * 100
    return own if listed_share is None else F.coalesce(own, listed_share * 100)


def short_status(end: Column, as_of: Column, first_listed: Column, settled: Column, have: Column) -> Column:
    return F.when(have.isNotNull(), "kept").when(settled.isNotNull(), "add").when(end > as_of, "pending").when(end < first_listed, "pre-listing").otherwise("no settlement")


def option_iv(chain: DataFrame, as_of: Column, price: Column, by: str = "sym") -> DataFrame:
    """Mean volatility at the strike nearest to the price among those that calls and puts share, at the expiry nearest to 7 of those 3 days off or more."""
    days = F.date_diff("expiry", as_of)
    chosen = chain.where(days >= 3).groupBy(by).agg(F.min_by("expiry", F.struct(F.abs(days - 7), "expiry")).alias("expiry"))
    own = chain.join(chosen, [by, "expiry"])
    calls, puts = (own.where(F.col("side") == s).select(by, "expiry", "strike", F.col("iv").alias(f"{s}_iv")) for s in ("call", "put"))
    both = calls.join(puts, [by, "expiry", "strike"]).withColumn("__gap", F.abs(F.col("strike") - price))
    best = both.groupBy(by, "expiry").agg(F.min_by(F.struct("strike", "call_iv", "put_iv"), F.struct("__gap", "strike")).alias("m"))
    return best.select(by, "expiry", "m.strike", ((F.col("m.call_iv") + F.col("m.put_iv")) / 2).alias("iv"))


def year_columns(years: DataFrame) -> DataFrame:
    """fiscal_years() under the names that quarters have: a year's stock compensation, guidance and short interest."""
    return years.withColumnsRenamed({"sbc": "q_ytd_sbc", "guide_low": "fy_low", "guide_high": "fy_high"})


def visible_rows(columns: DataFrame, quarters: DataFrame, trailing_sums: DataFrame | None = None) -> DataFrame:
    """By symbol, which optional rows of a valuation have something to show.

    columns are all displayed ones, years included (year_columns); trailing_sums (sym, ttm_q_ytd_sbc) is the trailing one. two_fcf asks
    for a capex line beyond plant in any of the symbol's quarters, shown or not.
    """
    some = lambda *c: F.bool_or(F.coalesce(*(F.col(x) if x in columns.columns else F.lit(None) for x in c)).isNotNull())
    lines = F.map_keys(F.coalesce("ytd_capex", F.create_map().cast("map<string,double>")))
    beyond = quarters.groupBy(*KEY).agg(F.bool_or(F.exists(lines, lambda k: k != "ppe")).alias("two_fcf"))
    seen = columns.groupBy(*KEY).agg(some("q_ytd_sbc").alias("has_sbc"), some("est_low", "est_high").alias("has_est"), some("nq_low", "nq_high").alias("has_nq_guide"), some("fy_low", "fy_high").alias("has_fy_guide"), some("shares_short").alias("has_short"))
    got = seen.join(beyond, KEY, "left").withColumn("two_fcf", F.coalesce("two_fcf", F.lit(False)))
    if trailing_sums is None:
        return got
    return got.join(trailing_sums.select(*KEY, "ttm_q_ytd_sbc"), KEY, "left").withColumn("has_sbc", F.col("has_sbc") | F.col("ttm_q_ytd_sbc").isNotNull()).drop("ttm_q_ytd_sbc")
