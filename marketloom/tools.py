"""The five reports as functions that return long tables (row, column, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import columns as C
from marketloom.functions import formats as X
from marketloom.operators import fundamentals as Q
from marketloom.operators import series as S
from marketloom.operators import shape as H
from marketloom.operators import text as T

PERIODS = {"week": [5, 10, 20], "month": [20, 50, 200]}


def _long(df: DataFrame, keys: list[str], values: list[str], column: Column) -> DataFrame:
    cast = df.select(*keys, column.cast("string").alias("column_label"), *(F.col(v).cast("string").alias(v) for v in values))
    return cast.unpivot([*keys, "column_label"], values, "row_label", "value")


def points_of_control(candles: DataFrame, unit: str, today: Column) -> DataFrame:
    """(sym, days, poc): the price of the most volume over the trailing days of each of the unit's windows; candles has sym, ts, h, l, v."""
    own = candles.withColumn("d", F.col("ts").cast("date"))
    found = [S.point_of_control(own, today, days).withColumn("days", F.lit(days)) for days in PERIODS[unit]]
    return reduce(DataFrame.unionByName, found)


def price(bars: DataFrame, bridge: DataFrame | None = None, unit: str = "week", as_of: str | None = None, live: DataFrame | None = None, columns: int = 4, candles: DataFrame | None = None, iv: DataFrame | None = None, short: DataFrame | None = None, tags: DataFrame | None = None, market=None, today: str | None = None) -> DataFrame:
    """Price, return, moving averages and relative volume of the current period and those before, for symbols and their benchmarks.

    The current period has more: points of control from hourly candles (sym, ts, h, l, v), the move that volatilities (sym, iv) imply, short
    interest (sym, pct_float, days_to_cover, as_of) with its age, and the flags of a stock whose tags (sym, small_cap) are known, against the symbol
    market. All but the flags are as of today, so a report as of another day lacks them.
    """
    own = bars if as_of is None else bars.where(F.col("d") <= F.lit(as_of).cast("date"))
    periods = PERIODS[unit]
    volume = S.relative_volume(own, unit, periods).withColumnRenamed("trend", "rvol_trend").drop(*(f"mean_{p}" for p in periods))
    averages = S.sma_alignment(own, periods).select("sym", F.col("d").alias("last_day"), *(f"mean_{p}" for p in periods), F.col("trend").alias("sma_trend"))
    got = volume.join(averages, ["sym", "last_day"])
    day = F.lit(as_of).cast("date") if as_of else F.lit(None).cast("date")
    last = own.groupBy("sym").agg(F.coalesce(day, F.max("d")).alias("day")).select("sym", F.explode(S.recent_periods(F.col("day"), unit, columns)).alias("start"))
    got = got.join(last, ["sym", "start"])
    current = last.groupBy("sym").agg(F.max("start").alias("start"))
    if live is not None:
        got = S.with_live(got, current.join(live, "sym"))
    values = ["last_close", "ret", "sma_trend", "rvol_trend", *(f"mean_{p}" for p in periods), *(f"rvol_{p}" for p in periods)]
    more: dict[str, DataFrame] = {}
    now = F.lit(today).cast("date") if today else F.current_date()
    if as_of is None and candles is not None:
        poc = points_of_control(candles, unit, now).groupBy("sym").pivot("days", periods).agg(F.first("poc"))
        more["poc"] = poc.select("sym", *(F.col(f"`{p}`").alias(f"poc_{p}") for p in periods))
    if as_of is None and iv is not None:
        more["iv"] = iv.select("sym", C.implied_move(F.col("iv"), unit == "month").alias("implied_move"))
    if as_of is None and short is not None:
        more["short"] = short.select("sym", (F.col("pct_float") * 100).alias("short_pct"), "days_to_cover", F.date_diff(now, "as_of").alias("short_age"))
    if market is not None:
        of_market = got.where(F.col("sym") == market).select("start", F.col("ret").alias("market_ret"))
        small = F.coalesce("small_cap", F.lit(False)) if tags is not None else F.lit(False)
        told = got.join(current, ["sym", "start"]).join(of_market, "start", "left")
        told = told if tags is None else told.join(tags.select("sym", "small_cap"), "sym", "left")
        told = S.heuristic_flags(told.withColumns({"small_cap": small, "price_trend": F.col("sma_trend"), "volume_trend": F.col("rvol_trend")}))
        more["flags"] = told.select("sym", F.nullif(F.array_join("flags", "; "), F.lit("")).alias("flags"))
    for part in more.values():
        new = [c for c in part.columns if c != "sym"]
        got = got.join(part.join(current, "sym"), ["sym", "start"], "left")
        values += new
    if bridge is not None:
        listed = bridge.select(F.col("sym").alias("stock"), F.posexplode(F.concat(F.array("sym"), "benchmarks")).alias("place", "sym")).groupBy("stock", "sym").agg(F.min("place").alias("place"))
        got = got.join(listed, "sym")
    else:
        got = got.withColumns({"stock": F.col("sym"), "place": F.lit(0)})
    return _long(got, ["stock", "place", "sym"], values, F.col("start"))


def flow(grid: DataFrame, row: str, slots: list[str], show: int = 4, now: Column | None = None, bars: DataFrame | None = None) -> DataFrame:
    """Volumes, changes against the row before and running fill of the newest rows; the baseline takes twice as many full ones.

    While the market is open at now (a UTC timestamp without zone), provisional marks the cell that still grows: of a grid of days the newest day's
    last present slot, of a grid of weeks (row is week) today's weekday in the newest week, whether it has a bar yet or not. With daily
    bars (sym, d, o, c) the cells of a week grid also have close and move, close less open.
    """
    changes, fill = S.grid_changes(grid, row, slots), S.grid_fill(grid, row, slots, 2 * show)
    cells = changes.join(fill.select("sym", row, "slot", "fill"), ["sym", row, "slot"])
    if now is None:
        cells = cells.withColumn("provisional", F.lit(False))
    else:
        cells = S.provisional_day(cells, row, now) if row == "week" else S.provisional(cells, row, S.market_open(now))
    values = ["v", "change", "fill", "provisional"]
    if bars is not None:
        daily = bars.select("sym", F.trunc("d", "week").alias(row), F.weekday("d").alias("slot"), F.col("c").alias("close"), (F.col("c") - F.col("o")).alias("move"))
        cells, values = cells.join(daily, ["sym", row, "slot"], "left"), [*values, "close", "move"]
    newest = grid.select("sym", row).withColumn("n", F.row_number().over(S.Window.partitionBy("sym").orderBy(F.desc(row)))).where(F.col("n") <= show).drop("n")
    return _long(cells.join(newest, ["sym", row]), ["sym", row], values, F.col("slot"))


def reaction(bars: DataFrame, announcements: DataFrame, before: int = 4, after: int = 5, show: int = 10) -> DataFrame:
    """Returns around the newest announcements, by offset."""
    if before < 0 or after < 0 or show < 1:
        raise ValueError("before and after must not be negative, show must be positive")
    newest = announcements.withColumn("__n", F.row_number().over(S.Window.partitionBy("sym").orderBy(F.desc("day")))).where(F.col("__n") <= show).drop("__n")
    got = S.reaction(S.event_window(newest, bars, before, after), ["sym", "day"])
    return _long(got, ["sym", "day", "session"], ["c", "v", "rel"], F.col("off"))


def shape(bars: DataFrame, symbol, query_len: int = 20, forward: int = 5, top_k: int = 30, price_weight: float = 0.6, min_distance: float = 0.05, any_weekday: bool = False, recency_bucket: int = 5, recency_floor: float = 0.5, min_cv: float = 0.005, max_scale_ratio: float = 100.0) -> dict[str, DataFrame | H.Scan]:
    """Matches of a symbol's last bars in all series, their bars on the query's scale, statistics and bands of what came after.

    scan.told has the metrics of the search once matches (or what is made of them) has been computed.
    """
    if query_len < 2 or forward < 1 or top_k < 1 or not 0 <= price_weight <= 1:
        raise ValueError("query_len >= 2, forward >= 1, top_k >= 1 and price_weight in 0..1 are needed")
    query = H.Query.last(bars.where(F.col("sym") == symbol), query_len, weights=H.recency_weights(query_len, recency_bucket, recency_floor))
    found, scan = H.search_observed(bars, query, k=top_k, forward=forward, min_distance=min_distance, any_weekday=any_weekday, price_weight=price_weight, min_cv=min_cv, max_scale_ratio=max_scale_ratio)
    rows = H.forward_returns(H.projected(H.match_bars(found, bars, query_len, forward), query), ["sym"])
    return {"matches": found, "bars": rows, "stats": H.bar_stats(rows, "proj_c", query), "volume_stats": H.bar_stats(rows, "proj_v", query, "v"), "bands": H.return_bands(rows), "scan": scan}


def valuation_columns(quarters: DataFrame, closes: DataFrame, years: int = 2) -> DataFrame:
    """The displayed columns of each symbol: quarters and, before its own, each complete fiscal year, with position and is_fy.

    quarters as for Q.priced_quarters, with shares_short and settled; money is in the unit reported.
    """
    priced = Q.priced_quarters(quarters, closes)
    growth = Q.year_over_year(priced, ["revenue", "fcf"]).select("sym", "fy", "qn", "revenue_yoy", "fcf_yoy")
    shown = Q.display_columns(quarters, years)
    ahead = Q.next_quarter_accuracy(quarters, shown).select("sym", "fy", "qn", F.col("accuracy").alias("nq_accuracy"))
    whole = Q.year_accuracy(quarters).select("sym", "fy", "qn", F.col("accuracy").alias("fy_accuracy"))
    keys = ["sym", "fy", "qn"]
    own = priced.join(growth, keys).join(ahead, keys, "left").join(whole, keys, "left").join(shown.where("is_fy = 0"), keys).withColumn("lag", F.date_diff("settled", "end_date"))
    years_ = Q.fiscal_years(quarters)
    flows = years_.withColumns(Q.flow_columns(F.col("ocf"), F.col("ppe"), F.col("capex_total"), F.col("sbc"), F.col("revenue")))
    before = flows.where("complete").select("sym", (F.col("fy") + 1).alias("fy"), F.col("revenue").alias("__r"), F.col("fcf").alias("__f"))
    flows = flows.join(before, ["sym", "fy"], "left").withColumns({"revenue_yoy": C.growth(F.col("revenue"), F.col("__r")), "fcf_yoy": C.growth(F.col("fcf"), F.col("__f"))})
    units = quarters.groupBy("sym").agg(F.first("fx").alias("fx"), F.first("mult").alias("mult"))
    annual = flows.join(units, "sym").join(shown.where("is_fy = 1"), ["sym", "fy"]).withColumnsRenamed({"ocf": "q_ytd_ocf", "ppe": "q_ytd_ppe", "sbc": "q_ytd_sbc", "guide_low": "fy_low", "guide_high": "fy_high"})
    annual = annual.select("sym", "fy", "qn", "is_fy", "position", "fx", "mult", F.concat(F.lit("FY-"), F.col("fy").cast("string")).alias("id"), "revenue", "q_ytd_ocf", "q_ytd_ppe", "q_ytd_sbc", "capex_total", F.col("lines").alias("q_ytd_capex"), "fcf", "fcf_strict", "fcf_ex_sbc", "fcf_strict_ex_sbc", "fcf_margin", "revenue_yoy", "fcf_yoy", *(c for c in ("est_low", "est_high", "fy_low", "fy_high", "shares_short") if c in annual.columns))
    return own.unionByName(annual, allowMissingColumns=True)


def valuation(quarters: DataFrame, closes: DataFrame, prices: DataFrame | None = None, years: int = 2) -> DataFrame:
    """The valuation as a long table of text: the trailing column (at prices: sym, price), then the displayed quarters and years.

    row orders the rows. Rows that no column has anything for are left out, and so are a year's point-in-time and valuation cells.
    """
    own = valuation_columns(quarters, closes, years)
    seen = Q.visible_rows(own, quarters, Q.latest_trailing(Q.quarter_flows(quarters), ["q_ytd_sbc"]))
    factor, alone = F.col("mult") / F.col("fx"), F.col("is_fy") == 0
    strict = F.col("has_sbc") | F.col("two_fcf")
    flow = F.when(F.col("has_sbc"), F.col("fcf_strict_ex_sbc")).otherwise(F.col("fcf_strict"))
    price_to = F.when(F.col("has_sbc"), F.col("pfcf_strict_ex_sbc")).otherwise(F.col("pfcf_strict"))
    cells: list[tuple[str, Column, Column]] = []  # label, whether the row is shown, text

    def row(label: str, text: Column, when: Column | None = None) -> None:
        cells.append((label, F.lit(True) if when is None else when, text))

    quarterly = lambda text: F.when(alone, text).otherwise("")
    valued = lambda text: F.when(F.col("show_val"), text).otherwise("")
    row("Period end date", quarterly(X.day(F.col("end_date"))))
    row("Revenue ($M)", X.millions(F.col("revenue") * factor))
    row("  Rev Y/Y", X.percent(F.col("revenue_yoy")))
    row("Operating CF ($M)", X.millions(F.col("q_ytd_ocf") * factor))
    row("CapEx PP&E ($M)", X.millions(F.col("q_ytd_ppe") * factor))
    row("FCF company ($M)", X.millions(F.col("fcf") * factor))
    row("  FCF Y/Y", X.percent(F.col("fcf_yoy")))
    row("SBC ($M)", X.millions(F.col("q_ytd_sbc") * factor), F.col("has_sbc"))
    row("FCF strict ($M)", X.millions(flow * factor), strict)
    row("Shares out (M)", quarterly(X.millions(F.col("shares") * F.col("mult"))))
    row("Shares short (M)", quarterly(X.short_interest(F.col("shares_short") * F.col("mult"), F.col("lag"))), F.col("has_short"))
    row("  % of shares out", quarterly(F.coalesce(F.format_string("%.1f%%", Q.short_share(F.col("shares_short"), F.col("shares"))), F.lit(X.MISSING))), F.col("has_short"))
    row("FCF company margin", X.percent(F.col("fcf_margin")))
    row("FCF strict margin", X.percent(C.ratio(flow, F.col("revenue"))), strict)
    row("NQ Rev guidance ($M)", quarterly(X.money_range(F.col("nq_low") * factor, F.col("nq_high") * factor, F.col("nq_hint"))))
    row("  NQ actual/guide", quarterly(X.percent(F.col("nq_accuracy"))), F.col("has_nq_guide"))
    row("FY Rev guidance ($M)", quarterly(X.money_range(F.col("fy_low") * factor, F.col("fy_high") * factor, F.col("fy_hint"))))
    row("  FY actual/guide", quarterly(X.percent(F.col("fy_accuracy"))), F.col("has_fy_guide"))
    row("FY Rev estimate ($M)", quarterly(X.money_range(F.col("est_low") * factor, F.col("est_high") * factor)), F.col("has_est"))
    row("Ref date", valued(X.day(F.col("report_date"))))
    row("Ref price ($)", valued(X.price(F.col("price"))))
    row("Market cap", valued(X.money(F.col("cap"))))
    row("Cash", valued(X.money(F.col("cash_value"))))
    row("Debt", valued(X.money(F.col("debt_value"))))
    row("P / S", valued(X.multiple(F.col("ps"))))
    row("P / FCF company", valued(X.multiple(F.col("pfcf"))))
    row("P / FCF strict", valued(X.multiple(price_to)), strict)
    row("FW P/S NQ guidance", valued(X.multiple_range(F.col("nq_ps_low"), F.col("nq_ps_high"))))
    row("FW P/S FY guidance", valued(X.multiple_range(F.col("fy_ps_low"), F.col("fy_ps_high"))))
    row("FW P/S FY estimate", valued(X.multiple_range(F.col("est_ps_low"), F.col("est_ps_high"))), F.col("has_est"))
    joined = own.join(seen, "sym")
    if prices is not None:
        blank = {c: None for c in ("revenue_yoy", "fcf_yoy", "nq_accuracy", "fy_accuracy", "end_date", "shares", "shares_short", "report_date")}
        today = Q.priced_today(quarters, prices).withColumnsRenamed({"ttm_revenue": "revenue", **{f"ttm_{c}": c for c in ("q_ytd_ocf", "q_ytd_ppe", "q_ytd_sbc", "fcf", "fcf_strict", "fcf_ex_sbc", "fcf_strict_ex_sbc")}})
        today = today.withColumns({c: F.lit(None).cast(own.schema[c].dataType) for c in blank}).withColumns({"id": F.lit("TTM"), "position": F.lit(0), "is_fy": F.lit(2), "show_val": F.lit(True), "fcf_margin": C.ratio(F.col("fcf"), F.col("revenue"))})
        joined = joined.unionByName(today.join(seen, "sym"), allowMissingColumns=True)
    place = [label for label, _, _ in cells].index("SBC ($M)") - 0.5
    lines = own.select("sym", "position", F.col("id").alias("column_label"), factor.alias("factor"), F.explode("q_ytd_capex").alias("line", "value"))
    if prices is not None:
        whole = Q.latest_lines(Q.quarter_flows(quarters)).join(quarters.groupBy("sym").agg(F.first(factor).alias("factor")), "sym")
        lines = lines.unionByName(whole.select("sym", F.lit(0).alias("position"), F.lit("TTM").alias("column_label"), "factor", "line", "value"))
    lines = lines.where("line <> 'ppe'").select("sym", "position", "column_label", F.lit(place).alias("row"), F.concat(F.lit("CapEx "), Q.line_label(F.col("line")), F.lit(" ($M)")).alias("row_label"), X.millions(F.col("value") * F.col("factor")).alias("value"))
    told = F.array(*(F.struct(F.lit(float(i)).alias("row"), F.lit(label).alias("row_label"), F.when(when, text).alias("value")) for i, (label, when, text) in enumerate(cells)))
    return joined.select("sym", "position", F.col("id").alias("column_label"), F.explode(told).alias("x")).select("sym", "position", "column_label", "x.*").where("value IS NOT NULL").unionByName(lines)


def posts(ledger: DataFrame, show: int = 5, by: list[str] | None = None) -> DataFrame:
    """The newest posts with who wrote them and their counts as text."""
    handle = F.when(F.col("screen_name") != "", F.concat(F.lit("@"), "screen_name")).otherwise("?")
    who = F.when(F.col("name") != "", F.concat("name", F.lit(" ("), handle, F.lit(")"))).otherwise(handle)
    stats = F.format_string("♥ %d  ↻ %d  💬 %d", "likes", "retweets", "comments")
    keyed = ledger if by else ledger.withColumn("__all", F.lit(0))
    got = T.newest_posts(keyed, show, by or ["__all"])
    return got.select(*(by or []), "position", F.coalesce(F.nullif("timestamp", F.lit("")), F.lit("?")).alias("stamp"), who.alias("who"), T.squeeze(F.col("text")).alias("text"), stats.alias("stats"), "tweet_url")


def success(results: DataFrame, ok: str, by: list[str] | None = None) -> DataFrame:
    """How many of the results succeeded, and how many there are."""
    return results.groupBy(*(by or [])).agg(F.count_if(F.col(ok)).alias("ok"), F.count("*").alias("total"))
