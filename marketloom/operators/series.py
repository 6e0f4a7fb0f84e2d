"""Bars: deduplication, windows by position, periods, as-of and nearest joins, flow grids, reactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import arrows, ratio

SESSION = ["09:30", "10:30", "11:30", "12:30", "13:30", "14:30", "15:30"]


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the last by order."""
    at = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__n", F.row_number().over(at)).where("__n = 1").drop("__n")


def valid_bars(bars: DataFrame) -> DataFrame:
    """Bars with a close and a positive volume."""
    return bars.where("c IS NOT NULL AND NOT isnan(c) AND v > 0")


def number_bars(bars: DataFrame, by: str = "sym", at: str = "d") -> DataFrame:
    return bars.withColumn("bar_no", F.row_number().over(Window.partitionBy(by).orderBy(at)))


def trailing_means(bars: DataFrame, value: str, periods: list[int], by: str = "sym", at: str = "d") -> DataFrame:
    """mean_<p> over the last p bars; all null until the longest period has passed."""
    order = Window.partitionBy(by).orderBy(at)
    full = F.row_number().over(order) >= max(periods)
    return bars.withColumns({f"mean_{p}": F.when(full, F.avg(value).over(order.rowsBetween(1 - p, 0))) for p in periods})


def sma_alignment(bars: DataFrame, periods: list[int], by: str = "sym", at: str = "d") -> DataFrame:
    """Moving averages of the close and the arrows between them."""
    means = trailing_means(bars, "c", periods, by, at)
    return means.withColumn("trend", arrows(*(F.col(f"mean_{p}") for p in sorted(periods))))


def period_start(day: Column, unit: str) -> Column:
    """The Monday of a day's week, or the first of its month."""
    return F.trunc(day, "week" if unit == "week" else "month")


def in_period(day: Column, unit: str) -> Column:
    return F.weekday(day) < 5 if unit == "week" else F.lit(True)


def recent_periods(as_of: Column, unit: str, count: int = 4) -> Column:
    """An array of the starts of the current period and those before."""
    back = (lambda i: F.date_sub(period_start(as_of, "week"), (7 * i).cast("int"))) if unit == "week" else (lambda i: F.add_months(period_start(as_of, "month"), (-i).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), back)


def period_snapshot(bars: DataFrame, unit: str, by: str = "sym") -> DataFrame:
    """By period: first and last close, their return (null for a single bar), mean volume and bars."""
    own = bars.where(in_period(F.col("d"), unit)).withColumn("start", period_start(F.col("d"), unit))
    got = own.groupBy(by, "start").agg(F.min_by("c", "d").alias("first_close"), F.max_by("c", "d").alias("last_close"), F.max("d").alias("last_day"), F.avg("v").alias("mean_volume"), F.count("*").alias("bars"))
    return got.withColumn("ret", F.when(F.col("bars") > 1, ratio(F.col("last_close"), F.col("first_close")) - 1))


def relative_volume(bars: DataFrame, unit: str, periods: list[int], by: str = "sym") -> DataFrame:
    """Mean volume of each period over the mean of the last p bars at its end."""
    means = trailing_means(bars, "v", periods, by).select(by, F.col("d").alias("last_day"), *(f"mean_{p}" for p in periods))
    got = period_snapshot(bars, unit, by).join(means, [by, "last_day"])
    got = got.withColumns({f"rvol_{p}": ratio(F.col("mean_volume"), F.col(f"mean_{p}")) for p in periods})
    return got.withColumn("trend", arrows(*(F.col(f"mean_{p}") for p in sorted(periods))))


def with_live(snapshots: DataFrame, live: DataFrame, by: str = "sym") -> DataFrame:
    """Snapshots in which a live price (by, start, live) takes the place of a period's last close, and of its return."""
    got = snapshots.join(live.select(by, "start", "live"), [by, "start"], "left")
    ret = F.when(F.col("live").isNotNull(), ratio(F.col("live"), F.col("first_close")) - 1).otherwise(F.col("ret"))
    return got.withColumn("ret", ret).withColumn("last_close", F.coalesce("live", "last_close")).drop("live")


def heuristic_flags(returns: DataFrame) -> DataFrame:
    """Flags of a current column: ret, market_ret, small_cap, volume_trend and price_trend give the array flags."""
    flag = F.array_compact(F.array(
        F.when(F.col("ret") - F.col("market_ret") > 0.10, "outruns the market"),
        F.when(F.col("small_cap") & (F.col("ret") < 0) & (F.col("volume_trend") == "↑↑"), "falls on rising volume"),
        F.when((F.col("price_trend") == "↓↓") & ~F.col("volume_trend").isin("↑↑", "↓↓"), "drifts down on neutral volume"),
    ))
    return returns.withColumn("flags", flag)


def asof(targets: DataFrame, bars: DataFrame, by: str, target: str, at: str, values: list[str], forward: bool = False) -> DataFrame:
    """For each target the values of the last bar at or before it (or the first at or after it).

    Both sides are one stream sorted by date, in which each target takes the nearest bar's row: a single sort, no range join.
    """
    left = targets.withColumns({"__at": F.col(target), "__bar": F.lit(None).cast(bars.select(F.struct(at, *values)).schema[0].dataType), "__side": F.lit(0 if forward else 1)})
    right = bars.select(F.col(by), F.col(at).alias("__at"), F.struct(at, *values).alias("__bar"), F.lit(1 if forward else 0).alias("__side"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy("__at", "__side")
    frame = order.rowsBetween(0, Window.unboundedFollowing) if forward else order.rowsBetween(Window.unboundedPreceding, 0)
    pick = (F.first if forward else F.last)("__bar", ignorenulls=True).over(frame)
    mine = both.withColumn("__got", pick).where(F.col("__side") == (0 if forward else 1))
    return mine.select(*targets.columns, F.col(f"__got.{at}").alias(f"bar_{at}"), *(F.col(f"__got.{v}").alias(f"bar_{v}") for v in values))


def nearest(targets: DataFrame, others: DataFrame, by: str, target: str, at: str, values: list[str], days: int, priority: list[Column] | None = None, first: list[Column] | None = None) -> DataFrame:
    """For each target the closest other row within days; ties go to the first by priority, else to the earlier.

    Columns of first count before closeness: a row of a later one is taken only where there is none of an earlier.

    Dates are dealt in buckets of `days`, and each target looks in its own and the two beside it: an equi join. A target is known by its own
    columns, exact repeats by their number, so nothing depends on the order in which rows come.
    """
    bucket = lambda c: F.floor(F.unix_date(F.col(c)) / max(days, 1))
    keys = targets.columns
    left = targets.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__b", F.explode(F.array(*(bucket(target) + i for i in (-1, 0, 1)))))
    right = others.select(F.col(by), F.col(at).alias("__at"), F.struct(*values).alias("__v"), F.struct(*(priority or [F.col(at)])).alias("__p"), F.struct(*(first or [F.lit(0)])).alias("__f"), bucket(at).alias("__b"))
    gap = F.abs(F.date_diff("__at", target))
    best = F.min_by(F.struct("__at", "__v"), F.when(gap <= days, F.struct("__f", gap, "__p"))).alias("__m")
    found = left.join(right, [by, "__b"], "left").groupBy(*keys, "__n").agg(best)
    got = found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return got.select(*keys, F.col("__m.__at").alias(f"near_{at}"), *(F.col(f"__m.__v.{v}").alias(f"near_{v}") for v in values))


def event_window(events: DataFrame, bars: DataFrame, before: int, after: int, by: str = "sym", at: str = "d") -> DataFrame:
    """Bars at offsets -before..after from each event's first bar on or after its day; places without a bar are null.

    Each bar carries those around it as an array, which the as-of join picks: bars are sorted, and read, once.
    """
    order = Window.partitionBy(by).orderBy(at)
    around = F.collect_list(F.struct(F.col(at).alias("bar_day"), "c", "v")).over(order.rowsBetween(-before, after))
    carried = bars.withColumns({"__around": around, "__no": F.row_number().over(order)})
    anchored = asof(events, carried, by, "day", at, ["__around", "__no"], forward=True).where("bar___no IS NOT NULL")
    spread = anchored.withColumn("off", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    own = F.get("bar___around", F.col("off") + F.least(F.col("bar___no") - 1, F.lit(before)))
    placed = spread.withColumns({"bar_no": F.col("bar___no") + F.col("off"), "__bar": F.when(F.col("off") + F.col("bar___no") >= 1, own)})
    return placed.select(by, "bar_no", *(c for c in events.columns if c != by), "off", "__bar.*")


def reaction(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Close relative to the bar before the reaction bar (offset 0, or 1 after the close); blank before it."""
    react = F.when(F.col("session") == "after-close", 1).otherwise(0)
    base = F.max(F.when(F.col("off") == react - 1, F.col("c"))).over(Window.partitionBy(*keys))
    return windows.withColumn("rel", F.when((F.col("off") >= react) & (base > 0), F.col("c") / base - 1))


def grid_changes(grid: DataFrame, row: str, slots: list[str], by: str = "sym") -> DataFrame:
    """Long form (row, slot, v) of a grid with the change against the row before: null at holes and at zero."""
    cells = grid.select(by, row, F.posexplode(F.array(*(F.col(f"`{s}`") for s in slots))).alias("slot", "v"))
    before = F.lag("v").over(Window.partitionBy(by, "slot").orderBy(row))
    return cells.withColumn("change", F.when(before > 0, F.col("v") / before - 1))


def grid_fill(grid: DataFrame, row: str, slots: list[str], rows: int, by: str = "sym") -> DataFrame:
    """Running share of the baseline (the mean total of the last `rows` full rows), blank at holes."""
    values = F.array(*(F.col(f"`{s}`").cast("double") for s in slots))
    full = F.forall(values, lambda x: x.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    ranked = grid.withColumn("__total", total).where(full)
    last = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(row)))).where(F.col("__n") <= rows)
    base = last.groupBy(by).agg(F.avg("__total").alias("baseline"))
    cells = grid.select(by, row, F.posexplode(values).alias("slot", "v")).join(base, by, "left")
    run = F.sum("v").over(Window.partitionBy(by, row).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("fill", F.when(F.col("v").isNotNull(), ratio(run, F.col("baseline"))))


def session_grid(bars: DataFrame, by: str = "sym") -> DataFrame:
    """Day by session slot (New York time): volumes of bars in the seven slots; a later bar of a slot wins."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts").cast("timestamp_ntz"))
    own = bars.where("v > 0").withColumns({"day": local.cast("date"), "slot": F.date_format(local, "HH:mm")})
    return own.groupBy(by, "day").pivot("slot", SESSION).agg(F.max_by("v", "ts"))


def week_grid(bars: DataFrame, by: str = "sym") -> DataFrame:
    """Monday of the week by weekday 0..4: volumes."""
    own = bars.where((F.col("v") > 0) & (F.weekday("d") < 5)).withColumns({"week": F.trunc("d", "week"), "wd": F.weekday("d")})
    return own.groupBy(by, "week").pivot("wd", [0, 1, 2, 3, 4]).agg(F.max_by("v", "d"))


def provisional(cells: DataFrame, row: str, is_open: Column, by: str = "sym") -> DataFrame:
    """Marks the newest row's last present slot while the market is open."""
    newest = F.max(row).over(Window.partitionBy(by))
    last = F.max(F.when(F.col("v").isNotNull(), F.col("slot"))).over(Window.partitionBy(by, row))
    return cells.withColumn("provisional", is_open & (F.col(row) == newest) & F.coalesce(F.col("slot") == last, F.lit(False)))


def provisional_day(cells: DataFrame, row: str, now: Column, by: str = "sym") -> DataFrame:
    """Marks today's weekday in the newest row of a week grid while the market is open; now is a UTC timestamp without zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), now)
    newest = F.max(row).over(Window.partitionBy(by))
    return cells.withColumn("provisional", market_open(now) & (F.col(row) == newest) & (F.col("slot") == F.weekday(local)))


def market_open(now: Column) -> Column:
    """Monday to Friday, 09:30 to 16:00 in New York, for a UTC timestamp without zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), now)
    clock = F.date_format(local, "HH:mm")
    return (F.weekday(local) < 5) & (clock >= "09:30") & (clock < "16:00")


def quality_flags(bars: DataFrame, length: int | None = None, by: str = "sym", at: str = "d") -> DataFrame:
    """The newest length bars of each series (or all), with thin and heavy volumes and jumps of the close.

    Thin is under a fifth, heavy over five times the median of these bars' positive volumes; a jump is over 40 % from one of
    these closes to the next.
    """
    own = bars
    if length is not None:
        own = bars.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at)))).where(F.col("__n") <= length).drop("__n")
    typical = own.where("v > 0").groupBy(by).agg(F.median("v").alias("typical"))
    before = F.lag("c").over(Window.partitionBy(by).orderBy(at))
    flagged = own.withColumn("gap", F.when(before > 0, F.col("c") / before - 1)).join(typical, by, "left")
    return flagged.withColumns({"thin": F.coalesce(F.col("v") < 0.2 * F.col("typical"), F.lit(False)), "heavy": F.coalesce(F.col("v") > 5 * F.col("typical"), F.lit(False)), "jump": F.coalesce(F.abs("gap") > 0.4, F.lit(False))})


def point_of_control(bars: DataFrame, as_of: Column, days: int, buckets: int = 100, by: str = "sym", at: str = "d") -> DataFrame:
    """Midpoint of the price bucket with the most volume over the trailing days: the lower one on ties, null for a flat range."""
    own = bars.where((F.col("v") > 0) & (F.col(at) >= F.date_sub(as_of, days)) & (F.col(at) <= as_of))
    ranges = own.groupBy(by).agg(F.min("l").alias("lo"), F.max("h").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / buckets
    bucket = F.least(F.greatest(F.floor((F.col("h") + F.col("l") - 2 * F.col("lo")) / 2 / F.nullif(width, F.lit(0.0))), F.lit(0)), F.lit(buckets - 1))
    volumes = own.join(ranges, by).withColumn("bucket", bucket).groupBy(by, "lo", "hi", "bucket").agg(F.sum("v").alias("volume"))
    best = volumes.groupBy(by, "lo", "hi").agg(F.max_by("bucket", F.struct("volume", -F.col("bucket"))).alias("bucket"))
    return best.select(by, F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("bucket") + 0.5) * width).alias("poc"))


def benchmark_returns(snapshots: DataFrame, bridge: DataFrame, markets: DataFrame | None = None, by: str = "sym") -> DataFrame:
    """Each symbol's benchmarks in their order, with their returns: bridge has by, benchmarks (array); markets are other snapshots that hold these."""
    spread = bridge.select(by, F.posexplode("benchmarks").alias("pos", "benchmark"))
    other = (snapshots if markets is None else markets).select(F.col(by).alias("benchmark"), "start", F.col("ret").alias("benchmark_ret"))
    return snapshots.join(spread, by).join(other, ["benchmark", "start"], "left").withColumn("excess", F.col("ret") - F.col("benchmark_ret"))
