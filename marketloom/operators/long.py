"""Windows over series that are too long for one task: ranges first, then what one range hands to the next.

A series is cut by ranges of dates. What a range needs of those before it (how many rows there were, the last row) is a row a range, so it is
computed first, over the ranges of a series only, and joined to the rows; within a range all is as for a short series. Windows of so
many rows go over blocks of positions, each with copies of the last rows of the block before. Results are those of the one-level
operators in series; null dates are a range of their own, the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import arrows
from marketloom.operators.shape import Query, pstdev

#: Days of a range, and rows of a block.
DAYS, ROWS = 90, 65_536


def range_of(at: str | Column, days: int) -> Column:
    day = (F.col(at) if isinstance(at, str) else at).cast("date")
    return F.floor(F.unix_date(day) / days)


def _with(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal keys, nulls being equal."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    return left.join(other, reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[f"__r_{k}"]) for k in keys)), "left").drop(*(f"__r_{k}" for k in keys))


def numbered(bars: DataFrame, by: str = "sym", at: str = "d", ties: Sequence[str] = (), days: int = DAYS) -> DataFrame:
    """bar_no: a bar's place in its series, by at and ties."""
    own = bars.withColumn("__range", range_of(at, days))
    sizes = own.groupBy(by, "__range").agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.partitionBy(by).orderBy("__range")) - F.col("__n")).drop("__n")
    place = F.row_number().over(Window.partitionBy(by, "__range").orderBy(at, *ties))
    return _with(own.withColumn("__place", place), starts, [by, "__range"]).withColumn("bar_no", F.col("__start") + F.col("__place")).drop("__range", "__start", "__place")


def asof(targets: DataFrame, bars: DataFrame, by: str, target: str, at: str, values: Sequence[str], forward: bool = False, ties: Sequence[str] = (), days: int = DAYS) -> DataFrame:
    """For each target the values of the last bar at or before it (or the first at or after it), of bars of one time the last (first) by ties; as series.asof."""
    bar = F.struct(at, *values)
    no_ties = {f"__t{i}": F.lit(None).cast(bars.schema[t].dataType) for i, t in enumerate(ties)}
    left = targets.withColumns({"__at": F.col(target), "__bar": F.lit(None).cast(bars.select(bar).schema[0].dataType), "__side": F.lit(0 if forward else 1), **no_ties})
    right = bars.select(F.col(by), F.col(at).alias("__at"), bar.alias("__bar"), F.lit(1 if forward else 0).alias("__side"), *(F.col(t).alias(f"__t{i}") for i, t in enumerate(ties)))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__range", range_of("__at", days))
    order = ["__at", "__side", *no_ties]
    place = F.struct(*order)
    is_bar = F.col("__bar").isNotNull()
    edge = (F.min_by if forward else F.max_by)("__bar", F.when(is_bar, place))
    over = Window.partitionBy(by).orderBy("__range")
    ranges = both.groupBy(by, "__range").agg(edge.alias("__edge"))
    beyond = F.first("__edge", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)) if forward else F.last("__edge", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    inside = Window.partitionBy(by, "__range").orderBy(*order)
    frame = inside.rowsBetween(0, Window.unboundedFollowing) if forward else inside.rowsBetween(Window.unboundedPreceding, 0)
    pick = (F.first if forward else F.last)("__bar", ignorenulls=True).over(frame)
    mine = both.withColumn("__got", pick).where(F.col("__side") == (0 if forward else 1))
    got = _with(mine, ranges.select(by, "__range", beyond.alias("__beyond")), [by, "__range"]).withColumn("__got", F.coalesce("__got", "__beyond"))
    return got.select(*targets.columns, F.col(f"__got.{at}").alias(f"bar_{at}"), *(F.col(f"__got.{v}").alias(f"bar_{v}") for v in values))


def blocks(bars: DataFrame, before: int, rows: int = ROWS) -> DataFrame:
    """Bars with bar_no in blocks of so many (block), each with copies of the last `before` bars before it (copy is true)."""
    first = F.expr(f"(bar_no - 1) div {rows}")
    spread = bars.withColumn("block", F.explode(F.sequence(first, F.expr(f"(bar_no - 1 + {before}) div {rows}"))))
    return spread.withColumn("copy", F.col("block") > first)


def trailing_means(bars: DataFrame, value: str, periods: list[int], by: str = "sym", at: str = "d", ties: Sequence[str] = (), days: int = DAYS, rows: int = ROWS) -> DataFrame:
    """mean_<p> over the last p bars, as series.trailing_means; bar_no is added."""
    own = blocks(numbered(bars, by, at, ties, days), max(periods) - 1, rows)
    order = Window.partitionBy(by, "block").orderBy("bar_no")
    full = F.col("bar_no") >= max(periods)
    return own.withColumns({f"mean_{p}": F.when(full, F.avg(value).over(order.rowsBetween(1 - p, 0))) for p in periods}).where("NOT copy").drop("copy", "block")


def sma_alignment(bars: DataFrame, periods: list[int], by: str = "sym", at: str = "d", ties: Sequence[str] = (), **cut: int) -> DataFrame:
    """Moving averages of the close and the arrows between them, as series.sma_alignment."""
    means = trailing_means(bars, "c", periods, by, at, ties, **cut)
    return means.withColumn("trend", arrows(*(F.col(f"mean_{p}") for p in sorted(periods))))


def correlate(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums of kernel times each window of x, by one product of transforms: as long for a long kernel as for a short one."""
    n = 1 << int(np.ceil(np.log2(len(x) + len(kernel))))
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(kernel[::-1], n), n)[len(kernel) - 1 : len(x)]


#: Squared distances under this share of the largest possible are computed term by term, as the difference of large sums has few digits there; so
#: are windows whose deviation is under STEEP times the largest value. EXACT windows at a time.
CLOSE, STEEP, EXACT = 1e-4, 1e-5, 4096


def each(x: np.ndarray, m: int, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of m values that begin at some places, some at a time: (places, windows)."""
    windows = np.lib.stride_tricks.sliding_window_view(x, m)
    for i in range(0, len(at), EXACT):
        yield at[i : i + EXACT], windows[at[i : i + EXACT]]


def window_distances(x: np.ndarray, base: np.ndarray, query: list[float], scale: list[float], weights: list[float] | None, min_cv: float) -> np.ndarray:
    """Distance of each window of x to the query, both normalised by the scale's channel (base); NaN for a flat window or one with a missing value."""
    m = len(query)
    q = np.asarray(query, float)
    mean, std = float(np.mean(scale)), pstdev(list(scale))
    missing = ~(np.isfinite(x) & np.isfinite(base))
    gone = np.convolve(missing, np.ones(m), "valid") > 0.5
    level = float(base[~missing].mean()) if (~missing).any() else 0.0
    a, b = np.where(missing, 0.0, x - level), np.where(missing, 0.0, base - level)  # small numbers, for the sake of digits
    own_mean = correlate(b, np.ones(m)) / m
    own_std = np.sqrt(np.maximum(correlate(b * b, np.ones(m)) / m - own_mean**2, 0.0))
    steep = own_std < STEEP * max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    for i, w in each(b, m, np.flatnonzero(steep | (own_std < 1e-3 * np.abs(own_mean + level)))):  # nearly flat: its deviation decides
        own_mean[i], own_std[i] = w.mean(axis=1), w.std(axis=1)
    own_std[own_std**2 < (1e-5 * np.abs(own_mean + level)) ** 2] = 0.0
    if std < 1e-10:
        return np.where(gone, np.nan, 0.0)
    z = (q - mean) / std
    w = np.ones(m) if weights is None else np.asarray(weights, float)
    flat = own_std < np.maximum(1e-10, min_cv * np.abs(own_mean + level))
    s = np.where(own_std > 0, own_std, np.nan)
    cross = correlate(a, w * z) - own_mean * (w * z).sum()
    square = correlate(a * a, w) - 2 * own_mean * correlate(a, w) + own_mean**2 * w.sum()
    d2 = (w * z * z).sum() - 2 * cross / s + square / s**2
    for i, x in each(a, m, np.flatnonzero(~flat & ~gone & (steep | (d2 < CLOSE * 4 * w.sum())))):
        d2[i] = (w * (z - (x - own_mean[i, None]) / own_std[i, None]) ** 2).sum(axis=1)
    return np.where(flat | gone, np.nan, np.sqrt(np.maximum(d2, 0.0)))


def distances(bars: DataFrame, query: Query, channels: dict[str, str], min_cv: float = 0.0, by: str = "sym", at: str = "d", ties: Sequence[str] = (), days: int = DAYS, rows: int = ROWS) -> DataFrame:
    """distance_<channel> of the window that ends at each bar, for channels on the scale of others (channel: scale); bar_no is added.

    As shape.distance, but by transforms over blocks of a series (Arrow), for long queries: the time doesn't grow with the query's length. Null
    for a flat window, too few bars or a missing value; for a flat query zero.
    """
    m, keep = query.size, bars.columns
    own = blocks(numbered(bars, by, at, ties, days), m - 1, max(rows, 2 * m))
    names = sorted({*channels, *channels.values()})
    schema = ", ".join([f"`{by}` {bars.schema[by].dataType.simpleString()}", "bar_no long", *(f"distance_{c} double" for c in channels)])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("bar_no")
        values = {c: part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names}
        mine = ~part.column("copy").to_numpy(zero_copy_only=False)
        out = [part.column(by).combine_chunks().filter(pa.array(mine)), pa.array(part.column("bar_no").to_numpy()[mine])]
        for c, scale in channels.items():
            d = np.full(len(mine), np.nan)
            if len(mine) >= m:
                d[m - 1 :] = window_distances(values[c], values[scale], query.values[c], query.values[scale], query.weights, min_cv if c == scale else 0.0)
            out.append(pa.array(d[mine], from_pandas=True))
        return pa.Table.from_arrays(out, [f.split()[0].strip("`") for f in schema.split(", ")])

    found = own.select(by, "block", "bar_no", "copy", *names).groupBy(by, "block").applyInArrow(run, schema)
    return _with(numbered(bars, by, at, ties, days), found, [by, "bar_no"]).select(*keep, "bar_no", *(f"distance_{c}" for c in channels))
