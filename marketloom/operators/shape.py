"""Chart-shape search: z-normalised distances of every window to a query window, best window of a series, global top-k.

A window's bars are one array over one window specification, so the whole profile is one sort and one pass of generated
code; the query is a few literals.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import fmean

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

CHANNELS = ["o", "h", "l", "c", "v"]


def pstdev(x: list[float]) -> float:
    mean = fmean(x)
    return fmean([(v - mean) ** 2 for v in x]) ** 0.5


def recency_weights(m: int, bucket: int = 5, floor: float = 0.5) -> list[float] | None:
    """Weights by blocks of bars, from 1 for the newest down to floor for the oldest; none where that does nothing."""
    oldest = (m - 1) // max(1, bucket)
    if floor >= 1 or oldest == 0:
        return None
    return [1.0 - (1.0 - floor) * ((m - 1 - j) // max(1, bucket)) / oldest for j in range(m)]


@dataclass(frozen=True)
class Query:
    """A query window: values by channel, oldest first, and the weekday of its last bar."""

    values: dict[str, list[float]]
    weekday: int | None = None
    weights: list[float] | None = field(default=None)

    @property
    def size(self) -> int:
        return len(self.values["c"])

    @classmethod
    def last(cls, bars: DataFrame, length: int, at: str = "d", weights: list[float] | None = None) -> Query:
        """The last bars of one series; an error if it has fewer."""
        rows = bars.orderBy(F.desc(at)).limit(length).select(*CHANNELS, F.weekday(at).alias("wd")).collect()[::-1]
        if len(rows) < length:
            raise ValueError(f"{len(rows)} bars; the query needs {length}")
        return cls({c: [float(r[c]) for r in rows] for c in CHANNELS}, rows[-1].wd, weights)


def with_stats(bars: DataFrame, channel: str, m: int, by: str = "sym", at: str = "d", held: str = "ohlcv") -> DataFrame:
    """mean_<channel> and std_<channel> of the m bars that end here, null for fewer, and these bars' held channels (window); noise-level deviations are zero."""
    order = Window.partitionBy(by).orderBy(at)
    frame = order.rowsBetween(1 - m, 0)
    mean, std = F.avg(channel).over(frame), F.stddev_pop(channel).over(frame)
    full = F.row_number().over(order) >= m
    snapped = F.when(std * std < F.pow(1e-5 * F.abs(mean), F.lit(2)), 0.0).otherwise(std)
    more = {} if "window" in bars.columns or not held else {"window": F.when(full, F.collect_list(F.struct(*held)).over(frame))}
    return bars.withColumns({f"mean_{channel}": F.when(full, mean), f"std_{channel}": F.when(full, snapped)} | more)


def distance(channel: str, scale: str, query: Query, min_cv: float = 0.0, folded: bool = False) -> Column:
    """Weighted distance of the window that ends here to the query's channel; both sides are normalised by channel scale.

    Zero everywhere for a flat query; null for a flat window (or one under min_cv of its level) and for too few bars. One
    SQL text, as building a sum of many terms from columns takes longer than running it. Folded, the sum is a fold over arrays: slower, but
    little code, where it is needed more than once in a stage.
    """
    m, own, base = query.size, query.values[channel], query.values[scale]
    mean, std = fmean(base), pstdev(base)
    if std < 1e-10:
        return F.when(F.col(f"mean_{scale}").isNotNull(), F.lit(0.0))
    weights = query.weights or [1.0] * m
    term = f"pow({{q}} - (get(window, {{j}}).{channel} - mean_{scale}) / nullif(std_{scale}, 0D), 2D)"
    total = " + ".join(f"{weights[j]!r}D * {term.format(q=f'{(own[j] - mean) / std!r}D', j=j)}" for j in range(m))
    if folded:
        listed = lambda x: f"array({', '.join(f'{v!r}D' for v in x)})"
        total = f"aggregate(sequence(0, {m - 1}), 0D, (s, j) -> s + get({listed(weights)}, j) * {term.format(q=f'get({listed((v - mean) / std for v in own)}, j)', j='j')})"
    return F.expr(f"CASE WHEN NOT std_{scale} < greatest(1e-10D, {min_cv!r}D * abs(mean_{scale})) THEN sqrt({total}) END")


def scale_rejected(channel: str, query: Query, ratio: float) -> Column:
    """Whether a window's mean is over ratio times the query's, or under its inverse; never for a zero query mean."""
    mean = fmean(query.values[channel])
    if not ratio or mean == 0:
        return F.lit(False)
    r = F.abs(f"mean_{channel}") / F.lit(abs(mean))
    return ~F.coalesce((r >= 1.0 / ratio) & (r <= ratio), F.lit(False))


def profile(bars: DataFrame, query: Query, price_weight: float = 0.6, min_cv: float = 0.005, max_scale_ratio: float = 100.0, by: str = "sym", at: str = "d") -> DataFrame:
    """score of each window by its last bar: the candle's four distances on the close's scale, and the volume's on its own."""
    own = with_stats(with_stats(bars, "c", query.size, by, at), "v", query.size, by, at)
    price = [distance(c, "c", query, min_cv if c == "c" else 0.0) for c in "ohlc"]
    score = price_weight * (price[0] + price[1] + price[2] + price[3]) / 4.0 + (1.0 - price_weight) * distance("v", "v", query)
    bad = scale_rejected("c", query, max_scale_ratio) | scale_rejected("v", query, max_scale_ratio)
    return own.withColumn("score", F.when(~bad, score))


def search(bars: DataFrame, query: Query, k: int = 30, forward: int = 5, min_distance: float = 0.05, any_weekday: bool = False, by: str = "sym", at: str = "d", watch: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """The best admissible window of each series, and of these the k best: by score, then series. watch may observe all bars, with bar_no and score."""
    order = Window.partitionBy(by).orderBy(at)
    own = profile(bars, query, by=by, at=at, **options).withColumns({"bar_no": F.row_number().over(order), "__next": F.lead("c", forward).over(order)})
    own = own if watch is None else watch(own)
    fit = own.where((F.col("score") >= min_distance) & F.col("__next").isNotNull())
    if not any_weekday:
        fit = fit.where(F.weekday(at) == query.weekday)
    best = fit.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("score", at))).where("__r = 1")
    return best.orderBy("score", by).limit(k).select(by, at, "bar_no", "score", "mean_c", "std_c")


#: Parts of a window whose means an index holds.
SEGMENTS = 4


def segments_of(m: int, count: int = SEGMENTS) -> list[tuple[int, int]]:
    """Begin and end of the parts of a window, as equal as can be."""
    edges = [i * m // count for i in range(count + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def window_index(bars: DataFrame, m: int, by: str = "sym", at: str = "d", count: int = SEGMENTS) -> DataFrame:
    """A row a whole window of m bars, by its last: (by, at, bar_no, weekday, last_no, mean and std of close and volume, part_<channel>).

    part_<channel> are the means of the window's parts, normalised as distance() does: the candle's on the close's scale, the volume's on its own; null
    for a flat window. Any query of m bars can be answered from it (search_indexed), so it is a table worth keeping.
    """
    order = Window.partitionBy(by).orderBy(at)
    own = with_stats(with_stats(bars, "c", m, by, at, held=""), "v", m, by, at, held="")
    own = own.withColumns({"bar_no": F.row_number().over(order), "last_no": F.count("*").over(Window.partitionBy(by)), "holes": F.count_if(F.greatest(*(F.col(c).isNull() for c in CHANNELS))).over(order.rowsBetween(1 - m, 0))})

    def parts(c: str) -> Column:
        scale = "v" if c == "v" else "c"
        means = (F.avg(c).over(order.rowsBetween(a - m + 1, b - m)) for a, b in segments_of(m, count))
        return F.when((F.col(f"std_{scale}") >= 1e-10) & (F.col("holes") == 0), F.array(*((x - F.col(f"mean_{scale}")) / F.nullif(F.col(f"std_{scale}"), F.lit(0.0)) for x in means)))

    found = own.withColumns({f"part_{c}": parts(c) for c in CHANNELS}).where(F.col("bar_no") >= m)
    return found.select(by, at, "bar_no", F.weekday(at).alias("weekday"), "last_no", "mean_c", "std_c", "mean_v", "std_v", *(f"part_{c}" for c in CHANNELS))


def least_distance(channel: str, scale: str, query: Query, count: int = SEGMENTS) -> Column:
    """A lower bound of distance(): in each part no weighted sum of squares is below its size times its least weight times the square of the means' difference."""
    own, base = query.values[channel], query.values[scale]
    mean, std = fmean(base), pstdev(base)
    if std < 1e-10:
        return F.lit(0.0)
    weights = query.weights or [1.0] * query.size
    terms = (f"{(b - a) * min(weights[a:b])!r}D * pow({(fmean(own[a:b]) - mean) / std!r}D - get(part_{channel}, {i}), 2D)" for i, (a, b) in enumerate(segments_of(query.size, count)))
    return F.expr(f"sqrt({' + '.join(terms)})")


def scored(windows: DataFrame, bars: DataFrame, query: Query, price_weight: float, min_cv: float, by: str, at: str) -> DataFrame:
    """windows (by, at, bar_no, mean and std of close and volume) with their bars joined by position, and their score."""
    spread = windows.withColumn("__pos", F.explode(F.sequence(F.col("bar_no") - (query.size - 1), F.col("bar_no"))))
    own = bars.select(by, F.col("bar_no").alias("__pos"), F.struct(*CHANNELS).alias("__bar"))
    keys = [by, at, "bar_no", "mean_c", "std_c", "mean_v", "std_v"]
    whole = spread.join(own, [by, "__pos"]).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__bar"))), lambda x: x["__bar"]).alias("window"))
    price = [distance(c, "c", query, min_cv if c == "c" else 0.0, True) for c in "ohlc"]
    return whole.withColumn("score", price_weight * (price[0] + price[1] + price[2] + price[3]) / 4.0 + (1.0 - price_weight) * distance("v", "v", query, folded=True)).drop("window")


def search_indexed(bars: DataFrame, index: DataFrame, query: Query, k: int = 30, forward: int = 5, min_distance: float = 0.05, any_weekday: bool = False, price_weight: float = 0.6, min_cv: float = 0.005, max_scale_ratio: float = 100.0, by: str = "sym", at: str = "d") -> tuple[DataFrame, DataFrame]:
    """What search() finds, and (windows, expanded): how many windows there are and how many were compared bar by bar.

    index is window_index(bars, query.size), best a written table; bars have a close. First the window with the least lower bound of each of a few series is
    compared; as k series then have a match at least as good as the k-th of these, windows whose bound is beyond it can't be among the k
    best and are never expanded. Bounds never exceed scores, so the rows are those of the full scan.
    """
    numbered = bars.withColumn("bar_no", F.row_number().over(Window.partitionBy(by).orderBy(at)))
    bad = scale_rejected("c", query, max_scale_ratio) | scale_rejected("v", query, max_scale_ratio)
    thin = F.lit(False) if pstdev(query.values["c"]) < 1e-10 else F.col("std_c") < F.greatest(F.lit(1e-10), F.lit(min_cv) * F.abs("mean_c"))
    price = [least_distance(c, "c", query) for c in "ohlc"]
    bound = price_weight * (price[0] + price[1] + price[2] + price[3]) / 4.0 + (1.0 - price_weight) * least_distance("v", "v", query)
    fit = index.where(~bad & ~thin & (F.col("bar_no") + forward <= F.col("last_no")))
    if not any_weekday:
        fit = fit.where(F.col("weekday") == query.weekday)
    fit = fit.select(by, at, "bar_no", "mean_c", "std_c", "mean_v", "std_v", bound.alias("__bound")).where("__bound IS NOT NULL")
    first = fit.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("__bound", at))).where("__r <= 2").orderBy("__bound").limit(8 * k).drop("__r")
    tried = scored(first, numbered, query, price_weight, min_cv, by, at).where(F.col("score") >= min_distance).groupBy(by).agg(F.min("score").alias("s"))
    limits = [r.s for r in tried.orderBy("s").limit(k).collect()]
    limit = limits[-1] * (1 + 1e-9) + 1e-12 if len(limits) == k else float("inf")
    left = fit.where(F.col("__bound") <= F.lit(limit))
    found = scored(left, numbered, query, price_weight, min_cv, by, at).where(F.col("score") >= min_distance)
    best = found.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("score", at))).where("__r = 1")
    share = index.agg(F.count("*").alias("windows")).crossJoin(left.agg(F.count("*").alias("expanded")))  # a row each
    return best.orderBy("score", by).limit(k).select(by, at, "bar_no", "score", "mean_c", "std_c"), share


def match_bars(matches: DataFrame, bars: DataFrame, m: int, forward: int, by: str = "sym", at: str = "d") -> DataFrame:
    """Bars of each match by position: 0 is the window's last, negative ones are before it."""
    numbered = bars.withColumn("bar_no", F.row_number().over(Window.partitionBy(by).orderBy(at)))
    spread = matches.withColumn("pos", F.explode(F.sequence(F.lit(1 - m), F.lit(forward)))).withColumn("bar_no", F.col("bar_no") + F.col("pos")).withColumnRenamed(at, "match_day")
    return spread.join(numbered.select(by, "bar_no", at, *CHANNELS), [by, "bar_no"])


def channel_maps(rows: DataFrame, query: Query, keys: list[str], channels: tuple[str, ...] = ("c", "v")) -> DataFrame:
    """gain_<channel> and offset_<channel>: value * gain + offset takes a match's channel onto the query's scale; null for a flat match.

    rows are match_bars(); a channel's scale is that of its own window, positions up to 0.
    """
    over = Window.partitionBy(*keys)
    inside = lambda c: F.when(F.col("pos") <= 0, F.col(c))
    out = rows
    for c in channels:
        mean, std = fmean(query.values[c]), pstdev(query.values[c])
        out = out.withColumns({f"__m_{c}": F.avg(inside(c)).over(over), f"__s_{c}": F.stddev_pop(inside(c)).over(over)})
        gain = F.when(F.col(f"__s_{c}") >= 1e-10, F.lit(std) / F.col(f"__s_{c}"))
        out = out.withColumn(f"gain_{c}", gain).withColumn(f"offset_{c}", F.lit(mean) - F.col(f"__m_{c}") * F.col(f"gain_{c}")).drop(f"__m_{c}", f"__s_{c}")
    return out


def projected(rows: DataFrame, query: Query, keys: list[str] | None = None, channels: tuple[str, ...] = ("c", "v")) -> DataFrame:
    """proj_<channel>: a match's channels on the query's scale, with their maps; a flat match lies at the query's mean."""
    mapped = channel_maps(rows, query, keys or ["sym"], channels)
    return mapped.withColumns({f"proj_{c}": F.coalesce(F.col(c) * F.col(f"gain_{c}") + F.col(f"offset_{c}"), F.when(F.col(c).isNotNull(), F.lit(fmean(query.values[c])))) for c in channels})


def forward_returns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """ret: close over the close at position 0, less one."""
    base = F.max(F.when(F.col("pos") == 0, F.col("c"))).over(Window.partitionBy(*keys))
    return rows.withColumn("ret", F.when(base != 0, F.col("c") / base - 1))


def bar_stats(rows: DataFrame, value: str, query: Query | None = None, channel: str = "c") -> DataFrame:
    """Mean, population deviation and variation by position; with a query also its own bar and the mean's difference from it, up to position 0."""
    got = rows.groupBy("pos").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    got = got.withColumn("cv", F.when(F.abs("mean") >= 1e-12, F.col("std") / F.abs("mean") * 100))
    if query is None:
        return got
    own = F.array(*(F.lit(float(x)) for x in query.values[channel]))
    actual = F.when(F.col("pos") <= 0, F.get(own, F.col("pos") + (query.size - 1)))
    return got.withColumn("actual", actual).withColumn("deviation", F.col("mean") - F.col("actual"))


@dataclass
class Scan:
    """What a search saw, known once its result has been computed: metrics of the same job."""

    series: Observation
    matches: Observation
    began: float = field(default_factory=time.monotonic)

    @property
    def told(self) -> dict[str, float]:
        """series, those long enough to be scanned, matched, and seconds since the search was planned; waits for the result to be computed."""
        return {**self.series.get, **self.matches.get, "elapsed": time.monotonic() - self.began}


def observed(profiled: DataFrame, m: int) -> tuple[DataFrame, Observation]:
    """Bars with bar_no, which tell how many series there are and how many have m bars."""
    seen = Observation()
    return profiled.observe(seen, F.count_if(F.col("bar_no") == 1).alias("series"), F.count_if(F.col("bar_no") == m).alias("scanned")), seen


def search_observed(bars: DataFrame, query: Query, **options) -> tuple[DataFrame, Scan]:
    """search() and its Scan, whose figures come with the result, in one job."""
    held: list[Observation] = []

    def watch(rows: DataFrame) -> DataFrame:
        rows, seen = observed(rows, query.size)
        held.append(seen)
        return rows

    found, matches = search(bars, query, watch=watch, **options), Observation()
    return found.observe(matches, F.count("*").alias("matched")), Scan(held[0], matches)


def scan_stats(found: DataFrame, scan: Scan) -> DataFrame:
    """One row (series, scanned, matched) of a search_observed(), after its result, a few rows, has been computed."""
    found.collect()
    told = scan.told
    return found.sparkSession.createDataFrame([(told["series"], told["scanned"], told["matched"])], "series long, scanned long, matched long")


def return_bands(rows: DataFrame, edge: float = 0.01) -> DataFrame:
    """Counts by forward position: up by the edge or more, down by it or more, between."""
    return rows.where("pos > 0").groupBy("pos").agg(F.count_if(F.col("ret") >= edge).alias("up"), F.count_if((F.col("ret") > -edge) & (F.col("ret") < edge)).alias("flat"), F.count_if(F.col("ret") <= -edge).alias("down"))
