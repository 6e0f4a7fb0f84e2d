"""Remote payloads: fetched by a function of the caller's, a host's one after another with a pause, and read as tables.

There is no client for any service here: fetch takes a URL and returns text, or None where there is nothing. Failures of a single
request leave a null payload, as a missing page would.
"""

from __future__ import annotations

import csv
import io
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.text import once, post_record
from marketloom.sources.connector import FILINGS_PAUSE

#: Days of hourly bars that the vendor keeps (fixed value).
HOURLY_DAYS = 729


def payloads(urls: DataFrame, fetch: Callable[[str], str | None], pause: float = FILINGS_PAUSE, url: str = "url") -> DataFrame:
    """urls with the payload of each: distinct URLs are requested once, by one task a host and in order, as the hosts ask for.

    For a crawl that goes on after a restart, and a store of its pages, see connector.crawl.
    """
    asked = urls.select(F.col(url).alias("__u")).where(F.col(url).isNotNull()).distinct().withColumn("__h", F.lower(F.regexp_extract("__u", "^[^:/]+://([^/?#]*)", 1)))

    def run(own: pa.Table) -> pa.Table:
        got, names = [], sorted(own.column("__u").to_pylist())
        for u in names:
            time.sleep(pause)
            try:
                got.append(fetch(u))
            except OSError:
                got.append(None)
        return pa.Table.from_arrays([pa.array(names, pa.string()), pa.array(got, pa.string())], ["__u", "payload"])

    told = asked.groupBy("__h").applyInArrow(run, "__u string, payload string")
    return urls.join(told, urls[url] == told["__u"], "left").drop("__u")


def _zipped(arrays: list[Column], fields: str) -> Column:
    """Arrays side by side, as long as the first; null where that is."""
    types = [f.rpartition(" ")[2] for f in fields.split(", ")]
    filled = [arrays[0], *(F.coalesce(a, F.array().cast(f"array<{t}>")) for a, t in zip(arrays[1:], types[1:]))]
    return F.slice(F.arrays_zip(*filled).cast(f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"), 1, F.size(arrays[0]))


def chart_bars(payload: Column, hourly: bool = False, holes: bool = False) -> Column:
    """An array of bars (ts or d, o, h, l, c, v) of a chart's JSON: prices adjusted by adjclose where it has that, bars without a close left out unless holes are asked for.

    A daily bar's day is that of its stamp on the exchange's clock (meta.gmtoffset), as its session may begin on the evening before in UTC.
    """
    quote = "struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>"
    parsed = F.from_json(payload, f"chart struct<result:array<struct<meta:struct<gmtoffset:long>,timestamp:array<long>,indicators:struct<quote:array<{quote}>,adjclose:array<struct<adjclose:array<double>>>>>>>")

    def bar(x: Column) -> Column:
        factor = F.coalesce(F.try_divide(x["a"], x["c"]), F.lit(1.0))
        at = F.to_timestamp_ntz(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(x["t"]).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")).alias("ts") if hourly else F.date_add(F.lit("1970-01-01").cast("date"), F.floor((x["t"] + x["z"]) / 86400).cast("int")).alias("d")
        return F.struct(at, *((x[k] * factor).alias(k) for k in "ohlc"), x["v"].alias("v"))

    def of(j: Column) -> Column:
        r = F.get(j.chart.result, F.lit(0))
        q, adjusted = F.get(r.indicators.quote, F.lit(0)), F.get(r.indicators.adjclose, F.lit(0)).adjclose
        offsets = F.array_repeat(F.coalesce(r.meta.gmtoffset, F.lit(0)), F.size(r.timestamp))
        told = _zipped([r.timestamp, q.open, q.high, q.low, q.close, q.volume, adjusted, offsets], "t long, o double, h double, l double, c double, v double, a double, z long")
        bars = F.transform(told, bar)
        return bars if holes else F.filter(bars, lambda b: b.c.isNotNull() & ~F.isnan(b.c))

    return once(parsed, of)


def split_events(payload: Column) -> Column:
    """An array of (effective, split) of a chart's JSON: the day and the ratio of each split."""
    j = F.from_json(payload, "chart struct<result:array<struct<events:struct<splits:map<string,struct<date:long,numerator:double,denominator:double>>>>>>")
    splits = F.map_values(F.get(j.chart.result, F.lit(0)).events.splits)
    return F.array_sort(F.transform(splits, lambda s: F.struct(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s.date / 86400).cast("int")).alias("effective"), F.try_divide(s.numerator, s.denominator).alias("split"))))


def settlement_rows(pages: DataFrame, by: str = "sym") -> DataFrame:
    """(by, day, qty) of pages' payloads of short-interest CSV text, whose first line names its columns; bad rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [(r.get("settlementDate"), r.get("currentShortPositionQuantity")) for r in csv.DictReader(io.StringIO(text or ""))]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.string()), *(pa.array([r[i] for r in own], pa.string()) for i in (0, 1))], ["by", "day", "qty"])

    rows = pages.select(F.col(by).cast("string"), "payload").mapInArrow(run, "by string, day string, qty string")
    typed = rows.select(F.col("by").alias(by), F.try_to_date("day", "yyyy-MM-dd").alias("day"), F.col("qty").try_cast("long").alias("qty"))
    return typed.where("day IS NOT NULL AND qty IS NOT NULL")


def live_price(payload: Column) -> Column:
    """The market's price in a chart's JSON; null where there is none, and for zero."""
    price = F.get(F.from_json(payload, "chart struct<result:array<struct<meta:struct<regularMarketPrice:double>>>>").chart.result, F.lit(0)).meta.regularMarketPrice
    return F.nullif(price, F.lit(0.0))


def fx_rate(payload: Column) -> Column:
    """Units of a currency for a dollar; one where the payload has none."""
    return F.coalesce(live_price(payload), F.lit(1.0))


def filings_feed(payload: Column) -> Column:
    """A company's filings in its JSON: fiscal_year_end, an array of rows (pos, form, accession, filed, period), and the names of older blocks."""
    arrays = "form array<string>, accessionNumber array<string>, filingDate array<string>, reportDate array<string>"
    inner = arrays.replace(" array", ":array")
    parsed = F.from_json(payload, f"fiscalYearEnd string, filings struct<recent:struct<{inner}>,files:array<struct<name:string>>>, {arrays}")
    day = lambda x: F.try_to_date(x, "yyyy-MM-dd")

    def of(j: Column) -> Column:
        pick = [F.coalesce(j.filings.recent[name], j[name]) for name in ("form", "accessionNumber", "filingDate", "reportDate")]
        told = _zipped(pick, "form string, accession string, filed string, period string")
        rows = F.transform(told, lambda x, i: F.struct(i.alias("pos"), x["form"].alias("form"), x["accession"].alias("accession"), day(x["filed"]).alias("filed"), day(F.nullif(x["period"], F.lit(""))).alias("period")))
        return F.struct(F.coalesce(F.nullif(j.fiscalYearEnd, F.lit("")), F.lit("1231")).alias("fiscal_year_end"), rows.alias("rows"), F.transform(j.filings.files, lambda f: f["name"]).alias("older"))

    return once(parsed, of)


def company_tickers(payload: Column) -> Column:
    """An array of (ticker, cik_str, pos) of the list of companies, in its order."""
    return F.transform(F.map_values(F.from_json(payload, "map<string,struct<cik_str:long,ticker:string>>")), lambda x, i: F.struct(x.ticker.alias("ticker"), x.cik_str.alias("cik_str"), i.alias("pos")))


def posts(payload: Column) -> Column:
    """An array of flat records of a search's JSON array of posts; those without an id are left out."""
    return F.filter(F.transform(F.from_json(payload, "array<string>"), post_record), lambda x: x.isNotNull())
