"""Files into DataFrames: CSV bars, YAML manifests, JSON-lines ledgers, settlement files, HTML documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions import columns as C

LEDGER = "tweet_id string, timestamp string, screen_name string, name string, text string, likes long, retweets long, comments long, tweet_url string"


def _file_symbol() -> Column:
    """A file's name without its ending; a symbol may hold dots."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"(?i)\.csv(\.gz)?$", "")


def _last_row(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The physically last row of each key in rows with _place(): by file, block and number within the partition, where a block's rows stand in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__file"), F.desc("__block"), F.desc("__row")))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n", "__file", "__block", "__row")


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")]


def daily_bars(spark: SparkSession, path: str) -> DataFrame:
    """<symbol>.csv files of Date,Open,High,Low,Close,Volume: (sym, d, o, h, l, c, v), the last row of a day; bad rows are left out whole."""
    raw = spark.read.csv(path, header=True, schema="Date string, Open string, High string, Low string, Close string, Volume string").select("*", _file_symbol().alias("sym"), *_place())
    number = lambda c: F.col(c).try_cast("double")
    rows = raw.select("__file", "__block", "__row", "sym", F.try_to_date(F.substring("Date", 1, 10), "yyyy-MM-dd").alias("d"), *(number(a).alias(b) for a, b in zip(("Open", "High", "Low", "Close", "Volume"), "ohlcv")))
    return _last_row(rows.where("d IS NOT NULL AND c IS NOT NULL AND NOT isnan(c)"), ["sym", "d"])


def hourly_bars(spark: SparkSession, path: str) -> DataFrame:
    """The same with Datetime in UTC in place of Date: (sym, ts, o, h, l, c, v)."""
    raw = spark.read.csv(path, header=True, schema="Datetime string, Open string, High string, Low string, Close string, Volume string").select("*", _file_symbol().alias("sym"), *_place())
    utc = F.regexp_replace(F.substring("Datetime", 1, 19), "T", " ").try_cast("timestamp_ntz")
    number = lambda c: F.col(c).try_cast("double")
    rows = raw.where(utc.isNotNull()).select("__file", "__block", "__row", "sym", utc.alias("ts"), *(number(a).alias(b) for a, b in zip(("Open", "High", "Low", "Close", "Volume"), "ohlcv")))
    return _last_row(rows.where("c IS NOT NULL AND v IS NOT NULL"), ["sym", "ts"])


def last_dates(bars: DataFrame, at: str = "d") -> DataFrame:
    return bars.groupBy("sym").agg(F.max(at).alias("last"))


def yaml_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, value): each YAML file under path as a value of schema; an empty file is an empty record."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            told = [json.dumps(yaml.safe_load(t) or {}, default=str) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], ["path", "json"])

    return files.mapInArrow(run, "path string, json string").select("path", F.from_json("json", schema).alias("value"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Source manifests: (path, ticker (the file's folder), cik with ten digits, day, and a struct of links)."""
    got = yaml_rows(spark, path, "map<string,string>").select("path", F.map_filter("value", lambda k, _: k != "_meta").alias("days"), F.from_json(F.col("value")["_meta"], "cik string").alias("meta"))
    ticker = F.regexp_extract(F.url_decode("path"), r"([^/]+)/[^/]+$", 1).alias("ticker")
    return got.select("path", ticker, F.lpad("meta.cik", 10, "0").alias("cik"), F.explode("days").alias("day", "json")).select("path", "ticker", "cik", "day", F.from_json("json", "quarter string, period_end string, report string, report_type string, letter string, letter_type string, transcript string").alias("links"))


def universe(spark: SparkSession, path: str) -> DataFrame:
    """A universe file: (symbol, tags, benchmarks) of its stocks."""
    return yaml_rows(spark, path, "stocks array<struct<symbol:string,tags:array<string>,benchmarks:array<string>>>").select(F.inline("value.stocks"))


def quarters(spark: SparkSession, path: str) -> DataFrame:
    """Quarter records of FINANCIALS-like files: (path, unit, currency, record map of text)."""
    got = yaml_rows(spark, path, "unit string, currency string, quarters array<map<string,string>>")
    return got.select("path", F.coalesce("value.unit", F.lit("thousands")).alias("unit"), F.coalesce("value.currency", F.lit("USD")).alias("currency"), F.explode("value.quarters").alias("record"))


def capex_lines(records: DataFrame) -> DataFrame:
    """Adds ytd_capex: a map of the ytd_capex_* keys of a record, without the prefix."""
    own = F.map_filter("record", lambda k, _: k.startswith("ytd_capex_"))
    return records.withColumn("ytd_capex", F.transform_values(F.transform_keys(own, lambda k, _: F.substring(k, 11, 100)), lambda _, v: v.try_cast("double")))


def announcements(records: DataFrame) -> DataFrame:
    """(path, id, day, session) of dated records by day; records with one of the two, or a bad one, are an error that names all of a file's."""
    day = F.try_to_date(F.substring(F.col("record")["announce_date"], 1, 10), "yyyy-MM-dd")
    session = F.col("record")["announce_session"]
    dated = records.where(F.col("record")["announce_date"].isNotNull() | session.isNotNull()).select("path", F.col("record")["id"].alias("id"), day.alias("day"), session.alias("session"))
    fine = F.coalesce(F.col("day").isNotNull() & F.col("session").isin("pre-open", "intraday", "after-close"), F.lit(False))
    bad = F.array_join(F.array_sort(F.collect_list(F.when(~fine, F.coalesce("id", F.lit("?")))).over(Window.partitionBy("path"))), ", ")
    told = dated.withColumn("__bad", bad)
    return told.withColumn("day", F.when(F.col("__bad") == "", F.col("day")).otherwise(F.raise_error(F.concat(F.lit("no valid announcement: "), "__bad")).cast("date"))).drop("__bad").orderBy("path", "day")


#: Columns of the quarter table, their key in a record, and their type.
RECORD = {
    "id": ("id", "string"), "end_date": ("end_date", "date"), "report_date": ("report_date", "date"), "announce_date": ("announce_date", "date"), "announce_session": ("announce_session", "string"),
    "revenue": ("revenue", "double"), "ytd_ocf": ("ytd_operating_cf", "double"), "ytd_sbc": ("ytd_sbc", "double"), "shares": ("shares_outstanding", "double"), "cash": ("cash", "double"), "debt": ("total_debt", "double"),
    "shares_short": ("shares_short", "double"), "settled": ("short_settlement_date", "date"), "nq_low": ("guidance_nq_revenue_low", "double"), "nq_high": ("guidance_nq_revenue_high", "double"),
    "fy_low": ("guidance_fy_revenue_low", "double"), "fy_high": ("guidance_fy_revenue_high", "double"), "nq_hint": ("guidance_nq_hint", "string"), "fy_hint": ("guidance_fy_hint", "string"),
    "est_low": ("est_fy_revenue_low", "double"), "est_high": ("est_fy_revenue_high", "double"),
}


def quarter_table(spark: SparkSession, path: str) -> DataFrame:
    """Quarter records as a typed table: sym (the file's folder), unit, currency, fy, qn, the columns of RECORD and ytd_capex, a map of lines.

    A value that isn't of its type is null; a capex line with no value stays a line without value.
    """
    rows = capex_lines(quarters(spark, path)).withColumn("sym", F.regexp_extract(F.url_decode("path"), r"([^/]+)/[^/]+$", 1))
    typed = [(F.try_to_date(F.substring(F.col("record")[k], 1, 10), "yyyy-MM-dd") if t == "date" else F.col("record")[k].try_cast(t)).alias(c) for c, (k, t) in RECORD.items()]
    got = rows.select("sym", "unit", F.upper("currency").alias("currency"), *typed, "ytd_capex")
    return got.withColumns({"fy": C.fiscal_year(F.col("id")), "qn": C.quarter_number(F.lower("id"))})


def capex_names(quarters: DataFrame) -> DataFrame:
    """(sym, lines): each symbol's distinct capex lines, plant first, then by name."""
    names = quarters.select("sym", F.explode(F.map_keys("ytd_capex")).alias("line")).distinct()
    own = names.groupBy("sym").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return own.withColumn("lines", F.concat(F.filter("lines", lambda x: x == "ppe"), F.filter("lines", lambda x: x != "ppe")))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines ledger; blank and broken lines are left out."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path).where("tweet_id IS NOT NULL")


def settlements(spark: SparkSession, path: str) -> DataFrame:
    """Short-interest CSV files: (sym, day, qty); bad rows are left out."""
    raw = spark.read.csv(path, header=True, schema="symbolCode string, settlementDate string, currentShortPositionQuantity string")
    return raw.select(F.col("symbolCode").alias("sym"), F.try_to_date("settlementDate", "yyyy-MM-dd").alias("day"), F.col("currentShortPositionQuantity").try_cast("long").alias("qty")).where("day IS NOT NULL AND qty IS NOT NULL")


def html_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
