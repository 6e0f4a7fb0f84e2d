"""Queries that write the test tables as files of the engine's formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom import tools
from marketloom.functions import formats as X
from marketloom.plans.price import week_grid
from marketloom.plans.views import announcements, hour_bars, nation_bars, quarters, query, read, view
from marketloom.sources import archives, readers, writers
from marketloom.streaming.stores import shared_dir

COUNTRY = "CASE region WHEN 0 THEN 'us' WHEN 1 THEN 'jp' WHEN 2 THEN 'uk' WHEN 3 THEN 'hk' ELSE 'world' END"
SEGMENT = "CASE sym % 4 WHEN 0 THEN 'nyse stocks' WHEN 1 THEN 'tse stocks' WHEN 2 THEN 'lse stocks intl' ELSE 'nyse etfs' END"


@query("archive_scan", f"SELECT country, segment, 'N' || sym || CASE WHEN sym % 3 = 0 THEN '.B' ELSE '' END AS ticker, d, o, h, l, c, v FROM (SELECT *, {COUNTRY} AS country, {SEGMENT} AS segment FROM nbars) WHERE country IN ('us', 'jp', 'uk', 'world') AND segment <> 'nyse etfs'", "nbars")
def archive_scan(spark, sf_dir):
    """Bars of every nation as members of archives, and those of some countries' stocks out of them."""
    where = f"{shared_dir(spark)}/archives"
    name = F.concat(F.lit("n"), F.col("sym").cast("string"), F.when(F.col("sym") % 3 == 0, ".b").otherwise(""), F.when(F.col("region") < 4, F.concat(F.lit("."), F.expr(COUNTRY))).otherwise(""))
    # a last .b is an ending too where the country gives none
    name = F.when((F.col("region") == 4) & (F.col("sym") % 3 == 0), F.concat(name, F.lit(".v"))).otherwise(name)
    archives.write_archives(nation_bars(spark, sf_dir).select(F.expr(COUNTRY).alias("country"), F.expr(SEGMENT).alias("segment"), name.alias("ticker"), "d", *"ohlcv"), where)
    return archives.archive_bars(spark, where, countries=["us", "jp", "uk", "world"]).drop("member")


def text_files(rows, by, line, order, head, ending, where):
    """A file a symbol: head, then its lines in order."""
    pages = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("x"))
    writers.write_documents(pages.select(F.concat(F.col(by).cast("string"), F.lit(ending)).alias("name"), F.concat(head, F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).alias("page")), where)
    return where


@query("daily_csv", "SELECT CAST(sym AS VARCHAR) AS sym, d, o, h, l, CASE WHEN sym % 2 = 0 AND day(d) = 1 THEN c * 2 ELSE c END AS c, v FROM nbars", "nbars")
def daily_csv(spark, sf_dir):
    """Daily bars as CSV files, with broken lines, and with a second row for some days, which counts."""
    own = nation_bars(spark, sf_dir)
    again = own.where("sym % 2 = 0 AND day(d) = 1").withColumns({"c": F.col("c") * 2, "n": F.lit(1)})
    rows = own.withColumn("n", F.lit(0)).unionByName(again)
    line = F.concat_ws(",", F.col("d").cast("string"), *(F.col(x).cast("string") for x in "ohlcv"))
    line = F.when(F.dayofmonth("d") == 2, F.concat(F.lit("broken,1,2\n"), line)).otherwise(line)
    where = text_files(rows, "sym", line, ["n", "d"], F.lit("Date,Open,High,Low,Close,Volume\n"), ".csv", f"{shared_dir(spark)}/daily")
    return readers.daily_bars(spark, where)


@query("hourly_csv", "SELECT sym, ts, o, h, l, c, v FROM hbars", "hbars")
def hourly_csv(spark, sf_dir):
    """Hourly bars as CSV files with zoned stamps."""
    line = F.concat_ws(",", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")), *(F.col(x).cast("string") for x in "ohlcv"))
    where = text_files(hour_bars(spark, sf_dir), "sym", line, ["ts"], F.lit("Datetime,Open,High,Low,Close,Volume\n"), ".csv", f"{shared_dir(spark)}/hourly")
    return readers.hourly_bars(spark, where)


def quarter_files(spark, sf_dir):
    """Quarter records as YAML files, a folder a symbol; money in whole cents."""
    told = lambda k, c: F.coalesce(F.concat(F.lit(f"\n  {k}: "), F.col(c).cast("string")), F.lit(""))
    own = quarters(spark, sf_dir).join(announcements(spark, sf_dir), ["sym", "fy", "qn"])
    cents = own.withColumns({c: F.col(c).cast("decimal(18,0)") for c in ("revenue", "ytd_ocf", "ytd_ppe", "ytd_software", "ytd_sbc", "shares")})
    keys = {"end_date": "end_date", "announce_date": "day", "announce_session": "session", "revenue": "revenue", "ytd_operating_cf": "ytd_ocf", "ytd_capex_ppe": "ytd_ppe", "ytd_capex_software": "ytd_software", "ytd_sbc": "ytd_sbc", "shares_outstanding": "shares"}
    line = F.concat(F.lit("- id: "), F.col("id"), *(told(k, c) for k, c in keys.items()))
    return text_files(cents, "sym", line, ["end_date"], F.lit("unit: millions\ncurrency: eur\nquarters:\n"), "/FINANCIALS.yml", f"{shared_dir(spark)}/quarters")


@query("quarter_yaml", "SELECT CAST(sym AS VARCHAR) AS sym, fy, qn, id, 'millions' AS unit, 'EUR' AS currency, end_date, revenue, ytd_ocf, ytd_ppe AS ppe, ytd_software AS software, ytd_sbc, shares FROM quarters", "quarters")
def quarter_yaml(spark, sf_dir):
    got = readers.quarter_table(spark, f"{quarter_files(spark, sf_dir)}/*/FINANCIALS.yml")
    return got.select("sym", "fy", "qn", "id", "unit", "currency", "end_date", "revenue", "ytd_ocf", F.col("ytd_capex")["ppe"].alias("ppe"), F.col("ytd_capex")["software"].alias("software"), "ytd_sbc", "shares")


@query("announcement_calendar", "SELECT CAST(q.sym AS VARCHAR) AS sym, id, day, session FROM quarters q JOIN announce a ON q.sym = a.sym AND q.fy = a.fy AND q.qn = a.qn", "quarters announce")
def announcement_calendar(spark, sf_dir):
    got = readers.announcements(readers.quarters(spark, f"{quarter_files(spark, sf_dir)}/*/FINANCIALS.yml"))
    return got.select(F.regexp_extract(F.url_decode("path"), r"([^/]+)/[^/]+$", 1).alias("sym"), "id", "day", "session")


view("weeks4", "SELECT sym, week FROM (SELECT sym, week, row_number() OVER (PARTITION BY sym ORDER BY week DESC) AS r FROM wgrid) WHERE r <= 4", ("wgrid",))


@query("flow_newest", "SELECT sym, week, CAST(slot AS VARCHAR) AS column_label, CAST(CAST(v AS DECIMAL(18, 1)) AS VARCHAR) AS volume FROM wcells SEMI JOIN weeks4 USING (sym, week)", "wcells weeks4")
def flow_newest(spark, sf_dir):
    """The flow report's volumes of the newest four weeks."""
    got = tools.flow(week_grid(spark, sf_dir), "week", ["0", "1", "2", "3", "4"])
    return got.where("row_label = 'v'").select("sym", "week", "column_label", F.col("value").cast("double").cast("decimal(18,1)").cast("string").alias("volume"))


@query("cached_result", "SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY 1")
def cached_result(spark, sf_dir):
    """A result that is published once and then read from its store."""
    where = shared_dir(spark)
    make = lambda: read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))
    writers.cached(spark, where, "priorities", make)
    return writers.cached(spark, where, "priorities", lambda: make().limit(0))


@query("formatted_money", """SELECT o_orderkey, CASE WHEN x >= 1e9 THEN printf('$%.2fB', x / 1e9) WHEN x >= 1e6 THEN printf('$%.0fM', x / 1e6) END AS money FROM (SELECT o_orderkey, (round(o_totalprice) * 4 + 1) * 1000.0 AS x FROM orders)""")
def formatted_money(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", X.money((F.round("o_totalprice") * 4 + 1) * 1000.0).alias("money"))
