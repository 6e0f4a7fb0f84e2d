"""Queries that refresh a store from payloads made of the test tables, which a fetch function serves from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.plans.company import SPLITS, settlements
from marketloom.plans.files import quarter_files
from marketloom.plans.views import nation_bars, query, read
from marketloom.sources import readers, refresh, writers
from marketloom.streaming.stores import shared_dir


#: Ids of events whose posts stand on one page of a search: on a symbol's page there are at most so many, and no page grows with the table.
PAGED = 100_000


def served(where: str):
    """A fetch function for file addresses: what follows ? names a first day, before which a chart's bars are left out; a last bar with a hole is whole on its own day."""

    def fetch(url: str) -> str | None:
        import datetime as dt
        import json

        from pyarrow import fs

        path, _, since = url.partition("?")
        store, folder = fs.FileSystem.from_uri(where)
        try:
            with store.open_input_stream(f"{folder}/{path.rpartition('/')[2]}") as f:
                text = f.read().decode()
        except FileNotFoundError as e:
            raise OSError(str(e)) from e
        if not since:
            return text
        chart = json.loads(text)
        own = chart["chart"]["result"][0]
        first = int(dt.datetime.fromisoformat(since).replace(tzinfo=dt.timezone.utc).timestamp())
        at = [i for i, t in enumerate(own["timestamp"]) if t >= first]
        quote = own["indicators"]["quote"][0]
        own["timestamp"] = [own["timestamp"][i] for i in at]
        for name, values in quote.items():
            quote[name] = [values[i] for i in at]
        if own.pop("hole", False) and len(at) > 1:
            for name in ("open", "high", "low", "close"):
                quote[name][-1] = None
        return json.dumps(chart)

    return fetch


def vendor_charts(bars, splits, where: str) -> None:
    """A chart's JSON a symbol: of every fourth one the last bar has a hole in any longer range, of every other fourth it has no close at all."""
    stamp = (F.unix_date("d") * 86400 + 52200).alias("t")
    rows = bars.groupBy("sym").agg(F.array_sort(F.collect_list(F.struct(stamp, *"ohlcv"))).alias("x")).join(splits, "sym", "left")
    n = F.size("x")
    close = F.transform("x", lambda b, i: F.when((F.col("sym") % 4 == 3) & (i == n - 1), None).otherwise(b.c))
    quote = F.struct(*(F.col(f"x.{k}").alias(name) for k, name in zip("ohl", ("open", "high", "low"))), close.alias("close"), F.col("x.v").alias("volume"))
    result = F.struct(F.struct(F.lit(0).alias("gmtoffset")).alias("meta"), F.col("x.t").alias("timestamp"), (F.col("sym") % 4 == 1).alias("hole"), F.struct(F.array(quote).alias("quote")).alias("indicators"), F.struct(F.col("splits")).alias("events"))
    page = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    writers.write_documents(rows.select(F.concat(F.col("sym").cast("string"), F.lit(".json")).alias("name"), page.alias("page")), where)


def split_maps(rows):
    """(sym, splits): a chart's events of splits (sym, effective, split)."""
    event = F.struct((F.unix_date("effective") * 86400 + 52200).alias("date"), F.col("split").alias("numerator"), F.lit(1.0).alias("denominator"))
    return rows.groupBy("sym").agg(F.map_from_entries(F.collect_list(F.struct(F.col("effective").cast("string"), event))).alias("splits"))


def chart_address(sym, since):
    return F.concat(F.lit("files://vendor/"), sym, F.lit(".json?"), since.cast("string"))


@query("price_refresh", """SELECT CAST(sym AS VARCHAR) AS sym, d, o, h, l, CASE WHEN sym % 6 <> 5 AND sym % 8 <> 2 AND d < last THEN c + 1 ELSE c END AS c, v FROM nbars LEFT JOIN (SELECT sym, max(d) AS last FROM nbars WHERE d < DATE '1998-01-01' GROUP BY 1) USING (sym)
 JOIN (SELECT sym, max(d) AS newest FROM nbars GROUP BY 1) USING (sym) WHERE sym % 4 <> 3 OR d < newest""", "nbars")
def price_refresh(spark, sf_dir):
    """A store that ends in 1997, whose closes are one too high and some symbols of which it lacks, refreshed from charts in which some symbols have split since."""
    where = shared_dir(spark)
    own = nation_bars(spark, sf_dir).drop("region")
    splits = own.where("sym % 8 = 2").select("sym").distinct().select("sym", F.lit("1998-03-02").cast("date").alias("effective"), F.lit(2.0).alias("split"))
    vendor_charts(own, split_maps(splits), f"{where}/vendor")
    stored = own.where("d < DATE '1998-01-01' AND sym % 6 <> 5").withColumns({"c": F.col("c") + 1, "sym": F.col("sym").cast("string")})
    writers.write_bars(stored, f"{where}/bars")
    symbols = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sym"))
    refresh.refresh_prices(symbols, f"{where}/bars", chart_address, served(f"{where}/vendor"), start="1980-01-01", pause=0.0)
    return writers.stored_bars(spark, f"{where}/bars", "sym string, d date, o double, h double, l double, c double, v double")


@query("short_refresh", """SELECT CAST(s.sym AS VARCHAR) AS sym, id, CASE WHEN settled IS NOT NULL THEN round_even(qty * 100000 * coalesce(ratio, 1.0) / 1000000.0, 3) END AS shares_short, settled FROM short s
 LEFT JOIN (SELECT a.sym, fy, qn, product(split) AS ratio FROM short a JOIN splits p ON a.sym = p.sym AND p.effective > a.settled GROUP BY 1, 2, 3) r ON s.sym = r.sym AND s.fy = r.fy AND s.qn = r.qn""", "short splits")
def short_refresh(spark, sf_dir):
    """Quarter files without short interest, which settlements and splits of a vendor's are added to."""
    where = shared_dir(spark)
    files, vendor = quarter_files(spark, sf_dir), f"{where}/vendor"
    line = F.concat(F.lit('"X, Inc.",'), (F.col("qty") * 100000).cast("string"), F.lit(","), F.col("day").cast("string"))
    text = F.concat(F.lit("issueName,currentShortPositionQuantity,settlementDate\nbroken,x,2020\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"))
    sheets = settlements(spark, sf_dir).groupBy("sym").agg(text.alias("page"))
    writers.write_documents(sheets.select(F.concat(F.col("sym").cast("string"), F.lit(".csv")).alias("name"), "page"), vendor)
    splits = spark.createDataFrame(SPLITS, "sym int, effective string, split double").withColumn("effective", F.to_date("effective"))
    traded = settlements(spark, sf_dir).select("sym", F.col("day").alias("d"), *(F.col("qty").cast("double").alias(k) for k in "ohlcv"))
    vendor_charts(traded, split_maps(splits), vendor)
    refresh.refresh_shorts(spark, files, "FINANCIALS.yml", lambda s: F.concat(F.lit("files://vendor/"), s, F.lit(".csv")), chart_address, served(vendor), 0.0)
    return readers.quarter_table(spark, f"{files}/*/FINANCIALS.yml").select("sym", "id", "shares_short", "settled")


@query("post_refresh", "SELECT event_type || '-' || user_id % 20 AS sym, CAST(event_id AS VARCHAR) AS tweet_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'u' || user_id AS screen_name, user_id AS likes FROM events")
def post_refresh(spark, sf_dir):
    """Events as posts of their type's and user's group, a search's results in pages: the older half is found by a first search, which a second one finds again."""
    where = shared_dir(spark)
    own = read(spark, sf_dir, "events").withColumn("sym", F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string")))
    own = own.withColumn("name", F.concat("sym", F.lit("."), F.coalesce(F.floor(F.col("event_id") / PAGED), F.lit(0)).cast("string"), F.lit(".json")))
    post = F.struct(F.col("event_id").cast("string").alias("tweet_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screen_name")).alias("user"), F.lit("  a text ").alias("text"), F.col("user_id").alias("likes"))
    for name, rows in (("first", own.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))), ("second", own)):
        writers.write_documents(rows.groupBy("name").agg(F.to_json(F.collect_list(post)).alias("page")), f"{where}/{name}")
        searches = own.select("sym", F.concat(F.lit("files://"), F.substring_index("sym", "-", 1), F.lit("/"), "name").alias("url")).distinct()
        refresh.refresh_posts(searches, f"{where}/ledger", served(f"{where}/{name}"), cooldown=0, pause=0.0)
    return refresh.posts_ledger(spark, f"{where}/ledger").select("sym", "tweet_id", "timestamp", "screen_name", "likes")
