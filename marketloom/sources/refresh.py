"""Refreshes: what a store lacks is asked for, read out of what comes back, and merged into it.

The caller gives addresses (as columns) and a fetch function, as for connector.crawl; a host's addresses are asked for one after another, hosts side by side.
A run's pages lie in a folder beside the store until it is done, so a task that is run again asks for nothing again, and the driver sees counts only.

Null symbols are left out and repeated ones count once. A symbol whose request fails or gives nothing keeps what it has, and the report says so.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import fundamentals as Q
from marketloom.operators import ingest as I
from marketloom.operators import series as S
from marketloom.sources import readers, remote, writers
from marketloom.sources.connector import FILINGS_PAUSE, add_urls, crawl, with_payloads

#: The first days of a symbol that isn't stored yet (fixed values).
DAILY_START, HOURLY_START = "2000-01-01", "2024-01-01"
#: Days between a quarter's end and a settlement at most (fixed value).
SETTLED_WITHIN = 6

Fetch = Callable[[str], str | None]
Pause = float | dict[str, float]


def _asked(rows: DataFrame, work: str, fetch: Fetch, pause: Pause) -> DataFrame:
    """rows, which have a url, with its payload; the pages stay in work."""
    add_urls(rows, f"{work}/urls")
    return with_payloads(rows, crawl(rows.sparkSession, f"{work}/urls", work, fetch, pause))


def refresh_prices(symbols: DataFrame, store: str, address: Callable[[Column, Column], Column], fetch: Fetch, today: str | None = None, hourly: bool = False, start: str | None = None, pause: Pause = FILINGS_PAUSE) -> DataFrame:
    """Bring the bars of symbols (sym) in a store up to date; address gives a symbol's chart from a day on.

    A stored symbol is asked for from its last day on, which heals a bar that was stored while it still grew; one that has split since is asked for
    whole. Daily bars that come without a close at the end of a range are asked for by themselves. Equal tails aren't written. Returns
    (sym, since, split, bars, healed): where the request began, whether it went back to the start for a split, the bars that came and those of them healed.
    """
    spark, at = symbols.sparkSession, "ts" if hourly else "d"
    store = store.rstrip("/")
    work = f"{store}_refresh-{uuid.uuid4().hex}"
    schema = f"sym string, {at} {'timestamp_ntz' if hourly else 'date'}, o double, h double, l double, c double, v double"
    day = dt.date.fromisoformat(today) if today else dt.date.today()
    first = dt.date.fromisoformat(start or (HOURLY_START if hourly else DAILY_START))
    begin = F.lit(max(first, day - dt.timedelta(days=remote.HOURLY_DAYS)) if hourly else first)
    old = writers.stored_bars(spark, store, schema)
    old = spark.createDataFrame([], schema) if old is None else old
    known = old.groupBy("sym").agg(F.max(at).cast("date").alias("last"))
    asked = symbols.select(F.col("sym").cast("string").alias("sym")).where("sym IS NOT NULL").distinct().join(known, "sym", "left")
    asked.withColumn("since", F.coalesce("last", begin)).write.parquet(f"{work}/asked")
    asked = spark.read.parquet(f"{work}/asked")
    pages = _asked(asked.withColumn("url", address(F.col("sym"), F.col("since"))), f"{work}/tails", fetch, pause)
    splits = pages.select("sym", "last", F.explode(remote.split_events(F.col("payload"))).alias("x")).select("sym", "last", "x.*").where("effective > last").select("sym", "effective", "split")
    hit = splits.select("sym").distinct()
    whole = asked.join(hit, "sym", "left_semi").withColumn("since", begin)
    again = _asked(whole.withColumn("url", address(F.col("sym"), begin)), f"{work}/whole", fetch, pause)
    told = pages.join(hit, "sym", "left_anti").withColumn("split", F.lit(False)).unionByName(again.withColumn("split", F.lit(True)))
    bars = told.select("sym", F.posexplode(remote.chart_bars(F.col("payload"), hourly, holes=True)).alias("pos", "x")).select("sym", "x.*", "pos")
    bars.write.parquet(f"{work}/bars")
    bars = spark.read.parquet(f"{work}/bars")
    if not hourly:
        probes = _asked(I.open_tail(bars).withColumn("url", address(F.col("sym"), F.col("d"))), f"{work}/probes", fetch, pause)
        found = probes.select("sym", F.col("d").alias("__day"), F.posexplode(remote.chart_bars(F.col("payload"))).alias("pos", "x")).where("x.d = __day").select("sym", "x.*", "pos")
        bars = I.heal_tail(bars.withColumn("healed", F.lit(False)), S.keep_last(found, ["sym", "d"], [F.col("pos")]).withColumn("healed", F.lit(True)))
    else:
        bars = bars.where("c IS NOT NULL AND NOT isnan(c)").withColumn("healed", F.lit(False))
    meta = told.select("sym", "since", "split", "last")
    new = S.keep_last(bars, ["sym", at], [F.col("pos")]).join(meta, "sym").where(F.col("split") | F.col("last").isNull() | (F.col(at).cast("date") >= F.col("last")))
    new.select("sym", at, *"ohlcv", "healed").write.parquet(f"{work}/new")
    new = spark.read.parquet(f"{work}/new")
    counts = new.groupBy("sym").agg(F.count("*").alias("bars"), F.count_if("healed").alias("healed"))
    report = meta.join(counts, "sym", "left").select("sym", "since", "split", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bars", "healed")))
    report.write.mode("overwrite").parquet(f"{store}_refreshed")
    writers.refresh_bars(spark, new.drop("healed").select("sym", at, *"ohlcv"), store, splits, at)
    writers.remove(spark, work)
    return spark.read.parquet(f"{store}_refreshed")


def missing_shorts(quarters: DataFrame, settlements: DataFrame, splits: DataFrame) -> DataFrame:
    """(sym, id, end_date, settled, qty, ratio, adjusted, status, implausible) of the quarters (readers.quarter_table) with an id and an end but no short interest.

    settlements has sym, day and qty, splits sym, effective and split. A quarter takes the settlement nearest to its end within SETTLED_WITHIN days,
    on today's split basis and in the file's unit; status tells why one has none. Symbols without any settlement are left out.
    """
    span = settlements.groupBy("sym").agg(F.max("day").alias("newest"), F.min("day").alias("oldest"))
    open_ = quarters.where("id IS NOT NULL AND end_date IS NOT NULL AND shares_short IS NULL").select("sym", "id", "end_date", "unit", "shares")
    near = S.nearest(open_, settlements, "sym", "end_date", "day", ["qty"], SETTLED_WITHIN).withColumnsRenamed({"near_day": "settled", "near_qty": "qty"}).join(span, "sym")
    own = Q.adjusted_short(Q.split_ratio(near, splits, "settled"))
    status = Q.short_status(F.col("end_date"), F.col("newest"), F.col("oldest"), F.col("settled"), F.lit(None))
    odd = Q.implausible_short(F.col("adjusted"), F.col("shares"), F.col("ratio"))
    return own.select("sym", "id", "end_date", "settled", "qty", "ratio", "adjusted", status.alias("status"), odd.alias("implausible"))


def refresh_shorts(spark: SparkSession, files: str, name: str, settlements: Callable[[Column], Column], charts: Callable[[Column, Column], Column], fetch: Fetch, pause: Pause = FILINGS_PAUSE, write: bool = True) -> DataFrame:
    """Add the short interest that quarter files (files/<symbol>/name) lack; returns missing_shorts.

    settlements gives the address of a symbol's settlements (CSV), charts that of its chart with its splits from a day on. Values that a file has
    are never overwritten, and all its other lines stay as they are; without write nothing is.
    """
    files = files.rstrip("/")
    work = f"{files}_refresh-{uuid.uuid4().hex}"
    quarters = readers.quarter_table(spark, f"{files}/*/{name}")
    symbols = quarters.select("sym").distinct()
    settled = _asked(symbols.withColumn("url", settlements(F.col("sym"))), f"{work}/settlements", fetch, pause)
    rows = remote.settlement_rows(settled)
    ranged = rows.groupBy("sym").agg(F.min("day").alias("since"))
    charted = _asked(ranged.withColumn("url", charts(F.col("sym"), F.col("since"))), f"{work}/charts", fetch, pause)
    splits = charted.select("sym", F.explode(remote.split_events(F.col("payload"))).alias("x")).select("sym", "x.*")
    missing_shorts(quarters, rows, splits).write.mode("overwrite").parquet(f"{files}_shorts")
    found = spark.read.parquet(f"{files}_shorts")
    if write:
        fresh = found.where("status = 'add'").groupBy("sym").agg(F.collect_list(F.struct("id", "adjusted", F.col("settled").cast("string").alias("settled"))).alias("x"))
        sym = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"([^/]+)/[^/]+$", 1)
        texts = spark.read.text(f"{files}/*/{name}", wholetext=True).select(sym.alias("sym"), F.col("value").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pages = []
                for text, updates in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    told = {u["id"]: (int(u["adjusted"]) if u["adjusted"].is_integer() else u["adjusted"], u["settled"]) for u in updates}
                    pages.append(writers.insert_short(text, told))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string())], ["name", "page"])

        named = texts.join(fresh, "sym").select(F.concat("sym", F.lit(f"/{name}")).alias("name"), "text", "x")
        named.mapInArrow(run, "name string, page string").write.parquet(f"{work}/texts")  # a task that is run again must not read what it has written
        writers.write_documents(spark.read.parquet(f"{work}/texts"), files)
    writers.remove(spark, work)
    return found


def posts_ledger(spark: SparkSession, store: str) -> DataFrame:
    """A ledger's posts, with the symbol that they were found for; no rows where there is none."""
    schema = f"sym string, {readers.LEDGER}"
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{store.rstrip('/')}/posts").where("tweet_id IS NOT NULL")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def refresh_posts(searches: DataFrame, store: str, fetch: Fetch, cooldown: float = 60, now: dt.datetime | None = None, pause: Pause = FILINGS_PAUSE) -> DataFrame:
    """Search for posts (searches has sym and url) and append those that a symbol's ledger lacks; returns them, newest first.

    A symbol whose ledger grew less than cooldown minutes ago isn't asked for; with zero minutes all are. now is a UTC time without zone.
    """
    spark = searches.sparkSession
    store = store.rstrip("/")
    work, stamp = f"{store}/refresh-{uuid.uuid4().hex}", now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    grown = spark.read.schema("sym string, grown timestamp_ntz").parquet(f"{store}/grown") if writers.age(spark, f"{store}/grown") is not None else None
    due = searches.select("sym", "url").where("sym IS NOT NULL AND url IS NOT NULL").distinct()
    if grown is not None and cooldown > 0:
        due = due.join(grown.where(F.col("grown") > F.lit(stamp - dt.timedelta(minutes=cooldown)).cast("timestamp_ntz")), "sym", "left_anti")
    due.write.parquet(f"{work}/due")
    pages = _asked(spark.read.parquet(f"{work}/due"), work, fetch, pause)
    found = pages.select("sym", F.posexplode(remote.posts(F.col("payload"))).alias("pos", "x")).select("sym", "pos", "x.*")
    new = I.unseen(found, posts_ledger(spark, store), ["sym", "tweet_id"], [-F.col("pos")]).drop("pos")
    fresh = f"{store}/newest"
    new.write.mode("overwrite").parquet(fresh)
    new = spark.read.schema(f"sym string, {readers.LEDGER}").parquet(fresh)
    new.write.mode("append").partitionBy("sym").json(f"{store}/posts")
    new.groupBy("sym").agg(F.lit(stamp).cast("timestamp_ntz").alias("grown")).write.mode("append").parquet(f"{store}/grown")
    writers.remove(spark, work)
    return new.orderBy("sym", F.desc("timestamp"), F.desc("tweet_id"))
