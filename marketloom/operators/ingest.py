"""Feeds and stores: upserts of bars, merges, ledgers, jobs, filings in columns of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_bars(old: DataFrame, new: DataFrame, splits: DataFrame | None = None, by: str = "sym", at: str = "d") -> DataFrame:
    """Stored bars before the first new day, then the new ones; a symbol split since its last stored day is taken from new only."""
    first = new.groupBy(by).agg(F.min(at).alias("__from"))
    if splits is not None:
        last = old.groupBy(by).agg(F.max(at).alias("__last"))
        hit = splits.join(last, by).where(F.col("effective") > F.col("__last")).select(by).distinct()
        old = old.join(hit.join(new.select(by).distinct(), by), by, "left_anti")
    kept = old.join(first, by, "left").where(F.col("__from").isNull() | (F.col(at) < F.col("__from"))).drop("__from")
    return kept.unionByName(new.select(*old.columns))


def tails_differ(old: DataFrame, new: DataFrame, values: list[str], by: str = "sym", at: str = "d") -> DataFrame:
    """By symbol: bars from the first new day on that only one side has, at six significant digits."""
    show = [F.format_string("%.5e", F.col(v).cast("double")).alias(v) for v in values]
    first = new.groupBy(by).agg(F.min(at).alias("__from"))
    tail = old.join(first, by).where(F.col(at) >= F.col("__from"))
    a, b = tail.select(by, at, *show), new.select(by, at, *show)
    odd = a.exceptAll(b).unionByName(b.exceptAll(a)).groupBy(by).agg(F.count("*").alias("differences"))
    return first.select(by).join(odd, by, "left").withColumn("differences", F.coalesce("differences", F.lit(0)))


def merge_existing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge in which stored values win."""
    fresh = new.select(*(F.col(k) for k in keys), *(F.col(c).alias(f"__{c}") for c in new.columns if c not in keys))
    both = old.join(fresh, keys, "full")
    rest = [c for c in old.columns if c not in keys]
    return both.select(*keys, *(F.coalesce(c, f"__{c}").alias(c) if f"__{c}" in both.columns else F.col(c) for c in rest))


def unseen(new: DataFrame, ledger: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """New records whose key (one column or several) is not in the ledger, the first by order of each key."""
    from marketloom.operators.series import keep_last

    keys = [key] if isinstance(key, str) else key
    return keep_last(new.join(ledger.select(*keys).distinct(), keys, "left_anti"), keys, order)


def rows_of_arrays(feed: DataFrame, arrays: list[str], keep: list[str]) -> DataFrame:
    """A feed whose columns are parallel arrays, as rows with their place."""
    return feed.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "x")).select(*keep, "pos", *(F.col(f"x.{a}").alias(a) for a in arrays))


#: Forms that report a period, in the order in which equally near ones are taken (fixed values).
FORM_PRIORITY = {"10-Q": 0, "10-K": 1, "20-F": 2, "6-K": 3}
#: Forms that a discovery lists (fixed values).
QUARTERLY_FORMS = ["10-Q", "10-K", "20-F"]


def wanted_filings(filings: DataFrame, forms: list[str], since: Column) -> DataFrame:
    return filings.where(F.col("form").isin(forms) & F.col("period").isNotNull() & (F.col("filed") >= since))


def nearest_filing(targets: DataFrame, filings: DataFrame, day: str, by: str = "sym", days: int = 30) -> DataFrame:
    """For each target the filing (filed, form, pos) closest to its day, within days; equally near ones by FORM_PRIORITY, then by place.

    filings has by, form, filed, block (0 the recent one, then the older) and pos, its place in the feed; an older block counts only
    where those before have none within days.
    """
    from marketloom.operators.series import nearest

    rank = F.create_map(*(F.lit(x) for pair in FORM_PRIORITY.items() for x in pair))[F.col("form")]
    own = filings.where(F.col("form").isin(*FORM_PRIORITY) & F.col("filed").isNotNull())
    got = nearest(targets, own, by, day, "filed", ["form", "pos"], days, [rank, F.col("pos")], [F.col("block")])
    return got.withColumnsRenamed({"near_filed": "filed", "near_form": "form", "near_pos": "pos"})


def filings_since(filings: DataFrame, since: Column, by: str = "sym") -> DataFrame:
    """Quarterly and annual filings of a period on or after a day, newest first; older blocks only where the recent one doesn't reach back beyond it."""
    reach = filings.where("block = 0").groupBy(by).agg(F.min("filed").alias("__oldest"))
    own = filings.join(reach, by, "left").where((F.col("block") == 0) | F.col("__oldest").isNull() | (F.col("__oldest") >= since)).drop("__oldest")
    return wanted_filings(own, QUARTERLY_FORMS, since).orderBy(F.desc("filed"), by, "pos")


def resolve_cik(tickers: DataFrame, listed: DataFrame) -> DataFrame:
    """cik with ten digits of each ticker, in either case; listed has ticker, cik_str and pos, and its first entry of a ticker counts."""
    first = listed.groupBy(F.upper("ticker").alias("__t")).agg(F.min_by("cik_str", "pos").alias("__c"))
    return tickers.withColumn("__t", F.upper("ticker")).join(first, "__t", "left").withColumn("cik", F.lpad(F.col("__c").cast("string"), 10, "0")).drop("__t", "__c")


def ordered_distinct(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Each value of by once, with its position in the order of its first row."""
    from pyspark.sql import Window

    first = rows.groupBy(*by, value).agg(F.min(order).alias("__first"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("__first", value))).drop("__first")


def open_tail(bars: DataFrame, by: str = "sym", at: str = "d") -> DataFrame:
    """(by, at): the days after a symbol's last bar with a close that came without one."""
    last = bars.where("c IS NOT NULL AND NOT isnan(c)").groupBy(by).agg(F.max(at).alias("__last"))
    return bars.where("c IS NULL OR isnan(c)").select(by, at).distinct().join(last, by).where(F.col(at) > F.col("__last")).select(by, at)


def heal_tail(bars: DataFrame, probes: DataFrame, by: str = "sym", at: str = "d") -> DataFrame:
    """Bars with a close, and for each day of open_tail the bar that a probe of that day alone gave."""
    kept = bars.where("c IS NOT NULL AND NOT isnan(c)")
    healed = probes.where("c IS NOT NULL AND NOT isnan(c)").join(open_tail(bars, by, at), [by, at], "left_semi").dropDuplicates([by, at])
    return kept.unionByName(healed.select(*bars.columns))


def vendor_row(vendor: DataFrame, key: str = "sym") -> DataFrame:
    """A vendor's aggregates (price, market_cap, revenue, free_cash_flow) as one wide row with multiples; price to flow needs a positive flow."""
    from marketloom.functions.columns import ratio

    pfcf = F.when(F.col("free_cash_flow") > 0, ratio(F.col("market_cap"), F.col("free_cash_flow")))
    return vendor.select(key, F.lit("vendor").alias("origin"), "price", F.col("market_cap").alias("cap"), F.col("revenue").alias("ttm_revenue"), F.col("free_cash_flow").alias("ttm_fcf"), ratio(F.col("market_cap"), F.col("revenue")).alias("ps"), pfcf.alias("pfcf"))


#: Kinds of documents that a manifest links to (fixed values).
SOURCE_KINDS = ["report", "letter", "transcript"]


def source_jobs(manifests: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(ticker, day, quarter, kind, url, path) of the links in manifests (ticker, day, links) whose entry has a quarter."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"links.{k}").alias("url")) for k in kinds or SOURCE_KINDS))
    own = manifests.where(F.coalesce(F.col("links.quarter"), F.lit("")) != "").select("ticker", "day", F.col("links.quarter").alias("quarter"), F.explode(pairs).alias("x"))
    path = F.concat("ticker", F.lit("/quarters/"), "day", F.lit("_"), "quarter", F.lit("-"), "kind", F.lit(".md"))
    return own.select("ticker", "day", "quarter", "x.*").where(F.coalesce("url", F.lit("")) != "").withColumn("path", path)


def jobs_missing(manifest: DataFrame, outputs: DataFrame, kinds: list[str]) -> DataFrame:
    """(ticker, day, kind, url) of links in the manifest whose output (path) doesn't exist."""
    links = manifest.unpivot(["ticker", "day"], kinds, "kind", "url").where("url IS NOT NULL")
    path = F.concat_ws("-", F.concat_ws("/", "ticker", F.col("day").cast("string")), "kind")
    return links.withColumn("path", path).join(outputs.select("path").distinct(), "path", "left_anti")


def with_fallback(tickers: DataFrame, official: DataFrame, vendor: DataFrame, price: DataFrame, key: str = "sym") -> DataFrame:
    """Official figures where there are some and a price, nothing where only the price is missing, else the vendor's."""
    o = official.select(key, F.col("value").alias("__o"))
    v = vendor.select(key, F.col("value").alias("__v"))
    got = tickers.join(o, key, "left").join(v, key, "left").join(price, key, "left")
    source = F.when(F.col("__o").isNotNull() & F.col("price").isNotNull(), "official").when(F.col("__o").isNotNull(), "skipped").when(F.col("__v").isNotNull(), "vendor").otherwise("none")
    return got.select(key, source.alias("origin"), F.when(source == "official", F.col("__o")).when(source == "vendor", F.col("__v")).alias("value"))


def united_valuations(tickers: DataFrame, official: DataFrame, vendor: DataFrame, prices: DataFrame, key: str = "sym") -> DataFrame:
    """One wide table of all tickers: official rows where there are figures and a price, else the vendor's; columns that a side lacks are null.

    official is fundamentals.priced_today at these prices, vendor is vendor_row. A ticker with figures and no price (null or zero) is skipped, whatever the
    vendor has: it has a row of origin skipped and nothing else; one that neither side has is of origin none.
    """
    live = prices.select(key, F.nullif(F.col("price"), F.lit(0.0)).alias("__live")).where("__live IS NOT NULL")
    asked = tickers.select(key).distinct()
    known = asked.join(official.select(key).distinct(), key, "left_semi")
    priced = official.join(asked, key, "left_semi").join(live.select(key), key, "left_semi").withColumn("origin", F.lit("official"))
    skipped = known.join(live, key, "left_anti").withColumn("origin", F.lit("skipped"))
    rest = asked.join(known, key, "left_anti")
    other = vendor.join(rest, key, "left_semi")
    none = rest.join(vendor.select(key), key, "left_anti").withColumn("origin", F.lit("none"))
    return priced.unionByName(other, allowMissingColumns=True).unionByName(skipped, allowMissingColumns=True).unionByName(none, allowMissingColumns=True)
