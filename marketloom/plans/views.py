"""Views that give the test tables the shape of bars, quarters, feeds and ledgers; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.plans.registry import ORACLE, QUERIES

WITH: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    WITH[name], NEEDS[name] = sql, list(needs)


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*_order(NEEDS[n]), n] if x not in out]
    return out


def query(name: str, sql: str | None, uses: str = ""):
    """Register a query; its SQL may use the views named in uses."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ctes = ", ".join(f"{n} AS ({WITH[n]})" for n in _order(uses.split()))
            ORACLE[name] = (f"WITH {ctes} " if ctes else "") + sql
        return f

    return add


view("fills", """SELECT n_nationkey, n_regionkey, CAST(l_shipdate AS DATE) AS d, l_quantity, l_extendedprice / l_quantity AS px,
 row(l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS k
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
view("bars", "SELECT n_regionkey AS sym, d, arg_min(px, k) AS o, max(px) AS h, min(px) AS l, arg_max(px, k) AS c, sum(l_quantity) AS v FROM fills GROUP BY 1, 2", ("fills",))
view("nbars", "SELECT n_nationkey AS sym, n_regionkey AS region, d, arg_min(px, k) AS o, max(px) AS h, min(px) AS l, arg_max(px, k) AS c, sum(l_quantity) AS v FROM fills GROUP BY 1, 2, 3", ("fills",))
view("hbars", "SELECT event_type AS sym, date_trunc('hour', ts) AS ts, arg_min(value, row(ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, row(ts, event_id)) AS c, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2")
view("numbered", "SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d) AS bar_no FROM nbars", ("nbars",))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.col("l_extendedprice") / F.col("l_quantity")
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.col("l_shipdate").cast("date").alias("d"), px.alias("px"), F.struct("l_orderkey", "l_linenumber", "l_partkey", px.alias("px")).alias("k"))
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))


OHLCV = [F.min_by, F.max, F.min, F.max_by, F.sum]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of a region."""
    return fills(spark, sf_dir).groupBy(F.col("n_regionkey").alias("sym"), "d").agg(F.min_by("px", "k").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", "k").alias("c"), F.sum("l_quantity").alias("v"))


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of a nation, with its region."""
    return fills(spark, sf_dir).groupBy(F.col("n_nationkey").alias("sym"), F.col("n_regionkey").alias("region"), "d").agg(F.min_by("px", "k").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", "k").alias("c"), F.sum("l_quantity").alias("v"))


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of an event type."""
    key = F.struct("ts", "event_id")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sym"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.min_by("value", key).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", key).alias("c"), F.count("*").cast("double").alias("v")).withColumnRenamed("hour", "ts")


# Fundamentals in whole cents, so that sums and quotients are exact on either engine.
view("allq", """SELECT c_nationkey AS sym, CAST(year(o_orderdate) AS INT) AS fy, CAST(quarter(o_orderdate) AS INT) AS qn, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS rev
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
view("quarters", """SELECT * FROM (SELECT sym, fy, qn, 'q' || qn || '-' || fy AS id, CAST(make_date(fy, qn * 3, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS end_date,
 CAST(make_date(fy, qn * 3, 1) + INTERVAL 1 MONTH + INTERVAL 40 DAY AS DATE) AS report_date, CASE WHEN (sym * 3 + fy + qn) % 13 <> 0 THEN CAST(rev AS DOUBLE) END AS revenue,
 CAST(sum(rev // 4) OVER w AS DOUBLE) AS ytd_ocf, CASE WHEN (sym + fy) % 6 <> 0 THEN CAST(sum(rev // 10) OVER w AS DOUBLE) END AS ytd_ppe,
 CASE WHEN (sym + qn) % 5 <> 0 THEN CAST(sum(rev // 50) OVER w AS DOUBLE) END AS ytd_software,
 CASE WHEN (sym + fy) % 7 <> 0 THEN CAST(sum(rev // 20) OVER w AS DOUBLE) END AS ytd_sbc,
 CAST(1000000 + sym * 1000 + qn AS DOUBLE) AS shares, CAST(rev // 3 AS DOUBLE) AS cash, CAST(20000 + sym * 10 + qn AS DOUBLE) AS shares_short,
 CASE WHEN (sym + qn) % 3 <> 0 THEN CAST(rev * 9 // 10 AS DOUBLE) END AS nq_low, CASE WHEN (sym + qn) % 3 = 1 THEN CAST(rev * 11 // 10 AS DOUBLE) END AS nq_high,
 CASE WHEN (sym + fy + qn) % 2 = 0 THEN CAST(rev * 4 AS DOUBLE) END AS fy_low, CASE WHEN (sym + fy + qn) % 2 = 0 THEN CAST(rev * 5 AS DOUBLE) END AS fy_high,
 CASE WHEN (sym + fy) % 2 = 1 THEN CAST(rev * 4 + qn AS DOUBLE) END AS est_low, CASE WHEN (sym + fy) % 2 = 1 THEN CAST(rev * 5 + qn AS DOUBLE) END AS est_high, CAST(rev // 7 AS DOUBLE) AS debt,
 CASE sym % 3 WHEN 0 THEN 'thousands' WHEN 1 THEN 'millions' ELSE 'units' END AS unit, CASE sym % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'CNY' WHEN 2 THEN 'rmb' WHEN 3 THEN 'XXX' ELSE 'USD' END AS currency
 FROM allq WINDOW w AS (PARTITION BY sym, fy ORDER BY qn)) WHERE (sym + fy + qn) % 11 <> 0""", ("allq",))
view("announce", "SELECT sym, fy, qn, CAST(end_date + INTERVAL 35 DAY AS DATE) AS day, CASE (sym + qn) % 3 WHEN 0 THEN 'after-close' WHEN 1 THEN 'pre-open' ELSE 'intraday' END AS session FROM quarters", ("quarters",))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter records of a nation, with gaps."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("qn"))
    own = orders.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    q = own.groupBy(F.col("c_nationkey").alias("sym"), "fy", "qn").agg(F.round(F.sum("o_totalprice") * 100).cast("long").alias("rev"))
    run = Window.partitionBy("sym", "fy").orderBy("qn").rowsBetween(Window.unboundedPreceding, 0)
    part = lambda n: F.sum(F.expr(f"rev div {n}")).over(run).cast("double")
    d = lambda e: F.expr(f"CAST({e} AS DOUBLE)")
    q = q.select("sym", "fy", "qn", F.concat(F.lit("q"), F.col("qn").cast("string"), F.lit("-"), F.col("fy").cast("string")).alias("id"), F.last_day(F.make_date("fy", F.col("qn") * 3, F.lit(1))).alias("end_date"),
        F.date_add(F.last_day(F.make_date("fy", F.col("qn") * 3, F.lit(1))), 41).alias("report_date"), F.when(F.expr("(sym * 3 + fy + qn) % 13 <> 0"), d("rev")).alias("revenue"),
        part(4).alias("ytd_ocf"), F.when(F.expr("(sym + fy) % 6 <> 0"), part(10)).alias("ytd_ppe"), F.when(F.expr("(sym + qn) % 5 <> 0"), part(50)).alias("ytd_software"), F.when(F.expr("(sym + fy) % 7 <> 0"), part(20)).alias("ytd_sbc"),
        d("1000000 + sym * 1000 + qn").alias("shares"), d("rev div 3").alias("cash"), d("20000 + sym * 10 + qn").alias("shares_short"),
        F.when(F.expr("(sym + qn) % 3 <> 0"), d("rev * 9 div 10")).alias("nq_low"), F.when(F.expr("(sym + qn) % 3 = 1"), d("rev * 11 div 10")).alias("nq_high"),
        F.when(F.expr("(sym + fy + qn) % 2 = 0"), d("rev * 4")).alias("fy_low"), F.when(F.expr("(sym + fy + qn) % 2 = 0"), d("rev * 5")).alias("fy_high"),
        F.when(F.expr("(sym + fy) % 2 = 1"), d("rev * 4 + qn")).alias("est_low"), F.when(F.expr("(sym + fy) % 2 = 1"), d("rev * 5 + qn")).alias("est_high"), d("rev div 7").alias("debt"),
        F.expr("CASE sym % 3 WHEN 0 THEN 'thousands' WHEN 1 THEN 'millions' ELSE 'units' END").alias("unit"), F.expr("CASE sym % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'CNY' WHEN 2 THEN 'rmb' WHEN 3 THEN 'XXX' ELSE 'USD' END").alias("currency"))
    return q.where("(sym + fy + qn) % 11 <> 0")


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.expr("CASE (sym + qn) % 3 WHEN 0 THEN 'after-close' WHEN 1 THEN 'pre-open' ELSE 'intraday' END")
    return quarters(spark, sf_dir).select("sym", "fy", "qn", F.date_add("end_date", 35).alias("day"), session.alias("session"))
