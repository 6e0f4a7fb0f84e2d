"""Queries over series of one symbol that many tasks share."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import long as L
from marketloom.operators import shape as H
from marketloom.plans.shapes import base
from marketloom.plans.views import query, read, view

view("trades", "SELECT 0 AS sym, CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, l_partkey, l_quantity AS c FROM lineitem")
PERIODS = [5, 20, 200]
TIES = ["l_orderkey", "l_linenumber", "l_partkey"]


def trades(spark, sf_dir):
    """All line items as one series, by day and key."""
    return read(spark, sf_dir, "lineitem").select(F.lit(0).alias("sym"), F.col("l_shipdate").cast("date").alias("d"), *TIES, F.col("l_quantity").alias("c"))


@query("long_sma", "SELECT l_orderkey, l_linenumber, l_partkey, n AS bar_no, " + ", ".join(f"CASE WHEN n >= 200 THEN m{p} END AS mean_{p}" for p in PERIODS) + " FROM (SELECT *, row_number() OVER w AS n, " + ", ".join(f"avg(c) OVER (ORDER BY d, l_orderkey, l_linenumber, l_partkey, c ROWS {p - 1} PRECEDING) AS m{p}" for p in PERIODS) + " FROM trades WINDOW w AS (ORDER BY d, l_orderkey, l_linenumber, l_partkey, c))", "trades")
def long_sma(spark, sf_dir):
    return L.sma_alignment(trades(spark, sf_dir), PERIODS, ties=[*TIES, "c"]).select(*TIES, "bar_no", *(f"mean_{p}" for p in PERIODS))


@query("long_asof", "SELECT o_orderkey, t.l_orderkey, t.l_linenumber, t.l_partkey, t.d AS day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) o ASOF LEFT JOIN (SELECT d, r.* FROM (SELECT d, max({'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey}) AS r FROM trades GROUP BY d)) t ON o.day >= t.d", "trades")
def long_asof(spark, sf_dir):
    """The last line item shipped up to each order's day."""
    targets = read(spark, sf_dir, "orders").select(F.lit(0).alias("sym"), "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    got = L.asof(targets, trades(spark, sf_dir), "sym", "day", "d", TIES, ties=TIES)
    return got.select("o_orderkey", *(F.col(f"bar_{c}").alias(c) for c in TIES), F.col("bar_d").alias("day"))


LONG = 100
PART = "PARTITION BY sym ORDER BY d"
view("q100", f"SELECT list(v ORDER BY d) AS q, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT * FROM nbars WHERE sym = (SELECT min(sym) FROM nbars) ORDER BY d DESC LIMIT {LONG})", ("nbars",))


@query("mass_volume_100", f"SELECT sym, d, CASE WHEN n >= {LONG} AND NOT std < 1e-10 THEN round(sqrt(list_sum(list_transform(range(1, {LONG + 1}), lambda i: ((q[i] - m) / s - (x[i] - mean) / std) ^ 2))), 5) END AS distance FROM (SELECT sym, d, row_number() OVER ({PART}) AS n, avg(v) OVER f AS mean, stddev_pop(v) OVER f AS std, list(v) OVER f AS x FROM nbars WINDOW f AS ({PART} ROWS {LONG - 1} PRECEDING)), q100", "nbars q100")
def mass_volume_100(spark, sf_dir):
    """The profile of a query of 100 bars, by transforms."""
    own, _ = base(spark, sf_dir, False)
    q = H.Query.last(own.join(own.agg(F.min("sym").alias("sym")), "sym"), LONG)
    return L.distances(own, q, {"v": "v"}).select("sym", "d", F.round("distance_v", 5).alias("distance"))


@query("mass_candle_fft", 'SELECT sym, d, round("do", 5) AS d_o, round(dh, 5) AS d_h, round(dl, 5) AS d_l, round(dc, 5) AS d_c, round(dv, 5) AS d_v FROM dists', "dists")
def mass_candle_fft(spark, sf_dir):
    """mass_candle_shared, with weights, by transforms."""
    own, q = base(spark, sf_dir)
    got = L.distances(own, q, {"o": "c", "h": "c", "l": "c", "c": "c", "v": "v"}, 0.0)
    return got.select("sym", "d", *(F.round(f"distance_{c}", 5).alias(f"d_{c}") for c in "ohlcv"))
