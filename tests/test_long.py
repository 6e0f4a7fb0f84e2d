"""Long series: two-level windows and transforms against the one-level operators; the index of windows against the full scan."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import long as L
from marketloom.operators import series as S
from marketloom.operators import shape as H

D = dt.date


@pytest.fixture(scope="module")
def one_symbol(spark):
    """A single series with gaps of weeks and of years, and a few others."""
    r = random.Random(2)
    rows, day, price = [], D(2000, 1, 1), 100.0
    for i in range(1500):
        day += dt.timedelta(days=r.choice([1, 1, 1, 2, 9]) + (800 if i == 700 else 0))
        price *= 1 + r.gauss(0, 0.02)
        rows.append(("a", day, price, price * 1.01, price * 0.98, price * (1 + r.gauss(0, 0.005)), float(r.randrange(1, 50))))
    rows += [(None, D(2000, 1, 1) + dt.timedelta(days=i * 40), 1.0, 1.0, 1.0, float(i), 1.0) for i in range(30)] + [("b", D(2001, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "sym string, d date, o double, h double, l double, c double, v double").repartition(4)


@pytest.fixture
def tasks(spark):
    """Sixteen shuffle partitions that stay sixteen."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_averages_over_many_tasks(one_symbol, tasks):
    got = L.sma_alignment(one_symbol, [5, 20, 200], days=30, rows=64)
    want = S.sma_alignment(one_symbol, [5, 20, 200])
    columns = ["sym", "d", "mean_5", "mean_20", "mean_200", "trend"]
    assert rows_of(got, *columns) == rows_of(want, *columns)
    of_a = got.where("sym = 'a'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(of_a) >= 10  # one symbol over many tasks
    assert rows_of(L.numbered(one_symbol, days=30), "sym", "d", "bar_no") == rows_of(S.number_bars(one_symbol), "sym", "d", "bar_no")


@pytest.mark.parametrize("forward", [False, True])
def test_asof_over_many_tasks(spark, one_symbol, tasks, forward):
    days = [D(1999, 1, 1) + dt.timedelta(days=37 * i) for i in range(250)]
    targets = spark.createDataFrame([(s, d, i) for s in ("a", "b", "none") for i, d in enumerate(days)] + [("a", None, 999)], "sym string, day date, n int")
    got = L.asof(targets, one_symbol, "sym", "day", "d", ["c", "v"], forward, days=30)
    want = S.asof(targets, one_symbol, "sym", "day", "d", ["c", "v"], forward)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_asof_takes_the_last_of_a_time(spark):
    bars = spark.createDataFrame([("a", D(2024, 1, 1), i, float(i)) for i in (3, 1, 2)], "sym string, d date, i int, c double")
    targets = spark.createDataFrame([("a", D(2024, 1, 1)), ("a", D(2024, 9, 1)), ("a", D(2023, 1, 1))], "sym string, day date")
    got = {r.day: r.bar_i for r in L.asof(targets, bars, "sym", "day", "d", ["i"], ties=["i"]).collect()}
    assert got == {D(2024, 1, 1): 3, D(2024, 9, 1): 3, D(2023, 1, 1): None}


@pytest.mark.parametrize("m", [20, 100, 250])
def test_transforms_equal_sums(spark, one_symbol, m):
    query = H.Query.last(one_symbol.where("sym = 'a'"), m, weights=H.recency_weights(m) if m != 100 else None)
    got = L.distances(one_symbol, query, {"c": "c", "o": "c", "v": "v"}, 0.005, rows=300)
    own = H.with_stats(H.with_stats(one_symbol, "c", m, held="ocv"), "v", m)
    want = own.select("sym", "d", H.distance("c", "c", query, 0.005).alias("x"), H.distance("o", "c", query).alias("y"), H.distance("v", "v", query).alias("z"))
    a = {(r.sym, r.d): (r.distance_c, r.distance_o, r.distance_v) for r in got.collect()}
    b = {(r.sym, r.d): (r.x, r.y, r.z) for r in want.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-8), (k, x, y)
    assert sum(x[0] is not None for x in a.values()) > 1000


def test_transforms_at_holes_and_flat_parts():
    x = np.concatenate([np.full(30, 5.0), np.arange(30.0), [np.nan], np.full(30, 1e9), 1e9 + np.arange(30.0)])
    q = [1.0, 3.0, 2.0, 5.0]
    got = L.window_distances(x, x, q, q, None, 0.0)
    z = (np.array(q) - np.mean(q)) / np.std(q)
    for i, d in enumerate(got):
        w = x[i : i + 4]
        if not np.isfinite(w).all() or w.std() ** 2 < (1e-5 * abs(w.mean())) ** 2:
            assert np.isnan(d)
        else:
            assert abs(d - np.sqrt(((z - (w - w.mean()) / w.std()) ** 2).sum())) < 1e-6
    assert np.nanmax(L.window_distances(x, x, [2.0] * 4, [2.0] * 4, None, 0.0)) == 0.0


def test_time_does_not_grow_with_the_query():
    x = np.cumsum(np.random.default_rng(1).normal(size=200_000)) + 500

    def seconds(m):
        best = 9e9
        for _ in range(3):
            began = time.perf_counter()
            L.window_distances(x, x, list(x[:m] + np.arange(m)), list(x[:m]), None, 0.0)
            best = min(best, time.perf_counter() - began)
        return best

    seconds(20)
    assert seconds(2000) < 3 * seconds(20)


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(7)
    rows = []
    for s in range(40):
        price = 50.0 + s
        for i in range(300):
            price *= 1 + r.gauss(0, 0.03)
            rows.append((s, D(2020, 1, 1) + dt.timedelta(days=i), price, price * 1.02, price * 0.97, price * (1 + r.gauss(0, 0.01)), float(r.randrange(100, 900))))
    rows += [(99, D(2020, 1, 1) + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 10.0) for i in range(100)]
    return spark.createDataFrame(rows, "sym int, d date, o double, h double, l double, c double, v double")


@pytest.mark.parametrize("weekday, weighted, k", [(False, True, 5), (True, False, 10), (True, True, 60)])
def test_index_equals_full_scan(many, tmp_path, weekday, weighted, k):
    m = 20
    query = H.Query.last(many.where("sym = 0"), m, weights=H.recency_weights(m) if weighted else None)
    H.window_index(many, m).write.parquet(str(tmp_path / "index"))
    found, share = H.search_indexed(many, many.sparkSession.read.parquet(str(tmp_path / "index")), query, k, any_weekday=weekday)
    want = [(r.sym, r.d, r.bar_no, round(r.score, 9)) for r in H.search(many, query, k, any_weekday=weekday).collect()]
    assert [(r.sym, r.d, r.bar_no, round(r.score, 9)) for r in found.collect()] == want and want
    told = share.first()
    assert told.expanded <= told.windows
    if k == 5:
        assert told.expanded < 0.25 * told.windows


def test_bounds_never_exceed_distances(many):
    m = 20
    query = H.Query.last(many.where("sym = 3"), m, weights=H.recency_weights(m))
    index = H.window_index(many, m).select("sym", "d", *(H.least_distance(c, "v" if c == "v" else "c", query).alias(f"b_{c}") for c in H.CHANNELS))
    own = H.with_stats(H.with_stats(many, "c", m), "v", m)
    exact = own.select("sym", "d", *(H.distance(c, "v" if c == "v" else "c", query).alias(f"x_{c}") for c in H.CHANNELS))
    assert index.join(exact, ["sym", "d"]).where(" OR ".join(f"b_{c} > x_{c} + 1e-9" for c in H.CHANNELS)).count() == 0


def test_scan_is_observed_in_one_job(spark, many):
    query = H.Query.last(many.where("sym = 0"), 20)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found, scan = H.search_observed(many, query, k=7)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before  # nothing has run yet
    assert len(found.collect()) == 7
    told = scan.told
    assert (told["series"], told["scanned"], told["matched"]) == (41, 41, 7) and told["elapsed"] > 0
