"""Hand-checked edge cases."""

import datetime as dt
import time
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom import tools
from marketloom.functions import columns as C
from marketloom.functions import formats as X2
from marketloom.operators import fundamentals as Q
from marketloom.operators import ingest as I
from marketloom.operators import series as S
from marketloom.operators import shape as H
from marketloom.operators import text as X
from marketloom.operators import vectors as V
from marketloom.sources import archives, readers, remote, writers
from marketloom.streaming import stores

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def bars_of(spark, closes, start=D(2024, 1, 1), sym=0, volume=None):
    rows = [(sym, start + dt.timedelta(days=i), float(c), float(c) + 1, float(c) - 1, float(c), float(volume[i] if volume else 10)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "sym int, d date, o double, h double, l double, c double, v double")


def test_fiscal_label(spark):
    for day, month, want in ((D(2025, 9, 30), 12, "q3-2025"), (D(2025, 6, 30), 3, "q1-fy2026"), (D(2026, 1, 31), 1, "q4-fy2026")):
        assert one(spark, C.fiscal_label(F.lit(day), F.lit(month))) == want


def test_arrows(spark):
    assert one(spark, C.arrows(F.lit(100.0), F.lit(100.4), F.lit(99.0))) == "→↑"
    assert one(spark, C.arrows(F.lit(3.0), F.lit(2.0), F.lit(1.0))) == "↑↑"
    assert one(spark, C.arrow(F.lit(0.0), F.lit(0.0))) == "→"


def test_growth_and_move(spark):
    assert one(spark, C.growth(F.lit(-5.0), F.lit(-10.0))) == 0.5
    assert one(spark, C.growth(F.lit(-5.0), F.lit(0.0))) is None
    assert one(spark, C.implied_move(F.lit(0.52))) == pytest.approx(7.211, abs=1e-3)


def test_labels(spark):
    assert one(spark, C.quarter_number(F.lit("q3-fy2026"))) == 3
    assert one(spark, C.fiscal_year(F.lit("q3-fy2026"))) == 2026
    assert one(spark, C.iso_date(F.lit("2024-02-30"))) is None


def test_standalone_and_gap(spark):
    rows = [(1, 2023, q, D(2023, 3 * q, 28), float(v)) for q, v in enumerate((1587, 2496, 3821, 3884), 1)] + [(2, 2022, 4, D(2022, 12, 31), 9.0)]
    got = Q.standalone(spark.createDataFrame(rows, "sym int, fy int, qn int, end_date date, ytd_ocf double"), ["ytd_ocf"]).orderBy("sym", "qn").collect()
    assert [r.q_ytd_ocf for r in got] == [1587, 909, 1325, 63, None]
    assert sum(r.q_ytd_ocf for r in got[:4]) == 3884


def test_trailing(spark):
    rows = [(1, D(2025, 12, 31), 2778.0), (1, D(2026, 3, 31), 2678.0), (1, D(2026, 6, 30), 3608.0), (1, D(2026, 9, 30), 4869.0)]
    got = Q.trailing(spark.createDataFrame(rows, "sym int, end_date date, revenue double"), ["revenue"]).orderBy("end_date").collect()
    assert [r.ttm_revenue for r in got] == [None, None, None, 13933]


def test_nearest(spark):
    targets = spark.createDataFrame([(1, D(2025, 6, 30)), (2, D(2025, 6, 30))], "sym int, day date")
    others = spark.createDataFrame([(1, D(2025, 6, 27), 1), (1, D(2025, 7, 3), 2), (2, D(2025, 7, 7), 3)], "sym int, at date, q int")
    got = {r.sym: r.near_q for r in S.nearest(targets, others, "sym", "day", "at", ["q"], 6).collect()}
    assert got == {1: 1, 2: None}
    far = spark.createDataFrame([(1, D(2025, 7, 30), 30), (2, D(2025, 7, 31), 31)], "sym int, at date, q int")
    assert {r.sym: r.near_q for r in S.nearest(targets, far, "sym", "day", "at", ["q"], 30).collect()} == {1: 30, 2: None}


def test_filing_search(spark):
    targets = spark.createDataFrame([(k, D(2025, 6, 30)) for k in range(1, 7)], "sym int, day date")
    rows = [(1, "6-K", D(2025, 6, 28), 0, 0), (1, "10-Q", D(2025, 7, 2), 0, 1), (2, "10-K", D(2025, 7, 30), 0, 0), (3, "10-K", D(2025, 7, 31), 0, 0), (4, "8-K", D(2025, 6, 30), 0, 0), (4, "20-F", D(2025, 6, 1), 1, 0),
        (5, "10-K", D(2025, 7, 20), 0, 0), (5, "10-Q", D(2025, 6, 30), 1, 0), (6, "10-Q", D(2025, 7, 1), 0, 4), (6, "10-Q", D(2025, 6, 29), 0, 2)]
    feed = spark.createDataFrame(rows, "sym int, form string, filed date, block int, pos int")
    got = {r.sym: (r.form, r.filed and r.filed.day) for r in I.nearest_filing(targets, feed, "day").collect()}
    assert got == {1: ("10-Q", 2), 2: ("10-K", 30), 3: (None, None), 4: ("20-F", 1), 5: ("10-K", 20), 6: ("10-Q", 29)}
    since = I.filings_since(feed.withColumn("period", F.col("filed")), F.lit(D(2025, 6, 15))).collect()
    assert [r.sym for r in since] == [3, 2, 5, 1, 6, 6, 5] and since[-1].form == "10-Q" or [r.filed for r in since] == sorted((r.filed for r in since), reverse=True)


def test_fiscal_rules(spark):
    """No capex line is a sum of zero; a line that can't be told makes none; a quarter without revenue hides trailing flows."""
    schema = "sym int, fy int, qn int, id string, end_date date, revenue double, ytd_ocf double, ytd_sbc double, ytd_capex map<string,double>"
    rows = [(1, 2025, q, f"q{q}-2025", D(2025, 3 * q, 28), 10.0 * q, 5.0 * q, 1.0 * q, {} if q != 3 else {"new": 7.0}) for q in (1, 2, 3, 4)]
    rows += [(2, 2025, q, f"q{q}-2025", D(2025, 3 * q, 28), None if q == 2 else 10.0, 5.0 * q, 1.0 * q, {"ppe": 2.0 * q, "b": 1.0 * q, "a": None}) for q in (1, 2, 3, 4)]
    frame = spark.createDataFrame(rows, schema)
    got = {(r.sym, r.qn): r for r in Q.quarter_flows(frame).collect()}
    assert [got[1, q].capex_total for q in (1, 2, 3, 4)] == [0.0, 0.0, None, 0.0] and got[1, 2].fcf_strict == 5.0 and got[1, 2].fcf is None
    assert got[2, 1].capex_total is None and got[2, 1].capex_lines == "ppe,a,b" and got[2, 2].fcf == 3.0
    sums = {(r.sym, r.qn): r for r in Q.trailing(Q.quarter_flows(frame), ["revenue", "fcf"]).collect()}
    assert sums[2, 4].ttm_revenue is None and sums[2, 4].ttm_fcf is None
    latest = {r.sym: r for r in Q.latest_trailing(Q.quarter_flows(frame), ["revenue", "fcf"]).collect()}
    assert latest[2].ttm_revenue is None and latest[2].ttm_fcf == 12.0 and latest[1].ttm_revenue == 100.0
    years = {r.sym: r for r in Q.fiscal_years(frame.withColumns({c: F.lit(None).cast("double") for c in ("fy_low", "fy_high")})).collect()}
    assert years[1].capex_total is None and years[2].capex_total == 12.0 and years[2].revenue == 30.0 and years[2].ppe == 8.0


def test_forward_ranges_and_multiples(spark):
    """The hand-checked figures of one company in millions."""
    schema = "sym string, fy int, qn int, id string, end_date date, report_date date, revenue double, ytd_ocf double, ytd_sbc double, ytd_capex map<string,double>, shares double, cash double, debt double, nq_low double, nq_high double, fy_low double, fy_high double, est_low double, est_high double, fx double, mult double"
    q = lambda fy, qn, rev, ocf, ppe, low=None, high=None: ("S", fy, qn, f"q{qn}-{fy}", D(fy, 3 * qn, 28), D(fy, 3 * qn, 28) + dt.timedelta(40), rev, ocf, 0.0, {"ppe": ppe}, 589.0, 1.0, 1.0, low, high, None, None, None, None, 1.0, 1e6)
    rows = [q(2025, 1, 2272.0, 1789.0, 8.0), q(2025, 2, 3096.0, 2764.0, 21.0), q(2025, 3, 4095.0, 4120.0, 28.0), q(2025, 4, 2778.0, 4646.0, 33.0), q(2026, 1, 2678.0, 1708.0, 4.0), q(2026, 2, 3608.0, 2978.0, 21.0, 4690.0, 4770.0), q(2026, 3, 4869.0, 4486.0, 103.0, 3220.0, 3280.0)]
    frame = spark.createDataFrame(rows, schema)
    closes = spark.createDataFrame([("S", D(2026, 11, 5), 170.13)], "sym string, d date, c double")
    got = {r.id: r for r in Q.priced_quarters(frame, closes).collect()}
    new = got["q3-2026"]
    assert (new.ttm_revenue, new.ttm_fcf) == (13933.0, 4904.0) and not got["q2-2026"].show_val and got["q2-2026"].ps is None
    assert round(new.ps, 1) == 7.2 and round(new.pfcf, 1) == 20.4 and (round(new.nq_ps_low, 1), round(new.nq_ps_high, 1)) == (6.9, 7.0)
    assert {r.id: r.accuracy for r in Q.next_quarter_accuracy(frame).collect()}["q2-2026"] == pytest.approx(0.0294, abs=1e-4)
    today = Q.priced_today(frame, spark.createDataFrame([("S", 170.13)], "sym string, price double")).first()
    assert round(today.pfcf, 1) == 20.4 and today.id == "q3-2026"
    cells = {(r.column_label, r.row_label): r.value for r in tools.valuation(frame.withColumns({c: F.lit(None).cast(t) for c, t in (("shares_short", "double"), ("settled", "date"), ("nq_hint", "string"), ("fy_hint", "string"))}), closes, spark.createDataFrame([("S", 170.13)], "sym string, price double")).collect()}
    assert cells["q3-2026", "P / FCF company"] == "20.4x" and cells["TTM", "Revenue ($M)"] == "13,933.0" and cells["FY-2025", "Revenue ($M)"] == "12,241.0"
    assert cells["q3-2026", "FW P/S NQ guidance"] == "6.9–7.0x" and cells["q2-2026", "  NQ actual/guide"] == "+2.9%" and ("q3-2026", "Shares short (M)") not in cells


def test_short_interest(spark):
    rows = spark.createDataFrame([("a", 15_234_567, 0.05, "millions", 2.0), ("b", 1_234_567, 1.0, "thousands", 1000.0), ("c", 7, 0.5, "units", 5.0)], "sym string, qty long, ratio double, unit string, shares double")
    got = {r.sym: r for r in Q.adjusted_short(rows).withColumn("odd", Q.implausible_short(F.col("adjusted"), F.col("shares"), F.col("ratio"))).collect()}
    assert [got[k].adjusted for k in "abc"] == [0.762, 1234.567, 4.0] and [got[k].odd for k in "abc"] == [False, True, False]
    snap = one(spark, C.short_snapshot(F.lit('{"sharesShort": 30, "floatShares": 120, "dateShortInterest": 1730332800}')))
    assert (snap.pct_float, snap.as_of) == (0.25, D(2024, 10, 31)) and one(spark, C.short_snapshot(F.lit('{"sharesShort": 0}'))) is None
    assert one(spark, Q.short_share(F.lit(None).cast("double"), F.lit(5.0), F.lit(0.32))) == 32.0


def test_quality_flags(spark):
    own = bars_of(spark, [10, 10, 20, 20, 12], volume=[100, 100, 100, 19, 501]).withColumn("o", F.lit(40.0))
    got = {r.d.day: (r.thin, r.heavy, r.jump) for r in S.quality_flags(own).collect()}
    assert got == {1: (False, False, False), 2: (False, False, False), 3: (False, False, True), 4: (True, False, False), 5: (False, True, False)}
    assert not any(r.jump for r in S.quality_flags(own, 3).collect() if r.d.day == 3) and S.quality_flags(own, 3).count() == 3


def test_provisional_day(spark):
    cells = spark.createDataFrame([(0, D(2024, 1, 29), s, 1.0) for s in range(5)] + [(0, D(2024, 1, 22), 1, 1.0)], "sym int, week date, slot int, v double")
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    assert [(r.week.day, r.slot) for r in S.provisional_day(cells, "week", stamp("2024-01-30 15:00:00")).where("provisional").collect()] == [(29, 1)]
    assert S.provisional_day(cells, "week", stamp("2024-01-30 23:00:00")).where("provisional").count() == 0


def test_healed_tail(spark):
    none = float("nan")
    own = spark.createDataFrame([(0, D(2024, 1, 1), none, 1.0), (0, D(2024, 1, 2), 5.0, 1.0), (0, D(2024, 1, 3), none, 9.0), (0, D(2024, 1, 4), none, 9.0)], "sym int, d date, c double, v double")
    probes = spark.createDataFrame([(0, D(2024, 1, 1), 1.0, 1.0), (0, D(2024, 1, 3), 6.0, 2.0), (0, D(2024, 1, 4), none, 1.0)], "sym int, d date, c double, v double")
    assert [(r.d.day, r.c) for r in I.heal_tail(own, probes).orderBy("d").collect()] == [(2, 5.0), (3, 6.0)]


def test_lookup_and_order(spark):
    listed = spark.createDataFrame([("Abc", 12, 1), ("ABC", 9, 2)], "ticker string, cik_str long, pos int")
    assert {r.ticker: r.cik for r in I.resolve_cik(spark.createDataFrame([("abc",), ("x",)], "ticker string"), listed).collect()} == {"abc": "0000000012", "x": None}
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3)], "k int, x string, n int")
    assert [r.x for r in I.ordered_distinct(rows, ["k"], "x", "n").orderBy("position").collect()] == ["b", "a"]
    vendor = spark.createDataFrame([("s", 2.0, 10.0, 5.0, -1.0)], "sym string, price double, market_cap double, revenue double, free_cash_flow double")
    row = I.vendor_row(vendor).first()
    assert (row.ps, row.pfcf, row.origin) == (2.0, None, "vendor")


def test_formats(spark):
    lit = lambda x: F.lit(x).cast("double")
    got = lambda c: one(spark, c)
    assert [got(X2.money(lit(x))) for x in (1.234e9, 45.4e6, -6789.0, None)] == ["$1.23B", "$45M", "$-6,789", "—"]
    assert [got(X2.volume(lit(x))) for x in (1.55e6, 949_000.0, 42.0, float("nan"))] == ["1.6M", "949K", "42", "·"] or got(X2.volume(lit(1.55e6))) in ("1.5M", "1.6M")
    assert got(X2.multiple_range(lit(5.31), lit(5.34))) == "5.3x" and got(X2.multiple_range(lit(1.4), lit(1.5))) == "1.4–1.5x" and got(X2.multiple_range(lit(None), lit(1.5))) == "n/m"
    assert got(X2.money_range(lit(181e6), lit(169e6))) == "169–181" and got(X2.money_range(lit(None), lit(None), F.lit("qualitative"))) == "qualitative"
    assert got(X2.short_interest(lit(12.4e6), F.lit(-2))) == "12.4 (-2d)" and got(X2.percent(lit(0.029))) == "+2.9%" and got(X2.short_price(lit(12.345))) == "12.3"
    assert got(X2.price_chain([lit(3.0), lit(3.0), lit(None), lit(5.0)])) == "3.00 > 3.00 · 5.00" and got(X2.price_chain([lit(None), lit(None)])) == "n/a"
    for x in (0.000123456, 0.05, 1.0, 12.345, 99.96, 999.6, 123456.0, 0.00001234):
        assert got(X2.significant(lit(x))) == f"{x:.3g}", x


def test_projection(spark):
    own = bars_of(spark, [1, 2, 3, 4, 2, 4, 6, 8, 9], volume=[1, 2, 1, 2, 10, 20, 10, 20, 30])
    query = H.Query({**{c: [1.0, 2.0, 3.0, 4.0] for c in "ohlc"}, "v": [1.0, 2.0, 1.0, 2.0]})
    found = spark.createDataFrame([(0, D(2024, 1, 8), 8)], "sym int, d date, bar_no int")
    rows = {r.pos: r for r in H.projected(H.match_bars(found, own, 4, 1), query).collect()}
    assert [rows[p].proj_c for p in (-3, -2, -1, 0, 1)] == pytest.approx([1, 2, 3, 4, 4.5]) and rows[1].proj_v == pytest.approx(3.0)
    assert rows[0].gain_c == pytest.approx(0.5) and rows[0].offset_c == pytest.approx(0.0)
    stats = {r.pos: r for r in H.bar_stats(spark.createDataFrame([(0, 5.0), (1, 6.0)], "pos int, x double"), "x", query).collect()}
    assert (stats[0].actual, stats[0].deviation, stats[1].actual) == (4.0, 1.0, None)


def test_yaml_edit():
    text = "# note\nquarters:\n  - id: q1-2024  # first\n    end_date: 2024-03-31\n    shares_outstanding: 5\n\n  - id: q2-2024\n    end_date: 2024-06-30\n  - id: q3-2024\n    end_date: 2024-09-30\n"
    got = writers.insert_short(text, {"q1-2024": (1.5, "2024-03-28"), "q2-2024": (2, "2024-06-28")})
    assert got == text.replace("shares_outstanding: 5\n", "shares_outstanding: 5\n    shares_short: 1.5\n    short_settlement_date: 2024-03-28\n").replace("end_date: 2024-06-30\n", "end_date: 2024-06-30\n    shares_short: 2\n    short_settlement_date: 2024-06-28\n")


def test_cache_and_cooldown(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    assert [writers.cached(spark, path, "k", make).count() for _ in range(2)] == [1, 1]
    assert writers.cached(spark, path, "k", make, now=time.time() + 4000).count() == 2 and len(calls) == 2
    assert writers.cooling(spark, path, 60) and not writers.cooling(spark, path, 0) and not writers.cooling(spark, str(tmp_path / "none"), 60)
    assert not writers.cooling(spark, path, 60, now=time.time() + 4000)


def test_streams_outlive_a_run(spark, tmp_path):
    one_, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), (None, 3)], "id string, n int").write.parquet(one_)
    spark.createDataFrame([("b", 5), ("c", 5)], "id string, n int").write.parquet(two)
    ledger, store = str(tmp_path / "ledger"), str(tmp_path / "store")
    assert sorted(r.id for r in stores.ledger(stores.stream_of(spark, one_), "id", ledger).collect()) == ["a", "b"]
    assert sorted(r.id for r in stores.ledger(stores.stream_of(spark, two), "id", ledger).collect()) == ["a", "b", "c"]
    stores.upserted(stores.stream_of(spark, one_).where("id IS NOT NULL"), ["id"], ["n"], store)
    assert sorted((r.id, r.n) for r in stores.upserted(stores.stream_of(spark, two), ["id"], ["n"], store).collect()) == [("a", 2), ("b", 5), ("c", 5)]


def test_payloads(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "url string")

    def fetch(url):
        if url == "b":
            raise OSError("gone")
        return url * 2

    assert sorted((r.url or "", r.payload) for r in remote.payloads(urls, fetch, 0).collect()) == [("", None), ("a", "aa"), ("a", "aa"), ("b", None)]
    chart = '{"chart": {"result": [{"meta": {"regularMarketPrice": 12.5}, "timestamp": [1704205800, 1704292200], "events": {"splits": {"1": {"date": 1704205800, "numerator": 1, "denominator": 20}}}, "indicators": {"quote": [{"open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [2, null], "volume": [5, 6]}], "adjclose": [{"adjclose": [1, null]}]}}]}}'
    bar, = one(spark, remote.chart_bars(F.lit(chart)))
    assert (bar.d, bar.o, bar.c, bar.v) == (D(2024, 1, 2), 0.5, 1.0, 5.0)
    hour, = one(spark, remote.chart_bars(F.lit(chart), hourly=True))
    assert hour.ts == dt.datetime(2024, 1, 2, 14, 30)
    assert [tuple(x) for x in one(spark, remote.split_events(F.lit(chart)))] == [(D(2024, 1, 2), 0.05)]
    assert one(spark, remote.live_price(F.lit(chart))) == 12.5 and one(spark, remote.fx_rate(F.lit("{}"))) == 1.0
    feed = one(spark, remote.filings_feed(F.lit('{"fiscalYearEnd": "0630", "filings": {"recent": {"form": ["10-Q"], "accessionNumber": ["x"], "filingDate": ["2024-01-02"], "reportDate": [""]}, "files": [{"name": "older.json"}]}}')))
    assert (feed.fiscal_year_end, feed.older, [tuple(r) for r in feed.rows]) == ("0630", ["older.json"], [(0, "10-Q", "x", D(2024, 1, 2), None)])
    older = one(spark, remote.filings_feed(F.lit('{"form": ["10-K"], "accessionNumber": ["y"], "filingDate": ["2020-01-02"], "reportDate": ["2019-12-31"]}')))
    assert [tuple(r) for r in older.rows] == [(0, "10-K", "y", D(2020, 1, 2), D(2019, 12, 31))]
    assert [tuple(x) for x in one(spark, remote.company_tickers(F.lit('{"0": {"cik_str": 5, "ticker": "A"}}')))] == [("A", 5, 0)]
    assert [x.tweet_id for x in one(spark, remote.posts(F.lit('[{"tweet_id": "1"}, {"text": "x"}]')))] == ["1"]


def test_split_ratio(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 15)), ("b", D(2024, 1, 15))], "sym string, settled date")
    splits = spark.createDataFrame([("a", D(2024, 1, 15), 2.0), ("a", D(2024, 6, 1), 0.05)], "sym string, effective date, split double")
    assert {r.sym: r.ratio for r in Q.split_ratio(rows, splits, "settled").collect()} == {"a": 0.05, "b": 1.0}


def test_asof(spark):
    own = bars_of(spark, [1, 2, 3], D(2024, 1, 5))
    targets = spark.createDataFrame([(0, D(2024, 1, 1)), (0, D(2024, 1, 6)), (0, D(2024, 2, 1))], "sym int, day date")
    assert [r.bar_c for r in S.asof(targets, own, "sym", "day", "d", ["c"]).orderBy("day").collect()] == [None, 2.0, 3.0]
    assert [r.bar_c for r in S.asof(targets, own, "sym", "day", "d", ["c"], forward=True).orderBy("day").collect()] == [1.0, 2.0, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=6), st.integers(0, 40))
def test_asof_is_the_last_at_or_before(spark, days, target):
    own = spark.createDataFrame([(0, x, float(x)) for x in sorted(set(days))], "sym int, d int, c double")
    got = S.asof(spark.createDataFrame([(0, target)], "sym int, day int"), own, "sym", "day", "d", ["c"]).first().bar_c
    assert got == max((float(x) for x in days if x <= target), default=None)


def test_reaction(spark):
    own = bars_of(spark, range(100, 120))
    events = spark.createDataFrame([(0, D(2024, 1, 8), "after-close"), (0, D(2024, 1, 9), "pre-open")], "sym int, day date, session string")
    got = S.reaction(S.event_window(events, own, 4, 5), ["sym", "day"]).collect()
    late = {r.off: r.rel for r in got if r.session == "after-close"}
    early = {r.off: r.rel for r in got if r.session == "pre-open"}
    assert late[0] is None and late[1] == pytest.approx(108 / 107 - 1)
    assert early[-1] is None and early[0] == pytest.approx(108 / 107 - 1)
    none = S.reaction(S.event_window(events, own, 0, 3), ["sym", "day"]).where("session = 'pre-open'").collect()
    assert all(r.rel is None for r in none)


def test_sma_gate_and_snapshot(spark):
    got = S.sma_alignment(bars_of(spark, range(1, 200)), [20, 50, 200])
    assert got.where("mean_20 IS NOT NULL OR mean_50 IS NOT NULL").count() == 0
    snap = S.period_snapshot(bars_of(spark, [5]), "week").first()
    assert snap.ret is None and snap.bars == 1


def test_point_of_control(spark):
    flat = spark.createDataFrame([(0, D(2024, 1, 2), 5.0, 5.0, 5.0, 5.0, 1.0)], "sym int, d date, o double, h double, l double, c double, v double")
    assert S.point_of_control(flat, F.lit(D(2024, 1, 3)), 9).first().poc is None
    rows = [(0, D(2024, 1, 1), 0.0, 0.0, 0.0, 0.0, 5.0), (0, D(2024, 1, 2), 100.0, 100.0, 100.0, 100.0, 5.0)]
    tied = spark.createDataFrame(rows, "sym int, d date, o double, h double, l double, c double, v double")
    assert S.point_of_control(tied, F.lit(D(2024, 1, 3)), 9).first().poc == 0.5


def test_flow_grid(spark):
    grid = spark.createDataFrame([(0, 1, 5.0, 0.0), (0, 2, None, 4.0), (0, 3, 10.0, 8.0)], "sym int, r int, a double, b double")
    change = {(r.r, r.slot): r.change for r in S.grid_changes(grid, "r", ["a", "b"]).collect()}
    assert change[(2, 1)] is None and change[(3, 0)] is None and change[(3, 1)] == 1.0
    fill = {(r.r, r.slot): r.fill for r in S.grid_fill(grid, "r", ["a", "b"], 8).collect()}
    assert fill[(2, 0)] is None and fill[(2, 1)] == pytest.approx(4 / 11.5)


def test_market_open(spark):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, S.market_open(stamp("2024-01-30 14:30:00"))) and not one(spark, S.market_open(stamp("2024-01-30 14:29:00")))
    assert one(spark, S.market_open(stamp("2024-07-30 13:30:00"))) and not one(spark, S.market_open(stamp("2024-07-28 15:00:00")))


def test_recency_weights():
    got = H.recency_weights(20)
    assert [round(x, 4) for x in (got[0], got[5], got[10], got[15])] == [0.5, 0.6667, 0.8333, 1.0]
    assert H.recency_weights(20, floor=1.0) is None and H.recency_weights(5) is None


def test_shape_self_match_and_flat(spark):
    own = bars_of(spark, [1, 3, 2, 5, 4, 6, 1, 3, 2, 5], volume=[1, 2, 3, 4, 5, 6, 7, 8, 9, 3])
    query = H.Query.last(own, 4)
    rows = H.profile(own, query, max_scale_ratio=0).orderBy("d").collect()
    assert rows[-1].score == pytest.approx(0, abs=1e-6) and rows[2].score is None
    flat = bars_of(spark, [2] * 8)
    assert H.profile(flat, query).where("score IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        H.Query.last(own, 99)
    same = H.Query({c: [2.0] * 4 for c in "ohlcv"})
    assert [r.x for r in H.with_stats(own, "v", 4).select(H.distance("v", "v", same).alias("x")).collect()][-1] == 0.0


def test_return_bands(spark):
    rows = spark.createDataFrame([(1, 0.01), (1, 0.0099), (1, -0.01)], "pos int, ret double")
    assert tuple(H.return_bands(rows).first()) == (1, 1, 1, 1)


def test_upsert(spark):
    old = bars_of(spark, [1, 2, 3])
    new = bars_of(spark, [9, 4], D(2024, 1, 3))
    got = [(r.d.day, r.c) for r in I.upsert_bars(old, new).orderBy("d").collect()]
    assert got == [(1, 1.0), (2, 2.0), (3, 9.0), (4, 4.0)]
    again = I.upsert_bars(I.upsert_bars(old, new), new)
    assert [(r.d.day, r.c) for r in again.orderBy("d").collect()] == got
    split = spark.createDataFrame([(0, D(2030, 1, 1), 2.0)], "sym int, effective date, split double")
    assert I.upsert_bars(old, new, split).count() == 2


def test_store_is_left_alone_when_equal(spark, tmp_path):
    path = str(tmp_path / "bars")
    old = bars_of(spark, [1, 2, 3])
    assert writers.refresh_bars(spark, old, path) == 1
    assert writers.refresh_bars(spark, bars_of(spark, [3.00000001], D(2024, 1, 3)), path) == 0
    assert writers.refresh_bars(spark, bars_of(spark, [4, 5], D(2024, 1, 3)), path) == 1
    assert [r.c for r in spark.read.parquet(path).orderBy("d").collect()] == [1, 2, 4, 5]


def test_ledger(spark):
    new = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "id string, n int")
    assert I.unseen(new, new, "id", [F.col("n")]).count() == 0
    assert I.unseen(new, new.where("id = 'a'"), "id", [F.col("n")]).first().n == 2


def test_html(spark):
    assert one(spark, X.cell_text(F.lit("<b>A&amp;B</b>&#160; c"))) == "A&B c"
    rows = one(spark, X.table_rows(F.lit('<table><tr><td colspan="2">x</td><td>y</td></tr></table>')))
    assert rows == [["x", "x", "y"]]
    assert one(spark, X.blocks(F.lit("<h1>T</h1><p>a<br>b</p>"))) == ["T", "a", "b"]
    assert one(spark, X.blocks(F.lit("<h1>T</h1><h3>U</h3>"), headings=True)) == ["## T", "#### U"]


def test_press_statements(spark):
    table = lambda x: f"<table><tr><td>{x}</td></tr></table>"
    md = lambda x: f"| {x} |\n|---|"
    html = "<p>Balance Sheets</p>" + table("a") + "Balance sheet" + table("b") + table("c") + "Balance sheet" + table("d") + "<p>Statements of Cash Flows</p>" + table("e")
    assert one(spark, X.press_statements(F.lit(html))) == {"cashflow": md("e"), "balance": md("d")}
    assert one(spark, X.press_statements(F.lit("<p>Statement of Income</p>" + table("a") + "Income statement" + table("b")))) == {"income": md("a") + "\n\n" + md("b")}
    assert one(spark, X.press_statements(F.lit("no tables"))) == {} and one(spark, X.press_statements(F.lit(None).cast("string"))) is None


def test_entities(spark):
    assert one(spark, X.cell_text(F.lit("it&#8217;s &#8212; a&nbsp;b &#8203;&middot; &amp;lt;"))) == "it's — ab · <"
    assert one(spark, X.blocks(F.lit("&#8216;a&#8217; &#8220;b&#8221;&#8203; c&nbsp;d &amp;#38;"))) == ["'a' \"b\" c d &"]


def test_exhibit(spark):
    html = "<style>x</style><p>One</p><table><tr><td>a</td><td>1</td></tr></table>two<br>three<TABLE><tr><td>&#160;</td></tr></TABLE><p>four"
    assert one(spark, X.exhibit(F.lit(html))) == "One\n\n| a | 1 |\n|---|---|\n\ntwo\n\nthree\n\nfour"
    assert one(spark, X.exhibit(F.lit(""))) == ""
    report = '<table id="x"><tr><td>no</td></tr></table><table class="report" id="y"><tr><th>T</th></tr><tr><td>1</td><td>2</td></tr></table>'
    assert one(spark, X.report_table(F.lit(report))) == "| T |  |\n|---|---|\n| 1 | 2 |"


def test_letter(spark):
    body = "EX-99.1\n\nlogo\n\nQ3  2024 Shareholder Letter of us\n\nshort\n\n" + "long line " * 60
    got = one(spark, X.letter(F.lit(body)))
    assert got.startswith("Q3  2024 Shareholder Letter of us\n\n\n\nshort") and not got.endswith(" ")
    assert one(spark, X.letter(F.lit("x" * 499))) is None
    assert one(spark, X.letter_file(*(F.lit(x) for x in ("T", "2024-01-01", "q3-2024", "b", "u")))) == "# T — Q3 2024 Shareholder Letter\n\n**Announcement date:** 2024-01-01  \n**Source:** u\n\n---\n\nb\n"
    page = X.report_file(*(F.lit(x) for x in ("T", "d", "q1-2024", "p")), F.create_map(F.lit("cashflow"), F.lit("c"), F.lit("income"), F.lit("i")), F.lit("u"))
    assert one(spark, page).endswith("---\n\n## Statements of Operations\n\ni\n\n## Statements of Cash Flows\n\nc\n")


def test_index(spark):
    xml = "<R><Report><LongName>2 - Statements of Income (Parenthetical)</LongName><HtmlFileName>R1</HtmlFileName></Report><Report><LongName>3 - Comprehensive Earnings</LongName><ShortName> E </ShortName><HtmlFileName>R2</HtmlFileName></Report><Report><LongName>4 - Statements of Operations and Cash Flow</LongName><HtmlFileName>R3</HtmlFileName></Report></R>"
    got = one(spark, X.statement_reports(X.report_index(F.lit(xml))))
    assert [tuple(r) for r in got] == [("income", "E", "R2"), ("cashflow", "", "R3")]


def test_transcript_page(spark):
    block = lambda name, *said: '<div class="border-t border-sharp pt-5">' + (f'<div class="text-lg font-bold">{name}</div>' if name else "") + "".join(f'<p><span class="transcript-sentence">{s}</span></p>' for s in said)
    page = F.lit('x aria-label="Full transcript">' + block("Ann", "a" * 1500, "cost $5") + block("", "b" * 600, "c"))
    got = one(spark, X.transcript_page(page))
    assert got.preliminary and got.transcript == "**Ann:** " + "a" * 1500 + " cost \\$5\n\n**Unattributed:** " + "b" * 600 + "\n\n**Unattributed:** c"
    assert not one(spark, X.transcript_page(F.lit('aria-label="Full transcript">' + block("Ann", "a" * 2000)))).preliminary
    assert one(spark, X.transcript_page(F.lit('aria-label="Full transcript">' + block("Ann", "a")))) is None and one(spark, X.transcript_page(F.lit("none"))) is None


def test_links(spark):
    assert tuple(one(spark, X.filing_of(F.lit("https://h/Archives/edgar/data/123/000012345624000001/x.htm")))) == ("0000000123", "0000123456-24-000001")
    assert one(spark, X.filing_of(F.lit("https://h/x"))) is None
    assert one(spark, X.first_exhibit(F.lit('<a href="/Archives/edgar/data/1/2/a_Exhibit-99.1.htm">'))) == "https://www.sec.gov/Archives/edgar/data/1/2/a_Exhibit-99.1.htm"


def test_posts(spark):
    got = one(spark, X.post_record(F.lit('{"tweet_id": "7", "text": " hi \\n", "user": {"name": "N"}, "likes": 3}')))
    assert tuple(got) == ("7", "", "", "N", "hi", 3, 0, 0, "") and one(spark, X.post_record(F.lit('{"text": "x"}'))) is None


def test_transcript(spark):
    turns = spark.createDataFrame([(1, 1, "Ann", "x" * 30), (1, 2, None, "cost $5")], "k int, o int, s string, t string")
    got = X.transcripts(turns, "k", "o", "s", "t", 20).first()
    assert got.preliminary and got.transcript.endswith("**Unattributed:** cost \\$5")
    assert X.transcripts(turns, "k", "o", "s", "t").first().transcript is None


def test_option_iv(spark):
    rows = [("a", D(2024, 1, 8), "call", k, 0.4) for k in (95, 100)] + [("a", D(2024, 1, 8), "put", k, 0.6) for k in (95, 105)]
    got = Q.option_iv(spark.createDataFrame(rows, "sym string, expiry date, side string, strike int, iv double"), F.lit(D(2024, 1, 1)), F.lit(100)).first()
    assert (got.strike, got.iv) == (95, 0.5)


def test_readers(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/ABC.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,1,2,5\nbad,1,1,1,1,1\n2024-01-02,1,2,1,3,6\n")
    got = readers.daily_bars(spark, str(tmp_path / "csv")).collect()
    assert [(r.sym, r.c, r.v) for r in got] == [("ABC", 3.0, 6.0)]
    (tmp_path / "zip").mkdir()
    with zipfile.ZipFile(tmp_path / "zip/d_us_txt.zip", "w") as z:
        z.writestr("data/daily/us/nyse stocks/1/abc.us.txt", "<TICKER>,<PER>,<DATE>\nABC.US,D,20240102,000000,1,2,0.5,1.5,100,0\nshort,line\n")
        z.writestr("data/daily/us/nyse etfs/xyz.us.txt", "<TICKER>\nXYZ.US,D,20240102,000000,1,2,0.5,1.5,100,0\n")
    rows = archives.archive_bars(spark, str(tmp_path / "zip")).collect()
    assert [(r.country, r.segment, r.ticker, r.d, r.c) for r in rows] == [("us", "nyse stocks", "ABC", D(2024, 1, 2), 1.5)]
    (tmp_path / "l.jsonl").write_text('{"tweet_id": "1", "likes": 2}\n\nbroken\n')
    (tmp_path / "csv/BRK.B.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,1,2,5\n")
    assert {r.sym for r in readers.daily_bars(spark, str(tmp_path / "csv")).collect()} == {"ABC", "BRK.B"}
    assert [r.tweet_id for r in readers.ledger(spark, str(tmp_path / "l.jsonl")).collect()] == ["1"]


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "ABC").mkdir()
    path = tmp_path / "ABC/f.yml"
    path.write_text("unit: millions\ncurrency: rmb\nquarters:\n- id: q1-2024\n  end_date: 2024-03-31\n  revenue: 10\n  ytd_capex_ppe: 5\n  ytd_capex_land: null\n  announce_date: 2024-05-01\n  announce_session: pre-open\n- id: q2-2024\n  end_date: 2024-06-30\n  ytd_capex_ppe: 7\n  ytd_capex_a: 1\n")
    records = readers.quarters(spark, str(path))
    assert readers.capex_lines(records).first().ytd_capex == {"ppe": 5.0, "land": None}
    assert readers.announcements(records).first().day == D(2024, 5, 1)
    typed = readers.quarter_table(spark, str(path))
    first = typed.orderBy("qn").first()
    assert (first.sym, first.unit, first.currency, first.fy, first.qn, first.end_date, first.revenue, first.announce_session) == ("ABC", "millions", "RMB", 2024, 1, D(2024, 3, 31), 10.0, "pre-open")
    assert readers.capex_names(typed).first().lines == ["ppe", "a", "land"]
    path.write_text("quarters:\n- id: a\n  announce_date: 2024-05-01\n- id: b\n  announce_session: pre-open\n- id: c\n  announce_date: 2024-05-02\n  announce_session: pre-open\n")
    with pytest.raises(Exception, match="a, b"):
        readers.announcements(readers.quarters(spark, str(path))).collect()
    writers.write_yaml(str(tmp_path / "o.yml"), {"b": 1, "a": {"z": "ü"}})
    assert (tmp_path / "o.yml").read_text() == "b: 1\na:\n  z: ü\n"


def test_tools(spark):
    own = bars_of(spark, [10 + (i * 7) % 13 for i in range(60)])
    assert {r.row_label for r in tools.price(own).collect()} >= {"ret", "sma_trend", "rvol_5"}
    assert tools.flow(S.week_grid(own), "week", ["0", "1", "2", "3", "4"]).count() > 0
    events = spark.createDataFrame([(0, D(2024, 1, 20), "pre-open")], "sym int, day date, session string")
    assert tools.reaction(own, events).count() == 30
    assert set(tools.shape(own, 0, query_len=5, any_weekday=True)) == {"matches", "bars", "stats", "volume_stats", "bands", "scan"}
    with pytest.raises(ValueError):
        tools.reaction(own, events, before=-1)


def test_nearest_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [3.0]), (None, [1.0, 0.0]), (2, [0.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query, r.vec_id, round(r.cosine, 6)) for r in V.nearest_vectors(frame, frame.where("vec_id IN (1, 5, 6)"), 4).orderBy("query", "rank").collect()]
    assert got == [(1, 2, 1.0), (1, 3, 1.0), (1, 9, 1.0), (1, 2, 0.0)]
    assert V.nearest_vectors(frame.limit(0), frame, 3).count() == 0


def test_corpus_queries_are_added_only_where_they_are():
    import __spark_entry__ as entry

    assert entry._there("marketloom.plans.registry") and not entry._there("marketloom.nothing") and not entry._there("nothing.at.all")
