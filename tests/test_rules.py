"""The rules of the reports and stores, by hand-made cases."""

import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F

from marketloom import tools
from marketloom.operators import fundamentals as Q
from marketloom.operators import ingest as I
from marketloom.operators import series as S
from marketloom.operators import text as X
from marketloom.sources import writers

D, T = dt.date, dt.datetime


def quarters(spark, years, **columns):
    """A row a quarter of {symbol: {year: quarters}}; columns are functions of (symbol, year, quarter)."""
    names = ["ytd_sbc", "est_low", "est_high", "nq_low", "nq_high", "fy_low", "fy_high", "shares_short"]
    rows = []
    for s, of in years.items():
        for fy, qs in of.items():
            for q in qs:
                made = [columns.get(n, lambda *a: None)(s, fy, q) for n in names]
                rows.append((s, fy, q, f"q{q}-{fy}", D(fy, 3 * q, 28), D(fy, 3 * q, 28) + dt.timedelta(40), 100.0, 10.0 * q, columns.get("ytd_capex", lambda *a: {"ppe": 1.0 * a[2]})(s, fy, q), 5.0, 1.0, 1.0, *made, D(fy, 3 * q, 25), None, None, 1.0, 1e6))
    kinds = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, f"sym string, fy int, qn int, id string, end_date date, report_date date, revenue double, ytd_ocf double, ytd_capex map<string,double>, shares double, cash double, debt double, {kinds}, settled date, nq_hint string, fy_hint string, fx double, mult double")


ALL = [1, 2, 3, 4]


@pytest.mark.parametrize("years, want", [
    ({2024: [1, 2]}, ["q2-2024", "q1-2024"]),  # no complete year
    ({2022: ALL, 2023: [1, 2, 3], 2024: [1, 2]}, ["q2-2024", "q1-2024", "FY-2022", "q4-2022", "q3-2022", "q2-2022", "q1-2022"]),  # only the newest incomplete year
    ({2021: ALL, 2022: ALL, 2023: ALL}, ["FY-2023", "q4-2023", "q3-2023", "q2-2023", "q1-2023", "FY-2022", "q4-2022", "q3-2022", "q2-2022", "q1-2022"]),
    ({2021: ALL, 2022: [1, 3, 4], 2023: ALL}, ["FY-2023", "q4-2023", "q3-2023", "q2-2023", "q1-2023", "FY-2021", "q4-2021", "q3-2021", "q2-2021", "q1-2021"]),
])
def test_display_columns(spark, years, want):
    got = Q.display_columns(quarters(spark, {"a": years})).orderBy("position").collect()
    assert [f"FY-{r.fy}" if r.is_fy else f"q{r.qn}-{r.fy}" for r in got] == want


def test_a_symbol_without_a_complete_year_is_valued(spark):
    closes = spark.createDataFrame([("a", D(2024, 6, 1), 10.0)], "sym string, d date, c double")
    cells = tools.valuation(quarters(spark, {"a": {2024: [1, 2]}}), closes).collect()
    assert {r.column_label for r in cells} == {"q1-2024", "q2-2024"}


def shown_of(spark, frame):
    columns = tools.valuation_columns(frame, spark.createDataFrame([("a", D(2020, 1, 1), 10.0)], "sym string, d date, c double"))
    return Q.visible_rows(columns, frame, Q.latest_trailing(Q.quarter_flows(frame), ["q_ytd_sbc"])).first()


def test_rows_that_only_a_year_has(spark):
    """Compensation told for the year only, guidance of a year's quarters, lines of a quarter that isn't shown."""
    of = {"a": {2018: ALL, 2021: ALL, 2022: ALL, 2023: [1]}}
    year_only = shown_of(spark, quarters(spark, of, ytd_sbc=lambda s, fy, q: 9.0 if (fy, q) == (2022, 4) else None))
    assert year_only.has_sbc and not year_only.two_fcf and not year_only.has_fy_guide
    hidden = shown_of(spark, quarters(spark, of, ytd_sbc=lambda s, fy, q: 9.0 if fy == 2018 else None, ytd_capex=lambda s, fy, q: {"ppe": 1.0, **({"software": 2.0} if fy == 2018 else {})}))
    assert not hidden.has_sbc and hidden.two_fcf
    guided = shown_of(spark, quarters(spark, of, fy_low=lambda s, fy, q: 5.0 if (fy, q) == (2021, 2) else None, shares_short=lambda s, fy, q: 1.0 if (fy, q) == (2022, 4) else None))
    assert guided.has_fy_guide and guided.has_short and not guided.has_nq_guide and not guided.has_est


def test_week_flow_marks_today_only(spark):
    """On a Tuesday with the market open and no bar yet, Monday's cell is final; on a Saturday nothing is marked."""
    rows = [("a", D(2024, 5, 6) + dt.timedelta(days=i), 1.0, 1.0, 1.0, 2.0, 10.0 + i) for i in (*range(5), 7)]
    bars = spark.createDataFrame(rows, "sym string, d date, o double, h double, l double, c double, v double")
    grid = S.week_grid(bars)
    cells = lambda now: {(r.week, r.column_label): r.value for r in tools.flow(grid, "week", ["0", "1", "2", "3", "4"], now=F.lit(now).cast("timestamp_ntz"), bars=bars).where("row_label = 'provisional'").collect()}
    tuesday = cells(T(2024, 5, 14, 15, 0))
    assert [k for k, v in tuesday.items() if v == "true"] == [(D(2024, 5, 13), "1")] and tuesday[D(2024, 5, 13), "0"] == "false"
    assert not any(v == "true" for v in cells(T(2024, 5, 18, 15, 0)).values())
    moves = tools.flow(grid, "week", ["0", "1", "2", "3", "4"], bars=bars).where("row_label = 'move'").collect()
    assert {r.value for r in moves if r.value} == {"1.0"}


def test_price_report_has_all_its_rows(spark):
    rows = [(s, D(2024, 1, 1) + dt.timedelta(days=i), c, c + 1, c - 1, c, 10.0) for s, up in (("a", 1.02), ("SPY", 1.0)) for i in range(60) for c in [100 * up**i] if (D(2024, 1, 1) + dt.timedelta(days=i)).weekday() < 5]
    bars = spark.createDataFrame(rows, "sym string, d date, o double, h double, l double, c double, v double")
    candles = spark.createDataFrame([("a", T(2024, 2, 28, 15) + dt.timedelta(hours=i), 10.0 + i, 9.0 + i, 5.0 if i == 3 else 1.0) for i in range(8)], "sym string, ts timestamp, h double, l double, v double")
    iv = spark.createDataFrame([("a", 0.52)], "sym string, iv double")
    short = spark.createDataFrame([("a", 0.031, 2.5, D(2024, 2, 20))], "sym string, pct_float double, days_to_cover double, as_of date")
    tags = spark.createDataFrame([("a", False)], "sym string, small_cap boolean")
    got = tools.price(bars, unit="month", candles=candles, iv=iv, short=short, tags=tags, market="SPY", today="2024-02-29")
    cells = {(r.row_label, r.column_label): r.value for r in got.where("sym = 'a'").collect()}
    now = "2024-02-01"
    assert float(cells["implied_move", now]) == pytest.approx(0.52 * (1 / 12) ** 0.5 * 100) and float(cells["short_pct", now]) == pytest.approx(3.1)
    assert cells["short_age", now] == "9" and cells["flags", now] == "outruns the market" and cells["flags", "2024-01-01"] is None
    assert 12.4 < float(cells["poc_20", now]) < 12.6 and cells["poc_20", "2024-01-01"] is None
    past = {r.row_label for r in tools.price(bars, as_of="2024-02-15", candles=candles, iv=iv, short=short).collect()}
    assert not past & {"poc_20", "implied_move", "short_pct"}


def test_nearest_is_the_same_however_rows_come(spark):
    """Targets whose order differs from one evaluation to the next, with repeats; each is paired with its own match."""
    targets = spark.range(400).select((F.col("id") % 7).alias("sym"), F.date_add(F.lit(D(2024, 1, 1)), (F.col("id") * 13 % 300).cast("int")).alias("day"), (F.col("id") % 90).alias("n"))
    targets = targets.unionByName(targets.where("n < 10")).withColumn("__r", F.rand()).repartition(7, "__r").drop("__r")  # rand() without a seed: dealt anew by each evaluation
    others = spark.range(120).select((F.col("id") % 7).alias("sym"), F.date_add(F.lit(D(2024, 1, 1)), (F.col("id") * 5 % 310).cast("int")).alias("d"), F.col("id").alias("x"))
    got = sorted(map(tuple, S.nearest(targets, others, "sym", "day", "d", ["x"], 6, [F.col("x")]).collect()))
    have = [tuple(r) for r in others.collect()]
    want = []
    for s, day, n in map(tuple, targets.collect()):
        near = [(abs((d - day).days), x, d) for o, d, x in have if o == s and abs((d - day).days) <= 6]
        want.append((s, day, n, *((min(near)[2], min(near)[1]) if near else (None, None))))
    assert repr(got) == repr(sorted(want, key=lambda r: r[:3])) and len(got) == 400 + len([i for i in range(400) if i % 90 < 10])
    for plan in (S.nearest(targets, others, "sym", "day", "d", ["x"], 6), Q.split_ratio(targets.withColumnRenamed("day", "settled"), spark.createDataFrame([(1, D(2024, 5, 1), 2.0)], "sym long, effective date, split double"), "settled")):
        assert "monotonically_increasing_id" not in plan._jdf.queryExecution().toString()


def test_united_valuations(spark):
    tickers = spark.createDataFrame([("own",), ("unpriced",), ("zero",), ("listed",), ("lost",)], "sym string")
    official = spark.createDataFrame([("own", 9.0, 1.5), ("unpriced", 1.0, 1.0), ("zero", 1.0, 1.0), ("elsewhere", 1.0, 1.0)], "sym string, cap double, rev3 double")
    vendor = I.vendor_row(spark.createDataFrame([("listed", 5.0, 100.0, 50.0, -1.0), ("unpriced", 1.0, 1.0, 1.0, 1.0)], "sym string, price double, market_cap double, revenue double, free_cash_flow double"))
    prices = spark.createDataFrame([("own", 3.0), ("zero", 0.0), ("listed", None)], "sym string, price double")
    got = {r.sym: r for r in I.united_valuations(tickers, official, vendor, prices).collect()}
    assert {k: r.origin for k, r in got.items()} == {"own": "official", "unpriced": "skipped", "zero": "skipped", "listed": "vendor", "lost": "none"}
    assert got["own"].rev3 == 1.5 and got["listed"].ps == 2.0 and got["listed"].rev3 is None and got["unpriced"].cap is None


def test_documents_are_one_file_each(spark, tmp_path):
    docs = [("A/quarters/2024-01-01_q1-letter.md", "# A\n\nü"), ("A/quarters/2024-01-01_q1-report.md", "report"), ("b.md", None)]
    writers.write_documents(spark.createDataFrame(docs, "name string, page string").repartition(3), str(tmp_path / "out"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {n: p or "" for n, p in docs}
    writers.write_documents(spark.createDataFrame([("b.md", "new")], "name string, page string"), str(tmp_path / "out"))
    assert (tmp_path / "out/b.md").read_text() == "new" and len(found) == 3
    with pytest.raises(Exception, match="no name of a document"):
        writers.write_documents(spark.createDataFrame([("../x", "p")], "name string, page string"), str(tmp_path / "out"))


def test_readers_see_whole_entries_only(spark, tmp_path):
    """While an entry is replaced again and again, every reader finds one version, whole."""
    path, failures, stop = str(tmp_path / "cache"), [], threading.Event()
    (tmp_path / "cache").mkdir()
    make = lambda n: spark.range(2000).select(F.lit(n).alias("n"), "id").repartition(4)
    writers.cached(spark, path, "k", lambda: make(0))

    def read():
        while not stop.is_set():
            try:
                seen = writers.cached(spark, path, "k", lambda: make(-1)).groupBy("n").count().collect()
                if [r["count"] for r in seen] != [2000] or seen[0].n < 0:
                    failures.append(seen)
            except Exception as e:  # noqa: BLE001
                failures.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 5):
        writers.cached(spark, path, "k", lambda n=n: make(n), refresh=True)
        time.sleep(1)
    stop.set()
    reader.join()
    assert not failures and writers.cached(spark, path, "k", lambda: make(9)).first().n == 4
    assert len(writers.versions(spark, f"{path}/k")) == 2


def test_points_of_control_by_mode_and_day(spark, tmp_path):
    asked = []

    def make(x):
        asked.append(x)
        return spark.createDataFrame([("a", x)], "sym string, poc double")

    path = str(tmp_path / "poc")
    get = lambda mode, day, x: writers.points_of_control(spark, path, mode, day, lambda: make(x)).first().poc
    assert [get("week", "2024-01-01", 1.0), get("week", "2024-01-01", 2.0), get("month", "2024-01-01", 3.0), get("week", "2024-01-02", 4.0)] == [1.0, 1.0, 3.0, 4.0]
    assert asked == [1.0, 3.0, 4.0]


def test_summaries_with_sections_and_entities(spark):
    one = '<Report instance="x.htm"><LongName>2 - Statement - <![CDATA[Balance Sheet <audited>]]></LongName><ShortName> A &#38; B&#x20AC; </ShortName><HtmlFileName>R2.htm</HtmlFileName></Report>'
    pages = [f'<?xml version="1.0" encoding="utf-8"?><FilingSummary xmlns="urn:x"><MyReports>{one}<Report><LongName/></Report></MyReports></FilingSummary>', f"<S>{one}</S>", "<S><Report><LongName>x", "no xml", "", None]
    got = spark.createDataFrame([(p,) for p in pages], "x string").select(X.report_index(F.col("x")).alias("i")).collect()
    report = ("2 - Statement - Balance Sheet <audited>", "A & B€", "R2.htm")
    assert [[tuple(x) for x in r.i] for r in got] == [[report, ("", "", "")], [report], [], [], [], []]


def test_press_release_is_cut_once(spark):
    """A page's cut, a table's rows and the text before it are computed once, however many tables a page has."""
    page = "".join(f"<p>Balance sheet</p><table><tr><td>{i}</td></tr><tr><td>a</td><td>b</td></tr></table>" for i in range(3))
    rows = spark.createDataFrame([(page,), (page * 20,), ("no table",), (None,)], "html string").select(X.press_statements(F.col("html")).alias("found"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in ("<table[^>]*>", "<tr[^>]*>", "(?U)")] == [1, 1, 2]
    one = lambda i: f"| {i} |  |\n|---|---|\n| a | b |"
    want = "\n\n".join(map(one, range(3)))
    assert [r.found for r in rows.collect()] == [{"balance": want}, {"balance": "\n\n".join([want] * 20)}, {}, None]
