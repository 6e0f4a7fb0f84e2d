"""Archives as a data source."""

import datetime as dt
import zipfile

import pytest

from marketloom.sources import archives

D = dt.date


@pytest.mark.parametrize("name, want", [
    ("data/daily/us/nyse stocks/1/brk.b.us.txt", ("us", "nyse stocks", "BRK.B")),
    ("data/daily/world/indices/abc.txt", ("world", "indices", "ABC")),
    ("x/data/daily/jp/tse stocks/7/7203.JP.txt", ("jp", "tse stocks", "7203")),
    ("world/currencies/eur.v.txt", ("world", "currencies", "EUR")),
    ("data/daily/us/readme.txt", None),
    ("data/daily/us/nyse stocks/1/abc.us.csv", None),
])
def test_member_meta(name, want):
    assert archives.member_meta(name) == want


def bars(spark):
    rows = [("us", "nyse stocks", f"s{i}.us", D(2024, 1, 1) + dt.timedelta(days=j), 1.5 + j, 2.0 + j, 0.1, 1 / 3 + i, 10.0) for i in range(12) for j in range(40)]
    rows += [("jp", "tse stocks", "brk.b.jp", D(2024, 1, 1), 1.0, 2.0, 3.0, 4.0, 5.0), ("us", "nyse etfs", "e.us", D(2024, 1, 1), 1.0, 2.0, 3.0, 4.0, 5.0)]
    return spark.createDataFrame(rows, "country string, segment string, ticker string, d date, o double, h double, l double, c double, v double")


def test_archives_round_trip(spark, tmp_path):
    where = str(tmp_path / "store")
    archives.write_archives(bars(spark), where)
    archives.write_archives(bars(spark), where)  # takes the place of the first
    files = list((tmp_path / "store").iterdir())
    assert files and all(f.suffix == ".zip" for f in files)
    got = archives.archive_bars(spark, where, None)
    key = lambda r: (r.country, r.segment, r.ticker, r.d, r.o, r.h, r.l, r.c, r.v)
    want = sorted((a, b, archives.member_meta(f"{a}/{b}/{t}.txt")[2], *rest) for a, b, t, *rest in bars(spark).collect())
    assert sorted(map(key, got.collect())) == want
    assert {r.ticker for r in archives.archive_bars(spark, where, countries=["jp"]).collect()} == {"BRK.B"}


def test_archives_push_and_slice(spark, tmp_path):
    """Filters reach the source, which then lists fewer members; an archive's members are dealt over partitions."""
    where = str(tmp_path / "store")
    archives.write_archives(bars(spark).coalesce(1), where)
    own = archives.archive_bars(spark, where, ["tse stocks", "nyse etfs"], ["us"])
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(own._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [In(segment, [nyse etfs,tse stocks]), EqualTo(country,us)]" in plan
    assert [r.ticker for r in own.collect()] == ["E"]
    reader = archives.Reader({"path": where, "slicebytes": "4000"})
    assert list(reader.pushFilters([archives.EqualTo(("country",), "us"), archives.In(("segment",), ("nyse stocks",)), archives.EqualTo(("line",), "x")])) == [archives.EqualTo(("line",), "x")]
    parts = reader.partitions()
    assert len(parts) >= 6 and sum(len(p.members) for p in parts) == 12
    many = archives.archive_lines(spark, where, slice_bytes=4000)
    assert many.rdd.getNumPartitions() >= 6 and many.count() == 12 * 40 + 2


def test_archives_edges(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert archives.archive_bars(spark, str(tmp_path / "none")).count() == 0
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/daily/us/nyse stocks/1/empty.us.txt", "")
        z.writestr("data/daily/us/nyse stocks/1/odd.us.txt", b"<TICKER>\nODD.US,D,20240102,000000,1,2,x,1.5,100,0\nODD.US,D,20240103,000000,1,2,1,1.5,100,0\n\xff\xfe,short\n")
    got = archives.archive_bars(spark, str(tmp_path / "a.zip")).collect()
    assert [(r.ticker, r.d) for r in got] == [("ODD", D(2024, 1, 3))]
    archives.write_archives(bars(spark).where("false"), str(tmp_path / "empty"))
    assert archives.archive_bars(spark, str(tmp_path / "empty")).count() == 0


def test_chart_days_are_the_exchange_s(spark):
    """A session that opens at 23:00 UTC is the next day's on a clock ten hours ahead."""
    from pyspark.sql import functions as F

    from marketloom.sources import remote

    chart = '{"chart": {"result": [{"meta": {"gmtoffset": %s}, "timestamp": [1704236400], "indicators": {"quote": [{"open": [1], "high": [1], "low": [1], "close": [2], "volume": [5]}]}}]}}'
    day = lambda offset: spark.range(1).select(remote.chart_bars(F.lit(chart % offset)).alias("x")).first().x[0].d
    assert (day("36000"), day("0"), day("null")) == (D(2024, 1, 3), D(2024, 1, 2), D(2024, 1, 2))
