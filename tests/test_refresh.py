"""Refreshes of stores from a fetch function's payloads."""

import datetime as dt
import json

from marketloom.plans import refreshes
from marketloom.sources import connector, readers, refresh, writers

D = dt.date


def stamp(day, hour=15):
    return int(dt.datetime(day.year, day.month, day.day, hour, tzinfo=dt.timezone.utc).timestamp())


def chart(closes, splits=()):
    """A chart's JSON of {day: close}; None is a hole."""
    days = sorted(closes)
    values = [closes[d] for d in days]
    events = {str(d): {"date": stamp(d), "numerator": n, "denominator": 1} for d, n in splits}
    quote = {k: values for k in ("open", "high", "low", "close")} | {"volume": [10.0] * len(days)}
    return json.dumps({"chart": {"result": [{"meta": {"gmtoffset": 0}, "timestamp": [stamp(d) for d in days], "events": {"splits": events}, "indicators": {"quote": [quote]}}]}})


def serve(pages, log):
    """Fetches pages by address, and writes down what it is asked for."""

    def fetch(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        if url not in pages:
            raise OSError("gone")
        return pages[url]

    return fetch


def address(sym, since):
    from pyspark.sql import functions as F

    return F.concat(F.lit("x://vendor/"), sym, F.lit("?"), since.cast("string"))


def stored(spark, store):
    got = writers.stored_bars(spark, store, "sym string, d date, o double, h double, l double, c double, v double")
    return {(r.sym, r.d.day): r.c for r in got.collect()}


def test_prices(spark, tmp_path):
    day = lambda n: D(2024, 3, n)
    store, log = str(tmp_path / "bars"), str(tmp_path / "log")
    symbols = spark.createDataFrame([("0005",), ("S",), ("0005",), (None,), ("GONE",)], "sym string")
    first = {"x://vendor/0005?2000-01-01": chart({day(1): 1.0, day(4): 2.0}), "x://vendor/S?2000-01-01": chart({day(1): 8.0})}
    told = refresh.refresh_prices(symbols, store, address, serve(first, log), pause=0.0)
    assert {r.sym: (r.split, r.bars) for r in told.collect()} == {"0005": (False, 2), "S": (False, 1), "GONE": (False, 0)}
    assert stored(spark, store) == {("0005", 1): 1.0, ("0005", 4): 2.0, ("S", 1): 8.0}  # the symbol stays text
    second = {
        # the boundary's close has changed, a hole inside stays one, of two at the end one is there on its own day
        "x://vendor/0005?2024-03-04": chart({day(4): 2.5, day(5): None, day(6): 3.0, day(7): None, day(8): None}),
        "x://vendor/0005?2024-03-07": chart({day(7): 4.0, day(8): None}),
        "x://vendor/0005?2024-03-08": chart({day(8): None}),
        # splits on the last day are known, later ones ask for everything again
        "x://vendor/S?2024-03-01": chart({day(1): 4.0, day(4): 4.5}, [(day(1), 3), (day(4), 2)]),
        "x://vendor/S?2000-01-01": chart({day(1): 4.0, day(4): 4.5}, [(day(4), 2)]) ,
    }
    told = refresh.refresh_prices(symbols, store, address, serve(second, log), pause=0.0)
    assert {r.sym: (r.since, r.split, r.bars, r.healed) for r in told.collect()} == {"0005": (day(4), False, 3, 1), "S": (D(2000, 1, 1), True, 2, 0), "GONE": (D(2000, 1, 1), False, 0, 0)}
    want = {("0005", 1): 1.0, ("0005", 4): 2.5, ("0005", 6): 3.0, ("0005", 7): 4.0, ("S", 1): 4.0, ("S", 4): 4.5}
    assert stored(spark, store) == want
    asked = open(log).read().split()
    assert len(asked) == len(set(asked)) + 2 and asked.count("x://vendor/GONE?2000-01-01") == 2  # and S whole in either run
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bars", "bars_refreshed", "log"]


def test_shorts(spark, tmp_path):
    files, log = tmp_path / "files", str(tmp_path / "log")
    text = "unit: millions  # kept\nquarters:\n  - id: q1-2024\n    end_date: 2024-03-31\n    shares_outstanding: 2\n  - id: q2-2024\n    end_date: 2024-06-30\n    shares_short: 9\n  - id: q3-2024\n    end_date: 2024-09-30\n  - id: q4-2024\n    end_date: 2024-12-31\n  - id: q4-2020\n    end_date: 2020-12-31\n"
    for sym in ("A", "B"):
        (files / sym).mkdir(parents=True)
        (files / sym / "F.yml").write_text(text)
    sheet = 'name,settlementDate,currentShortPositionQuantity\n"A, Inc",2024-03-28,1500000\nx,2024-06-28,7\nbad,2024-06-99,7\nx,2024-08-15,z\nx,2024-10-15,5\n'
    pages = {"x://s/A": sheet, "x://vendor/A?2024-03-28": chart({D(2024, 3, 28): 1.0}, [(D(2024, 3, 28), 7), (D(2024, 5, 1), 2)])}
    from pyspark.sql import functions as F

    run = lambda write: refresh.refresh_shorts(spark, str(files), "F.yml", lambda s: F.concat(F.lit("x://s/"), s), address, serve(pages, log), 0.0, write)
    got = {r.id: (r.status, r.settled, r.adjusted, r.implausible) for r in run(False).collect()}
    assert got == {"q1-2024": ("add", D(2024, 3, 28), 3.0, False), "q3-2024": ("no settlement", None, None, False), "q4-2024": ("pending", None, None, False), "q4-2020": ("pre-listing", None, None, False)}
    assert (files / "A" / "F.yml").read_text() == text
    run(True)
    assert (files / "A" / "F.yml").read_text() == text.replace("shares_outstanding: 2\n", "shares_outstanding: 2\n    shares_short: 3\n    short_settlement_date: 2024-03-28\n")
    assert (files / "B" / "F.yml").read_text() == text  # its settlements can't be had


def test_posts(spark, tmp_path):
    store, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    post = lambda n, text="t": {"tweet_id": n, "timestamp": f"2024-01-0{n}", "text": f" {text} "}
    searches = spark.createDataFrame([("A", "x://a"), ("B", "x://b"), ("C", "x://none"), (None, "x://a")], "sym string, url string")
    noon = dt.datetime(2024, 1, 9, 12)
    run = lambda pages, minutes, cooldown=60: refresh.refresh_posts(searches, store, serve(pages, log), cooldown, noon + dt.timedelta(minutes=minutes), 0.0)
    first = {"x://a": json.dumps([post("1"), post("2"), post("1", "again"), {"text": "no id"}]), "x://b": json.dumps([])}
    assert [(r.sym, r.tweet_id, r.text) for r in run(first, 0).collect()] == [("A", "2", "t"), ("A", "1", "t")]
    second = {"x://a": json.dumps([post("3"), post("1")]), "x://b": json.dumps([post("1")])}
    assert [(r.sym, r.tweet_id) for r in run(second, 30).collect()] == [("B", "1")]  # A's ledger has just grown, B's hasn't
    assert [(r.sym, r.tweet_id) for r in run(second, 61).collect()] == [("A", "3")]
    assert run(second, 62, 0).count() == 0
    assert sorted((r.sym, r.tweet_id) for r in refresh.posts_ledger(spark, store).collect()) == [("A", "1"), ("A", "2"), ("A", "3"), ("B", "1")]
    asked = open(log).read().split()
    assert asked.count("x://a") == 3 and asked.count("x://none") == 4
    assert refresh.posts_ledger(spark, str(tmp_path / "never")).columns == ["sym", *(c.split()[0] for c in readers.LEDGER.split(", "))]


def test_fetched_payloads_are_handed_on(tmp_path):
    """A task holds few payloads at once, however many a host has."""
    paced = connector.Paced({"path": str(tmp_path), "upto": "9"}, lambda url: None if url == "x://h/4" else "p" * (connector.HELD // 2), 0.0)
    batches = list(paced.read(connector.Host("h", tuple((n, f"x://h/{n}") for n in range(9)))))
    assert [b.num_rows for b in batches] == [2, 2, 3, 2]
    assert [n for b in batches for n in b.column(0).to_pylist()] == list(range(9)) and batches[2].column(3)[0].as_py() is None


def test_posts_stand_on_many_pages(spark, tables, tmp_path, monkeypatch):
    """A symbol's posts come in pages whose size is bounded, and all of them are found."""
    monkeypatch.setattr(refreshes, "PAGED", 300)
    monkeypatch.setattr(refreshes, "shared_dir", lambda spark: str(tmp_path))
    got = refreshes.post_refresh(spark, tables).select("tweet_id").collect()
    own = spark.read.parquet(f"{tables}/events.parquet").select("event_id").collect()
    assert sorted(r.tweet_id for r in got) == sorted(str(r.event_id) for r in own)
    sizes = [(p.name.split(".")[0], len(json.loads(p.read_text()))) for p in (tmp_path / "second").glob("*.json")]
    assert len(sizes) > len(set(s for s, _ in sizes)) and sum(n for _, n in sizes) == len(own)
