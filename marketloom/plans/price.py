"""Queries over bars: periods, averages, flow grids, events, points of control."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import columns as C
from marketloom.operators import ingest as I
from marketloom.operators import series as S
from marketloom.plans.views import announcements, bars, hour_bars, nation_bars, query, quarters, read, view
from marketloom.sources import readers

ARROW = "CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN coalesce(abs({x} - {y}) / nullif(greatest(abs({x}), abs({y})), 0), 0) < 0.005 THEN '→' WHEN {x} > {y} THEN '↑' ELSE '↓' END"
PAIR = lambda a, b, c: ARROW.format(x=a, y=b) + " || " + ARROW.format(x=b, y=c)
SLOTS = "'09:30', '10:30', '11:30', '12:30', '13:30', '14:30', '15:30'"


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


query("daily_bars", "SELECT * FROM bars", "bars")(bars)
query("hourly_bars", "SELECT * FROM hbars", "hbars")(hour_bars)


@query("dedup_keep_last", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1""")
def dedup_keep_last(spark, sf_dir):
    last = S.keep_last(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")])
    return last.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("filter_valid_bars", "SELECT * FROM (SELECT sym, d, c, CASE WHEN v % 7 = 0 THEN 0 ELSE v END AS v FROM bars) WHERE v > 0", "bars")
def filter_valid_bars(spark, sf_dir):
    return S.valid_bars(bars(spark, sf_dir).select("sym", "d", "c", F.expr("CASE WHEN v % 7 = 0 THEN 0 ELSE v END AS v")))


view("sessions", f"""SELECT sym, CAST(local AS DATE) AS day, strftime(local, '%H:%M') AS slot, v FROM (SELECT sym, v, ((ts + INTERVAL 30 MINUTE) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM hbars)
 WHERE strftime(local, '%H:%M') IN ({SLOTS})""", ("hbars",))
view("sgrid", "SELECT sym, day, " + ", ".join(f"max(v) FILTER (slot = '{s}') AS \"{s}\"" for s in S.SESSION) + " FROM sessions GROUP BY 1, 2", ("sessions",))
view("wgrid", "SELECT sym, CAST(date_trunc('week', d) AS DATE) AS week, " + ", ".join(f"max(v) FILTER (isodow(d) = {i + 1}) AS \"{i}\"" for i in range(5)) + " FROM bars WHERE isodow(d) < 6 GROUP BY 1, 2", ("bars",))


def session_grid(spark, sf_dir):
    shifted = hour_bars(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    return S.session_grid(shifted).where(" OR ".join(f"`{s}` IS NOT NULL" for s in S.SESSION))


def week_grid(spark, sf_dir):
    return S.week_grid(bars(spark, sf_dir))


query("session_pivot", "SELECT * FROM sgrid", "sgrid")(session_grid)
query("week_pivot", "SELECT * FROM wgrid", "wgrid")(week_grid)

PERIOD = """SELECT sym, CAST(date_trunc('{u}', d) AS DATE) AS start, arg_min(c, d) AS first_close, arg_max(c, d) AS last_close, max(d) AS last_day, avg(v) AS mean_volume, count(*) AS bars,
 CASE WHEN count(*) > 1 THEN arg_max(c, d) / arg_min(c, d) - 1 END AS ret FROM {t} {w} GROUP BY 1, 2"""
view("weeks", PERIOD.format(u="week", t="bars", w="WHERE isodow(d) < 6"), ("bars",))
view("months", PERIOD.format(u="month", t="bars", w=""), ("bars",))


@query("period_snapshot", "SELECT sym, start, first_close, last_close, last_day, round(mean_volume, 6) AS mean_volume, bars, round(ret, 9) AS ret FROM weeks", "weeks")
def period_snapshot(spark, sf_dir):
    got = S.period_snapshot(bars(spark, sf_dir), "week")
    return got.withColumns({"mean_volume": F.round("mean_volume", 6), "ret": F.round("ret", 9)})


for unit, back in (("week", "INTERVAL 7 DAY"), ("month", "INTERVAL 1 MONTH")):

    @query(f"period_bounds_{unit}", f"SELECT sym, CAST(date_trunc('{unit}', last) - i * {back} AS DATE) AS start FROM (SELECT sym, max(d) AS last FROM bars GROUP BY 1), range(4) t(i)", "bars")
    def period_bounds(spark, sf_dir, unit=unit):
        last = bars(spark, sf_dir).groupBy("sym").agg(F.max("d").alias("last"))
        return last.select("sym", F.explode(S.recent_periods(F.col("last"), unit)).alias("start"))


TARGETS = "(SELECT DISTINCT sym, CAST(end_date AS DATE) AS day FROM quarters)"


@query("asof_backward_close", f"SELECT t.sym, t.day, b.d AS bar_d, b.c AS bar_c FROM {TARGETS} t ASOF LEFT JOIN nbars b ON t.sym = b.sym AND t.day >= b.d", "nbars quarters")
def asof_backward_close(spark, sf_dir):
    targets = quarters(spark, sf_dir).select("sym", F.col("end_date").alias("day")).distinct()
    return S.asof(targets, nation_bars(spark, sf_dir), "sym", "day", "d", ["c"])


@query("asof_forward_bar", f"SELECT t.sym, t.day, b.d AS bar_d, b.bar_no AS bar_bar_no FROM {TARGETS} t ASOF LEFT JOIN numbered b ON t.sym = b.sym AND t.day <= b.d", "numbered quarters")
def asof_forward_bar(spark, sf_dir):
    targets = quarters(spark, sf_dir).select("sym", F.col("end_date").alias("day")).distinct()
    return S.asof(targets, S.number_bars(nation_bars(spark, sf_dir)), "sym", "day", "d", ["bar_no"], forward=True)


view("windows", """SELECT e.sym, fy, qn, day, session, off, b.d AS bar_day, b.c, b.v FROM (SELECT a.*, n.bar_no + off AS want, off FROM announce a ASOF JOIN numbered n ON a.sym = n.sym AND a.day <= n.d, (SELECT CAST(unnest(range(-4, 6)) AS INT) AS off)) e
 LEFT JOIN numbered b ON e.sym = b.sym AND b.bar_no = e.want""", ("announce", "numbered"))


def event_windows(spark, sf_dir):
    return S.event_window(announcements(spark, sf_dir), nation_bars(spark, sf_dir), 4, 5)


@query("event_window_offsets", "SELECT sym, fy, qn, off, bar_day, c, v FROM windows", "windows")
def event_window_offsets(spark, sf_dir):
    return event_windows(spark, sf_dir).select("sym", "fy", "qn", "off", "bar_day", "c", "v")


@query("reaction_returns", """SELECT sym, fy, qn, off, CASE WHEN off >= r AND base > 0 THEN round(c / base - 1, 9) END AS rel FROM (SELECT *, max(CASE WHEN off = r - 1 THEN c END) OVER (PARTITION BY sym, fy, qn) AS base
 FROM (SELECT *, CASE WHEN session = 'after-close' THEN 1 ELSE 0 END AS r FROM windows))""", "windows")
def reaction_returns(spark, sf_dir):
    return rounded(S.reaction(event_windows(spark, sf_dir), ["sym", "fy", "qn"]).select("sym", "fy", "qn", "off", "rel"), "rel", digits=9)


@query("session_summary", "SELECT sym, count(DISTINCT session) AS sessions, count(*) AS quarters, min(day) AS first_day, max(day) AS last_day FROM announce GROUP BY 1", "announce")
def session_summary(spark, sf_dir):
    return announcements(spark, sf_dir).groupBy("sym").agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("quarters"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


MEANS = lambda col, ps: ", ".join(f"CASE WHEN row_number() OVER w >= {max(ps)} THEN avg({col}) OVER (PARTITION BY sym ORDER BY d ROWS {p - 1} PRECEDING) END AS mean_{p}" for p in ps)
for name, ps in (("sma_alignment", (5, 10, 20)), ("sma_alignment_monthly", (20, 50, 200))):

    @query(name, f"SELECT sym, d, {', '.join(f'round(mean_{p}, 6) AS mean_{p}' for p in ps)}, {PAIR(*(f'mean_{p}' for p in ps))} AS trend FROM (SELECT *, {MEANS('c', ps)} FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d))", "bars")
    def sma_alignment(spark, sf_dir, ps=ps):
        got = S.sma_alignment(bars(spark, sf_dir), list(ps))
        return rounded(got.select("sym", "d", *(f"mean_{p}" for p in ps), "trend"), *(f"mean_{p}" for p in ps))


@query("rvol", f"""SELECT w.sym, w.start, {', '.join(f'round(w.mean_volume / nullif(m.mean_{p}, 0), 6) AS rvol_{p}' for p in (5, 10, 20))}, {PAIR('m.mean_5', 'm.mean_10', 'm.mean_20')} AS trend
 FROM weeks w JOIN (SELECT *, {MEANS('v', (5, 10, 20))} FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)) m ON w.sym = m.sym AND w.last_day = m.d""", "weeks")
def rvol(spark, sf_dir):
    got = S.relative_volume(bars(spark, sf_dir), "week", [5, 10, 20])
    return rounded(got.select("sym", "start", "rvol_5", "rvol_10", "rvol_20", "trend"), "rvol_5", "rvol_10", "rvol_20")


@query("live_override", "SELECT m.sym, m.start, coalesce(x.live, m.last_close) AS price, round(CASE WHEN x.live IS NOT NULL THEN x.live / m.first_close - 1 ELSE m.ret END, 9) AS ret FROM months m LEFT JOIN (SELECT sym, max(start) AS start, CAST(1000 + sym AS DOUBLE) AS live FROM months WHERE sym % 2 = 0 GROUP BY sym) x ON m.sym = x.sym AND m.start = x.start", "months")
def live_override(spark, sf_dir):
    months = S.period_snapshot(bars(spark, sf_dir), "month")
    live = months.where("sym % 2 = 0").groupBy("sym").agg(F.max("start").alias("start")).withColumn("live", (F.col("sym") + 1000).cast("double"))
    return S.with_live(months, live).select("sym", "start", F.col("last_close").alias("price"), F.round("ret", 9).alias("ret"))


@query("trend_arrows", f"SELECT sym, d, {PAIR('o', 'c', 'h')} AS pair, CASE WHEN {PAIR('o', 'c', 'h')} = '↑↑' THEN 'green' WHEN {PAIR('o', 'c', 'h')} = '↓↓' THEN 'red' ELSE 'yellow' END AS colour FROM bars", "bars")
def trend_arrows(spark, sf_dir):
    pair = C.arrows(F.col("o"), F.col("c"), F.col("h"))
    return bars(spark, sf_dir).select("sym", "d", pair.alias("pair"), C.arrow_colour(pair).alias("colour"))


view("nweeks", PERIOD.format(u="week", t="nbars", w="WHERE isodow(d) < 6").replace("sym, CAST", "sym, region, CAST", 1).replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3"), ("nbars",))


@query("benchmark_returns", """SELECT n.sym, n.start, pos, b AS benchmark, round(n.ret, 9) AS ret, round(w.ret, 9) AS benchmark_ret, round(n.ret - w.ret, 9) AS excess FROM nweeks n, (VALUES (0), (1)) p(pos)
 JOIN LATERAL (SELECT CASE pos WHEN 0 THEN n.region ELSE (n.region + 1) % 5 END AS b) ON true LEFT JOIN weeks w ON w.sym = b AND w.start = n.start""", "nweeks weeks")
def benchmark_returns(spark, sf_dir):
    own = nation_bars(spark, sf_dir)
    bridge = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sym"), F.array("n_regionkey", (F.col("n_regionkey") + 1) % 5).alias("benchmarks"))
    market = S.period_snapshot(bars(spark, sf_dir), "week")
    got = S.benchmark_returns(S.period_snapshot(own, "week"), bridge, market)
    return rounded(got.select("sym", "start", "pos", "benchmark", "ret", "benchmark_ret", "excess"), "ret", "benchmark_ret", "excess", digits=9)


view("rvols", f"SELECT w.sym, w.start, w.ret, {PAIR('m.mean_5', 'm.mean_10', 'm.mean_20')} AS vt, {PAIR('k.mean_5', 'k.mean_10', 'k.mean_20')} AS pt FROM weeks w JOIN (SELECT *, {MEANS('v', (5, 10, 20))} FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)) m ON w.sym = m.sym AND w.last_day = m.d JOIN (SELECT *, {MEANS('c', (5, 10, 20))} FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)) k ON w.sym = k.sym AND w.last_day = k.d", ("weeks",))


@query("heuristic_flags", """SELECT r.sym, r.start, concat_ws('; ', CASE WHEN r.ret - s.ret > 0.10 THEN 'outruns the market' END, CASE WHEN r.sym % 2 = 1 AND r.ret < 0 AND r.vt = '↑↑' THEN 'falls on rising volume' END,
 CASE WHEN r.pt = '↓↓' AND r.vt NOT IN ('↑↑', '↓↓') THEN 'drifts down on neutral volume' END) AS flags FROM rvols r LEFT JOIN weeks s ON s.sym = 0 AND s.start = r.start""", "rvols weeks")
def heuristic_flags(spark, sf_dir):
    own = bars(spark, sf_dir)
    rv = S.relative_volume(own, "week", [5, 10, 20]).select("sym", "start", "last_day", "ret", F.col("trend").alias("volume_trend"))
    sma = S.sma_alignment(own, [5, 10, 20]).select("sym", F.col("d").alias("last_day"), F.col("trend").alias("price_trend"))
    market = S.period_snapshot(own.where("sym = 0"), "week").select("start", F.col("ret").alias("market_ret"))
    got = rv.join(sma, ["sym", "last_day"]).join(market, "start", "left").withColumn("small_cap", F.col("sym") % 2 == 1)
    return S.heuristic_flags(got).select("sym", "start", F.array_join("flags", "; ").alias("flags"))


@query("poc_profile", """SELECT sym, CASE WHEN hi > lo THEN lo + (b + 0.5) * ((hi - lo) / 100) END AS poc FROM (SELECT sym, lo, hi, arg_max(b, row(vol, -b)) AS b FROM (SELECT sym, lo, hi, least(greatest(floor((h + l - 2 * lo) / 2 / nullif((hi - lo) / 100, 0)), 0), 99) AS b, sum(v) AS vol
 FROM bars JOIN (SELECT sym, min(l) AS lo, max(h) AS hi FROM bars WHERE d >= DATE '1998-01-01' - 50 AND d <= DATE '1998-01-01' GROUP BY 1) USING (sym) WHERE d >= DATE '1998-01-01' - 50 AND d <= DATE '1998-01-01' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)""", "bars")
def poc_profile(spark, sf_dir):
    return S.point_of_control(bars(spark, sf_dir), F.lit("1998-01-01").cast("date"), 50)


view("scells", "SELECT sym, day, slot, v FROM (SELECT sym, day, unnest(range(7)) AS slot, unnest([" + ", ".join(f'"{s}"' for s in S.SESSION) + "]) AS v FROM sgrid)", ("sgrid",))
view("wcells", 'SELECT sym, week, slot, v FROM (SELECT sym, week, unnest(range(5)) AS slot, unnest(["0", "1", "2", "3", "4"]) AS v FROM wgrid)', ("wgrid",))


@query("flow_change", "SELECT sym, week, CAST(slot AS INT) AS slot, v, round(CASE WHEN lag(v) OVER w > 0 THEN v / lag(v) OVER w - 1 END, 9) AS change FROM wcells WINDOW w AS (PARTITION BY sym, slot ORDER BY week)", "wcells")
def flow_change(spark, sf_dir):
    return rounded(S.grid_changes(week_grid(spark, sf_dir), "week", ["0", "1", "2", "3", "4"]), "change", digits=9)


@query("flow_fill_baseline", """SELECT c.sym, day, CAST(slot AS INT) AS slot, v, baseline, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER (PARTITION BY c.sym, day ORDER BY slot ROWS UNBOUNDED PRECEDING) / baseline, 9) END AS fill FROM scells c LEFT JOIN
 (SELECT sym, avg(total) AS baseline FROM (SELECT sym, total, row_number() OVER (PARTITION BY sym ORDER BY day DESC) AS n FROM (SELECT sym, day, sum(v) AS total FROM scells GROUP BY 1, 2 HAVING count(v) = 7)) WHERE n <= 8 GROUP BY 1) b ON c.sym = b.sym""", "scells")
def flow_fill_baseline(spark, sf_dir):
    return rounded(S.grid_fill(session_grid(spark, sf_dir), "day", S.SESSION, 8), "fill", digits=9).select("sym", "day", "slot", "v", "baseline", "fill")


@query("provisional_mask", "SELECT sym, day, CAST(slot AS INT) AS slot, day = max(day) OVER (PARTITION BY sym) AND coalesce(slot = max(CASE WHEN v IS NOT NULL THEN slot END) OVER (PARTITION BY sym, day), false) AS provisional FROM scells", "scells")
def provisional_mask(spark, sf_dir):
    cells = S.grid_changes(session_grid(spark, sf_dir), "day", S.SESSION)
    return S.provisional(cells, "day", S.market_open(F.lit("2024-01-30 15:00:00").cast("timestamp_ntz"))).select("sym", "day", "slot", "provisional")


@query("provisional_week", "SELECT sym, week, CAST(slot AS INT) AS slot, week = max(week) OVER (PARTITION BY sym) AND slot = 1 AS provisional FROM wcells", "wcells")
def provisional_week(spark, sf_dir):
    now = F.lit("2024-01-30 15:00:00").cast("timestamp_ntz")
    return S.provisional_day(S.grid_changes(week_grid(spark, sf_dir), "week", ["0", "1", "2", "3", "4"]), "week", now).select("sym", "week", "slot", "provisional")


@query("quality_flags", """SELECT sym, d, coalesce(v < 0.2 * t, false) AS thin, coalesce(v > 5 * t, false) AS heavy, coalesce(abs(c / nullif(lag(c) OVER (PARTITION BY sym ORDER BY d), 0) - 1) > 0.4, false) AS jump
 FROM (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY sym ORDER BY d DESC) <= 60) JOIN (SELECT sym, median(v) AS t FROM (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY sym ORDER BY d DESC) <= 60) WHERE v > 0 GROUP BY 1) USING (sym)""", "numbered")
def quality_flags(spark, sf_dir):
    """The newest 60 bars of each nation, as one would query them."""
    return S.quality_flags(nation_bars(spark, sf_dir), 60).select("sym", "d", "thin", "heavy", "jump")


@query("bar_moves", "SELECT sym, d, c - o AS move FROM nbars", "nbars")
def bar_moves(spark, sf_dir):
    return nation_bars(spark, sf_dir).select("sym", "d", C.bar_move(F.col("o"), F.col("c")).alias("move"))


@query("market_hours", """SELECT event_id, isodow(t) < 6 AND strftime(t, '%H:%M') >= '09:30' AND strftime(t, '%H:%M') < '16:00' AS is_open FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events)""")
def market_hours(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", S.market_open(F.col("ts").cast("timestamp_ntz")).alias("is_open"))


HOLES = "CASE WHEN sym % 3 = 0 AND d >= DATE '1998-06-01' OR (sym + day(d)) % 7 = 0 THEN NULL ELSE c END AS c"
view("holes", f"SELECT sym, d, {HOLES}, v FROM nbars", ("nbars",))


@query("healed_tail", """SELECT sym, d, c, v FROM holes WHERE c IS NOT NULL UNION ALL SELECT b.sym, b.d, b.c, b.v FROM nbars b JOIN holes h ON b.sym = h.sym AND b.d = h.d AND h.c IS NULL JOIN (SELECT sym, max(d) AS last FROM holes WHERE c IS NOT NULL GROUP BY 1) l ON l.sym = b.sym AND b.d > l.last WHERE day(b.d) % 2 = 0""", "holes")
def healed_tail(spark, sf_dir):
    """Bars with missing closes, and probes of every second day."""
    own = nation_bars(spark, sf_dir).select("sym", "d", "c", "v")
    return I.heal_tail(own.withColumn("c", F.expr(HOLES.removesuffix(" AS c"))), own.where("day(d) % 2 = 0"))


@query("last_dates", "SELECT sym, max(d) AS last FROM nbars GROUP BY 1", "nbars")
def last_dates(spark, sf_dir):
    return readers.last_dates(nation_bars(spark, sf_dir))
