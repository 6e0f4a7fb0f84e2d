"""Queries over quarter records, feeds and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom import tools
from marketloom.functions import columns as C
from marketloom.operators import fundamentals as Q
from marketloom.operators import ingest as I
from marketloom.operators import series as S
from marketloom.sources import readers
from marketloom.plans.views import bars, nation_bars, query, quarters, read, view

FLOWS = ["ytd_ocf", "ytd_ppe", "ytd_software", "ytd_sbc"]
view("alone", "SELECT *, " + ", ".join(f"CASE WHEN qn = 1 THEN {c} WHEN lag(qn) OVER w = qn - 1 THEN {c} - lag({c}) OVER w END AS q_{c}" for c in FLOWS) + " FROM quarters WINDOW w AS (PARTITION BY sym, fy ORDER BY qn)", ("quarters",))
view("capex", "SELECT *, (CASE WHEN ytd_ppe IS NULL THEN 0 ELSE q_ytd_ppe END) + (CASE WHEN ytd_software IS NULL THEN 0 ELSE q_ytd_software END) AS capex_total FROM alone", ("alone",))
view("flows", "SELECT *, q_ytd_ocf - q_ytd_ppe AS fcf, q_ytd_ocf - capex_total AS fcf_strict, q_ytd_ocf - q_ytd_ppe - q_ytd_sbc AS fcf_ex_sbc, q_ytd_ocf - capex_total - q_ytd_sbc AS fcf_strict_ex_sbc FROM capex", ("capex",))
ROWS = lambda n: f"OVER (PARTITION BY sym ORDER BY end_date ROWS {n - 1} PRECEDING)"
TTM = lambda c, n=4: f"CASE WHEN count({c}) {ROWS(n)} = {n} AND count(revenue) {ROWS(n)} = {n} THEN sum({c}) {ROWS(n)} END"
FREE = ["fcf", "fcf_strict", "fcf_ex_sbc", "fcf_strict_ex_sbc"]
view("ttm", "SELECT *, " + ", ".join(f"{TTM(c)} AS ttm_{c}" for c in ["revenue", *FREE]) + f", {TTM('revenue', 3)} AS rev3 FROM flows", ("flows",))
view("years", """SELECT sym, fy, count(DISTINCT qn) = 4 AS complete, nullif(sum(revenue), 0) AS revenue, max(ytd_ocf) FILTER (qn = 4) AS ocf, max(ytd_ppe) FILTER (qn = 4) AS ppe, CASE WHEN max(ytd_ppe) FILTER (qn = 4) IS NOT NULL OR max(ytd_software) FILTER (qn = 4) IS NOT NULL THEN coalesce(max(ytd_ppe) FILTER (qn = 4), 0) + coalesce(max(ytd_software) FILTER (qn = 4), 0) END AS capex_total,
 max(ytd_sbc) FILTER (qn = 4) AS sbc, max(cash) FILTER (qn = 4) AS cash, max(shares) FILTER (qn = 4) AS shares, max(debt) FILTER (qn = 4) AS debt, max(shares_short) FILTER (qn = 4) AS shares_short, max(end_date) FILTER (qn = 4) AS end_date, max(report_date) FILTER (qn = 4) AS report_date, arg_max(est_low, qn) FILTER (qn < 4 AND est_low IS NOT NULL) AS est_low, arg_max(est_high, qn) FILTER (qn < 4 AND est_low IS NOT NULL) AS est_high, arg_max(fy_low, qn) FILTER (qn < 4 AND fy_low IS NOT NULL) AS guide_low, arg_max(fy_high, qn) FILTER (qn < 4 AND fy_low IS NOT NULL) AS guide_high FROM quarters GROUP BY 1, 2""", ("quarters",))


LINES = {"ppe": "ytd_ppe", "software": "ytd_software"}


def records(spark, sf_dir):
    """Quarters with their capex lines as a map."""
    return Q.family_of(quarters(spark, sf_dir), LINES)


def flows(spark, sf_dir):
    return Q.quarter_flows(records(spark, sf_dir)).withColumn("q_ytd_software", F.col("q_ytd_capex")["software"])


@query("standalone_quarter", "SELECT sym, fy, qn, " + ", ".join(f"q_{c}" for c in FLOWS) + " FROM alone", "alone")
def standalone_quarter(spark, sf_dir):
    return flows(spark, sf_dir).select("sym", "fy", "qn", *(f"q_{c}" for c in FLOWS))


@query("capex_family_sum", "SELECT sym, fy, qn, concat_ws(',', CASE WHEN ytd_ppe IS NOT NULL THEN 'ppe' END, CASE WHEN ytd_software IS NOT NULL THEN 'software' END) AS capex_lines, capex_total FROM capex", "capex")
def capex_family_sum(spark, sf_dir):
    return flows(spark, sf_dir).select("sym", "fy", "qn", "capex_lines", "capex_total")


@query("ttm_window", f"SELECT sym, fy, qn, ttm_revenue, {', '.join(f'ttm_{c}' for c in FREE)} FROM ttm", "ttm")
def ttm_window(spark, sf_dir):
    return Q.trailing(flows(spark, sf_dir), ["revenue", *FREE]).select("sym", "fy", "qn", "ttm_revenue", *(f"ttm_{c}" for c in FREE))


@query("fy_rollup", "SELECT sym, fy, complete, revenue, ocf, ppe, capex_total, sbc, cash, shares, debt, shares_short, end_date, report_date FROM years", "years")
def fy_rollup(spark, sf_dir):
    return Q.fiscal_years(records(spark, sf_dir)).drop("guide_low", "guide_high", "est_low", "est_high", "lines")


@query("fy_guidance_last", "SELECT sym, fy, guide_low, guide_high, est_low, est_high FROM years", "years")
def fy_guidance_last(spark, sf_dir):
    return Q.fiscal_years(records(spark, sf_dir)).select("sym", "fy", "guide_low", "guide_high", "est_low", "est_high")


YOY = lambda c: f"(a.{c} - b.{c}) / nullif(abs(b.{c}), 0) AS {c}_yoy"


@query("yoy_growth", f"SELECT a.sym, a.fy, a.qn, {YOY('revenue')}, {YOY('fcf')} FROM flows a LEFT JOIN flows b ON a.sym = b.sym AND a.fy - 1 = b.fy AND a.qn = b.qn", "flows")
def yoy_growth(spark, sf_dir):
    return Q.year_over_year(flows(spark, sf_dir), ["revenue", "fcf"]).select("sym", "fy", "qn", "revenue_yoy", "fcf_yoy")


MID = "((least({0}_low, {0}_high) + greatest({0}_low, {0}_high)) / 2)"


view("latest2", "SELECT sym, fy FROM (SELECT sym, fy, row_number() OVER (PARTITION BY sym ORDER BY fy DESC) AS r FROM years WHERE complete) WHERE r <= 2", ("years",))
view("running", "SELECT sym, fy FROM (SELECT sym, max(fy) AS fy FROM years GROUP BY 1) JOIN years USING (sym, fy) WHERE NOT complete", ("years",))
view("shown", """SELECT sym, fy, qn, is_fy, row_number() OVER (PARTITION BY sym ORDER BY fy DESC, is_fy DESC, qn DESC) AS position FROM (
 SELECT q.sym, q.fy, q.qn, 0 AS is_fy FROM quarters q JOIN (SELECT * FROM latest2 UNION ALL SELECT * FROM running) y ON q.sym = y.sym AND q.fy = y.fy UNION ALL SELECT sym, fy, 0, 1 FROM latest2)""", ("quarters", "latest2", "running"))


@query("guidance_nq_accuracy", f"SELECT a.sym, a.fy, a.qn, b.revenue / {MID.format('a.nq')} - 1 AS accuracy FROM quarters a LEFT JOIN quarters b ON a.sym = b.sym AND a.fy * 4 + a.qn + 1 = b.fy * 4 + b.qn", "quarters")
def guidance_nq_accuracy(spark, sf_dir):
    return Q.next_quarter_accuracy(quarters(spark, sf_dir)).select("sym", "fy", "qn", "accuracy")


@query("guidance_fy_accuracy", f"SELECT a.sym, a.fy, a.qn, y.revenue / {MID.format('a.fy')} - 1 AS accuracy FROM quarters a LEFT JOIN years y ON a.sym = y.sym AND y.complete AND y.fy = a.fy + CASE WHEN a.qn = 4 THEN 1 ELSE 0 END", "quarters years")
def guidance_fy_accuracy(spark, sf_dir):
    return Q.year_accuracy(records(spark, sf_dir)).select("sym", "fy", "qn", "accuracy")


@query("display_columns", "SELECT * FROM shown", "shown")
def display_columns(spark, sf_dir):
    return Q.display_columns(quarters(spark, sf_dir))


FX = "CASE upper(currency) WHEN 'EUR' THEN 0.875 WHEN 'CNY' THEN 7.25 WHEN 'RMB' THEN 7.25 ELSE 1.0 END"
MULT = "CASE unit WHEN 'millions' THEN 1e6 WHEN 'units' THEN 1.0 ELSE 1e3 END"
CAP = "nullif(price * shares * mult, 0)"
view("priced", f"SELECT *, {CAP} AS cap, mult / fx AS factor FROM (SELECT t.*, b.c AS price, {MULT} AS mult, CAST({FX} AS DOUBLE) AS fx FROM ttm t ASOF LEFT JOIN nbars b ON t.sym = b.sym AND t.report_date >= b.d)", ("ttm", "nbars"))
PFCF = lambda c, n: f"CASE WHEN ttm_fcf IS NOT NULL AND ttm_{c} * factor > 0 THEN cap / (ttm_{c} * factor) END AS {n}"
MULTIPLES = "cap / nullif(ttm_revenue * factor, 0) AS ps, " + ", ".join(PFCF(c, n) for c, n in zip(FREE, ("pfcf", "pfcf_strict", "pfcf_ex_sbc", "pfcf_strict_ex_sbc")))
RANGE = lambda p, n, base="0.0": f"cap / nullif(({base} + greatest({p}_low, {p}_high)) * factor, 0) AS {n}_low, cap / nullif(({base} + least({p}_low, {p}_high)) * factor, 0) AS {n}_high"
RANGES = ", ".join((RANGE("nq", "nq_ps", "rev3"), RANGE("fy", "fy_ps"), RANGE("est", "est_ps")))
FORWARD = [f"{n}_{end}" for n in ("nq_ps", "fy_ps", "est_ps") for end in ("low", "high")]


def with_fx(df):
    rates = df.sparkSession.createDataFrame([("EUR", 0.875), ("CNY", 7.25)], "currency string, rate double")
    return Q.with_fx(df, rates)


def priced(spark, sf_dir):
    return Q.priced_quarters(with_fx(records(spark, sf_dir)), nation_bars(spark, sf_dir))


@query("fx_unit_normalize", "SELECT sym, fy, qn, fx, mult, cash * factor AS cash_value, debt * factor AS debt_value, cap, price IS NOT NULL AS show_val FROM priced", "priced")
def fx_unit_normalize(spark, sf_dir):
    return priced(spark, sf_dir).select("sym", "fy", "qn", "fx", "mult", "cash_value", "debt_value", "cap", "show_val")


@query("valuation_multiples", f"SELECT sym, fy, qn, {MULTIPLES} FROM priced", "priced")
def valuation_multiples(spark, sf_dir):
    return priced(spark, sf_dir).select("sym", "fy", "qn", "ps", "pfcf", "pfcf_strict", "pfcf_ex_sbc", "pfcf_strict_ex_sbc")


@query("forward_ps_range", f"SELECT sym, fy, qn, {RANGES} FROM priced", "priced")
def forward_ps_range(spark, sf_dir):
    return priced(spark, sf_dir).select("sym", "fy", "qn", *FORWARD)


LAST4 = "SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY sym ORDER BY end_date DESC) <= 4"
SUMS = {"ttm_" + c: c for c in ["revenue", "q_ytd_ocf", "q_ytd_ppe", "q_ytd_sbc", *FREE]}
view("today", f"SELECT *, nullif(price * shares * mult, 0) AS cap FROM (SELECT sym, {', '.join(f'CASE WHEN count({c}) = 4 THEN sum({c}) END AS {n}' for n, c in SUMS.items())} FROM ({LAST4}) GROUP BY 1) JOIN (SELECT sym, id, shares, rev3, nq_low, nq_high, fy_low, fy_high, est_low, est_high, mult, factor FROM priced QUALIFY row_number() OVER (PARTITION BY sym ORDER BY end_date DESC) = 1) USING (sym) LEFT JOIN (SELECT sym, arg_max(c, d) AS price FROM nbars GROUP BY 1) USING (sym)", ("priced",))


@query("valuation_today", f"SELECT sym, id, cap, {', '.join(SUMS)}, {MULTIPLES}, {RANGES} FROM today", "today")
def valuation_today(spark, sf_dir):
    prices = nation_bars(spark, sf_dir).groupBy("sym").agg(F.max_by("c", "d").alias("price"))
    got = Q.priced_today(with_fx(records(spark, sf_dir)), prices)
    return got.select("sym", "id", "cap", *SUMS, "ps", "pfcf", "pfcf_strict", "pfcf_ex_sbc", "pfcf_strict_ex_sbc", *FORWARD)


@query("fcf_margin", "SELECT sym, fy, qn, fcf, fcf_strict, fcf_ex_sbc, fcf_strict_ex_sbc, fcf / nullif(revenue, 0) AS fcf_margin FROM flows", "flows")
def fcf_margin(spark, sf_dir):
    return flows(spark, sf_dir).select("sym", "fy", "qn", "fcf", "fcf_strict", "fcf_ex_sbc", "fcf_strict_ex_sbc", "fcf_margin")


view("settle", "SELECT c_nationkey AS sym, CAST(o_orderdate AS DATE) AS day, count(*) AS qty FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")


def settlements(spark, sf_dir):
    own = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return own.groupBy(F.col("c_nationkey").alias("sym"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("qty"))


view("short", """SELECT q.*, m.day AS settled, m.qty FROM quarters q LEFT JOIN (SELECT sym, fy, qn, arg_min(row(day, qty), row(gap, day)) AS r FROM (SELECT q.sym, q.fy, q.qn, s.day, s.qty, abs(s.day - q.end_date) AS gap FROM quarters q JOIN settle s ON q.sym = s.sym AND abs(s.day - q.end_date) <= 6) GROUP BY 1, 2, 3) x
 ON q.sym = x.sym AND q.fy = x.fy AND q.qn = x.qn LEFT JOIN settle m ON m.sym = q.sym AND m.day = x.r[1]""", ("quarters", "settle"))


def shorts(spark, sf_dir):
    return S.nearest(quarters(spark, sf_dir), settlements(spark, sf_dir), "sym", "end_date", "day", ["qty"], 6).withColumnsRenamed({"near_day": "settled", "near_qty": "qty"})


@query("nearest_settlement", "SELECT sym, fy, qn, settled, qty FROM short", "short")
def nearest_settlement(spark, sf_dir):
    return shorts(spark, sf_dir).select("sym", "fy", "qn", "settled", "qty")


@query("short_pct_lag", "SELECT sym, fy, qn, shares_short / nullif(shares, 0) * 100 AS pct, CAST(settled - end_date AS INT) AS lag FROM short", "short")
def short_pct_lag(spark, sf_dir):
    return shorts(spark, sf_dir).select("sym", "fy", "qn", Q.short_share(F.col("shares_short"), F.col("shares")).alias("pct"), C.short_lag(F.col("settled"), F.col("end_date")).alias("lag"))


SPLITS = [(0, "1995-06-30", 2.0), (0, "1996-03-01", 0.05), (1, "1994-01-15", 3.0), (2, "1997-07-01", 4.0), (2, "1997-07-02", 0.5)]
view("splits", "SELECT * FROM (VALUES " + ", ".join(f"({a}, DATE '{b}', CAST({c} AS DOUBLE))" for a, b, c in SPLITS) + ") t(sym, effective, split)")


def splits(spark):
    return spark.createDataFrame(SPLITS, "sym int, effective string, split double").withColumn("effective", F.to_date("effective"))


view("adjusted", f"""SELECT *, CASE WHEN {MULT} > 1 THEN round_even(qty * ratio / ({MULT}), 3) ELSE round_even(qty * ratio, 0) END AS adjusted FROM (SELECT s.*, coalesce(r.ratio, 1.0) AS ratio FROM short s
 LEFT JOIN (SELECT a.sym, fy, qn, product(split) AS ratio FROM short a JOIN splits p ON a.sym = p.sym AND p.effective > a.settled GROUP BY 1, 2, 3) r ON s.sym = r.sym AND s.fy = r.fy AND s.qn = r.qn)""", ("short", "splits"))


def adjusted(spark, sf_dir):
    """Quantities are scaled up, so that they count in thousands and millions."""
    return Q.adjusted_short(Q.split_ratio(shorts(spark, sf_dir), splits(spark), "settled"))


@query("split_adjust_short", "SELECT sym, fy, qn, ratio, adjusted FROM adjusted", "adjusted")
def split_adjust_short(spark, sf_dir):
    return adjusted(spark, sf_dir).select("sym", "fy", "qn", "ratio", "adjusted")


@query("short_status", "SELECT sym, fy, qn, CASE WHEN sym % 6 = 0 THEN 'kept' WHEN settled IS NOT NULL THEN 'add' WHEN end_date > DATE '1998-06-01' THEN 'pending' WHEN end_date < DATE '1993-01-01' THEN 'pre-listing' ELSE 'no settlement' END AS status, coalesce(ratio = 1.0 AND adjusted / shares > 0.5, false) AS implausible FROM adjusted", "adjusted")
def short_status(spark, sf_dir):
    day = lambda s: F.lit(s).cast("date")
    status = Q.short_status(F.col("end_date"), day("1998-06-01"), day("1993-01-01"), F.col("settled"), F.when(F.col("sym") % 6 == 0, 1))
    return adjusted(spark, sf_dir).select("sym", "fy", "qn", status.alias("status"), Q.implausible_short(F.col("adjusted"), F.col("shares"), F.col("ratio")).alias("implausible"))


FORM = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '10-Q' WHEN '2' THEN '10-K' WHEN '3' THEN '20-F' WHEN '4' THEN '6-K' ELSE '8-K' END"
view("feed", f"SELECT c_nationkey AS sym, {FORM} AS form, CAST(o_orderdate AS DATE) AS filed, CASE WHEN year(o_orderdate) % 2 = 0 THEN 0 ELSE 1 END AS block, o_orderkey AS pos FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = year(o_orderdate) % 2 OR month(o_orderdate) % 4 > 0")


def feed(spark, sf_dir):
    """Orders as filings: odd years lie in the older block; some months are filed by half of the customers only."""
    own = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_custkey % 2 = year(o_orderdate) % 2 OR month(o_orderdate) % 4 > 0")
    return own.select(F.col("c_nationkey").alias("sym"), F.expr(FORM).alias("form"), F.col("o_orderdate").cast("date").alias("filed"), F.when(F.year("o_orderdate") % 2 == 0, 0).otherwise(1).alias("block"), F.col("o_orderkey").alias("pos"))


@query("nearest_filing_priority", """SELECT q.sym, q.fy, q.qn, x.r[1] AS filed, x.r[2] AS form, x.r[3] AS pos FROM quarters q LEFT JOIN (SELECT q.sym, fy, qn, arg_min(row(f.filed, f.form, f.pos), row(f.block, abs(f.filed - q.end_date), CASE form WHEN '10-Q' THEN 0 WHEN '10-K' THEN 1 WHEN '20-F' THEN 2 ELSE 3 END, f.pos)) AS r FROM quarters q JOIN feed f
 ON q.sym = f.sym AND f.form <> '8-K' AND abs(f.filed - q.end_date) <= 30 GROUP BY 1, 2, 3) x ON q.sym = x.sym AND q.fy = x.fy AND q.qn = x.qn""", "quarters feed")
def nearest_filing_priority(spark, sf_dir):
    return I.nearest_filing(quarters(spark, sf_dir), feed(spark, sf_dir), "end_date").select("sym", "fy", "qn", "filed", "form", "pos")


@query("filings_newest", "SELECT sym, form, filed, pos FROM feed f WHERE form IN ('10-Q', '10-K', '20-F') AND filed >= DATE '1994-06-01' AND (block = 0 OR sym IN (SELECT sym FROM feed WHERE block = 0 GROUP BY 1 HAVING min(filed) >= DATE '1994-06-01'))", "feed")
def filings_newest(spark, sf_dir):
    """Filings since a day; the older block counts only where the recent one ends after that day."""
    return I.filings_since(feed(spark, sf_dir).withColumn("period", F.col("filed")), F.lit("1994-06-01").cast("date")).select("sym", "form", "filed", "pos")


@query("cik_lookup", "SELECT c_custkey, lpad(CAST(k AS VARCHAR), 10, '0') AS cik FROM customer LEFT JOIN (SELECT c_mktsegment AS s, min(c_custkey) AS k FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1) ON s = c_mktsegment")
def cik_lookup(spark, sf_dir):
    own = read(spark, sf_dir, "customer")
    listed = own.where("c_custkey % 5 > 0").select(F.initcap("c_mktsegment").alias("ticker"), F.col("c_custkey").alias("cik_str"), F.col("c_custkey").alias("pos"))
    return I.resolve_cik(own.select("c_custkey", F.lower("c_mktsegment").alias("ticker")), listed).select("c_custkey", "cik")


@query("ordered_distinct", "SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY k) AS segments FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    got = I.ordered_distinct(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "c_custkey")
    return got.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "c_mktsegment"))), lambda x: x.c_mktsegment), ",").alias("segments"))


view("chain", "SELECT p_brand AS sym, DATE '2024-01-01' + CAST(p_partkey % 5 * 4 AS INT) AS expiry, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS side, p_size AS strike, max(p_retailprice / 10000) AS iv FROM part GROUP BY 1, 2, 3, 4")


@query("implied_move", """SELECT sym, expiry, strike, round(iv, 9) AS iv, round(iv * sqrt(1.0 / 52.0) * 100, 6) AS weekly, round(iv * sqrt(1.0 / 12.0) * 100, 6) AS monthly FROM (SELECT sym, expiry, m[1] AS strike, (m[2] + m[3]) / 2 AS iv FROM (SELECT c.sym, c.expiry, arg_min(row(c.strike, c.iv, p.iv), row(abs(c.strike - 25), c.strike)) AS m
 FROM chain c JOIN chain p ON c.sym = p.sym AND c.expiry = p.expiry AND c.strike = p.strike AND c.side = 'call' AND p.side = 'put' JOIN (SELECT sym, arg_min(expiry, row(abs(expiry - DATE '2024-01-01' - 7), expiry)) AS expiry FROM chain WHERE expiry - DATE '2024-01-01' >= 3 GROUP BY 1) e ON c.sym = e.sym AND c.expiry = e.expiry GROUP BY 1, 2))""", "chain")
def implied_move(spark, sf_dir):
    start = F.lit("2024-01-01").cast("date")
    chain = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("sym"), F.date_add(start, (F.col("p_partkey") % 5 * 4).cast("int")).alias("expiry"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("side"), F.col("p_size").alias("strike")).agg(F.max(F.col("p_retailprice") / 10000).alias("iv"))
    got = Q.option_iv(chain, start, F.lit(25))
    return got.select("sym", "expiry", "strike", F.round("iv", 9).alias("iv"), F.round(C.implied_move(F.col("iv")), 6).alias("weekly"), F.round(C.implied_move(F.col("iv"), True), 6).alias("monthly"))


@query("fiscal_label", "SELECT o_orderkey, fye, 'q' || (((m - fye - 1 + 24) % 12) // 3 + 1) || CASE WHEN fye = 12 THEN '-' ELSE '-fy' END || (y + CASE WHEN m <= fye THEN 0 ELSE 1 END) AS label FROM (SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS m, CAST(year(o_orderdate) AS INT) AS y, CAST(o_custkey % 12 + 1 AS INT) AS fye FROM orders)")
def fiscal_label(spark, sf_dir):
    own = read(spark, sf_dir, "orders").withColumn("fye", (F.col("o_custkey") % 12 + 1).cast("int"))
    return own.select("o_orderkey", "fye", C.fiscal_label(F.col("o_orderdate").cast("date"), F.col("fye")).alias("label"))


CUT = "DATE '1998-06-01'"


@query("upsert_bars", f"SELECT sym, d, c, v FROM bars WHERE d < {CUT} AND sym <> 2 UNION ALL SELECT sym, d, c * 2 AS c, v FROM bars WHERE d >= {CUT}", "bars")
def upsert_bars(spark, sf_dir):
    own = bars(spark, sf_dir).select("sym", "d", "c", "v")
    old, new = own.where(f"d < {CUT} + INTERVAL 10 DAYS"), own.where(f"d >= {CUT}").withColumn("c", F.col("c") * 2)
    late = spark.createDataFrame([(2, "2030-01-01", 2.0)], "sym int, effective string, split double").withColumn("effective", F.to_date("effective"))
    return I.upsert_bars(old, new, late)


@query("tail_equality", f"SELECT sym, CASE WHEN sym % 2 = 0 THEN 2 * count(*) ELSE 0 END AS differences FROM bars WHERE d >= {CUT} GROUP BY sym", "bars")
def tail_equality(spark, sf_dir):
    own = bars(spark, sf_dir).select("sym", "d", "c")
    new = own.where(f"d >= {CUT}").withColumn("c", F.col("c") * F.when(F.col("sym") % 2 == 0, 1.5).otherwise(1.0))
    return I.tails_differ(own, new, ["c"])


@query("ledger_antijoin", "SELECT user_id, max(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) GROUP BY 1")
def ledger_antijoin(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return I.unseen(events.select("user_id", "event_id"), events.where("event_type = 'purchase' AND value > 90"), "user_id", [F.col("event_id")])


@query("merge_existing_wins", "SELECT coalesce(a.sym, b.sym) AS sym, coalesce(a.fy, b.fy) AS fy, coalesce(a.qn, b.qn) AS qn, coalesce(a.nq_low, b.nq_low) AS nq_low FROM (SELECT * FROM quarters WHERE fy < 1997) a FULL JOIN (SELECT sym, fy, qn, revenue AS nq_low FROM quarters WHERE fy > 1994) b ON a.sym = b.sym AND a.fy = b.fy AND a.qn = b.qn", "quarters")
def merge_existing_wins(spark, sf_dir):
    own = quarters(spark, sf_dir)
    return I.merge_existing(own.where("fy < 1997").select("sym", "fy", "qn", "nq_low"), own.where("fy > 1994").select("sym", "fy", "qn", F.col("revenue").alias("nq_low")), ["sym", "fy", "qn"])


@query("jobs_missing", """SELECT ticker || '/' || day || '-' || kind AS path, ticker, day, kind, url FROM (SELECT c_mktsegment AS ticker, DATE '2024-01-01' + CAST(c_custkey % 300 AS INT) AS day, kind, CASE kind WHEN 'letter' THEN 'l' || c_custkey WHEN 'report' THEN CASE WHEN c_custkey % 3 > 0 THEN 'r' || c_custkey END END AS url, c_custkey FROM customer, (VALUES ('letter'), ('report')) k(kind))
 WHERE url IS NOT NULL AND (ticker || '/' || day || '-' || kind) NOT IN (SELECT c_mktsegment || '/' || (DATE '2024-01-01' + CAST(c_custkey % 300 AS INT)) || '-letter' FROM customer WHERE c_custkey % 4 = 0)""")
def jobs_missing(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int"))
    own = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("ticker"), day.alias("day"), F.concat(F.lit("l"), F.col("c_custkey").cast("string")).alias("letter"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("r"), F.col("c_custkey").cast("string"))).alias("report"))
    done = own.where("c_custkey % 4 = 0").select(F.concat(F.col("ticker"), F.lit("/"), F.col("day").cast("string"), F.lit("-letter")).alias("path"))
    return I.jobs_missing(own, done, ["letter", "report"])


@query("vendor_fallback", "SELECT s_suppkey AS sym, CASE WHEN o IS NOT NULL AND price IS NOT NULL THEN 'official' WHEN o IS NOT NULL THEN 'skipped' WHEN v IS NOT NULL THEN 'vendor' ELSE 'none' END AS origin, CASE WHEN o IS NOT NULL AND price IS NOT NULL THEN o WHEN o IS NULL THEN v END AS value FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS o, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal * 2 END AS v, CASE WHEN s_suppkey % 5 > 0 THEN 1.0 END AS price FROM supplier)")
def vendor_fallback(spark, sf_dir):
    own = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sym"), F.col("s_acctbal").alias("value"))
    return I.with_fallback(own.select("sym"), own.where("sym % 2 = 0"), own.where("sym % 3 > 0").withColumn("value", F.col("value") * 2), own.where("sym % 5 > 0").select("sym", F.lit(1.0).alias("price")))


@query("feed_arrays_inline", "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderpriority, o_orderdate) - 1 AS pos, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(o_orderdate AS DATE) >= DATE '1995-01-01'")
def feed_arrays_inline(spark, sf_dir):
    own = read(spark, sf_dir, "orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(o_orderdate AS DATE) >= DATE'1995-01-01'")
    packed = own.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderdate"))).alias("x"))
    feed = packed.select("o_custkey", F.transform("x", lambda r: r.o_orderpriority).alias("form"), F.transform("x", lambda r: r.o_orderdate.cast("date")).alias("filed"))
    got = I.rows_of_arrays(feed, ["form", "filed"], ["o_custkey"])
    return I.wanted_filings(got.withColumn("period", F.col("filed")), ["1-URGENT", "2-HIGH"], F.lit("1995-01-01").cast("date")).select("o_custkey", F.col("pos").cast("long").alias("pos"), "form", "filed")


@query("capex_names", "SELECT sym, concat_ws(',', CASE WHEN count(ytd_ppe) > 0 THEN 'ppe' END, CASE WHEN count(ytd_software) > 0 THEN 'software' END) AS lines FROM quarters GROUP BY 1 HAVING count(ytd_ppe) + count(ytd_software) > 0", "quarters")
def capex_names(spark, sf_dir):
    return readers.capex_names(records(spark, sf_dir)).select("sym", F.array_join("lines", ",").alias("lines"))


view("cells", """SELECT a.sym, q_ytd_sbc, coalesce(est_low, est_high) AS est, coalesce(nq_low, nq_high) AS nq, coalesce(fy_low, fy_high) AS guide, shares_short FROM alone a SEMI JOIN shown s ON a.sym = s.sym AND a.fy = s.fy AND a.qn = s.qn
 UNION ALL SELECT sym, sbc, coalesce(est_low, est_high), NULL, coalesce(guide_low, guide_high), shares_short FROM years SEMI JOIN latest2 USING (sym, fy)
 UNION ALL SELECT sym, CASE WHEN count(q_ytd_sbc) = 4 THEN sum(q_ytd_sbc) END, NULL, NULL, NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY end_date DESC) AS r FROM alone) WHERE r <= 4 GROUP BY sym""", ("alone", "shown", "years", "latest2"))


@query("visible_rows", "SELECT c.sym, count(q_ytd_sbc) > 0 AS has_sbc, any_value(two_fcf) AS two_fcf, count(est) > 0 AS has_est, count(nq) > 0 AS has_nq_guide, count(guide) > 0 AS has_fy_guide, count(shares_short) > 0 AS has_short FROM cells c JOIN (SELECT sym, count(ytd_software) > 0 AS two_fcf FROM alone GROUP BY 1) USING (sym) GROUP BY 1", "cells alone")
def visible_rows(spark, sf_dir):
    own, shown = flows(spark, sf_dir), Q.display_columns(quarters(spark, sf_dir))
    cells = own.join(shown.where("is_fy = 0").select("sym", "fy", "qn"), ["sym", "fy", "qn"], "left_semi")
    years = Q.year_columns(Q.fiscal_years(records(spark, sf_dir))).join(shown.where("is_fy = 1").select("sym", "fy"), ["sym", "fy"], "left_semi")
    return Q.visible_rows(cells.unionByName(years, allowMissingColumns=True), own, Q.latest_trailing(own, ["q_ytd_sbc"]))


@query("label_parts", "SELECT o_orderkey, CAST((month(o_orderdate) - 1) // 3 + 1 AS INT) AS qn, CAST(year(o_orderdate) AS INT) AS fy FROM orders")
def label_parts(spark, sf_dir):
    label = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "'q'q-yyyy")).otherwise(F.date_format("o_orderdate", "'q'q'-fy'yyyy"))
    return read(spark, sf_dir, "orders").select("o_orderkey", C.quarter_number(label).alias("qn"), C.fiscal_year(label).alias("fy"))


@query("day_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS day, CAST(o_orderdate AS DATE) AS from_epoch FROM orders")
def day_parse(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 4 > 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise("2024-02-30")
    seconds = F.unix_date(F.col("o_orderdate").cast("date")) * 86400 + F.col("o_orderkey") % 86400
    return read(spark, sf_dir, "orders").select("o_orderkey", C.iso_date(text).alias("day"), C.epoch_day(seconds).alias("from_epoch"))


@query("short_snapshot", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.25 WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS DOUBLE) / 2000 END AS pct_float, CAST(c_custkey AS DOUBLE) AS shares_short, DATE '2024-10-31' AS as_of FROM customer WHERE c_custkey % 10 > 0")
def short_snapshot(spark, sf_dir):
    """Payloads with the vendor's fraction, with the float's shares only, with neither, and without shares short."""
    key = F.col("c_custkey").cast("string")
    more = F.when(F.col("c_custkey") % 3 == 0, ', "shortPercentOfFloat": 0.25').when(F.col("c_custkey") % 3 == 1, ', "floatShares": 2000').otherwise("")
    payload = F.concat(F.lit('{"sharesShort": '), F.when(F.col("c_custkey") % 10 > 0, key).otherwise("0"), more, F.lit(', "dateShortInterest": 1730332800}'))
    return read(spark, sf_dir, "customer").select("c_custkey", C.short_snapshot(payload).alias("x")).where("x IS NOT NULL").select("c_custkey", "x.pct_float", "x.shares_short", "x.as_of")


@query("vendor_row", "SELECT s_suppkey AS sym, 'vendor' AS origin, 2.0 AS price, s_acctbal AS cap, CAST(s_nationkey AS DOUBLE) AS ttm_revenue, CAST(s_nationkey - 12 AS DOUBLE) AS ttm_fcf, s_acctbal / nullif(CAST(s_nationkey AS DOUBLE), 0) AS ps, CASE WHEN s_nationkey > 12 THEN s_acctbal / CAST(s_nationkey - 12 AS DOUBLE) END AS pfcf FROM supplier")
def vendor_row(spark, sf_dir):
    own = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sym"), F.lit(2.0).alias("price"), F.col("s_acctbal").alias("market_cap"), F.col("s_nationkey").cast("double").alias("revenue"), (F.col("s_nationkey") - 12).cast("double").alias("free_cash_flow"))
    return I.vendor_row(own)


@query("success_counts", "SELECT o_orderstatus, count(*) FILTER (o_totalprice > 100000) AS ok, count(*) AS total FROM orders GROUP BY 1")
def success_counts(spark, sf_dir):
    return tools.success(read(spark, sf_dir, "orders").withColumn("fine", F.col("o_totalprice") > 100000), "fine", ["o_orderstatus"])


@query("source_jobs", "SELECT c_mktsegment AS ticker, CAST(c_custkey AS VARCHAR) AS day, 'q1-2024' AS quarter, kind, kind || c_custkey AS url, c_mktsegment || '/quarters/' || c_custkey || '_q1-2024-' || kind || '.md' AS path FROM customer, (VALUES ('report'), ('letter'), ('transcript')) k(kind) WHERE c_custkey % 5 > 0 AND (kind <> 'letter' OR c_custkey % 2 = 0)")
def source_jobs(spark, sf_dir):
    """Manifest entries without a quarter (every fifth), and some without a letter."""
    link = lambda kind: F.concat(F.lit(kind), F.col("c_custkey").cast("string")).alias(kind)
    links = F.struct(F.when(F.col("c_custkey") % 5 > 0, "q1-2024").alias("quarter"), link("report"), F.when(F.col("c_custkey") % 2 == 0, link("letter")).alias("letter"), link("transcript"))
    own = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("ticker"), F.col("c_custkey").cast("string").alias("day"), links.alias("links"))
    return I.source_jobs(own)


view("vendors", "SELECT c_nationkey AS sym, avg(c_acctbal) AS price, sum(c_acctbal) AS market_cap, CAST(count(*) AS DOUBLE) AS revenue, min(c_acctbal) AS free_cash_flow FROM customer GROUP BY 1")


@query("valuation_united", """SELECT sym, origin, id, round(CASE WHEN origin = 'official' THEN t.cap WHEN origin = 'vendor' THEN v.market_cap END, 4) AS cap, round(CASE WHEN origin = 'official' THEN t.ps WHEN origin = 'vendor' THEN v.market_cap / v.revenue END, 4) AS ps,
 round(CASE WHEN origin = 'official' THEN t.pfcf WHEN origin = 'vendor' AND v.free_cash_flow > 0 THEN v.market_cap / v.free_cash_flow END, 4) AS pfcf FROM (SELECT n_nationkey AS sym,
 CASE WHEN n_nationkey % 2 = 0 AND n_nationkey IN (SELECT sym FROM quarters) THEN CASE WHEN n_nationkey % 3 > 0 AND n_nationkey IN (SELECT sym FROM nbars) THEN 'official' ELSE 'skipped' END WHEN n_nationkey % 5 > 0 AND n_nationkey IN (SELECT sym FROM vendors) THEN 'vendor' ELSE 'none' END AS origin FROM nation)
 LEFT JOIN (SELECT sym AS k, id, cap, """ + MULTIPLES + """ FROM today) t ON t.k = sym AND origin = 'official' LEFT JOIN (SELECT sym AS k, * EXCLUDE (sym) FROM vendors) v ON v.k = sym AND origin = 'vendor'""", "today vendors quarters nbars")
def valuation_united(spark, sf_dir):
    """Nations with even keys have figures, a third of them no price; a vendor knows most."""
    prices = nation_bars(spark, sf_dir).groupBy("sym").agg(F.max_by("c", "d").alias("price")).withColumn("price", F.when(F.col("sym") % 3 > 0, F.col("price")))
    official = Q.priced_today(with_fx(records(spark, sf_dir)).where("sym % 2 = 0"), prices)
    vendor = read(spark, sf_dir, "customer").where("c_nationkey % 5 > 0").groupBy(F.col("c_nationkey").alias("sym")).agg(F.avg("c_acctbal").alias("price"), F.sum("c_acctbal").alias("market_cap"), F.count("*").cast("double").alias("revenue"), F.min("c_acctbal").alias("free_cash_flow"))
    tickers = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sym"))
    got = I.united_valuations(tickers, official, I.vendor_row(vendor), prices)
    return got.select("sym", "origin", "id", *(F.round(c, 4).alias(c) for c in ("cap", "ps", "pfcf")))
