"""Queries over pages, letters, transcripts and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import text as X
from marketloom.plans.views import query, read

CODE = "regexp_replace(regexp_replace({0}, '(?is)<script[^>]*>.*?</script>', '{1}', 'g'), '(?is)<style[^>]*>.*?</style>', '{1}', 'g')"
BLANK = r"[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+".replace("{{", "{").replace("}}", "}")


def unescaped(e: str, entities=X.TEXT_ENTITIES) -> str:
    for a, b in entities:
        e = "replace({}, '{}', '{}')".format(e, a, b.replace("'", "''"))
    return e


def clean(e: str) -> str:
    return rf"trim(regexp_replace({e}, '{BLANK}', ' ', 'g'))"


TAGLESS = lambda e, by: f"regexp_replace({e}, '<[^>]+>', '{by}', 'g')"
COMMENTS = lambda e: f"regexp_replace({e}, '(?s)<!--.*?-->', ' ', 'g')"
LINES = lambda e: rf"regexp_replace({e}, '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>', chr(10), 'g')"


@query("html_strip", f"SELECT page_id, {clean(unescaped(TAGLESS(COMMENTS(CODE.format('html', ' ')), ' ')))} AS text FROM pages")
def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.page_text(F.col("html")).alias("text"))


@query("html_blocks", rf"""SELECT page_id, pos, block FROM (SELECT page_id, unnest(b) AS block, unnest(range(len(b))) AS pos FROM (SELECT page_id,
 list_filter(list_transform(string_split({unescaped(TAGLESS(LINES(CODE.format('html', '')), ''))}, chr(10)), lambda x: {clean('x')}), lambda x: x <> '') AS b FROM pages))""")
def html_blocks(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(X.blocks(X.strip_code(F.col("html")))).alias("pos", "block")).select("page_id", F.col("pos").cast("long").alias("pos"), "block")


TABLE = "'<table class=\"report\" id=\"r\"><tr><th colspan=\"2\">Item<span style=\"x\"></span></th><th>Value</th></tr><tr><td>&#160;</td></tr><TR><td>' || p_name || '&#160;</td><td>' || p_brand || ' &amp; co&#8217;s &middot;</td><td><b>' || p_size || '</b></td><td colspan=\"0\">gone</td></tr></table>'"
ROWS = "'| Item | Item | Value |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || p_name || ' | ' || p_brand || ' & co''s · | ' || p_size || ' |'"


@query("html_table_cells", f"SELECT p_partkey, {ROWS} AS table_text FROM part")
def html_table_cells(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.markdown(X.table_rows(F.expr(TABLE))).alias("table_text"))


@query("report_table", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {ROWS} ELSE '| lone | ' || p_size || ' |' || chr(10) || '|---|---|' END AS table_text FROM part")
def report_table(spark, sf_dir):
    """Files with a table of class report beside another, and files without one."""
    page = F.concat(F.lit("<tr><td>lone</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr>"), F.when(F.col("p_partkey") % 2 == 0, F.expr(TABLE)).otherwise("<p>no table</p>"))
    return read(spark, sf_dir, "part").select("p_partkey", X.report_table(page).alias("table_text"))


EXHIBIT = f"""'<style>p {{}}</style><h1>Letter &#8220;' || p_name || '&#8221;</h1><p>a<br/>b &nbsp; &#8203;c</p>stray</table>tail' || {TABLE} || '<table><tr><td> </td></tr></table><div>&amp;#38; it&#8216;s</div><script>x</script>'"""


@query("exhibit_markdown", f"""SELECT p_partkey, 'Letter "' || p_name || '"' || chr(10) || chr(10) || 'a' || chr(10) || chr(10) || 'b c' || chr(10) || chr(10) || 'straytail' || chr(10) || chr(10) || {ROWS} || chr(10) || chr(10) || '& it''s' AS body FROM part""")
def exhibit_markdown(spark, sf_dir):
    """Text, tables and blank tables in turn; headings are plain blocks."""
    return read(spark, sf_dir, "part").select("p_partkey", X.exhibit(F.expr(EXHIBIT)).alias("body"))


ONE = lambda c: f"'| ' || {c} || ' | 1 |' || chr(10) || '|---|---|'"


@query("press_classify", f"""SELECT p_partkey, 'income' AS kind, {ONE('p_name')} || chr(10) || chr(10) || {ONE('p_brand')} AS body FROM part UNION ALL SELECT p_partkey, 'balance', {ONE('p_type')} FROM part
 UNION ALL SELECT p_partkey, 'cashflow', CASE WHEN p_partkey % 2 = 0 THEN {ONE('p_brand')} ELSE {ONE('p_type')} || chr(10) || chr(10) || {ONE('p_brand')} END FROM part""")
def press_classify(spark, sf_dir):
    """Neighbouring tables of one type join, blank ones don't part them, an unnamed one does (even keys), and a name over 500 characters back is none."""
    table = lambda c: F.concat(F.lit("<table><tr><td>"), c, F.lit("</td><td>1</td></tr></table>"))
    unnamed = F.when(F.col("p_partkey") % 2 == 0, table(F.lit("notes"))).otherwise("")
    far = F.concat(F.lit("<p>Balance sheet</p>"), F.repeat(F.lit("word "), 120))
    page = F.concat(F.lit("<p>Condensed Statement of\nIncome</p>"), table(F.col("p_name")), F.lit("<p>Income statement</p><table><tr><td> </td></tr></table><b>Income statement</b>, continued"), table(F.col("p_brand")), F.lit("<p>Financial position</p>"), table(F.col("p_type")),
        far, table(F.lit("none")), F.lit("Cash flows from operations"), table(F.col("p_type")), unnamed, F.lit("Statements of Cash Flow"), table(F.col("p_brand")))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # a small file makes many pages, which one task would parse
    return dealt.select("p_partkey", F.explode(X.press_statements(page)).alias("kind", "body"))


@query("xml_report_index", """SELECT p_partkey, kind, short_name, file FROM part, (VALUES ('income', 'Earnings', 'R2.htm'), ('balance', 'A & B', 'R5.htm'), ('cashflow', 'C', 'R7.htm')) t(kind, short_name, file) WHERE kind <> 'cashflow' OR p_partkey % 2 = 0""")
def xml_report_index(spark, sf_dir):
    """The first report of each type: parenthetical ones, those without a file and later ones of a type are left out; a second income report may still be the first of another type."""
    one = lambda long, short, file: f"<Report><LongName>{long}</LongName><ShortName> {short} </ShortName>" + (f"<HtmlFileName>{file}</HtmlFileName>" if file else "") + "</Report>"
    head = '<?xml version="1.0"?><FilingSummary xmlns="urn:x"><MyReports>' + one("1 - Cover", "Cover", "R1.htm") + one("2 - CONSOLIDATED STATEMENTS OF EARNINGS", "Earnings", "R2.htm") + one("3 - Balance Sheets (Parenthetical)", "P", "R3.htm") + one("4 - Balance Sheet", "no file", "")
    head += one("5 - Earnings and financial position", "A &amp; B", "R5.htm") + one("6 - Statements of operations", "late", "R6.htm")
    xml = F.concat(F.lit(head), F.when(F.col("p_partkey") % 2 == 0, one("7 - Cash Flow", "C", "R7.htm")).otherwise(""), F.lit("</MyReports></FilingSummary>"))
    return read(spark, sf_dir, "part").select("p_partkey", F.inline(X.statement_reports(X.report_index(xml))))


LETTER = "CASE WHEN doc_id % 3 = 0 THEN 'EX-99.1' || chr(10) || 'Q3  2024 results of the quarter' || chr(10) || '&#167; a line with a section mark in it' || chr(10) WHEN doc_id % 3 = 1 THEN 'logo' || chr(10) || '&#167; another line with that mark' || chr(10) ELSE '' END || text"


LONG = "length(replace(b[i], ' ', '')) >= 20 AND NOT contains(b[i], '&#167;')"


@query("letter_cleanup", rf"""SELECT doc_id, CASE WHEN length(t) >= 500 THEN CASE WHEN len(list_filter(range(1, len(b) + 1), lambda i: {LONG})) > 0
 THEN regexp_replace(array_to_string(list_slice(b, list_filter(range(1, len(b) + 1), lambda i: {LONG})[1], len(b)), chr(10) || chr(10)), '^{BLANK}|{BLANK}$', '', 'g') ELSE '' END END AS letter
 FROM (SELECT doc_id, t, string_split(substr(t, 1 + CASE WHEN regexp_matches(t, 'Q\d\s+20\d\d\b') THEN length(regexp_extract(t, '(?s)^(.*?)Q\d\s+20\d\d\b', 1)) ELSE 0 END), chr(10)) AS b FROM (SELECT doc_id, {LETTER} AS t FROM documents))""")
def letter_cleanup(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.letter(F.expr(LETTER.replace("chr(10)", r"'\n'"))).alias("letter"))


@query("transcript_blocks", "SELECT conv_id, CASE WHEN length(b) > 200 THEN b END AS transcript, p AS preliminary FROM (SELECT conv_id, string_agg('**' || CASE WHEN role = 'system' THEN 'Unattributed' ELSE role END || ':** ' || replace(coalesce(text, ''), '$', '\\$'), chr(10) || chr(10) ORDER BY turn, text) AS b, bool_or(role = 'system') AS p FROM conversations GROUP BY 1)".replace("\\\\", "\\"))
def transcript_blocks(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("speaker", F.when(F.col("role") != "system", F.col("role")))
    return X.transcripts(turns, "conv_id", "turn", "speaker", "text", 200)


SAID = "replace(replace(coalesce(text, ''), '<', ' '), '>', ' ')"


@query("transcript_page", f"""SELECT conv_id, transcript, preliminary FROM (SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN '**Unattributed:** first' || chr(10) || chr(10) || '**Unattributed:** ' || s ELSE '**' || role || ':** first ' || s END, chr(10) || chr(10) ORDER BY turn, text) AS transcript, bool_or(role = 'system') AS preliminary
 FROM (SELECT *, replace({SAID} || ' 5$', '$', chr(92) || '$') AS s FROM conversations WHERE {SAID} <> '') GROUP BY 1) WHERE length(transcript) > 2000""")
def transcript_page(spark, sf_dir):
    """Pages of one block a turn, whose name is missing for the system, each with two paragraphs, the second of two sentences."""
    turns = read(spark, sf_dir, "conversations").withColumn("said", F.expr(SAID)).where("said <> ''")
    name = F.when(F.col("role") != "system", F.concat(F.lit('<div class="text-lg font-bold"> '), "role", F.lit(" </div>"))).otherwise("")
    block = F.concat(F.lit('<div class="border-t border-sharp pt-5 x">'), name, F.lit('<p><span class="transcript-sentence">first</span></p><p class="y"><span id="1" class="transcript-sentence">'), "said", F.lit('</span><span class="transcript-sentence">5$</span><i>left out</i></p></div>'))
    pages = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", block.alias("b")))), lambda x: x.b), "\n").alias("body"))
    page = F.concat(F.lit('<p>menu</p><div aria-label="Full transcript">intro'), "body", F.lit("</div>"))
    return pages.select("conv_id", X.transcript_page(page).alias("x")).where("x IS NOT NULL").select("conv_id", "x.transcript", "x.preliminary")


@query("prelim_final", "SELECT user_id, arg_max(props, row(CAST(value > 50 AS INT), ts, event_id)) AS props, max(CAST(value > 50 AS INT)) AS is_final FROM events GROUP BY 1")
def prelim_final(spark, sf_dir):
    own = read(spark, sf_dir, "events").withColumn("final", F.col("value") > 50)
    return X.final_or_preliminary(own, ["user_id"], "props", "final", ["ts", "event_id"])


@query("tweet_normalize", "SELECT event_id, CAST(event_id AS VARCHAR) AS tweet_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS text, 'u' || user_id AS screen_name, CASE WHEN event_id % 3 = 0 THEN 'n' ELSE '' END AS name, CASE WHEN event_id % 2 = 0 THEN user_id ELSE 0 END AS likes, CAST(0 AS BIGINT) AS retweets, CAST(7 AS BIGINT) AS comments, 'x/' || event_id AS tweet_url FROM events WHERE event_id % 5 > 0")
def tweet_normalize(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    likes, name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "likes": '), text("user_id"))).otherwise(""), F.when(F.col("event_id") % 3 == 0, F.lit(', "name": "n"')).otherwise("")
    own_id = F.when(F.col("event_id") % 5 > 0, text("event_id")).otherwise("")
    raw = F.concat(F.lit('{"tweet_id": "'), own_id, F.lit('", "timestamp": "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('", "text": "  '), "event_type", F.lit(' \\n", "comments": 7, "tweet_url": "x/'), text("event_id"), F.lit('", "user": {"screen_name": "u'), text("user_id"), F.lit('"'), name, F.lit("}"), likes, F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", X.post_record(raw).alias("x")).where("x IS NOT NULL").select("event_id", "x.*")


@query("posts_newest", "SELECT user_id, tweet_id, position FROM (SELECT user_id, CAST(event_id AS VARCHAR) AS tweet_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(date_trunc('hour', ts) AS VARCHAR) DESC, CAST(event_id AS VARCHAR) DESC) AS position FROM events) WHERE position <= 5")
def posts_newest(spark, sf_dir):
    posts = read(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("tweet_id"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return X.newest_posts(posts, 5, ["user_id"]).select("user_id", "tweet_id", "position")


@query("cache_key", "SELECT event_id, substr(sha1(event_type || '|' || user_id), 1, 16) AS key FROM events")
def cache_key(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", X.cache_key(F.concat_ws("|", "event_type", F.col("user_id").cast("string"))).alias("key"))


@query("accession_format", "SELECT o_orderkey, substr(a, 1, 10) || '-' || substr(a, 11, 2) || '-' || substr(a, 13, 6) AS accession, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik FROM (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS a FROM orders) WHERE o_orderkey % 4 > 0")
def accession_format(spark, sf_dir):
    """Addresses of filings; every fourth names none."""
    url = F.concat(F.when(F.col("o_orderkey") % 4 > 0, "https://x/Archives/edgar/data/").otherwise("https://x/other/"), F.col("o_custkey").cast("string"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0"), F.lit("/a.htm"))
    return read(spark, sf_dir, "orders").select("o_orderkey", X.filing_of(url).alias("x")).where("x IS NOT NULL").select("o_orderkey", "x.accession", "x.cik")


@query("first_exhibit", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'https://www.sec.gov/Archives/edgar/data/' || p_partkey || '/12/d_EX-99' || p_size || '.htm' END AS url FROM part")
def first_exhibit(spark, sf_dir):
    key, size = (F.col(c).cast("string") for c in ("p_partkey", "p_size"))
    link = F.when(F.col("p_partkey") % 3 < 2, F.concat(F.lit('<a HREF="/Archives/edgar/data/'), key, F.lit("/12/d_EX-99"), size, F.lit('.htm">x</a>'))).otherwise("")
    page = F.concat(F.lit('<a href="/Archives/edgar/data/1/2/main.htm">m</a><a href="/other/ex99.htm">o</a>'), link, F.lit('<a href="/Archives/edgar/data/x/2/ex99-2.htm">l</a>'))
    return read(spark, sf_dir, "part").select("p_partkey", X.first_exhibit(page).alias("url"))
