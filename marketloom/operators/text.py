"""Documents: HTML to text, tables and blocks, statements, letters, transcripts, records. Column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entities in table cells and their text, in the order they are replaced (fixed values).
CELL_ENTITIES = [("&#160;", ""), ("&nbsp;", ""), ("&#8212;", "—"), ("&#8211;", "–"), ("&#8203;", ""), ("&#8217;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&middot;", "·")]
#: Entities in running text and their text, in the order they are replaced (fixed values).
TEXT_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#160;", " "), ("&#8212;", "—"), ("&#8211;", "–"), ("&#8217;", "'"), ("&#8216;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&#8203;", ""), ("&#38;", "&")]
#: Words that tell statements apart in a press release, first type wins (fixed values).
PRESS_WORDS = {
    "income": ["statements of income", "statement of income", "income statement", "statements of operations", "statement of operations", "statements of earnings", "statement of earnings"],
    "balance": ["balance sheet", "financial position"],
    "cashflow": ["statements of cash flow", "statement of cash flow", "cash flows from"],
}
#: Words that tell reports apart in a filing's index, first type wins; and a word of those to be left out (fixed values).
INDEX_WORDS = {"income": ["statements of operations", "statements of income", "earnings"], "balance": ["balance sheet", "financial position"], "cashflow": ["cash flow"]}
LEFT_OUT = "parenthetical"
#: Headings of a report's statements (fixed values).
SECTIONS = {"income": "## Statements of Operations", "balance": "## Balance Sheet", "cashflow": "## Statements of Cash Flows"}
#: White space as Unicode has it, and the separators of files, groups, records and units.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Stands at both ends of a table while a page is cut; no character of a text.
EDGE = "\uffff"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often it stands in use; Spark shares no expressions within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gone(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def unescape(text: Column, entities: list[tuple[str, str]]) -> Column:
    for entity, plain in entities:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(gone(text, SPACE, " "))


def strip_code(html: Column, by: str = "") -> Column:
    return gone(html, r"(?is)<(script|style)[^>]*>.*?</\1>", by)


def cell_text(html: Column) -> Column:
    """A cell's text: empty spans and tags out, entities in, white space squeezed."""
    return squeeze(unescape(gone(gone(html, r"<span[^>]*></span>"), r"<[^>]+>"), CELL_ENTITIES))


def page_text(html: Column) -> Column:
    """All text of a page, tags as spaces."""
    return squeeze(unescape(gone(gone(strip_code(html, " "), r"(?s)<!--.*?-->", " "), r"<[^>]+>", " "), TEXT_ENTITIES))


def blocks(html: Column, headings: bool = False) -> Column:
    """An array of the text blocks of a piece without tables: line-like tags end a block; headings become #-lines only where asked for."""
    if headings:
        for level in range(1, 7):
            html = gone(html, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>", f"\n{'#' * min(level + 1, 4)} $1\n")
    lines = F.split(gone(html, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n"), "\n")
    # A tag may span lines, so tags go before lines are parted.
    lines = F.split(unescape(gone(F.array_join(lines, "\n"), r"<[^>]+>"), TEXT_ENTITIES), "\n")
    return F.filter(F.transform(lines, squeeze), lambda x: x != "")


def table_rows(html: Column) -> Column:
    """An array of rows of a table, each an array of cell texts; a cell is repeated as its colspan says; blank rows are left out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))

    def cells(row: Column) -> Column:
        raw = F.regexp_extract_all(row, F.lit(r"(?is)<t([dh])([^>]*)>(.*?)</t\1>"), F.lit(0))
        part = lambda c, k: F.regexp_extract(c, r"(?is)^<t[dh]([^>]*)>(.*)</t[dh]>$", k)
        span = lambda c: F.coalesce(F.nullif(F.regexp_extract(part(c, 1), r'colspan="(\d+)"', 1), F.lit("")).cast("int"), F.lit(1))
        return F.flatten(F.transform(raw, lambda c: F.array_repeat(cell_text(part(c, 2)), span(c))))

    return F.filter(F.transform(rows, cells), lambda r: F.exists(r, lambda c: c != ""))


def markdown(rows: Column) -> Column:
    """Rows as a table padded to the widest, with the rule after the first; empty without rows."""

    def padded(rows: Column, width: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
        return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")).when(rows.isNotNull(), "")

    return once(rows, lambda own: once(F.array_max(F.transform(own, lambda r: F.size(r))), lambda width: padded(own, width)))


def report_table(html: Column) -> Column:
    """A report file as a table: that of class report, else all rows of the page."""
    own = F.regexp_extract(html, r'(?is)<table[^>]*class="report"[^>]*>(.*?)</table>', 1)
    return markdown(table_rows(F.when(own != "", own).otherwise(html)))


def around_tables(html: Column) -> Column:
    """A page cut at its tables: an array of pieces of text and tables, in turn, beginning with text."""
    return F.split(gone(html, r"(?is)<table[^>]*>.*?</table>", f"{EDGE}$0{EDGE}"), EDGE)


def exhibit(html: Column) -> Column:
    """An exhibit: its text blocks and its tables in order, parted by blank lines."""
    pieces = around_tables(strip_code(html))
    each = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, blocks(p)).otherwise(F.array(markdown(table_rows(p)))))
    return F.array_join(F.filter(F.flatten(each), lambda b: b != ""), "\n\n")


def first_type(text: Column, words: dict[str, list[str]], without: Column | None = None) -> Column:
    """The first type of which a word stands in the text, but those in the array without; else null."""
    out = F.when(F.lit(False), "")
    for kind, own in words.items():
        hit = F.lit(False)
        for w in own:
            hit = hit | text.contains(w)
        out = out.when(hit if without is None else hit & ~F.array_contains(without, kind), kind)
    return out


def press_statements(html: Column) -> Column:
    """A map of statement type to its tables.

    A table is named by the last 500 characters of text before it; one without a name is left out, and parts what stands on either
    side. Neighbouring tables of one type are joined by a blank line; a later separate one takes the place of an earlier.
    """
    last = lambda t: once(F.lower(gone(gone(t, r"<[^>]+>", " "), SPACE, " ")), lambda own: F.right(own, F.lit(500)))
    name = lambda t: once(last(t), lambda own: first_type(own, PRESS_WORDS))

    def tables(pieces: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2))
        named = F.transform(places, lambda i: F.struct(name(F.get(pieces, i - 1)).alias("kind"), markdown(table_rows(F.get(pieces, i))).alias("body")))
        return F.when(F.size(pieces) > 1, named).when(pieces.isNotNull(), F.array().cast("array<struct<kind:string,body:string>>"))

    named = once(around_tables(strip_code(html)), tables)
    empty = F.struct(F.lit(None).cast("string").alias("last"), F.create_map().cast("map<string,string>").alias("found"))

    def step(a: Column, p: Column) -> Column:
        joined = F.when(a.last.eqNullSafe(p.kind) & F.map_contains_key(a.found, p.kind), F.concat(F.get(F.array(a.found[p.kind]), F.lit(0)), F.lit("\n\n"), p.body)).otherwise(p.body)
        rest = F.map_filter(a.found, lambda k, _: k != p.kind)
        return F.when(p.kind.isNull(), F.struct(p.kind.alias("last"), a.found.alias("found"))).when(p.body == "", a).otherwise(F.struct(p.kind.alias("last"), F.map_concat(rest, F.create_map(F.coalesce(p.kind, F.lit("")), joined)).alias("found")))

    return F.aggregate(named, empty, step, lambda a: a.found)


def letter(body: Column, least: int = 500) -> Column:
    """A letter's body from its first 'Q<n> <year>' on, without short leading lines, its lines parted by blank lines; null under least characters."""
    start = F.regexp_instr(body, F.lit(r"Q\d\s+20\d\d\b"))
    lines = F.split(F.when(start > 0, F.substr(body, start)).otherwise(body), "\n")
    keep = lambda x: (F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 20) & ~x.contains("&#167;")
    first = F.array_position(F.transform(lines, keep), True)
    kept = F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n\n")).otherwise("")
    return F.when(F.length(body) >= least, gone(kept, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"))


def quarter_title(quarter: Column) -> Column:
    return F.replace(F.upper(quarter), F.lit("-"), F.lit(" "))


def letter_file(ticker: Column, day: Column, quarter: Column, body: Column, url: Column) -> Column:
    """The file of a letter: a header and the body."""
    return F.concat(F.lit("# "), ticker, F.lit(" — "), quarter_title(quarter), F.lit(" Shareholder Letter\n\n**Announcement date:** "), day, F.lit("  \n**Source:** "), url, F.lit("\n\n---\n\n"), body, F.lit("\n"))


def report_file(ticker: Column, day: Column, quarter: Column, period_end: Column, statements: Column, url: Column) -> Column:
    """The file of a report: a header and the statements that a map has, in fixed order."""
    parts = F.array_compact(F.array(*(F.concat(F.lit(f"{title}\n\n"), statements[kind]) for kind, title in SECTIONS.items())))
    return F.concat(F.lit("# "), ticker, F.lit(" — "), quarter_title(quarter), F.lit(" Financial Statements\n\n**Announcement date:** "), day, F.lit("  \n**Period ended:** "), period_end, F.lit("  \n**Source:** "), url, F.lit("\n\n---\n\n"), F.array_join(parts, "\n\n"), F.lit("\n"))


def transcript_file(ticker: Column, day: Column, quarter: Column, body: Column, url: Column, preliminary: Column) -> Column:
    """The file of a transcript: a header that says whether it is preliminary, and the body."""
    title = F.when(preliminary, " Preliminary Earnings Call Transcript").otherwise(" Earnings Call Transcript")
    return F.concat(F.lit("# "), ticker, F.lit(" "), quarter_title(quarter), title, F.lit("\n\n**Announcement date:** "), day, F.lit("  \n**Source:** "), url, F.lit("\n\n---\n\n"), body, F.lit("\n"))


REPORT = "struct<LongName:string,ShortName:string,HtmlFileName:string>"
#: A filing summary as a schema: its reports stand in a list of their own, or right in the document.
SUMMARY = f"MyReports struct<Report:array<{REPORT}>>, Report array<{REPORT}>"


def report_index(xml: Column) -> Column:
    """Reports of a filing summary, read by a schema: an array of (long_name, short_name, file), a missing tag being empty.

    Sections of character data and entities of any kind come out as their text; text that isn't well-formed has no reports.
    """
    read = F.from_xml(xml, SUMMARY, {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"})
    none = F.array().cast(f"array<{REPORT}>")
    reports = F.concat(F.coalesce(read.MyReports.Report, none), F.coalesce(read.Report, none))
    told = lambda x: F.coalesce(x, F.lit(""))
    return F.transform(reports, lambda r: F.struct(told(r.LongName).alias("long_name"), F.trim(told(r.ShortName)).alias("short_name"), told(r.HtmlFileName).alias("file")))


def statement_reports(index: Column) -> Column:
    """Of report_index's array the first report of each statement type: an array of (kind, short_name, file) in order.

    The long name tells the type; reports without a file and parenthetical ones are left out.
    """
    empty = F.array().cast("array<struct<kind:string,short_name:string,file:string>>")

    def step(out: Column, r: Column) -> Column:
        low = F.lower(r.long_name)
        kind = first_type(low, INDEX_WORDS, F.transform(out, lambda x: x.kind))
        return F.when((r.file != "") & ~low.contains(LEFT_OUT) & kind.isNotNull(), F.concat(out, F.array(F.struct(kind.alias("kind"), r.short_name.alias("short_name"), r.file.alias("file"))))).otherwise(out)

    return F.aggregate(index, empty, step)


#: How a transcript's page marks its article, blocks, names and sentences (fixed values).
ARTICLE = r'(?s)aria-label="Full transcript">(.*)'
BLOCK = r'<div class="border-t border-sharp pt-5[^"]*">'
SPEAKER = r"<div[^>]*text-lg font-bold[^>]*>([^<]+)</div>"
SENTENCE = r"<span[^>]*transcript-sentence[^>]*>([^<]+)</span>"
PARAGRAPH = r"(?s)<p[^>]*>(.*?)</p>"
UNATTRIBUTED = "Unattributed"


def transcript_page(html: Column, least: int = 2000) -> Column:
    """(transcript, preliminary) of a transcript's page: a paragraph a named block, one a paragraph of unnamed ones.

    Paragraphs without a speaker are marked and make it preliminary. Null without an article or up to least characters.
    """
    article = F.nullif(F.regexp_extract(html, ARTICLE, 1), F.lit(""))
    parts = F.split(article, BLOCK)
    parts = F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts) - 1)).otherwise(parts)
    sentences = lambda t: F.replace(F.array_join(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(1)), " "), F.lit("$"), F.lit("\\$"))

    def paragraphs(part: Column) -> Column:
        own = F.regexp_extract_all(part, F.lit(PARAGRAPH), F.lit(1))
        return F.filter(F.transform(F.when(F.size(own) > 0, own).otherwise(F.array(part)), sentences), lambda x: x != "")

    def lines(part: Column) -> Column:
        speaker, texts = squeeze_ends(F.regexp_extract(part, SPEAKER, 1)), paragraphs(part)
        named = F.filter(F.array(F.array_join(texts, " ")), lambda x: x != "")
        marked = lambda who: lambda x: F.concat(F.lit("**"), who, F.lit(":** "), x)
        return F.when(F.regexp_like(part, F.lit(SPEAKER)), F.transform(named, marked(speaker))).otherwise(F.transform(texts, marked(F.lit(UNATTRIBUTED))))

    body = F.array_join(F.flatten(F.transform(parts, lines)), "\n\n")
    unnamed = F.exists(parts, lambda p: ~F.regexp_like(p, F.lit(SPEAKER)) & (F.size(paragraphs(p)) > 0))
    return F.when(F.length(body) > least, F.struct(body.alias("transcript"), unnamed.alias("preliminary")))


def squeeze_ends(text: Column) -> Column:
    return gone(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$")


def transcripts(turns: DataFrame, key: str, order: str, speaker: str, text: str, least: int = 2000) -> DataFrame:
    """One text a key of its turns in order; a turn without a speaker is unattributed and makes it preliminary; null up to least characters."""
    own = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(speaker).alias("s")))).alias("x"))
    line = lambda r: F.concat(F.lit("**"), F.coalesce(F.nullif(r.s, F.lit("")), F.lit(UNATTRIBUTED)), F.lit(":** "), F.replace(F.coalesce(r.t, F.lit("")), F.lit("$"), F.lit("\\$")))
    body = F.array_join(F.transform("x", line), "\n\n")
    return own.select(key, F.when(F.length(body) > least, body).alias("transcript"), F.exists("x", lambda r: F.coalesce(r.s, F.lit("")) == "").alias("preliminary"))


def final_or_preliminary(versions: DataFrame, keys: list[str], text: str, final: str, order: list[str]) -> DataFrame:
    """The last final version of each key, else its last preliminary one."""
    rank = F.struct(F.col(final).cast("int"), *order)
    return versions.groupBy(*keys).agg(F.max_by(text, rank).alias(text), F.max(F.col(final).cast("int")).alias("is_final"))


def post_record(raw: Column) -> Column:
    """A flat record of a raw social post: the id as text, missing texts empty, missing counts zero, the text trimmed; null without an id."""
    j = F.from_json(raw, "tweet_id string, timestamp string, user struct<screen_name:string,name:string>, text string, likes long, retweets long, comments long, tweet_url string")
    empty, zero = (lambda c: F.coalesce(c, F.lit(""))), (lambda c: F.coalesce(c, F.lit(0).cast("long")))
    names = [empty(j.timestamp).alias("timestamp"), empty(j.user["screen_name"]).alias("screen_name"), empty(j.user["name"]).alias("name"), squeeze_ends(empty(j.text)).alias("text")]
    counts = [zero(j[c]).alias(c) for c in ("likes", "retweets", "comments")]
    return F.when(F.coalesce(j.tweet_id, F.lit("")) != "", F.struct(j.tweet_id.alias("tweet_id"), *names, *counts, empty(j.tweet_url).alias("tweet_url")))


def newest_posts(posts: DataFrame, show: int, by: list[str]) -> DataFrame:
    """The newest show posts of each key in by, by their ISO time; ties go to the larger id."""
    order = Window.partitionBy(*by).orderBy(F.desc("timestamp"), F.desc("tweet_id"))
    return posts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= show)


def cache_key(value: Column) -> Column:
    return F.substring(F.sha1(value.cast("binary")), 1, 16)


#: How an exhibit's link looks in a filing's index, and the host before it (fixed values).
EXHIBIT_LINK = r'(?i)href="(/Archives/edgar/data/\d+/\d+/[^"]*(?:ex[-_]?99|exhibit[-_]?99)[^"]*\.htm[^"]*)"'
FILINGS_HOST = "https://www.sec.gov"


def first_exhibit(index_html: Column) -> Column:
    """The address of the first exhibit 99 that a filing's index links to, null without one."""
    link = F.regexp_extract(index_html, EXHIBIT_LINK, 1)
    return F.when(link != "", F.concat(F.lit(FILINGS_HOST), link))


def filing_of(url: Column) -> Column:
    """(cik with ten digits, accession) of a filing's address, null where it names none."""
    cik, number = (F.regexp_extract(url, r"/edgar/data/(\d+)/(\d+)/", k) for k in (1, 2))
    padded = F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik)
    return F.when(number != "", F.struct(padded.alias("cik"), F.concat_ws("-", F.substring(number, 1, 10), F.substring(number, 11, 2), F.substr(number, F.lit(13))).alias("accession")))
