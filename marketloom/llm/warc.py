"""Web archives: pages written as WARC records by Spark's text writer, archives read back, and captures put together from their records.

Writing. A page gives a request, a response and a metadata record, each naming the response as concurrent. Of pages with equal payloads (SHA-256) of at least
so many bytes the first by (id, place in the table) is a response, the others are revisits of it, without payload. A record is a header, an empty
line and a block, and ends with two line ends; these are the text writer's line separator, so archives are committed and retried as any
output of Spark is, on any file system it writes to. Archives are gzip files of ARCHIVE_RECORDS records at most.

Reading. Archives (gzip or plain, WARC/1.0 or 1.1) are read by Spark's text reader, parted at an end of a record and the begin of another. A task joins the
pieces of a file again and cuts them by Content-Length, so a payload that quotes a whole record comes out right. An archive with something else
between records, or cut off in one, is an error; so is a plain one in which a quoted record lies over the end of a split (a gzip
file is never split).

Assembly. Records that aren't captures themselves (responses and revisits are) belong to the capture that they name as concurrent, or that
names them, or to that of such a record. Those without one make a capture of their own, without response.

Null and empty payloads have no bytes and are equal; a null address gives no Target-URI and null ids no page-id; equal rows are captures of their
own, and a null id comes after all others. An address's blanks and control characters are written as %XX. Texts of any length are one
record. An empty table gives no archive, and reading none no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.llm.common import new_path, small_batches, table

END = "\r\n"
#: Ends a record's block and begins the next record; without the version's last figure.
BETWEEN = f"{END}{END}WARC/1."
#: Records of an archive at most.
ARCHIVE_RECORDS = 30_000
#: Parts over which the rows of one payload, or of one record that many revisit, are dealt when they are joined.
SALTS = 16
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Types whose records are captures.
CAPTURES = ["response", "revisit", "resource"]


def base32(hexadecimal: Column) -> Column:
    """Hexadecimal digits, five of them as four digits to the base of 32."""
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.length(hexadecimal) / 5).cast("int") - 1), lambda i: F.conv(F.substring(hexadecimal, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    digit = lambda x, n: F.substring(F.lit(BASE32), F.shiftright(x, n).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda x: F.concat(*(digit(x, n) for n in (15, 10, 5, 0)))), "")


def record_id(row: Column, kind: str, archive: str) -> Column:
    """A name for a row's record of a kind, the same wherever it is needed."""
    h = F.md5(F.concat(F.lit(f"{archive}/{kind}/"), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5"), F.lit(">"))


def record(kind: str | Column, name: Column, date: str, block: Column, content: str, fields: dict[str, Column]) -> Column:
    """A record's text, without the line ends after it; fields that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": F.lit(date), **fields, "Content-Type": F.lit(content), "Content-Length": F.octet_length(block).cast("string")}
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(END))) for k, v in head.items()]
    return F.concat(F.lit(f"WARC/1.1{END}"), F.concat_ws("", *lines), F.lit(END), block)


def keyed(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """A working table (row, id, url, payload, bytes, sha1 to the base of 32, same): from here on each page has a name, equal ones too."""
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    own = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), text.alias("payload"))
    binary = F.col("payload").cast("binary")
    return table(own.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": base32(F.sha1(binary)), "same": F.sha2(binary, 256)}), "pages")


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(row, first): pages whose payload an earlier one has, and the row of the first."""
    heads = pages.where(F.col("bytes") >= least).select("row", "id", "same")
    groups = heads.groupBy("same").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("x"), F.count("*").alias("n")).where("n > 1")
    spread = groups.select("same", F.col("x.row").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = heads.select("row", "same", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    return dealt.join(spread, ["same", "salt"]).where("row <> first").select("row", "first")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of the pages in the folder path; payloads of fewer than least bytes are responses all."""
    own = keyed(pages, key, url, payload)
    again = table(revisits(own, least), "revisits")
    rows = own.join(again, "row", "left")
    archive = path.rstrip("/")
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20")
    server, rest = F.regexp_extract(target, "^[^:/]*://([^/]*)", 1), F.regexp_replace(target, "^[^:/]*://[^/]*", "")
    answer = record_id(F.col("row"), "response", archive)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    revisit = F.col("first").isNotNull()
    fields = {"WARC-Target-URI": target}
    digest = {"WARC-Payload-Digest": F.concat(F.lit("sha1:"), "sha1")}
    refers = {"WARC-Refers-To": F.when(revisit, record_id(F.col("first"), "response", archive)), "WARC-Profile": F.when(revisit, F.lit(IDENTICAL))}
    request = F.concat(F.lit("GET "), F.coalesce(F.nullif(rest, F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{END}"), F.coalesce(F.concat(F.lit("Host: "), F.nullif(server, F.lit("")), F.lit(END)), F.lit("")), F.lit(END))
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(END)), F.lit("")), F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(END))
    concurrent = {"WARC-Concurrent-To": answer}
    texts = F.array(
        record("request", record_id(F.col("row"), "request", archive), date, request, "application/http;msgtype=request", fields | concurrent),
        record(F.when(revisit, "revisit").otherwise("response"), answer, date, F.when(revisit, head).otherwise(F.concat(head, "payload")), "application/http;msgtype=response", fields | digest | refers),
        record("metadata", record_id(F.col("row"), "metadata", archive), date, about, "application/warc-fields", fields | concurrent),
    )
    records = rows.select(F.explode(texts).alias("value"))
    writer = records.write.option("lineSep", END + END).option("compression", "gzip").option("zlib.compress.level", "THREE")  # half the time of the default for 5 % more bytes
    writer.option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


#: A record as it is read: headers by their name in small letters, the last of each; payload is what follows an HTTP head, else the block.
RECORD = "type string, id string, date string, url string, concurrent array<string>, refers string, digest string, headers map<string,string>, http string, payload_bytes long, payload_sha1 string, payload binary, file string"


class Cutter:
    """The records of one file, given in pieces."""

    def __init__(self, file: str):
        self.file, self.left = file, b""

    def add(self, piece: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        """Headers and block of each record that is whole now."""
        self.left = self.left + piece if self.left else piece
        while self.left:
            if not self.left.startswith(b"WARC/1."):
                raise ValueError(f"no record where one should begin in {self.file}")
            end = self.left.find(b"\r\n\r\n")
            if end < 0:
                return
            headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in self.left[:end].decode("utf-8", "replace").split("\r\n")[1:])]
            length = next((int(v) for k, v in headers if k.lower() == "content-length"), 0)
            if len(self.left) < end + 4 + length:
                return
            yield headers, self.left[end + 4 : end + 4 + length]
            self.left = self.left[end + 4 + length :].lstrip(b"\r\n")

    def done(self) -> None:
        if self.left:
            raise ValueError(f"{self.file} ends within a record, or is split within one that quotes another: compress it")


def told(headers: list[tuple[str, str]], block: bytes, file: str, keep: bool) -> tuple:
    """A row of RECORD."""
    own = {k.lower(): v for k, v in headers}
    http, payload = None, block
    if own.get("content-type", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    concurrent = [v for k, v in headers if k.lower() == "warc-concurrent-to"]
    keep = keep or own.get("content-type", "") == "application/warc-fields"
    return own.get("warc-type"), own.get("warc-record-id"), own.get("warc-date"), own.get("warc-target-uri"), concurrent, own.get("warc-refers-to"), own.get("warc-payload-digest"), list(own.items()), http, len(payload), sha1, payload if keep else None, file


def records(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """The records of archives, as RECORD. Without keep, payloads are measured and hashed but not returned, save those of warc-fields."""
    small_batches(spark)
    own = spark.read.option("lineSep", BETWEEN).text(path)
    pieces = own.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    schema = spark.createDataFrame([], RECORD).schema
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter = None, Cutter("")
        for batch in batches:
            rows = []
            for piece, file, at in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lead = BETWEEN.encode() if cutter.left else b"WARC/1."  # what the text reader has parted the pieces by
                if (file, at) != now:
                    cutter.done()
                    now, cutter, lead = (file, at), Cutter(file), b"WARC/1." if at else b""
                rows += [told(h, b, file, keep) for h, b in cutter.add(lead + piece.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(arrow), arrow)], schema=arrow)
        cutter.done()

    return pieces.mapInArrow(cut, schema)


def captures(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture, record, requests, metadata, others), the last three sorted by id.

    record is the response, revisit or resource; capture is its id, or that of the record itself where none belongs to it. Of records of one id
    each is kept.
    """
    is_capture = F.col("type").isin(*CAPTURES)
    ids = table(records.select("id", "concurrent", is_capture.alias("is_capture")), "ids")
    anchors = ids.where("is_capture").select(F.col("id").alias("capture")).distinct()
    links = ids.select("id", F.explode("concurrent").alias("other")).distinct()
    both = table(links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "links")
    direct = both.join(anchors, both.other == anchors.capture).select("id", "capture")
    free = ids.where("NOT is_capture").select("id").distinct()
    near = table(free.join(direct, "id").groupBy("id").agg(F.min("capture").alias("capture")), "near")
    rest = free.join(near, "id", "left_anti").join(both, "id").join(near.select(F.col("id").alias("other"), "capture"), "other").groupBy("id").agg(F.min("capture").alias("capture"))
    belongs = near.unionByName(rest)
    rows = records.join(belongs, "id", "left").withColumn("capture", F.coalesce("capture", "id"))
    whole = F.struct(*records.columns)
    of = lambda cond: F.array_sort(F.collect_list(F.when(cond, whole)), lambda a, b: F.when(a.id < b.id, -1).when(a.id > b.id, 1).otherwise(0))
    kind = F.col("type")
    got = rows.groupBy("capture").agg(of(is_capture).alias("own"), of(kind == "request").alias("requests"), of(kind == "metadata").alias("metadata"), of(~is_capture & ~kind.isin("request", "metadata")).alias("others"))
    return got.select("capture", F.explode_outer("own").alias("record"), "requests", "metadata", "others")


def field_of(payload: Column, name: str) -> Column:
    """A field of a record of warc-fields; null where it has none."""
    return F.nullif(F.regexp_extract(payload.cast("string"), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures that write() made, refers_to being the page that a revisit repeats.

    Digest and bytes of a response are those of the payload as read; a revisit's are from its heads.
    """
    page = field_of(F.get("metadata", F.lit(0)).payload, "page-id").cast("long")
    sized = F.when(F.col("record.type") == "revisit", F.regexp_extract("record.http", r"(?im)^content-length:\s*(\d+)", 1).cast("long")).otherwise(F.col("record.payload_bytes"))
    digest = F.when(F.col("record.type") == "revisit", F.regexp_replace("record.digest", "^sha1:", "")).otherwise(F.col("record.payload_sha1"))
    own = table(found.select("capture", page.alias("page_id"), sized.alias("payload_bytes"), digest.alias("payload_digest"), F.col("record.type").alias("record_type"), F.col("record.refers").alias("refers")), "captures")
    asked = own.where("refers IS NOT NULL").select(F.col("refers").alias("capture")).distinct()
    names = own.join(asked, "capture").select(F.col("capture").alias("refers"), F.col("page_id").alias("refers_to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = own.withColumn("salt", F.when(F.col("refers").isNotNull(), F.pmod(F.xxhash64("capture"), F.lit(SALTS)).cast("int")))
    return dealt.join(names, ["refers", "salt"], "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written as archives in the shared folder, read back and put together, as pages_of."""
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write(pages, path, least=least)
    return pages_of(captures(table(records(spark, path, keep=False), "records")))
