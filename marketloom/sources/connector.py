"""A paced connector: a table of URLs as a stream, whose hosts are fetched side by side, each at its own pace.

add_urls() appends URLs that the table doesn't have yet, numbered on from its end; a stream's offset is a number in this table, so a run that is
started again goes on where the last one's checkpoint stopped, and asks for no URL of a finished batch twice. A batch's partitions are its
hosts: a host's URLs are requested by one task, one after another with a pause before each, whatever the number of tasks. What comes back is appended
to a store with Spark's own record of finished batches. There is no client for any service here: fetch takes a URL and returns text, or
None where there is nothing; an OSError leaves a null payload with its text as error. A task holds HELD bytes of payloads and one more at a time.

Null URLs are left out; repeated ones are asked for once. An address without a host counts as the host ''. The URL table is read by pyarrow,
in whatever store it and all executors reach.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Seconds between two requests to the filings' and to the transcripts' host (fixed values).
FILINGS_PAUSE, TRANSCRIPTS_PAUSE = 0.6, 1.5
#: URLs that a batch asks for at most.
BATCH = 1000
FORMAT = "paced_urls"
SCHEMA = "n long, url string, host string, payload string, error string, asked timestamp"
ARROW = pa.schema([("n", pa.int64()), *((c, pa.string()) for c in ("url", "host", "payload", "error")), ("asked", pa.timestamp("us", "UTC"))])
URLS = "n long, url string"
#: Bytes of payloads after which a task hands on what it has fetched.
HELD = 4 << 20
#: Rows after which the store's writer looks how much it holds (by default at least 100, whatever their size).
LOOKS = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 10, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 10}
#: Ranges of a hash over which new URLs are numbered.
RANGES = 64


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def url_table(spark: SparkSession, path: str) -> DataFrame:
    """(n, url) of a URL table; no rows where there is none."""
    return spark.read.schema(URLS).parquet(path) if _exists(spark, path) else spark.createDataFrame([], URLS)


def add_urls(urls: DataFrame, path: str, url: str = "url") -> int:
    """Append the URLs that the table at path lacks, numbered from its end on; returns how many the table then has."""
    spark = urls.sparkSession
    known = url_table(spark, path)
    end = known.agg(F.coalesce(F.max("n") + 1, F.lit(0))).first()[0]
    new = urls.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct().join(known.select("url"), "url", "left_anti")
    dealt = new.withColumn("range", F.pmod(F.xxhash64("url"), F.lit(RANGES)))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))
    starts = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("start"))  # RANGES rows
    within = F.row_number().over(Window.partitionBy("range").orderBy("url")) - 1
    numbered = dealt.join(F.broadcast(starts), "range").select((F.lit(end) + F.col("start") + within).cast("long").alias("n"), "url")
    numbered.write.mode("append").parquet(path)
    return url_table(spark, path).count()


@dataclass
class Host(InputPartition):
    """A host's URLs of a batch, with their numbers."""

    host: str
    urls: tuple[tuple[int, str], ...]


class Paced(DataSourceStreamReader):
    """Options: path, upto (the number before which a run stops)."""

    def __init__(self, options: dict[str, str], fetch: Callable[[str], str | None], pause: float | dict[str, float]):
        self.path, self.upto, self.fetch, self.pause = options["path"], int(options["upto"]), fetch, pause

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        return {"n": self.upto}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.path)
        own = ds.dataset(path, filesystem=store, format="parquet").to_table(filter=(ds.field("n") >= start["n"]) & (ds.field("n") < end["n"]))
        hosts: dict[str, list[tuple[int, str]]] = {}
        for n, url in sorted(zip(own.column("n").to_pylist(), own.column("url").to_pylist())):
            hosts.setdefault(urlsplit(url).netloc.lower(), []).append((n, url))
        return [Host(h, tuple(x)) for h, x in hosts.items()] or [Host("", ())]

    def read(self, partition: Host) -> Iterator[pa.RecordBatch]:
        from datetime import datetime, timezone

        pause = self.pause.get(partition.host, FILINGS_PAUSE) if isinstance(self.pause, dict) else self.pause
        rows, held = [], 0
        for n, url in partition.urls:
            time.sleep(pause)
            asked, payload, error = datetime.now(timezone.utc), None, None
            try:
                payload = self.fetch(url)
            except OSError as e:
                error = str(e)
            rows.append((n, url, partition.host, payload, error, asked))
            held += len(payload or "")
            if held >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def source(fetch: Callable[[str], str | None], pause: float | dict[str, float] = FILINGS_PAUSE) -> type[DataSource]:
    """A data source with the caller's fetch; pause in seconds, or by host."""

    class PacedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Paced({k.lower(): v for k, v in self.options.items()}, fetch, pause)

    return PacedSource


def results(spark: SparkSession, store: str) -> DataFrame:
    """What a crawl has stored: SCHEMA."""
    return spark.read.schema(SCHEMA).parquet(f"{store}/pages") if _exists(spark, f"{store}/pages/_spark_metadata") else spark.createDataFrame([], SCHEMA)


def crawl(spark: SparkSession, urls: str, store: str, fetch: Callable[[str], str | None], pause: float | dict[str, float] = FILINGS_PAUSE, batch: int = BATCH, batches: int | None = None) -> DataFrame:
    """Fetch what the URL table at urls has and the store hasn't, batch by batch (so many of them, or to the end); returns the store's pages."""
    spark.dataSource.register(source(fetch, pause))
    store = store.rstrip("/")
    total = url_table(spark, urls).agg(F.coalesce(F.max("n") + 1, F.lit(0))).first()[0]
    done = results(spark, store).agg(F.coalesce(F.max("n") + 1, F.lit(0))).first()[0]
    left = range(done, total, batch)
    for at in left if batches is None else left[:batches]:
        rows = spark.readStream.format(FORMAT).option("path", urls).option("upto", min(at + batch, total)).load()
        rows.writeStream.format("parquet").options(**LOOKS).option("path", f"{store}/pages").option("checkpointLocation", f"{store}/state").trigger(availableNow=True).start().awaitTermination()
    return results(spark, store)


def with_payloads(rows: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """rows with the payload of their URL, from a crawl's pages."""
    return rows.join(pages.select(F.col("url").alias("__u"), "payload"), F.col(url) == F.col("__u"), "left").drop("__u")
