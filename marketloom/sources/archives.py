"""Zip archives of price series as a data source: members are listed, filtered by their paths, and dealt in slices.

A path is opened by pyarrow's file systems, so it may lie in any store that Arrow and all executors reach. Reading lists an archive's members
from its central directory on the driver (names and sizes, as a listing of files would), leaves out those that pushed filters on
country, segment and ticker rule out, and makes a partition of every slice of members of some SLICE bytes; a task unpacks its members
as streams. So neither an archive's size nor their number bounds a task. Writing makes one archive a task, moved to its place on commit.
"""

from __future__ import annotations

import fnmatch
import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

FORMAT = "series_archive"
#: Endings that exchanges add to a symbol (fixed values); the first that fits is left out.
SUFFIXES = (".us", ".jp", ".uk", ".hk", ".v", ".b")
#: Path parts of the equity segments that a search covers by default (fixed values).
SEGMENTS = ("nasdaq stocks", "nyse stocks", "nysemkt stocks", "lse stocks", "lse stocks intl", "tse stocks", "hkex stocks")
#: Where the paths of members begin, and the columns of their lines (fixed values).
ROOT = "data/daily/"
HEADER = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>"
#: Bytes of unpacked members in a partition, and lines in a batch.
SLICE, LINES = 64 << 20, 50_000
COLUMNS = ("country", "segment", "ticker")
SCHEMA = "country string, segment string, ticker string, archive string, member string, line string"


def member_meta(name: str) -> tuple[str, str, str] | None:
    """Country, segment and symbol of [data/daily/]<country>/<segment>/[<n>/]<symbol>.txt; None for a path that isn't a series'."""
    parts = name.split(ROOT, 1)[-1].split("/")
    if not name.endswith(".txt") or len(parts) < 3:
        return None
    stem = PurePosixPath(parts[-1]).stem
    ending = next((s for s in SUFFIXES if stem.lower().endswith(s)), "")
    return parts[0], parts[1], stem.removesuffix(stem[len(stem) - len(ending) :]).upper()


@dataclass
class Slice(InputPartition):
    """Members of an archive."""

    archive: str
    members: tuple[str, ...]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.slice = options["path"], options.get("pattern", "*.zip"), int(options.get("slicebytes", SLICE))
        self.asked: list[tuple[int, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at = COLUMNS.index(f.attribute[0]) if isinstance(f, (EqualTo, In)) and f.attribute[0] in COLUMNS else -1
            if at < 0:
                yield f
            else:
                self.asked.append((at, frozenset(f.value if isinstance(f, In) else [f.value])))

    def partitions(self) -> Sequence[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path))
        out = []
        for archive in sorted(x.path for x in found if x.is_file and (x is info or fnmatch.fnmatch(x.base_name, self.pattern))):
            with store.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                own, size = [], 0
                for member in z.infolist():
                    meta = member_meta(member.filename)
                    if meta is None or any(meta[at] not in values for at, values in self.asked):
                        continue
                    own.append(member.filename)
                    size += member.file_size
                    if size >= self.slice:
                        out.append(Slice(archive, tuple(own)))
                        own, size = [], 0
                if own:
                    out.append(Slice(archive, tuple(own)))
        return out or [Slice("", ())]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.members:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            for name in partition.members:
                country, segment, ticker = member_meta(name)
                with io.TextIOWrapper(z.open(name), "utf-8", errors="replace") as text:
                    next(text, None)  # the header
                    while own := list(islice(text, LINES)):
                        fixed = (country, segment, ticker, partition.archive, name)
                        yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(own), pa.string()) for x in fixed), pa.array(own, pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceArrowWriter):
    """Rows (country, segment, ticker, line) of whole series, one after the other, into an archive a task."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = self._store()
        name, now, out, archive = f"d_{uuid.uuid4().hex}_txt.zip", None, None, None
        try:
            for batch in iterator:
                for country, segment, ticker, line in zip(*(c.to_pylist() for c in batch.columns)):
                    if archive is None:
                        store.create_dir(f"{path}/_staged", recursive=True)
                        archive = zipfile.ZipFile(store.open_output_stream(f"{path}/_staged/{name}"), "w", zipfile.ZIP_DEFLATED)
                    if (country, segment, ticker) != now:
                        if out is not None:
                            out.close()
                        now = (country, segment, ticker)
                        out = archive.open(f"{ROOT}{country}/{segment}/{ticker.lower()}.txt", "w", force_zip64=True)
                        out.write(f"{HEADER}\r\n".encode())
                    out.write(f"{line}\r\n".encode())
        finally:
            if archive is not None:
                if out is not None:
                    out.close()
                archive.close()
                archive.fp and archive.fp.close()
        return Written(name if archive is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = self._store()
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path)):
                if old.is_file:
                    store.delete_file(old.path)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{path}/_staged/{m.name}", f"{path}/{m.name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, path = self._store()
        if store.get_file_info(f"{path}/_staged").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_staged")


class ArchiveSource(DataSource):
    """Format series_archive; options path, pattern of the archives' names, and sliceBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def archive_lines(spark: SparkSession, path: str, pattern: str = "*.zip", slice_bytes: int = SLICE) -> DataFrame:
    """(country, segment, ticker, archive, member, line) of all members' lines but their headers; equality and IN on the first three are pushed down."""
    _ready(spark)
    return spark.read.format(FORMAT).option("pattern", pattern).option("sliceBytes", slice_bytes).load(path)


def archive_bars(spark: SparkSession, path: str, segments: Sequence[str] | None = SEGMENTS, countries: Sequence[str] | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """Bars (country, segment, ticker, member, d, o, h, l, c, v) of the archives under path; segments and countries are tested before a member is unpacked.

    Lines are parsed by Spark; short and broken ones are left out. Null segments or countries mean all of them.
    """
    rows = archive_lines(spark, path, slice_bytes=slice_bytes)
    for column, values in (("segment", segments), ("country", countries)):
        if values is not None:
            rows = rows.where(F.col(column).isin(*values))
    cells = rows.withColumn("x", F.split(F.trim(F.regexp_replace("line", r"[\r\n]+$", "")), ",")).where(F.size("x") >= 9)
    number = lambda i: F.get("x", F.lit(i)).try_cast("double")
    got = cells.select("country", "segment", "ticker", "member", F.try_to_date(F.get("x", F.lit(2)), "yyyyMMdd").alias("d"), *(number(i).alias(c) for i, c in zip(range(4, 9), "ohlcv")))
    return got.where("d IS NOT NULL AND o IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL AND v IS NOT NULL")


def write_archives(bars: DataFrame, path: str) -> None:
    """Bars (country, segment, ticker, d, o, h, l, c, v) as archives, each series whole in one of them; they take the place of those there."""
    _ready(bars.sparkSession)
    line = F.concat_ws(",", "ticker", F.lit("D"), F.date_format("d", "yyyyMMdd"), F.lit("000000"), *(F.col(c).cast("string") for c in "ohlcv"), F.lit("0"))
    own = bars.repartition(*COLUMNS).sortWithinPartitions(*COLUMNS, "d").select(*COLUMNS, line.alias("line"))
    own.write.format(FORMAT).mode("overwrite").save(path)
