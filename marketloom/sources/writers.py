"""DataFrames into stores: bar partitions, ledgers, documents, cached results; and small YAML files by hand."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from marketloom.operators.ingest import tails_differ, upsert_bars


def _file_system(spark: SparkSession, path: str):
    """The file system of a path and the path, as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def age(spark: SparkSession, path: str, now: float | None = None) -> float | None:
    """Seconds since a file or folder, or the newest file in it, was written; None where there is none."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return None
    newest, left = 0, [fs.getFileStatus(where)]
    while left:
        status = left.pop()
        if status.isDirectory():
            left.extend(fs.listStatus(status.getPath()))
        newest = max(newest, status.getModificationTime())
    return (time.time() if now is None else now) - newest / 1000


def cooling(spark: SparkSession, path: str, minutes: float = 60, now: float | None = None) -> bool:
    """Whether a ledger was refreshed less than so many minutes ago; never with zero minutes."""
    old = age(spark, path, now) if minutes > 0 else None
    return old is not None and old < 60 * minutes


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def write_bars(bars: DataFrame, path: str, at: str = "d") -> None:
    """Bars in one folder a symbol; only the symbols that are written are replaced."""
    bars.repartition("sym").sortWithinPartitions("sym", at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sym").parquet(path)


def stored_bars(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The bars of a store, None where there is none; schema gives the symbols' type, as folder names don't tell 0005 from 5."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the store isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def refresh_bars(spark: SparkSession, new: DataFrame, path: str, splits: DataFrame | None = None, at: str = "d") -> int:
    """Upsert new bars into a store; symbols whose tail is the same at six digits aren't written. Returns how many were."""
    old = stored_bars(spark, path, new.schema)
    if old is None:
        write_bars(new, path, at)
        return new.select("sym").distinct().count()
    changed = tails_differ(old, new, ["o", "h", "l", "c", "v"], at=at).where("differences > 0").select("sym")
    listed = f"{path.rstrip('/')}_changed"
    changed.write.mode("overwrite").parquet(listed)
    changed = spark.read.parquet(listed)
    count = changed.count()
    if count:
        merged = upsert_bars(old.join(changed, "sym", "left_semi").select(*new.columns), new.join(changed, "sym", "left_semi"), splits, at=at)
        staged = f"{path.rstrip('/')}_next"
        merged.write.mode("overwrite").parquet(staged)
        write_bars(spark.read.parquet(staged), path, at)
        remove(spark, staged)
    remove(spark, listed)
    return count


def append_ledger(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


#: Bytes of documents that a writing task gets at once.
BATCH_BYTES = 4 << 20


class DocumentWriter(DataSourceArrowWriter):
    """Rows (name, page) as files of these names: each is written beside its place and renamed, by the task that has it."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = fs.FileSystem.from_uri(self.path)
        for batch in iterator:
            for name, page in ((n.as_py(), p.as_py()) for n, p in zip(batch.column(0), batch.column(1))):
                if name is None or ".." in name.split("/") or name.startswith("/"):
                    raise ValueError(f"{name!r} is no name of a document")
                where = f"{path}/{name}"
                store.create_dir(where.rpartition("/")[0], recursive=True)
                staged = f"{where}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(staged) as f:
                    f.write((page or "").encode())
                store.move(staged, where)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass


class DocumentFiles(DataSource):
    """Format document_files, for writing; path is a folder in a store that pyarrow and all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "name string, page string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DocumentWriter(self.options["path"])


def write_documents(docs: DataFrame, path: str) -> None:
    """docs has name and page (text.letter_file, report_file, transcript_file): one file a document, by its name, which may lie in subfolders.

    Files of other names stay; of rows of one name one stays. A null page is an empty file, a null name an error.
    """
    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.dataSource.register(DocumentFiles)
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        docs.select("name", "page").write.format("document_files").mode("append").save(path)
    finally:
        spark.conf.set(name, before)


def publish(df: DataFrame, where: str, keep: int = 2) -> str:
    """Write df beside the entry where and rename it into place as its newest version; the keep newest ones stay, for those who still read them."""
    spark = df.sparkSession
    parent, _, name = where.rstrip("/").rpartition("/")
    staged, version = f"{parent}/_staged-{uuid.uuid4().hex}", f"{where}/v-{time.time_ns():020d}"
    df.write.parquet(staged)
    fs_, entry = _file_system(spark, where)
    fs_.mkdirs(entry)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not fs_.rename(path(staged), path(version)):
        raise OSError(f"{version} couldn't be published")
    for old in versions(spark, where)[:-keep]:
        remove(spark, old)
    return version


def versions(spark: SparkSession, where: str) -> list[str]:
    """The published versions of an entry, oldest first."""
    fs_, entry = _file_system(spark, where)
    return sorted(str(s.getPath()) for s in fs_.listStatus(entry) if s.getPath().getName().startswith("v-")) if fs_.exists(entry) else []


def cached(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame], ttl: float | None = 3600, refresh: bool = False, now: float | None = None) -> DataFrame:
    """The result stored under key, or make()'s, which is then published there; entries older than ttl seconds (None: for ever) are removed first.

    A reader sees a whole version or none: a new one takes its place by a rename, and the one before stays until the next.
    """
    where = f"{path.rstrip('/')}/{key}"
    prune(spark, path, ttl, now)
    found = versions(spark, where)
    return spark.read.parquet(found[-1] if found and not refresh else publish(make(), where))


def prune(spark: SparkSession, path: str, ttl: float | None, now: float | None = None) -> int:
    """Remove the entries of a cache whose newest version is older than ttl seconds; returns how many."""
    fs_, where = _file_system(spark, path)
    if ttl is None or not fs_.exists(where):
        return 0
    entries = [str(s.getPath()) for s in fs_.listStatus(where) if not s.getPath().getName().startswith("_staged-")]
    stale = [p for p in entries if (found := versions(spark, p)) and (age(spark, found[-1], now) or 0) > ttl]
    for p in stale:
        remove(spark, p)
    return len(stale)


def points_of_control(spark: SparkSession, path: str, mode: str, day: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The points of control of a mode (week or month) as of a day, from the store, or make()'s, published there under both."""
    return cached(spark, path, f"poc-{mode}-{day}", make, None)


def write_yaml(path: str, value: dict) -> None:
    """A mapping as block YAML, keys in their order; a small file of the driver."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(value, f, default_flow_style=False, sort_keys=False, allow_unicode=True)


#: Fields after which a record's short interest stands, the first that it has (fixed values).
SHORT_AFTER = ("shares_outstanding", "end_date")


def insert_short(text: str, updates: dict[str, tuple[float, str]]) -> str:
    """A YAML text with shares_short and short_settlement_date added to the records that updates names by id; all other lines stay as they are."""
    lines = text.split("\n")
    records = [(i, m.group(1)) for i, line in enumerate(lines) if (m := re.match(r"\s*-\s+id:\s*(\S+)", line))]
    added: dict[int, list[str]] = {}
    for (start, name), (end, _) in zip(records, [*records[1:], (len(lines), "")]):
        if name not in updates:
            continue
        fields = {m.group(2): (i, m.group(1)) for i in range(start + 1, end) if (m := re.match(r"(\s*)(\w+):", lines[i]))}
        place = next((fields[f] for f in SHORT_AFTER if f in fields), None)
        if place is not None:
            short, settled = updates[name]
            added[place[0]] = [f"{place[1]}shares_short: {short}", f"{place[1]}short_settlement_date: {settled}"]
    return "\n".join(x for i, line in enumerate(lines) for x in [line, *added.get(i, [])])
