"""Shared pieces: working tables, byte-level words and rolling hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own, which only a local master can share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="marketloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_made: list[str] = []


def drop_tables(spark: SparkSession) -> int:
    """Remove the working tables that this process has made; results that read them must have been written. Returns how many."""
    for path in _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gone = len(_made)
    _made.clear()
    return gone


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which drop_tables removes."""
    folder = f"{shared_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as a working table in the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that Python gets at once in the pipeline: whole rows with their texts, twice over.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches have BATCH_ROWS rows at most, so that workers hold few long texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(column: str, fold: int, folds: int):
    """Whether crc32 of an id's text, modulo folds, is fold; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")), F.lit(folds)) == fold


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(m, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """Sums of x[j] * BASE**j over j < i, for each i up to len(x)."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(len(x))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end), the same wherever the content stands."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start])


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that don't separate words."""
    edge = np.diff(np.concatenate(([True], IS_SPACE[b], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


#: Words over this many bytes get XXH3: polynomial hashes modulo 2**64 are equal for some pairs of long repetitive words.
LONG_WORD = 64


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, with the words' starts and ends."""
    b = np.frombuffer(data, np.uint8)
    start, end = word_spans(b)
    out = span_hashes(prefix_sums(b.astype(np.uint64) + np.uint64(1)), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out, start, end
