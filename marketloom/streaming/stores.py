"""A deduplicated ledger and an upserted bar store fed by file streams.

A stream has one checkpoint for ever in a store's folder, so that a later run reads new files only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marketloom.operators.series import keep_last


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one, which only a local master can share."""
    import tempfile

    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="marketloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a parquet file or folder as a stream."""
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


def _path(spark: SparkSession, path: str):
    """The file system of a path and the path, as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _is_file(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.getFileStatus(where).isFile()


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def feed_of(rows: DataFrame) -> str:
    """A name for the folders that a stream reads, of which each has a checkpoint of its own in a store."""
    read = re.findall(r"FileSource\[[^\]]*\]|pathGlobFilter -> [^,)]*", rows._jdf.queryExecution().analyzed().toString())
    return hashlib.md5("\n".join(sorted(read)).encode()).hexdigest()[:16]


def _parts(spark: SparkSession, path: str) -> list[str]:
    fs, where = _path(spark, path)
    return [str(s.getPath()) for s in fs.listStatus(where)] if fs.exists(where) else []


def _read(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def ledger(rows: DataFrame, key: str, store: str | None = None) -> DataFrame:
    """A ledger for ever: of the stream's rows one of each key that no run has seen is appended to the store; returns the store.

    The keys that a stream has brought are its state, dealt over all tasks, so a batch costs what it brings and not what the ledger holds; only
    where other streams feed the store too are their rows read. The store (a folder; a new one where none is given) outlives the
    run: another run of a stream reads files that none has read and adds only new keys. A batch that is run again replaces its part. A
    null key is left out.
    """
    spark, schema, feed = rows.sparkSession, rows.schema, feed_of(rows)
    where = (store or shared_dir(spark)).rstrip("/")

    def add(batch: DataFrame, n: int) -> None:
        others = [p for p in _parts(batch.sparkSession, f"{where}/rows") if not p.rpartition("/")[2].startswith(f"{feed}-")]
        fresh = batch.join(_read(batch.sparkSession, others, schema).select(key), key, "left_anti").select(*schema.names) if others else batch
        fresh.write.mode("overwrite").parquet(f"{where}/rows/{feed}-{n}")

    fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    fresh.writeStream.foreachBatch(add).option("checkpointLocation", f"{where}/state/{feed}").trigger(availableNow=True).start().awaitTermination()
    return _read(spark, _parts(spark, f"{where}/rows"), schema)


#: Parts over which a new keyed store is dealt; a store keeps its own number.
BUCKETS = 16


def _buckets(spark: SparkSession, where: str, wanted: int) -> int:
    """The number of buckets of the store, written down when it is made."""
    if not exists(spark, f"{where}/buckets/_SUCCESS"):
        spark.range(1).select(F.lit(str(wanted)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{where}/buckets")
    return int(spark.read.text(f"{where}/buckets").first()[0])


def merger(spark: SparkSession, where: str, schema: StructType, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """What puts a batch into a keyed store: the last by order of a key wins, or, without order, the batch's row.

    A batch rewrites only the buckets that it touches: the merged rows are staged beside the store, then take the buckets' place. A batch that is
    run again gives the same store.
    """
    deal = lambda df, n: df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))

    def merge(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        count = _buckets(session, where, buckets)
        new = deal(batch.select(*schema.names), count)
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # at most buckets
        if not touched:
            return
        dealt = new.schema
        old = session.read.schema(dealt).parquet(f"{where}/rows").where(F.col("__bucket").isin(touched)) if exists(session, f"{where}/rows") else session.createDataFrame([], dealt)
        if order is None:
            kept = new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))
        else:
            kept = keep_last(new.unionByName(old), keys, [F.col(c) for c in order])
        kept.write.mode("overwrite").parquet(f"{where}/staged")
        staged = session.read.schema(dealt).parquet(f"{where}/staged")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(f"{where}/rows")

    return merge


def stored_rows(spark: SparkSession, where: str, schema: StructType) -> DataFrame:
    """The rows of a keyed store."""
    return spark.read.schema(StructType([*schema.fields, StructField("__bucket", IntegerType())])).parquet(f"{where}/rows").drop("__bucket") if exists(spark, f"{where}/rows") else spark.createDataFrame([], schema)


def upserted(rows: DataFrame, keys: list[str], order: list[str], store: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A keyed store in which the latest arrival of a key wins, dealt over buckets by a hash of the key; it outlives the run where its folder is given."""
    spark = rows.sparkSession
    where = (store or shared_dir(spark)).rstrip("/")
    merge = merger(spark, where, rows.schema, keys, order, buckets)
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{where}/state/{feed_of(rows)}").trigger(availableNow=True).start().awaitTermination()
    return stored_rows(spark, where, rows.schema)
