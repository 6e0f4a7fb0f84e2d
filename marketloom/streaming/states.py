"""Streams with keyed state and event time: documents that are preliminary or final, and bars that are still forming.

Each store belongs to one stream and has one checkpoint for ever, so a later run reads new files only and goes on with the state that
the one before left.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from marketloom.streaming.stores import merger, stored_rows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, on each executor, with changes in the checkpoint; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class DocumentState(StatefulProcessor):
    """A key's document: a preliminary one never replaces a final one, a final one replaces either, and a later one an earlier one of its kind."""

    def __init__(self, key: str, preliminary: str, order: str, schema: StructType):
        self.key, self.preliminary, self.order, self.schema = key, preliminary, order, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.document = handle.getValueState("document", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.document.get() if self.document.exists() else None
        now = None if now is None else dict(zip(self.schema.names, now))
        before = now
        for row in sorted((r.asDict() for r in rows), key=lambda r: (r[self.order] is not None, r[self.order])):
            if now is None or not row[self.preliminary] or now[self.preliminary]:
                now = row
        if now is not before:
            self.document.update(tuple(now[c] for c in self.schema.names))
            yield Row(**{c: now[c] for c in self.schema.names})

    def close(self) -> None:
        pass


def documents(rows: DataFrame, key: str, preliminary: str, order: str, store: str) -> DataFrame:
    """A store of one document a key, fed by a stream of all the columns: preliminary says whether a row is, order sorts a batch's rows of a key.

    Rows of earlier runs count as earlier. A null key is left out, a null preliminary counts as final. Returns the store: each key's
    document as it stands; a preliminary one is gone once there is a final one.
    """
    spark, where, schema = rows.sparkSession, store.rstrip("/"), rows.schema
    own = rows.where(F.col(key).isNotNull()).withColumn(preliminary, F.coalesce(preliminary, F.lit(False)))
    changed = own.groupBy(key).transformWithState(statefulProcessor=DocumentState(key, preliminary, order, schema), outputStructType=schema, outputMode="Update", timeMode="None")
    merge = merger(spark, where, schema, [key])
    with state_store(spark):
        query = changed.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stored_rows(spark, where, schema)


def _watermark(progress: list) -> str | None:
    stamps = [p.eventTime["watermark"] for p in progress if p.eventTime and "watermark" in p.eventTime]
    return max(stamps, default=None)


def forming_bars(rows: DataFrame, store: str, delay: str = "1 hour", width: str = "1 hour", by: str = "sym", at: str = "ts", value: str = "value", tie: str = "id") -> DataFrame:
    """(by, ts, o, h, l, c, v, provisional): bars of a stream of values, by windows of event time; v counts values.

    A bar is provisional while its window ends after the watermark, which is delay before the latest time seen: then late values still change it.
    Values of a window that ended before are left out, so a final bar never changes. The store has one checkpoint and goes on in
    each run; it keeps the watermark of the last. Values of one time count in the order of tie; null times and keys are left out.
    """
    spark, where = rows.sparkSession, store.rstrip("/")
    stamp = F.col(at).cast("timestamp")
    own = rows.where(F.col(at).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("sym"), stamp.alias("__at"), F.col(value).alias("x"), F.struct(stamp, F.col(tie)).alias("k"))
    bars = own.withWatermark("__at", delay).groupBy("sym", F.window("__at", width).alias("w")).agg(F.min_by("x", "k").alias("o"), F.max("x").alias("h"), F.min("x").alias("l"), F.max_by("x", "k").alias("c"), F.count("*").cast("double").alias("v"))
    flat = bars.select("sym", F.col("w.start").alias("ts"), F.col("w.end").alias("until"), "o", "h", "l", "c", "v")
    schema = flat.schema
    merge = merger(spark, where, schema, ["sym", "ts"])
    query = flat.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    latest = _watermark(query.recentProgress)
    if latest is not None:
        spark.createDataFrame([(latest,)], "watermark string").coalesce(1).write.mode("append").text(f"{where}/watermark")
    told = spark.read.text(f"{where}/watermark").agg(F.max("value")).first()[0]
    mark = dt.datetime.fromisoformat((told or "1970-01-01T00:00:00.000Z").replace("Z", "+00:00"))
    return stored_rows(spark, where, schema).select(F.col("sym").alias(by), "ts", "o", "h", "l", "c", "v", (F.col("until") > F.lit(mark)).alias("provisional"))
