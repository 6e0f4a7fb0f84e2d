"""Hard-negative mining: integer inner products of anchors with all rows, in dense blocks.

Usable rows are written once. Anchors are then taken block by block (BLOCK_BYTES at most): a block is broadcast, and every task multiplies its
own candidate rows with it in float64, which is exact as long as no sum can reach 2**53; rows that could reach it are multiplied as
Python integers. A task keeps the best rows of each anchor only, so the tasks' lists merge: first the block's positives, then, in a
second pass, the negatives whose scores lie in a positive's window. The driver holds one block and its positives at a time.

Rows with a null label, a null vector or a null or non-finite component take no part. Shorter vectors are padded with zeros. Of equal
scores the smaller id comes first, a null id last; rows that repeat an id are rows of their own, also beside an anchor. An anchor without
positives, and a positive without negatives in its window, give no rows; an empty table gives none. A score beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import new_path, table

#: Bytes of a block of anchors as float64, and its rows at most.
BLOCK_BYTES, BLOCK_ROWS = 1 << 24, 8192
#: Products that a task holds at once.
PRODUCTS = 1 << 20
#: Sums below this are exact in float64, in whatever order they are added.
EXACT = 2.0**53
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1


def usable(rows: DataFrame, label: Column, is_anchor: Column, key: str, vector: str) -> DataFrame:
    """(row, id, label, anchor, x) of the rows that take part."""
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    own = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor & F.col(key).isNotNull(), F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("x"))
    return own.where(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("row", F.monotonically_increasing_id())


def quantized(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """A matrix of floor(scale * component), padded to dim."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products: float64 where no sum can reach EXACT, Python integers else."""
    reach = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * max(1, rows.shape[1])
    if reach < EXACT:
        return rows @ anchors.T
    whole = [np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in (rows, anchors)]
    out = whole[0] @ whole[1].T
    if any(abs(v) > LAST for v in out.ravel().tolist()):
        raise OverflowError("an inner product doesn't fit into a long")
    return out.astype(np.int64)


@dataclass
class Best:
    """The first k of each slot by (score descending, id), with each slot's last as the bar for others."""

    k: int
    slot: np.ndarray
    score: np.ndarray
    id: np.ndarray
    bar: np.ndarray
    bar_id: np.ndarray

    @classmethod
    def of(cls, slots: int, k: int) -> Best:
        return cls(k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(slots, np.iinfo(np.int64).min), np.full(slots, LAST))

    def better(self, score: np.ndarray, ids: np.ndarray, slots: slice) -> np.ndarray:
        """Which of the scores (rows by slots) come before their slot's last."""
        bar = self.bar[slots].astype(score.dtype)
        out, same = score > bar, score == bar
        if same.any():
            out |= same & (ids[:, None] < self.bar_id[slots][None, :])
        return out

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """slot, score, id of entries that passed their bars."""
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score.astype(np.int64)), (self.id, ids)))
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        full = place == self.k - 1
        self.bar[slot[full]], self.bar_id[slot[full]] = score[full], ids[full]
        kept = place < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]


@dataclass
class Block:
    """Anchors with their quantized vectors, and in the second pass the slots' bounds: slot s belongs to anchor s // wide."""

    row: np.ndarray
    label: np.ndarray
    x: np.ndarray
    least: np.ndarray | None = None
    most: np.ndarray | None = None


def tiles(batches: Iterator[pa.RecordBatch], block: Block, dim: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, rows, labels, products) of so many candidates at a time that there are PRODUCTS of them."""
    step = max(16, PRODUCTS // max(1, len(block.row)))
    for whole in batches:
        for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
            ids = batch.column("id").fill_null(LAST).to_numpy()
            yield ids, batch.column("row").to_numpy(), batch.column("label").to_numpy(), products(quantized(batch.column("x"), dim, scale), block.x)


def told(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (best.slot, best.score, best.id)], ["slot", "score", "id"])


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The tasks' lists (slot, score, id) merged: the first k of each slot, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of the vectors' floor(scale * component). An anchor's positives are its first rows of its label but itself; a
    positive's negatives are the first rows of other labels with least <= 100 * score / positive score <= most, in integers. label and
    is_anchor are columns of rows; a row without an id is no anchor.
    """
    spark = rows.sparkSession
    own = table(usable(rows, label, is_anchor, key, vector), "vectors")
    told_of = own.agg(F.max(F.size("x")).alias("dim"), F.count_if("anchor").alias("n")).first()
    dim, schema = told_of.dim or 0, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    blocks = -(-told_of.n // min(block_rows, max(1, BLOCK_BYTES // (8 * max(1, dim)))))
    if not blocks:
        return spark.createDataFrame([], schema)
    anchors = table(own.where("anchor").drop("anchor").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "anchors", "block")
    candidates, path = own.select("row", "id", "label", "x"), new_path(spark, "negatives")
    for b in range(blocks):
        part = anchors.where(F.col("block") == b).toArrow()
        if part.num_rows:
            found = mined(candidates, part, dim, scale, positives, negatives, least, most)
            found.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", "))).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def mined(candidates: DataFrame, anchors: pa.Table, dim: int, scale: float, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """The rows of one block of anchors (row, id, label, x): both passes, each with the block broadcast."""
    spark = candidates.sparkSession
    block = Block(anchors.column("row").to_numpy(), anchors.column("label").to_numpy(), quantized(anchors.column("x"), dim, scale))
    sent = spark.sparkContext.broadcast(block)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        best = Best.of(len(own.row), positives)
        for ids, row, label, score in tiles(batches, own, dim, scale):
            at, slot = np.nonzero((label[:, None] == own.label) & (row[:, None] != own.row) & best.better(score, ids, slice(None)))
            best.add(slot, score[at, slot], ids[at])
        yield told(best)

    first = first_of(candidates.mapInArrow(near, "slot long, score long, id long"), positives).toArrow()  # a few a row of the block
    anchor, place, score = (first.column(c).to_numpy() for c in ("slot", "rank", "score"))
    slot = anchor * positives + place - 1
    low, high = np.ones(len(block.row) * positives, np.int64), np.zeros(len(block.row) * positives, np.int64)
    low[slot] = [-(-least * s // 100) for s in score.tolist()]
    high[slot] = [most * s // 100 for s in score.tolist()]
    windows = spark.sparkContext.broadcast(Block(block.row, block.label, block.x, low, high))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = windows.value
        best = Best.of(len(own.least), negatives)
        for ids, _, label, score in tiles(batches, own, dim, scale):
            other = label[:, None] != own.label
            for j in range(positives):
                slots = slice(j, None, positives)
                at, a = np.nonzero(other & (score >= own.least[slots].astype(score.dtype)) & (score <= own.most[slots].astype(score.dtype)) & best.better(score, ids, slots))
                best.add(a * positives + j, score[at, a], ids[at])
        yield told(best)

    names = pa.table({"slot": slot, "anchor_id": anchors.column("id").to_numpy()[anchor], "positive": first.column("id").to_numpy(), "positive_score": score})
    slots = F.broadcast(spark.createDataFrame(names))
    merged = first_of(candidates.mapInArrow(hard, "slot long, score long, id long"), negatives).join(slots, "slot")
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return merged.select("anchor_id", known("positive").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
