"""Embedding near-duplicates by spherical-cap filters.

Filter directions are products: the (rotated) space is cut into BLOCKS blocks, each has a code of random unit vectors,
and every choice of one per block is a direction. A vector is decoded to the list of all directions that it exceeds the
threshold for, block by block: a partial sum goes on only with the words that can still reach the threshold with the best of the
blocks left, which are the first of the block's words by score. Vectors are joined on (label, filter) and verified in double
precision. Joins ship ids only; filters that share their first words lie in one shard, which gets each of its vectors once. The code grows with the number of vectors, so a filter holds a bounded number of
unrelated ones, and the threshold is set so that a list has LISTED filters on average; a vector with fewer than FLOOR takes its best FLOOR.

Equal vectors are one from the start. A pair is counted in the least filter that its lists share. A filter with more than
TILE vectors is dealt out in tiles, each pair of which is one group. Links inside a group leave it as a forest.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing;
vectors shorter than the longest are padded with zeros; repeated rows are copies of each other, and rows that repeat an id with
another vector are vectors of their own; a row with a null id links with nothing; ties have no influence; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import table
from marketloom.llm.components import connected_components

BLOCKS = 4
LISTED = 24
FLOOR = 20
#: Least dimensions of a block: vectors of fewer are embedded in so many.
WIDTH = 4
TILE = 2048
#: Places of vectors in filters in a shard, about.
SHARD_ROWS = 20_000
SEED = 7
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Caps:
    """A product code over dim dimensions with size words a block."""

    dim: int
    size: int
    listed: int = LISTED

    def parts(self) -> tuple[np.ndarray, list[np.ndarray], float]:
        return _caps(self.dim, self.size, self.listed)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the filters that it exceeds, ascending; where they are under FLOOR, the best FLOOR."""
        rotation, codes, threshold = self.parts()
        scores, order = ranked(x @ rotation, codes)
        row, name = exceeding(scores, order, threshold)
        found = np.split(name, np.searchsorted(row, np.arange(1, len(x))))
        few = np.array([i for i, f in enumerate(found) if len(f) < FLOOR], np.int64)
        if len(few):
            halves = [first_sums(scores[k][few], scores[k + 1][few], order[k][few] * self.size, order[k + 1][few]) for k in (0, 2)]
            _, top = first_sums(halves[0][0], halves[1][0], halves[0][1] * self.size**2, halves[1][1])
            for i, f in zip(few.tolist(), top):
                found[i] = f
        return [np.sort(f) for f in found]


def ranked(y: np.ndarray, codes: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each block the words' scores of each row, descending, and which words they are."""
    width = y.shape[1] // BLOCKS
    scores = [y[:, width * k : width * (k + 1)] @ codes[k].T for k in range(BLOCKS)]
    order = [np.argsort(-s, axis=1, kind="stable") for s in scores]
    return [np.take_along_axis(s, o, axis=1) for s, o in zip(scores, order)], order


def exceeding(scores: list[np.ndarray], order: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter), by row, of all filters whose sum of scores is the threshold or more."""
    n, size = scores[0].shape
    best = np.stack([s[:, 0] for s in scores], axis=1)
    rest = best[:, ::-1].cumsum(axis=1)[:, ::-1] - best  # the best of the blocks after each
    row, partial, name = np.arange(n), np.zeros(n), np.zeros(n, np.int64)
    for k in range(BLOCKS):
        count = reaching(scores[k], row, threshold - partial - rest[row, k])
        at = np.repeat(np.arange(len(row)), count)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        row, partial = row[at], partial[at] + scores[k][row[at], nth]
        name = name[at] * size + order[k][row, nth]
    return row, name


def reaching(scores: np.ndarray, row: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many of scores[row], which descend, are least or more, by binary search."""
    low, high = np.zeros(len(row), np.int64), np.full(len(row), scores.shape[1], np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        ok = scores[row[open_], middle] >= least[open_]
        low[open_[ok]] = middle[ok] + 1
        high[open_[~ok]] = middle[~ok]
    return low


def first_sums(a: np.ndarray, b: np.ndarray, a_names: np.ndarray, b_names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The FLOOR largest sums of one of a and one of b for each row, both descending, and the sums of their names."""
    i, j = np.array([(i, j) for i in range(min(FLOOR, a.shape[1])) for j in range(min(FLOOR, b.shape[1])) if (i + 1) * (j + 1) <= FLOOR]).T
    sums = a[:, i] + b[:, j]
    top = np.argsort(-sums, axis=1, kind="stable")[:, :FLOOR]
    return np.take_along_axis(sums, top, axis=1), np.take_along_axis(a_names[:, i] + b_names[:, j], top, axis=1)


@lru_cache
def _caps(dim: int, size: int, listed: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    rng = np.random.default_rng(SEED)
    width = max(WIDTH, -(-dim // BLOCKS))
    rotation = np.linalg.qr(rng.standard_normal((width * BLOCKS, width * BLOCKS)))[0][:dim]
    codes = [unit(rng.standard_normal((size, width))) for _ in range(BLOCKS)]
    y = unit(rng.standard_normal((400, dim))) @ rotation
    pick = rng.integers(0, size, (20_000, BLOCKS))
    sums = sum(y[:, width * k : width * (k + 1)] @ codes[k][pick[:, k]].T for k in range(BLOCKS))
    low, high = float(np.quantile(sums, max(0.0, 1 - 2 * listed / size**BLOCKS))), float(sums.max()) * 1.5
    scores, order = ranked(y, codes)
    for _ in range(12):  # the sampled quantile is too rough for large codes
        middle = (low + high) / 2
        low, high = (middle, high) if len(exceeding(scores, order, middle)[0]) > listed * len(y) else (low, middle)
    return rotation, codes, low


def forest(near: np.ndarray) -> np.ndarray:
    """The least row reached from each row of a symmetric matrix."""
    name = np.arange(len(near))
    while True:
        new = np.minimum(name, np.where(near, name, len(near)).min(axis=1, initial=len(near)))
        new = new[new]
        if (new == name).all():
            return name
        name = new


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by the largest component first, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(groups: DataFrame, least: float, dim: int) -> DataFrame:
    """Rows (u, v, n) of shards' vectors (node, mult, x, list) and their places (label, f, ta, tb, tile): v is LAST and n the links that u has in a group, or an edge of the group's forest."""

    def run(own: pa.Table) -> pa.Table:
        node, mult = (own.column(c).to_numpy() for c in ("node", "mult"))
        unit_x = unit(np.array([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in own.column("x").to_pylist()], np.float64))
        lists = [np.frombuffer(b, np.int64) for b in own.column("list").to_pylist()]
        places = own.column("places").combine_chunks()
        of = np.repeat(np.arange(own.num_rows), places.value_lengths().to_numpy())
        f, ta, tb, tile = (places.flatten().field(c).to_numpy() for c in ("f", "ta", "tb", "tile"))
        label = own.column("label").to_numpy()[of]
        order = np.lexsort((node[of], tb, ta, f, label))
        of, f, ta, tb, tile, label = (c[order] for c in (of, f, ta, tb, tile, label))
        start = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (f[1:] != f[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1]))))
        out = [[], [], []]
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(of)]):
            if b - a < 2:
                continue
            mine = of[a:b]
            y = unit_x[mine]
            near = y @ y.T >= least
            np.fill_diagonal(near, False)
            if ta[a] != tb[a]:  # two tiles: only pairs across
                near &= tile[a:b, None] != tile[None, a:b]
            if not near.any():
                continue
            name = forest(near)
            rows = np.flatnonzero(name != np.arange(len(name)))
            out[0].append(node[mine[rows]])
            out[1].append(node[mine[name[rows]]])
            out[2].append(np.zeros(len(rows), np.int64))
            lower = [s[: np.searchsorted(s, f[a])] for s in (lists[i] for i in mine.tolist())]
            names = np.unique(np.concatenate(lower))
            if len(names):
                has = np.zeros((b - a, len(names)), np.float32)
                for i, s in enumerate(lower):
                    has[i, np.searchsorted(names, s)] = 1
                near &= has @ has.T == 0
            n = near @ mult[mine]
            rows = np.flatnonzero(n)
            out[0].append(node[mine[rows]])
            out[1].append(np.full(len(rows), LAST))
            out[2].append(n[rows])
        u, v, n = (np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out)
        return pa.Table.from_arrays([pa.array(u), pa.array(v), pa.array(n)], ["u", "v", "n"])

    return groups.groupBy("shard").applyInArrow(run, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", listed: int = LISTED, tile: int = TILE) -> DataFrame:
    """Rows (key, n_links, component_id, kept) for each row of vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    most = F.array_max(F.transform("e", lambda c: F.abs(c)))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("e") > 0) & finite & (most > 0), F.lit(False))
    rows = rows.withColumn("ok", usable)
    reps = rows.where("ok").groupBy("label", "e").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    reps = table(reps.withColumn("node", F.monotonically_increasing_id()), "vectors")
    size = reps.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("dim")).first()
    dim = size.dim or 1
    caps = Caps(dim, max(16, int(np.ceil((size.n / 2) ** (1 / BLOCKS)))), listed)

    def decode(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                x = np.zeros((batch.num_rows, dim))
                for i, e in enumerate(batch.column("e").to_pylist()):
                    x[i, : len(e)] = e
                raw = x.astype(np.float32) if (x.astype(np.float32) == x).all() else x
                lists = caps.decode(unit(x))
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("node"), batch.column("mult"), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([s.astype(np.int64).tobytes() for s in lists], pa.binary()), pa.array([s.astype(np.int64) for s in lists], pa.list_(pa.int64()))], ["label", "node", "mult", "x", "list", "fs"])

    decoded = table(reps.mapInArrow(decode, "label long, node long, mult long, x binary, list binary, fs array<long>"), "filters")
    keyed = decoded.select("label", "node", F.explode("fs").alias("f"))
    sizes = table(keyed.groupBy("label", "f").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_ROWS))
    depth = next((k for k in range(1, BLOCKS) if caps.size**k * SHARD_ROWS >= total), BLOCKS)
    live = keyed.join(sizes, ["label", "f"]).withColumn("tiles", F.ceil(F.col("n") / tile)).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")})
    shard = F.pmod(F.xxhash64("label", F.floor(F.col("f") / caps.size ** (BLOCKS - depth)), "ta", "tb"), F.lit(shards))
    placed = live.groupBy(shard.alias("shard"), "node").agg(F.collect_list(F.struct("f", "ta", "tb", "tile")).alias("places"))
    groups = placed.join(decoded.select("label", "node", "mult", "x", "list"), "node")
    found = table(links(groups.select("shard", "label", "node", "mult", "x", "list", "places"), least, dim), "links")
    counts = found.where(F.col("v") == LAST).groupBy("u").agg(F.sum("n").alias("n"))
    components = connected_components(found.where(F.col("v") != LAST).select("u", "v"))
    named = reps.join(counts, F.col("node") == F.col("u"), "left").drop("u").join(components.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left")
    named = table(named.select("label", "e", "rep", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "named")
    names = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(names, "component").select("label", "e", "n_links", F.col("least").alias("component"))
    good = rows.where("ok").join(named, ["label", "e"]).select("id", "n_links", "component")
    rest = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return good.unionByName(rest).select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
