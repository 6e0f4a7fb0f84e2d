"""Connected components of a graph in a table: forests of parts of the edges, then alternating large and small stars until few edges are left for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import table


#: A node with more neighbours than this is hot; there are at most 2 / HOT as many of them as edges.
HOT = 20_000
#: With fewer edges than this no node's rows are too many for a task, and hot ones aren't sought.
MANY = 5_000_000


def _large(edges: DataFrame, count: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least one; where there are MANY edges, the few hot nodes' names are broadcast, so their rows stay where they are."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    up = both.where("v > u")
    named = lambda own, names: own.join(names, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if count < MANY:
        return named(up, least)
    least = table(least, "least")
    hot = least.where(F.col("n") > HOT).select("u", "m")
    split = up.join(F.broadcast(hot.select("u", F.lit(True).alias("hot"))), "u", "left")
    return named(split.where("hot").drop("hot"), F.broadcast(hot)).unionByName(named(split.where("hot IS NULL").drop("hot"), least.where(F.col("n") <= HOT).select("u", "m")))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(rest)


#: So many edges (4 MB) at most are finished by one task; more go through rounds of stars over all tasks.
FEW = 250_000
#: Edges of which a task makes a forest before they are shuffled.
PART = 500_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    name = np.arange(len(nodes))
    while len(a):
        low = np.minimum(name[a], name[b])
        for x in (name[a], name[b]):
            np.minimum.at(name, x, low)
        while (name[name] != name).any():
            name = name[name]
        open_ = name[a] != name[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[name]


def _edges(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All edges of the batches, or so many at a time."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if most is not None and size >= most:
            yield tuple(np.concatenate(x) for x in zip(*waiting))
            waiting, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*waiting))


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as forests of PART of them at a time."""
    for u, v in _edges(batches, PART):
        nodes, least = least_reached(u, v)
        own = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(least[own])], ["u", "v"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for u, v in _edges(batches, None):
        nodes, least = least_reached(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])


def connected_components(edges: DataFrame, most_rounds: int = 60, contract: bool = True) -> DataFrame:
    """Rows (node, component) for every node of edges (u, v), component being the smallest node reached.

    Self-loops, repeated edges and either direction are fine; nulls are left out; no edges give no rows.
    A star with very many leaves stays a set of rows: minima are taken before rows are joined, nothing is collected but
    the last FEW edges, by one task. Without contract the tasks make no forests first: edges that Python makes are forests
    already, and a second Python worker a task would hold memory for nothing.
    """
    own = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    now, before = table((own.mapInArrow(forests, "u long, v long") if contract else own).distinct(), "edges"), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] <= FEW:
            return table(now.coalesce(1).mapInArrow(_whole, "node long, component long"), "components")
        if mark == before:
            break
        before = mark
        now = table(_small(_large(now, mark[0]).where("u <> v").distinct()).distinct(), "stars")
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
