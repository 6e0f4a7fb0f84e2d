"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over their roots, a proof for every row.

A node is the lower-case hex SHA-256 of its children's digests as text, one after the other; a level's nodes are taken fanout at a time, and the
last run of a level is hashed as it is, without padding. Leaves are sorted by range over all tasks, so that each partition holds
consecutive leaves of a group, and numbered by the partitions' counts. A partition then keeps a stack of mountains, as a counter to the base of
the fanout does with its digits: a full run is hashed and carried one level up, which completes a peak. Runs that began in an earlier
partition or end in a later one stay open; open nodes (at most two runs a level) meet those of SPAN partitions at a time, round by round,
until the group's root is left. Proofs go from the top down, over chunks of levels whose subtrees have some 4,096 nodes at the bottom.

Groups and keys may be null: a null group is one of its own and the first, null keys come first in a group. Rows with equal keys are ordered by
their leaf's digest, so exact repeats are leaves of their own with one digest. Empty and very long texts are texts like others. A group of one
row has its leaf as root; one group's root is the dataset's. An empty table has no root and gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marketloom.llm.common import parts, table

#: Consecutive partitions whose open nodes meet in a round.
SPAN = 64
#: Nodes at the bottom of a chunk's subtree.
CHUNK = 4096
#: Nodes that a task of a chunk gets, about.
SHARD_ROWS = 100_000

NODE, OPEN, ROOT = 0, 1, 2
NODES = "tree string, run long, total long, level int, idx long, hash string, state int"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(column: Column) -> Column:
    """A value as a leaf holds it: - for a null, else the number of its bytes, a colon and its text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def widths(total: int, fanout: int) -> list[int]:
    """The number of nodes of each level, from the leaves to the root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Mountains:
    """The peaks over consecutive nodes, from any index on."""

    def __init__(self, fanout: int):
        self.fanout = fanout
        self.held: list[tuple[int, list[str]]] = []  # by level: the index of the first node held, and these nodes
        self.edge: list[tuple[int, int, str]] = []  # nodes of runs that began before

    def push(self, first: int, nodes: list[str], level: int = 0) -> Iterator[tuple[int, int, str]]:
        """Take the next nodes of a level and yield those that they complete above: (level, index, digest)."""
        while nodes:
            if level == len(self.held):
                self.held.append((first, []))
            start, own = self.held[level]
            start, own = (start, own + nodes) if own else (first, nodes)
            lead = min(-start % self.fanout, len(own))
            self.edge += [(level, start + i, x) for i, x in enumerate(own[:lead])]
            start, own = start + lead, own[lead:]
            full = len(own) - len(own) % self.fanout
            above = [digest("".join(own[i : i + self.fanout])) for i in range(0, full, self.fanout)]
            self.held[level] = (start + full, own[full:])
            level, first, nodes = level + 1, start // self.fanout, above
            yield from ((level, first + i, x) for i, x in enumerate(above))

    def open(self) -> list[tuple[int, int, str]]:
        """Nodes whose runs aren't whole here."""
        return self.edge + [(level, start + i, x) for level, (start, own) in enumerate(self.held) for i, x in enumerate(own)]


def merge(nodes: list[tuple[int, int, str]], total: int, fanout: int) -> list[tuple[int, int, str, int]]:
    """Open nodes of one tree, and what they complete: (level, index, digest, state)."""
    width, found, out = widths(total, fanout), dict[int, dict[int, str]](), []
    for level, i, x in nodes:
        found.setdefault(level, {})[i] = x
    for level, count in enumerate(width):
        own = found.get(level, {})
        if count == 1:
            out += [(level, i, x, ROOT) for i, x in own.items()]
            break
        for run, members in groupby(sorted(own), lambda i: i // fanout):
            at = list(members)
            if len(at) == min(fanout, count - run * fanout):
                found.setdefault(level + 1, {})[run] = above = digest("".join(own[i] for i in at))
                if level + 1 < len(width) - 1:
                    out.append((level + 1, run, above, NODE))
            else:
                out += [(level, i, own[i], OPEN) for i in at]
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
    columns = zip(*rows) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "run", "total", "level", "idx", "hash", "state"])


def stack(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    """Nodes above the leaves (tree, run, total, idx, leaf), which are sorted by tree and index; a tree that lies here whole is finished."""
    key, first, after, peaks = None, 0, 0, Mountains(fanout)

    def end() -> list[tuple]:
        if key is None:
            return []
        (tree, run, total), left = key, peaks.open()
        told = merge(left, total, fanout) if first == 0 and after == total else [(*x, OPEN) for x in left]
        return [(tree, run, total, *x) for x in told]

    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("tree", "run", "total", "idx", "leaf")]
        for own, group in groupby(zip(*columns), lambda x: x[:3]):
            members, whole = list(group), len(widths(own[2], fanout)) - 1
            while members:
                at = members[0][3]
                if own != key or at != after:
                    rows += end()
                    key, first, after, peaks = own, at, at, Mountains(fanout)
                n = next((i for i, x in enumerate(members) if x[3] != at + i), len(members))
                rows += [(*key, level, i, x, ROOT if level == whole else NODE) for level, i, x in peaks.push(at, [x[4] for x in members[:n]]) if level < whole]
                after, members = at + n, members[n:]
        yield _batch(rows)
    yield _batch(end())


@dataclass
class Forest:
    """leaves: (tree, run, total, idx, leaf and the other columns given); nodes: those above them, roots included; roots: (tree, total, hash)."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    fanout: int
    size: int
    tallest: int


def forest(rows: DataFrame, order: list[str], fanout: int = 2) -> Forest | None:
    """The trees of rows (tree, leaf, and others), whose leaves stand in the order of the columns named; None for no rows."""
    spark = rows.sparkSession
    row = table(rows.withColumn("__row", F.monotonically_increasing_id()), "leaves")  # a place of its own for each of many equal rows
    at = ["tree", *order, "leaf", "__row"]
    own = row.repartitionByRange(parts(spark), *at).sortWithinPartitions(*at).drop("__row").withColumn("part", F.spark_partition_id())
    names, numbered_schema = own.columns, StructType([*own.schema.fields, StructField("n", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            places = []
            for tree in batch.column("tree").to_pylist():
                last, n = tree, n + 1 if tree == last else 0
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*names, "n"])

    numbered = table(own.mapInArrow(number, numbered_schema), "numbered")
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("tree").orderBy("part")
    runs = table(counts.select("tree", "part", (F.row_number().over(before) - 1).cast("long").alias("run"), (F.sum("size").over(before) - F.col("size")).alias("start"), F.sum("size").over(Window.partitionBy("tree")).alias("total")), "runs")
    known = runs.agg(F.max("run").alias("run"), F.max("total").alias("total"), F.sum(F.when(F.col("run") == 0, F.col("total"))).alias("size")).first()
    if known.size is None:
        return None
    leaves = numbered.join(runs, ["tree", "part"]).withColumn("idx", F.col("start") + F.col("n")).drop("part", "start", "n")
    found = table(leaves.select("tree", "run", "total", "idx", "leaf").sortWithinPartitions("tree", "idx").mapInArrow(lambda batches: stack(batches, fanout), NODES), "peaks")
    all_nodes, span = [found.where(F.col("state") != OPEN)], 1
    while span <= known.run:
        span *= SPAN

        def meet(own: pa.Table) -> pa.Table:
            told = own.to_pydict()
            nodes = list(zip(told["level"], told["idx"], told["hash"]))
            total = told["total"][0]
            return pa.Table.from_batches([_batch([(told["tree"][0], min(told["run"]), total, *x) for x in merge(nodes, total, fanout)])])

        found = table(found.where(F.col("state") == OPEN).groupBy("tree", F.floor(F.col("run") / span)).applyInArrow(meet, NODES), "merged")
        all_nodes.append(found.where(F.col("state") != OPEN))
    nodes = all_nodes[0]
    for more in all_nodes[1:]:
        nodes = nodes.unionByName(more)
    return Forest(leaves, nodes, nodes.where(F.col("state") == ROOT).select("tree", "total", "hash"), fanout, known.size, len(widths(known.total, fanout)) - 1)


def folded(start: str, path: str) -> str:
    """The root that a leaf's digest and a proof lead to. A proof is a step a level, parted by ;, of the digests left and right of the node, parted by |."""
    for step in path.split(";") if path else ():
        left, right = step.split("|")
        start = digest(left + start + right)
    return start


def subtree_paths(levels: list[tuple[int, int, list[str]]], top: str, height: int, fanout: int) -> list[str]:
    """Proofs of a subtree's lowest nodes; levels are (level, first index, digests) from the top down, top is the proof of the node above them, or of the root."""
    above, first = [top], 0
    for level, start, nodes in levels:
        own = [top] if level == height else []
        for i in range(0, 0 if own else len(nodes), fanout):
            run = nodes[i : i + fanout]
            parent = above[(start + i) // fanout - first] if len(above) > 1 or first else above[0]
            rest = f";{parent}" if parent else ""
            own += [f"{''.join(run[:k])}|{''.join(run[k + 1 :])}{rest}" for k in range(len(run))]
        above, first = own, start
    return above


def paths(trees: Forest, tops: DataFrame, carry: list[str], changed: str | None = None, keep: bool = False) -> DataFrame:
    """The leaves (columns of carry, tree, leaf) with their group's root, proof_sha256 and folded_root, and proof if it is kept.

    tops gives each tree's root its own proof and names the root: (tree, path, subroot). The fold starts from the column changed where it
    isn't null, else from the leaf.
    """
    spark, fanout = trees.leaves.sparkSession, trees.fanout
    chunk = max(1, int(log2(CHUNK) / log2(fanout)))
    shards = max(parts(spark), -(-2 * trees.size // SHARD_ROWS))
    extra = [*carry, *([changed] if changed else [])]
    none = [F.lit(None).cast(trees.leaves.schema[c].dataType).alias(c) for c in extra]
    every = trees.leaves.select("tree", "total", F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash"), *extra).unionByName(trees.nodes.where("level > 0").select("tree", "total", "level", "idx", "hash", *none))
    height = F.when(F.col("total") == 1, 0).otherwise(F.size(F.expr(f"filter(sequence(1, 64), l -> pow(CAST({fanout} AS DOUBLE), l - 1) < total)")))
    ends = tops.join(trees.roots.select("tree", "total"), "tree").select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", F.floor(height / chunk).alias("chunk"))
    upper = None
    for j in range(trees.tallest // chunk, -1, -1):
        low, high = j * chunk, (j + 1) * chunk
        own = every.where((F.col("level") >= low) & (F.col("level") < high)).withColumn("block", F.expr(f"idx div CAST(pow({fanout}, {high} - level) AS BIGINT)"))
        given = ends.where(F.col("chunk") == j).drop("chunk")
        given = given if upper is None else given.unionByName(upper)
        deal = lambda df: df.withColumn("shard", F.pmod(F.xxhash64("tree", "block"), F.lit(shards)))
        names = [*carry, "tree", "idx", "leaf", "subroot", "proof_sha256", "folded_root", "proof"] if j == 0 else ["tree", "block", "path", "subroot"]
        schema = ", ".join([*(f"`{c}` {trees.leaves.schema[c].dataType.simpleString()}" for c in (carry if j == 0 else [])), *(f"{c} {'long' if c in ('idx', 'block') else 'string'}" for c in names if c not in carry)])

        def walk(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by([("tree", "ascending"), ("block", "ascending"), ("level", "descending"), ("idx", "ascending")])
            tops = {(t, b): (p, s) for t, b, p, s in zip(*(right.column(c).to_pylist() for c in ("tree", "block", "path", "subroot")))}
            rows = list(zip(*(left.column(c).to_pylist() for c in ("tree", "block", "level", "idx", "hash", "total"))))
            out: list[list] = [[] for _ in names]
            places: list[int] = []
            at = 0
            for key, members in groupby(rows, lambda x: x[:2]):
                own = list(members)
                at += len(own)
                top, subroot = tops[key]
                levels = [(level, x[0][3], [y[4] for y in x]) for level, g in groupby(own, lambda x: x[2]) if (x := list(g))]
                if levels[-1][0] != low:
                    continue
                found = subtree_paths(levels, top, len(widths(own[0][5], fanout)) - 1, fanout)
                _, first, nodes = levels[-1]
                if low:
                    for column, values in zip(out, ([key[0]] * len(found), range(first, first + len(found)), found, [subroot] * len(found))):
                        column.extend(values)
                    continue
                mine = range(at - len(found), at)
                places.extend(mine)
                begin = left.column(changed).slice(mine.start, len(found)).to_pylist() if changed else [None] * len(found)
                beyond: dict[tuple[str, str], str] = {}
                ends_at = []
                for x, y, p in zip(nodes, begin, found):  # most leaves share the way from some node of their chunk on
                    inside, outside = (p[: -len(top) - 1], top) if top and len(p) > len(top) else ("" if top else p, top)
                    reached = folded(y or x, inside)
                    if (reached, outside) not in beyond:
                        beyond[reached, outside] = folded(reached, outside)
                    ends_at.append(beyond[reached, outside])
                proofs = [digest(p.replace("|", "").replace(";", "")) for p in found]
                for column, values in zip(out[len(carry) :], ([key[0]] * len(found), range(first, first + len(found)), nodes, [subroot] * len(found), proofs, ends_at, found if keep else [None] * len(found))):
                    column.extend(values)
            told = [pa.array(x, pa.int64() if n in ("idx", "block") else pa.string()) for x, n in zip(out, names)]
            if low == 0:
                told[: len(carry)] = [left.column(c).take(pa.array(places, pa.int64())).combine_chunks() for c in carry]
            return pa.Table.from_arrays(told, names)

        upper = deal(own).groupBy("shard").cogroup(deal(given).groupBy("shard")).applyInArrow(walk, schema)
        if j:
            upper = table(upper, "paths")
    return upper


def manifest(docs: DataFrame, columns: list[str], group: str = "lang", key: str = "doc_id", changes: dict[str, Column] | None = None, fanout: int = 2, keep: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified, and proof if it is kept) of every row; a leaf is made of the columns given.

    Groups are ordered by their text, byte by byte. changes are columns in place of those of their names: the fold then starts from the
    changed row's leaf, and verified says whether it still leads to the root. A proof can be checked without the table: folded(leaf, proof).
    """
    if fanout < 2:
        raise ValueError("a fanout of 2 or more is needed")
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    now = [(changes or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf(*(F.col(c) for c in columns)).alias("leaf"), (leaf(*now) if changes else F.lit(None).cast("string")).alias("changed"))
    rows = rows.withColumn("changed", F.when(F.col("changed") != F.col("leaf"), F.col("changed")))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    trees = forest(rows, ["key"], fanout)
    if trees is None:
        return docs.sparkSession.createDataFrame([], schema + (", proof string" if keep else ""))
    roots = table(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("hash").alias("leaf")), "roots")
    over = forest(roots, ["name"], fanout)
    root = over.roots.first().hash
    tops = table(paths(over, over.roots.select("tree", F.lit("").alias("path"), F.col("hash").alias("subroot")), ["name"], keep=True).select(F.col("name").alias("tree"), F.col("proof").alias("path"), F.col("leaf").alias("subroot")), "tops")
    got = paths(trees, tops, ["key"], "changed", keep)
    return got.select(F.col("key").alias(key), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), *(["proof"] if keep else []))
