"""Windows of a fixed length that occur more than once in a corpus, exactly and without shipping every window.

A sequence (the bytes or the words of a document) has a window at each position. Its key is the least hash among the
k-grams inside, so equal windows have equal keys, and neighbouring windows mostly share one: a run of them with one key
is a region, which holds all the run's content once. Regions are counted by (key, content):

* a key with one content only needs no search (unless the key occurs twice inside): its windows occur again exactly
  where the content does;
* a key with several contents sends one region of each, with its weight, to a shard, where a solver (suffix arrays or
  suffix trees) finds the windows that they share.

A key whose contents exceed SHARD_BYTES is dealt over several shards by content; their windows are merged afterwards by
binary search of one shard's sorted digests in another's, so no task holds an unbounded key.

Equality of contents is decided by 64 bits beside the key's 64, that of a dealt key's windows by 128, that of words by 64.
Ids are integers. Null and empty sequences have no window, and one shorter than a window none either; ties and repeated rows are told
apart by (id, hash of the text), and exact repeats share their spans; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import mix, prefix_sums, powers, table, word_hashes

SHARD_BYTES = 2_000_000
#: A region with more windows (periodic text) is cut into pieces of so many, most of which are equal.
PIECE = 1 << 13
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Kind:
    """What is compared: unit is 'bytes' or 'words'; a window has length of them, a k-gram gram."""

    unit: str
    length: int
    gram: int

    @property
    def size(self) -> int:
        return 1 if self.unit == "bytes" else 8

    def content(self, text: str | None) -> np.ndarray:
        """The sequence of a text: its bytes, or a 64-bit hash of each word."""
        data = (text or "").encode()
        return np.frombuffer(data, np.uint8) if self.unit == "bytes" else word_hashes(data)[0]


def regions(x: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window, number of windows of each region of a sequence, and whether its key occurs in it twice.

    Only a region whose key occurs twice can hold equal windows itself.
    """
    windows = len(x) - kind.length + 1
    if windows < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    sums = prefix_sums(x.astype(np.uint64) + np.uint64(1))
    grams = len(x) - kind.gram + 1
    least = gram = mix((sums[kind.gram :] - sums[:grams]) * powers(len(sums))[1][:grams])
    width, have = kind.length - kind.gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    start = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    count = np.diff(np.append(start, windows))
    if count.max() > PIECE:
        pieces = -(-count // PIECE)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.repeat(start + count, pieces)
        start = np.repeat(start, pieces) + nth * PIECE
        count = np.minimum(end - start, PIECE)
    key = least[start]
    # Keys are minima, so only small hashes can be occurrences of one.
    at = np.flatnonzero(gram <= key.max())
    order = np.argsort(gram[at], kind="stable")
    at, small = at[order], gram[at][order]
    first, last = np.searchsorted(small, key, "left"), np.searchsorted(small, key, "right")
    twice = np.zeros(len(key), bool)
    for r in np.flatnonzero(last - first > 1).tolist():
        own = at[first[r] : last[r]]
        a, b = np.searchsorted(own, (start[r], start[r] + count[r] + width - 1))
        twice[r] = b - a > 1
    return key, start, count, twice


def with_row(docs: DataFrame, key: str) -> DataFrame:
    """doc (a null id counts as the last), t (a hash of the text) and text, which name a row up to exact repeats."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("t"), F.col("text"))


def all_regions(rows: DataFrame, kind: Kind) -> DataFrame:
    """Rows (doc, t, key, c, s, n, twice): the regions of each document; c is a hash of the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size, more = xxhash.xxh3_64_intdigest, kind.size, kind.length - 1
        for batch in batches:
            at, keys, starts, counts, contents, selves = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                x = kind.content(text)
                k, s, n, twice = regions(x, kind)
                if len(k):
                    raw = memoryview(x.tobytes() if size > 1 else x)
                    at.append(np.full(len(k), i))
                    keys.append(k)
                    starts.append(s)
                    counts.append(n)
                    selves.append(twice)
                    contents += [digest(raw[size * a : size * (a + b + more)]) for a, b in zip(s.tolist(), n.tolist())]
            join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            rows = pa.array(join(at, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(join(keys, np.uint64).view(np.int64)), pa.array(np.array(contents, np.uint64).view(np.int64)), pa.array(join(starts, np.int32)), pa.array(join(counts, np.int32)), pa.array(join(selves, bool))], ["doc", "t", "key", "c", "s", "n", "twice"])

    return rows.mapInArrow(run, "doc long, t long, key long, c long, s int, n int, twice boolean")


def cut_out(rows: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """Rows (shard, key, c, doc, m, chunks, n, content) for the regions that wanted lists for each (doc, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = kind.content(text)
                raw, size = x.tobytes(), kind.size
                cuts = [raw[size * r["s"] : size * (r["s"] + r["n"] + kind.length - 1)] for r in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in own], pa.int64()) for c in ("shard", "key", "c", "doc", "m", "chunks", "n")] + [pa.array(cuts, pa.binary())], ["shard", "key", "c", "doc", "m", "chunks", "n", "content"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for b in run(batches):
            waiting.append(b)
            size += b.nbytes
            if size > 4_000_000:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, size = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    found = rows.join(wanted.hint("shuffle_hash"), ["doc", "t"]).select("text", "own")
    return found.mapInArrow(joined, "shard long, key long, c long, doc long, m long, chunks long, n long, content binary")


#: A solver gets the regions' sequences, their numbers of windows, documents and weights; it returns for each
#: region a mask of its windows that count as matched, and for all windows in order the number of their class.
Solver = Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray], tuple[list[np.ndarray], np.ndarray]]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.diff(np.concatenate(([False], mask, [False])).view(np.int8))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


DIGEST = np.dtype("S16")


@dataclass
class Windows:
    """Windows by their 128-bit digests; rows are key, content, weight, document and place in the content."""

    digest: np.ndarray
    rows: np.ndarray

    def take(self, at: np.ndarray) -> Windows:
        return Windows(self.digest[at], self.rows[:, at])

    def sorted(self) -> Windows:
        return self.take(np.argsort(self.digest, kind="stable"))

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """For sorted digests the class of each window, and where the classes begin."""
        new = np.concatenate(([True], self.digest[1:] != self.digest[:-1]))
        return np.cumsum(new) - 1, np.flatnonzero(new)

    def merged(self, other: Windows) -> Windows:
        """Both, sorted, of two that are: the other's places are found by binary search."""
        at = np.searchsorted(self.digest, other.digest, "right") + np.arange(len(other.digest))
        n = len(self.digest) + len(other.digest)
        mine = np.ones(n, bool)
        mine[at] = False
        digest, rows = np.empty(n, DIGEST), np.empty((len(self.rows), n), np.int64)
        digest[at], rows[:, at] = other.digest, other.rows
        digest[mine], rows[:, mine] = self.digest, self.rows
        return Windows(digest, rows)

    def packed(self) -> bytes:
        return zstandard.compress(self.digest.tobytes() + np.ascontiguousarray(self.rows).tobytes(), 1)

    @classmethod
    def unpacked(cls, b: bytes) -> Windows:
        raw = zstandard.decompress(b)
        n = len(raw) // 56
        return cls(np.frombuffer(raw[: 16 * n], DIGEST), np.frombuffer(raw[16 * n :], np.int64).reshape(5, n))


def solve(cuts: DataFrame, kind: Kind, solver: Solver, smaller: bool, shards: int) -> tuple[DataFrame, DataFrame]:
    """(key, c, a, b): runs of matched windows in each region; and of keys dealt over several shards the windows by digest.

    A shard sends a window of such a key once, with its weight or least document, packed with others of a digest range.
    """

    def run(own: pa.Table) -> pa.Table:
        dtype = np.uint8 if kind.unit == "bytes" else np.uint64
        own = own.sort_by([("key", "ascending"), ("c", "ascending"), ("doc", "ascending")])
        contents = own.column("content").to_pylist()
        x = [np.frombuffer(b, dtype) for b in contents]
        n, doc, m = (own.column(c).to_numpy() for c in ("n", "doc", "m"))
        masks, _ = solver(x, n, doc, m)
        key, c, chunks = (own.column(k).to_numpy() for k in ("key", "c", "chunks"))
        out, sent, digests = [[] for _ in range(4)], [], []
        for i, mask in enumerate(masks):
            a, b = runs(mask)
            for column, v in zip(out, (np.full(len(a), key[i]), np.full(len(a), c[i]), a, b), strict=True):
                column.append(v)
            if chunks[i] > 1:  # every window, for the merge
                raw, size, k = contents[i], kind.size, int(n[i])
                digests += [xxhash.xxh3_128_digest(raw[size * j : size * (j + kind.length)]) for j in range(k)]
                sent.append(np.stack([np.full(k, v) for v in (key[i], c[i], m[i], doc[i])] + [np.arange(k)]))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        columns = [pa.array(join(v)) for v in out]
        made = pa.Table.from_arrays([*columns, pa.nulls(len(columns[0]), pa.int64()), pa.nulls(len(columns[0]), pa.binary())], ["key", "c", "a", "b", "range", "windows"])
        if not sent:
            return made
        found = Windows(np.frombuffer(b"".join(digests), DIGEST), np.concatenate(sent, axis=1)).sorted()
        group, first = found.classes()
        if smaller:
            least = np.minimum.reduceat(found.rows[3], first)
            found = found.take(found.rows[3] == least[group])
        else:  # one window of a class, with the weight of all
            total = np.add.reduceat(found.rows[2], first)
            found = found.take(first)
            found.rows[2] = total
        of = (found.digest.view(np.uint64).reshape(-1, 2)[:, 0] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        cut = np.flatnonzero(np.diff(of[order], prepend=-1))
        pieces = [found.take(x).packed() for x in np.split(order, cut[1:])]
        empty = pa.nulls(len(pieces), pa.int64())
        packs = pa.Table.from_arrays([empty, empty, empty, empty, pa.array(of[order][cut]), pa.array(pieces, pa.binary())], made.column_names)
        return pa.concat_tables([made, packs])

    both = table(cuts.groupBy("shard").applyInArrow(run, "key long, c long, a long, b long, range long, windows binary"), "solved")
    return both.where("range IS NULL").select("key", "c", "a", "b"), both.where("range IS NOT NULL").select("range", "windows")


def merge(windows: DataFrame, smaller: bool) -> DataFrame:
    """Matched windows of keys dealt over several shards: each shard's sorted pack of a digest range is merged into the others' by binary search."""

    def run(own: pa.Table) -> pa.Table:
        packs = [Windows.unpacked(b) for b in own.column("windows").to_pylist()]
        while len(packs) > 1:
            packs = [a.merged(b) for a, b in zip(packs[::2], packs[1::2])] + packs[len(packs) & ~1 :]
        found = packs[0]
        group, first = found.classes()
        w = found.rows
        if smaller:
            hit = w[3] > np.minimum.reduceat(w[3], first)[group]
        else:
            hit = (np.add.reduceat(w[2], first)[group] > 1) & (w[2] == 1)
        w = w[:, hit]
        w = w[:, np.lexsort((w[4], w[1], w[0]))]
        edge = np.ones(w.shape[1], bool)
        edge[1:] = (w[0, 1:] != w[0, :-1]) | (w[1, 1:] != w[1, :-1]) | (w[4, 1:] != w[4, :-1] + 1)
        at = np.flatnonzero(edge)
        return pa.Table.from_arrays([pa.array(v) for v in (w[0, at], w[1, at], w[4, at], np.diff(np.append(at, w.shape[1])))], ["key", "c", "a", "b"])

    return windows.groupBy("range").applyInArrow(run, "key long, c long, a long, b long")


def matched(docs: DataFrame, kind: Kind, solver: Solver, smaller: bool, key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (doc, t, spans): for each row of with_row(docs) that has any, runs (s, n) of windows that occur elsewhere.

    With smaller, a window counts where it also starts in a document with a smaller id; else where it starts anywhere
    else, the same document included.
    """
    rows = with_row(docs, key)
    spark = docs.sparkSession
    found = table(all_regions(rows, kind), "regions")
    by_content = found.groupBy("key", "c").agg(F.count("*").alias("m"), F.min(F.struct("doc", "t", "s")).alias("rep"), F.first("n").alias("n"), F.lit(False).alias("again") if smaller else (F.first("twice") & (F.count("*") == 1)).alias("again"))
    mixed = by_content.groupBy("key").agg(F.count("*").alias("d"), F.sum((F.col("n") + kind.length) * kind.size).alias("bytes")).where("d > 1")
    live = by_content.join(mixed, "key", "left").where("m > 1 OR d > 1 OR again").withColumn("chunks", F.coalesce(F.ceil(F.col("bytes") / shard_bytes), F.lit(1)))
    live = table(live, "live")
    sought = live.where("d > 1 OR again")
    total = sought.agg(F.sum((F.col("n") + kind.length) * kind.size)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // shard_bytes))
    shard = F.pmod(F.xxhash64("key", F.pmod("c", "chunks")), F.lit(shards))
    wanted = sought.select("rep.doc", "rep.t", F.struct(shard.alias("shard"), "key", "c", F.col("rep.doc").alias("doc"), "m", "chunks", F.col("rep.s").alias("s"), "n").alias("x")).groupBy("doc", "t").agg(F.collect_set("x").alias("own"))
    in_shard, dealt = solve(cut_out(rows, wanted, kind), kind, solver, smaller, shards)
    some = in_shard
    if live.where("chunks > 1").limit(1).count():
        some = in_shard.unionByName(merge(dealt, smaller))
    some = some.groupBy("key", "c").agg(F.collect_set(F.struct("a", "b")).alias("part"))
    whole = F.col("rep.doc") < F.col("doc") if smaller else F.col("m") > 1
    told = found.join(live.select("key", "c", "m", "rep").join(some, ["key", "c"], "left").where("m > 1 OR part IS NOT NULL"), ["key", "c"])
    spans = F.when(whole, F.array(F.struct(F.col("s").cast("long").alias("s"), F.col("n").cast("long").alias("n")))).otherwise(F.transform("part", lambda p: F.struct((p.a + F.col("s")).alias("s"), p.b.alias("n"))))
    return told.select("doc", "t", F.explode(spans).alias("x")).groupBy("doc", "t").agg(F.collect_set("x").alias("spans"))


def covered(n: int, spans: list[dict], length: int) -> np.ndarray:
    """Which of n elements lie in a window of the runs."""
    edge = np.zeros(n + 1, np.int64)
    for x in spans:
        edge[x["s"]] += 1
        edge[x["s"] + x["n"] + length - 1] -= 1
    return np.cumsum(edge)[:-1] > 0
