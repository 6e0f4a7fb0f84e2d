"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are split into BLOCKS blocks. Two that differ in at most d bits agree in all blocks but d, so
rows are keyed by every choice of BLOCKS - d blocks and joined on equal keys, and each pair is verified. Equal
fingerprints are one row from the start. Where a key holds more than PAIRS fingerprints, its pairs aren't made: each
fingerprint is keyed by its neighbours at one differing bit within the free blocks, and those that share a neighbour
(at most 65, two bits apart at most) form a star.

Null and empty texts have fingerprint zero and link like others; repeated rows share a fingerprint; rows with a null
id take part in links but are no component's name unless all are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.caps import forest
from marketloom.llm.common import mix, parts, table
from marketloom.llm.components import connected_components, forests

BLOCKS = 5
PAIRS = 64
SEED = 42


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Space-joined shingles of width words, in order; fewer words give one of them all; none gives none."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [joined[s:e] for s, e in zip(starts, ends[width - 1 :])]


def text_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes.split() takes 0x20 and 0x09-0x0D as separators."""
    return (text or "").encode().lower().split()


def fingerprint(text: str | None, width: int = 3) -> bytes:
    """64 bits, each set if set in over half of the shingles' XXH64."""
    h = shingles(text_words(text), width)
    if not h:
        return bytes(8)
    digest, count = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        raw = np.frombuffer(b"".join([digest(x, SEED) for x in h[i : i + (1 << 15)]]), np.uint8)
        count += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(h)).tobytes()


def fingerprints(docs: DataFrame, keys: list[str], width: int = 3) -> DataFrame:
    """keys and fp, the fingerprint as a signed long."""
    kept = docs.select(*keys, F.col("text").alias("__text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(t, width) for t in batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.frombuffer(raw, ">i8").astype("<i8"))], [*keys, "fp"])

    return kept.mapInArrow(run, out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def choices(distance: int, blocks: int = BLOCKS) -> list[int]:
    """Masks of every choice of all blocks but distance."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in range(blocks)]
    return [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]


def near_pairs(prints: DataFrame, distance: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fp, enough to join every two that differ in distance bits at most.

    Keys of up to PAIRS fingerprints give every such pair. Larger keys give stars whose every edge is such a pair
    too; that needs distance 2, so for other distances their pairs are made.
    """
    masks = choices(distance, blocks)
    key = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)))).alias("x")
    keyed = prints.select("fp", key).select("fp", "x.c", "x.k")
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    live = table(keyed.join(sizes, ["c", "k"]), "blocks")
    few = live if distance != 2 else live.where(F.col("n") <= PAIRS)
    a, b = few.select("c", "k", F.col("fp").alias("u")), few.select("c", "k", F.col("fp").alias("v"))
    pairs = a.join(b, ["c", "k"]).where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v")
    if distance == 2:
        free = F.create_map(*(x for i, m in enumerate(masks) for x in (F.lit(i), F.array(F.lit(0), *(F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1)).cast("array<long>"))))
        near = live.where(F.col("n") > PAIRS).select("c", "k", "fp", F.explode(F.element_at(free, F.col("c"))).alias("e")).select("c", "k", "fp", F.col("fp").bitwiseXOR(F.col("e")).alias("mid"))
        stars = near.groupBy("c", "k", "mid").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
        pairs = pairs.unionByName(stars.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u > v").select("u", "v"))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, key: str = "doc_id") -> DataFrame:
    """Rows (key, fp, component_id): the smallest key reachable over fingerprints that differ in distance bits at most."""
    prints = table(fingerprints(docs, [key], width), "prints")
    distinct = prints.groupBy("fp").agg(F.min(key).alias("least"))
    components = connected_components(near_pairs(distinct, distance))
    named = distinct.join(components, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = table(named, "named")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = named.join(names, "component").select("fp", "component_id")
    return prints.join(lookup, "fp").select(key, "fp", "component_id")


#: Wide fingerprints for similarities well below one: 64-bit words, blocks of sampled bits.
WORDS = 8
#: A block has so many bits more than the number of fingerprints has, so the unrelated ones in it don't grow in number.
SPARE_BITS = 2
#: Share of pairs that no block holds, where they differ by BLOCK_DEVIATIONS more bits than the least similar do on average.
MISSED, BLOCK_DEVIATIONS = 0.02, 1
#: Standard deviations of the Hamming distance that the candidates' limit lies above what the least similarity gives, over all words and over the one
#: that a block compares: unrelated words pass that once in 15,000 times, while similar texts meet in several blocks, each with another word.
DEVIATIONS, WORD_DEVIATIONS = 5, 2
#: Rows of a block, or of a component of candidates, that are compared with each other at once.
TILE = 1024
#: Rows of each larger component that all of its tiles get.
PIVOTS = 64
#: Bytes of shingle hashes in a tile, as far as texts can be parted, and in a task.
TILE_BYTES = 1 << 23
#: Rows of blocks in a partition.
BLOCK_ROWS = 4_000_000


def block_plan(n: int, share: float) -> tuple[int, int]:
    """Bits of a block and number of blocks for n fingerprints, so that MISSED of the pairs that differ in share of their bits meet in none."""
    bits = max(16, int(np.ceil(np.log2(max(n, 2)))) + SPARE_BITS)
    return bits, int(np.ceil(np.log(MISSED) / np.log1p(-((1 - share) ** bits))))


def differing(least: float, deviations: float, bits: int = 64 * WORDS) -> int:
    """Of so many bits, those in which texts of similarity least differ on average, and deviations more."""
    share = float(np.arccos(2 * least / (1 + least)) / np.pi)
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(text_words(text), width)], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of shingles; that of two empty ones is one."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def wide_fingerprint(text: str | None, width: int = 5) -> bytes:
    """WORDS * 64 bits, each set if set in over half of the distinct shingles' hashes, mixed anew for each word."""
    h = shingle_set(text, width)
    if not len(h):
        return bytes(8 * WORDS)
    count = np.zeros((WORDS, 64), np.int64)
    for i in range(0, len(h), 1 << 14):
        own = h[i : i + (1 << 14)]
        for k in range(WORDS):
            raw = mix(own + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
            count[k] += np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(h)).tobytes()


def block_edges(k: np.ndarray, node: np.ndarray, sketch: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate edges (u, v) of rows sorted by block: in a block of up to TILE rows a forest of those whose sketches differ in most bits at most, in a larger one a star."""
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(k)))
    two = start[size == 2]
    near = two[np.bitwise_count(sketch[two] ^ sketch[two + 1]) <= most]
    yield node[near], node[near + 1]
    for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        own = node[a : a + n]
        if n > TILE:
            yield own[1:], np.full(n - 1, own[0])
        else:
            x = sketch[a : a + n]
            name = forest(np.bitwise_count(x[:, None] ^ x[None, :]) <= most)
            rows = np.flatnonzero(name != np.arange(n))
            yield own[rows], own[name[rows]]


def block_keys(raw: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By sample, the blocks of fingerprints (rows of bytes) and the word that is compared there, sample by sample another one: (samples, rows) each."""
    weight = 1 << np.arange(picks.shape[1], dtype=np.int64)
    bits = np.unpackbits(raw, axis=1)
    words = np.ascontiguousarray(raw).view(np.int64)
    k = np.stack([bits[:, p].astype(np.int64) @ weight + (i << picks.shape[1]) for i, p in enumerate(picks)])
    return k, np.stack([words[:, i % WORDS] for i in range(len(picks))])


def candidate_edges(prints: DataFrame, least: float, count: int) -> DataFrame:
    """Edges (u, v) between fingerprints (node, fp) that meet in a block of sampled bits and whose words there are close.

    Rows (block, node, word) are sorted by block once; a task streams over its blocks and holds no more than TILE rows
    of one. Unrelated fingerprints give far less than an edge each, so that these don't join the families of copies to each other. Blocks are so long that unrelated fingerprints fill none, so a block over TILE rows is a family of copies: its rows
    are all candidates, joined to one of them without comparing.
    """
    share = differing(least, BLOCK_DEVIATIONS) / (64 * WORDS)
    bits_each, samples = block_plan(count, share)
    rng = np.random.default_rng(SEED)
    picks = np.array([rng.choice(64 * WORDS, bits_each, replace=False) for _ in range(samples)])
    most = differing(least, WORD_DEVIATIONS, 64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                k, word = block_keys(raw, picks)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.tile(batch.column(0).to_numpy(), samples)), pa.array(word.ravel())], ["k", "node", "sketch"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            left = [np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate(left)]
            k = left[0]
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last block may go on in the next batch
            yield from out(*(x[:last] for x in left))
            left = [x[last:] for x in left]
            if len(left[0]) > 2 * TILE:  # a star from its first row; the others are done with
                yield pa.RecordBatch.from_arrays([pa.array(left[1][TILE + 1 :]), pa.array(np.full(len(left[0]) - TILE - 1, left[1][0]))], ["u", "v"])
                left = [x[: TILE + 1] for x in left]
        yield from out(*left)

    def out(k: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = list(block_edges(k, node, sketch.view(np.uint64), most))
        u, v = (np.concatenate(x) for x in zip(*found))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    keyed = prints.select("node", "fp").mapInArrow(keys, "k long, node long, sketch long")
    shards = max(parts(prints.sparkSession), -(-count * samples // BLOCK_ROWS))
    return keyed.repartition(shards, "k").sortWithinPartitions("k").mapInArrow(lambda batches: forests(edges(batches)), "u long, v long")


#: Shingles that more rows of a group have are multiplied as columns of a matrix, others give their pairs.
FEW = 12


def shared(sets: list[np.ndarray], left: int) -> np.ndarray:
    """How many elements each of the first left sets has in common with every later set."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    element = np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    start = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1]))) if len(element) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(element)))
    pairs = []
    for c in range(2, FEW + 1):
        members = row[start[size == c][:, None] + np.arange(c)]
        for i, j in combinations(range(c), 2):  # rows are ascending
            pairs.append((members[:, i] * n + members[:, j])[members[:, i] < left])
    out = np.bincount(np.concatenate(pairs), minlength=left * n).reshape(left, n).astype(np.float32)
    many = np.flatnonzero(size > FEW)
    for at in range(0, len(many), 2048):
        own = many[at : at + 2048]
        has = np.zeros((n, len(own)), np.float32)
        column = np.repeat(np.arange(len(own)), size[own])
        has[row[np.repeat(start[own], size[own]) + np.arange(len(column)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])], column] = 1
        out += has[:left] @ has.T
    return out


def verified(words: np.ndarray, sets: list[np.ndarray], most: int, least: float, left: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs within most bits whose sets have a Jaccard of least or more; of the first left rows with all, the others not among themselves."""
    n = len(words)
    if n == 2:
        near = np.bitwise_count(words[0] ^ words[1]).sum() <= most and jaccard(sets[0], sets[1]) >= least
        return np.arange(near), np.arange(1, 1 + near)
    size = np.array([len(x) for x in sets], np.float64)
    both, near = shared(sets, left), np.zeros((n, n), bool)
    for i in range(0, left, 256):  # few rows at a time, for the sake of memory
        rows = slice(i, min(i + 256, left))
        near[rows] = both[rows] >= least * (size[rows, None] + size[None, :] - both[rows])
        bits = np.zeros(near[rows].shape, np.uint16)
        for k in range(WORDS):
            bits += np.bitwise_count(words[rows, None, k] ^ words[None, :, k])
        near[rows] &= bits <= most
    near |= near.T
    np.fill_diagonal(near, False)
    name = forest(near)
    u = np.flatnonzero(name != np.arange(n))
    return u, name[u]


def meet(rows: DataFrame, most: int, least: float) -> DataFrame:
    """Edges (u, v) within each group (component, a, b) of rows (.., side, node, fp, h): side 0 with all, side 1 not with side 1."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.length("h") + 100)).first()[0] or 0
    shards = max(4 * parts(spark), -(-total // TILE_BYTES))

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by([(c, "ascending") for c in ("component", "a", "b", "side", "node")])
        key = np.stack([own.column(c).to_numpy() for c in ("component", "a", "b")])
        node, side = own.column("node").to_numpy(), own.column("side").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        u, v = [], []
        for a, b in zip(start.tolist(), [*start[1:].tolist(), own.num_rows]):
            words = np.frombuffer(b"".join(own.column("fp").slice(a, b - a).to_pylist()), np.uint64).reshape(-1, WORDS)
            sets = [np.frombuffer(x, np.uint64) for x in own.column("h").slice(a, b - a).to_pylist()]
            x, y = verified(words, sets, most, least, int((side[a:b] == 0).sum()))
            u.append(node[a:b][x])
            v.append(node[a:b][y])
        return pa.Table.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (u, v)], ["u", "v"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("component", "a", "b"), F.lit(shards)))
    return dealt.select("shard", "component", "a", "b", "side", "node", "fp", "h").groupBy("shard").applyInArrow(run, "u long, v long")


def similar_links(sets: DataFrame, most: int, least: float) -> DataFrame:
    """Edges (u, v) that join exactly the rows (node, component, fp, h) that similarity joins, within components of candidates.

    A component of up to TILE rows (or TILE_BYTES) is one group. A larger one is dealt into tiles, each with the same PIVOTS rows
    or so, which joins most of a family of copies. Only the rows that are not in the component's largest class then still
    meet all rows of the component, tile by tile; so a component of n rows costs n, not n * n, as far as pivots join it.
    """
    sizes = sets.groupBy("component").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.length("h")) / TILE_BYTES)).alias("tiles"))
    dealt = table(sets.join(sizes, "component").withColumn("a", F.pmod(F.xxhash64("node"), F.col("tiles"))), "dealt")
    zero = F.lit(0).cast("long")
    groups = dealt.select("component", "a", zero.alias("b"), F.lit(0).alias("side"), "node", "fp", "h")
    large = dealt.where("tiles > 1")
    if not large.limit(1).count():
        return meet(groups, most, least)
    is_pivot = F.pmod(F.xxhash64(F.lit("pivot"), "node"), F.ceil(F.col("n") / PIVOTS)) == 0
    pivots = large.where(is_pivot).withColumn("t", F.explode(F.sequence(zero, F.col("tiles") - 1))).where("t <> a")
    first = table(meet(groups.unionByName(pivots.select("component", F.col("t").alias("a"), zero.alias("b"), F.lit(0).alias("side"), "node", "fp", "h")), most, least), "first")
    classes = connected_components(first, contract=False)
    named = large.join(classes.withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    count = named.groupBy("component", "class").agg(F.count("*").alias("m"))
    main = count.groupBy("component").agg(F.max_by("class", F.struct("m", "class")).alias("main"))
    named = named.join(main, "component").withColumn("rest", F.col("class") != F.col("main"))
    few = table(named.where("rest").groupBy("component").agg(F.ceil(F.count("*") / TILE).alias("others")), "rest")
    if not few.limit(1).count():
        return first
    live = named.join(few, "component")
    left = live.where("rest").withColumn("b", F.pmod(F.xxhash64(F.lit("rest"), "node"), F.col("others"))).withColumn("a", F.explode(F.sequence(zero, F.col("tiles") - 1)))
    right = live.withColumn("c", F.explode(F.sequence(zero, F.col("others") - 1)))
    both = left.select("component", "a", "b", F.lit(0).alias("side"), "node", "fp", "h").unionByName(right.select("component", "a", F.col("c").alias("b"), F.lit(1).alias("side"), "node", "fp", "h"))
    return first.unionByName(meet(both, most, least))


def similar_texts(docs: DataFrame, width: int = 5, least: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Rows (key, t, component_id, first): texts whose shingles have a similarity (Jaccard) of least or more are linked.

    Such texts differ in a share of acos(2s / (1 + s)) / pi of a wide fingerprint's bits on average. Candidates meet in blocks of
    sampled bits (block_plan): at the least similarity about 2 % of the pairs meet in none, above it fewer. The texts of each component of
    candidates then meet (similar_links), and a pair whose fingerprints differ in DEVIATIONS standard deviations more than the
    average at most is a link only if the Jaccard of its shingles, taken exactly over their hashes, is least or more. t is a hash of
    the text, so that (key, t) names a row up to exact repeats; first is true for the component's least (key, t) only, null keys being last.

    Null and empty texts have no shingles and are alike; a text of fewer words than a shingle has is one shingle; texts of any length are
    read whole; repeated rows share a component, as do rows of one key with equal texts; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([wide_fingerprint(t, width) for t in batch.column(2).to_pylist()], pa.binary())], ["doc", "t", "fp"])

    last = F.lit((1 << 63) - 1)
    texts = docs.select(F.coalesce(F.col(key).cast("long"), last).alias("doc"), F.xxhash64("text").alias("t"), "text")
    prints = table(texts.mapInArrow(run, "doc long, t long, fp binary"), "prints")
    distinct = table(prints.groupBy("fp").agg(F.min(F.struct("doc", "t")).alias("x")).select("fp", F.xxhash64("fp").alias("node"), "x.doc", "x.t", "x"), "distinct")
    candidates = connected_components(candidate_edges(distinct, least, distinct.count()), contract=False)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([shingle_set(t, width).tobytes() for t in batch.column(3).to_pylist()], pa.binary())], ["node", "component", "fp", "h"])

    sought = distinct.join(candidates, "node").select("doc", "t", "node", "component", "fp")
    sets = texts.join(sought, ["doc", "t"]).select("node", "component", "fp", "text").mapInArrow(hashes, "node long, component long, fp binary, h binary")
    sets = table(sets.dropDuplicates(["node"]), "shingles")
    components = connected_components(similar_links(sets, differing(least, DEVIATIONS), least), contract=False)
    named = table(distinct.join(components, "node", "left").select("fp", "x", F.coalesce("component", "node").alias("component")), "named")
    names = named.groupBy("component").agg(F.min("x").alias("least"))
    lookup = named.join(names, "component").select("fp", "least")
    first = F.struct("doc", "t") == F.col("least")
    return prints.join(lookup, "fp").select(F.when(F.col("doc") != last, F.col("doc")).alias(key), "t", F.col("least.doc").alias("component_id"), first.alias("first"))
