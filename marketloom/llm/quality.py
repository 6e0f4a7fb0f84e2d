"""Quality rules: word, symbol and repetition counts, and bands of zstandard ratios.

A text passes when the ratio of its bytes to its compressed bytes lies within the limits for its length, and when no
more than half of its fixed chunks lie outside those for theirs. Repetitive or symbol-laden text is above its limits, text without
structure (keys, encoded binaries) below them. Limits are lines over the logarithm of the length between half-octaves: in each
that has MIN_IN_BAND labelled good texts, the tails of their ratios, freed of the ratio's trend with the length; all labelled good
texts count, and the tails are exact. Chunks have lines of their own. Where there are too few labels the fixed wide bands hold.

Nulls and empty texts have no words and fail the base rules; texts under MIN_BYTES get no verdict from compression;
texts of any length are compressed whole; repeated rows get equal results, and of rows with one doc_id one counts for the limits; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import IS_SPACE, span_hashes, prefix_sums, table, word_hashes

LEVEL = 3
CHUNK = 4096
MIN_BYTES = 64
#: A band is learned from so many labelled good texts at least.
MIN_IN_BAND = 40
#: Cells, coarse and fine, of a value's inverse hyperbolic sine, in which values are counted.
CELLS = (1 << 10, 1 << 20)
#: Share of good texts that may lie beyond a learned limit on either side, and the room left beyond it.
TAIL, ROOM = 0.005, 0.02
#: Half-octaves of any length.
BANDS = 80
SPACES = " \t\n\v\f\r"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = "n_bytes long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, chunk_ratios array<double>, chunk_bytes array<int>"


def band(n: int) -> int:
    """The half-octave of a length in bytes."""
    return int(2 * math.log2(max(n, 1)))


def fixed_band(k: int) -> tuple[float, float]:
    """Widest ratios of ordinary prose in band k, which grow with the length."""
    n = 2 ** (k / 2)
    return (0.0 if n < 256 else 1.15 if n < 512 else 1.3 if n < 1024 else 1.42), 1.6 + 0.17 * max(0.0, k / 2 - 5)


def repeated_words(words: np.ndarray, window: int = 3) -> int:
    """Words in windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    sums = prefix_sums(words)
    at = np.arange(n)
    _, which, count = np.unique(span_hashes(sums, at, at + window), return_inverse=True, return_counts=True)
    cover = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(count[which] > 1)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def ratios(data: bytes, compress) -> tuple[float, list[float], list[int]]:
    """The ratio of a text, and the ratios and sizes of its chunks."""
    pieces = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)] if len(data) > CHUNK else []
    pieces = [p for p in pieces if len(p) >= MIN_BYTES]
    return len(data) / len(compress(data)) if data else 0.0, [len(p) / len(compress(p)) for p in pieces], [len(p) for p in pieces]


def measure(text: str, compress) -> tuple:
    """One row of SCHEMA."""
    data = text.encode()
    b = np.frombuffer(data, np.uint8)
    words, start, _ = word_hashes(data)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in lines
            lines.add(line)
    chars = int((~IS_SPACE[b] & ((b & 0xC0) != 0x80)).sum())
    return len(data), len(words), chars, int(SYMBOL[b].sum()), dup, repeated_words(words), *ratios(data, compress)


def measures(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the columns of SCHEMA for each row of docs, whose text is in column text."""
    kept = docs.select(*keys, F.col("text").alias("__text"))
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema[:-1])}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32())]
        for batch in batches:
            rows = [measure(t.as_py() or "", compress) for t in batch.column(batch.num_columns - 1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*keys, *names])

    return kept.mapInArrow(run, out)


def slopes(middle: dict[int, float]) -> dict[int, float]:
    """By half-octave, the trend of the medians from one to the next; 0 without a neighbour."""
    near = {k: [(middle[j] - m) / (j - k) for j in (k - 1, k + 1) if j in middle] for k, m in middle.items()}
    return {k: float(np.mean(x)) if x else 0.0 for k, x in near.items()}


@dataclass(frozen=True)
class Lines:
    """Limits at the middles of half-octaves first, first + 1, ...: low and high; none without labels."""

    first: int
    low: tuple[float, ...]
    high: tuple[float, ...]

    @classmethod
    def fit(cls, n: np.ndarray, ratio: np.ndarray) -> Lines:
        place = 2 * np.log2(np.maximum(n, 1).astype(float))
        own = np.floor(place).astype(int)
        own[n < MIN_BYTES] = -1
        middle = {int(k): float(np.median(ratio[own == k])) for k in np.unique(own) if k >= 0 and (own == k).sum() >= MIN_IN_BAND}
        trend = slopes(middle)
        rest = {k: ratio[own == k] - trend[k] * (place[own == k] - k - 0.5) for k in middle}
        return cls.through({k: (float(np.quantile(x, TAIL)), float(np.quantile(x, 1 - TAIL))) for k, x in rest.items()})

    @classmethod
    def through(cls, tails: dict[int, tuple[float, float]]) -> Lines:
        """Lines through the tails at the middles of half-octaves, with room beyond them."""
        if not tails:
            return cls(0, (), ())
        at, low, high = (np.array(c) for c in zip(*((k, a * (1 - ROOM), b * (1 + ROOM)) for k, (a, b) in sorted(tails.items()))))
        every = np.arange(at[0], at[-1] + 1)
        return cls(int(at[0]), tuple(np.interp(every, at, low).tolist()), tuple(np.interp(every, at, high).tolist()))

    def outside(self, n, ratio):
        """Whether a ratio lies beyond the limits for n bytes, as columns; beyond the known half-octaves the fixed bands hold."""
        size = F.greatest(n, F.lit(1)).cast("double")
        place = 2 * F.log2(size)
        fixed = [F.element_at(F.array(*(F.lit(fixed_band(k)[i]) for k in range(BANDS))), F.floor(place).cast("int") + 1) for i in (0, 1)]
        wide = (ratio < fixed[0]) | (ratio > fixed[1])
        if not self.low:
            return wide
        last = len(self.low) - 1
        x = F.least(F.greatest(place - (self.first + 0.5), F.lit(0.0)), F.lit(float(last)))
        at = F.floor(x).cast("int")

        def line(values: tuple[float, ...]):
            a = F.array(*(F.lit(v) for v in [*values, values[-1]]))
            left, right = F.element_at(a, at + 1), F.element_at(a, at + 2)
            return left + (x - at) * (right - left)

        known = (place >= self.first) & (place < self.first + last + 1)
        return F.when(known, (ratio < line(self.low)) | (ratio > line(self.high))).otherwise(wide)


@dataclass(frozen=True)
class Limits:
    """Lines for whole texts and for chunks."""

    texts: Lines
    chunks: Lines


NO_LABELS = Limits(Lines(0, (), ()), Lines(0, (), ()))


def quantiles(rows: DataFrame, shares: tuple[float, ...]) -> dict[tuple[bool, int], list[float]]:
    """By (chunk, band) of at least MIN_IN_BAND rows, the quantiles of value at shares, exact as numpy's.

    No group is sorted or collected: values are counted in coarse cells, then in fine ones within those where a wanted rank lies, then one by one within these.
    """
    names, cells = ["chunk", "band"], rows.withColumns({f"cell{i}": F.floor(F.asinh("value") * w) for i, w in enumerate(CELLS)})

    def counted(own: DataFrame, step: str) -> dict[tuple, list[tuple]]:
        out: dict[tuple, list[tuple]] = {}
        for *key, at, n in own.groupBy(*names, step).count().collect():
            out.setdefault(tuple(key), []).append((at, n))
        return {k: sorted(x) for k, x in out.items()}

    def find(steps: list[tuple], rank: int) -> tuple:
        for at, n in steps:
            if rank < n:
                return at, rank
            rank -= n
        raise ValueError("no such rank")

    counts = counted(cells, "cell0")
    sizes = {k: n for k, x in counts.items() if (n := sum(c for _, c in x)) >= MIN_IN_BAND}
    spots = {(k, s): (n - 1) * s for k, n in sizes.items() for s in shares}
    places = {(k, r): (k, r) for (k, _), x in spots.items() for r in (math.floor(x), math.ceil(x))}
    for step in ("cell0", "cell1", "value"):
        if step != "cell0" and places:
            known = rows.sparkSession.createDataFrame(sorted({k for k, _ in places.values()}), cells.select(*names).schema)
            counts = counted(cells.join(F.broadcast(known), names), step)
        places = {p: ((*k, at), left) for p, (k, r) in places.items() for at, left in [find(counts[k], r)]}
        names.append(step)
    value = {p: k[-1] for p, (k, _) in places.items()}
    return {k: [float(np.quantile([value[k, math.floor(x)], value[k, math.ceil(x)]], x - math.floor(x))) for s in shares for x in [spots[k, s]]] for k in sizes}


def labelled_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(chunk, band, place, value): ratios of all labelled good texts and of their chunks; texts themselves aren't shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        kinds = {"n_bytes": pa.int64(), "ratio": pa.float64(), "chunk_ratios": pa.list_(pa.float64()), "chunk_bytes": pa.list_(pa.int32())}
        for batch in batches:
            told = [(len(d), *ratios(d, compress)) for d in ((t.as_py() or "").encode() for t in batch.column(1))]
            columns = list(zip(*told, strict=True)) if told else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], ["doc_id", *kinds])

    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    kept = docs.select("doc_id", "text")
    rows = kept.mapInArrow(run, f"doc_id {kept.schema[0].dataType.simpleString()}, n_bytes long, ratio double, chunk_ratios array<double>, chunk_bytes array<int>").join(good, "doc_id", "left_semi")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("n_bytes", "ratio", "chunk_ratios", "chunk_bytes")).alias("x")).select("x.*")
    parts = one.select(F.explode(F.arrays_zip(F.col("chunk_bytes").cast("array<long>").alias("n"), F.col("chunk_ratios").alias("value"))).alias("x")).select(F.lit(True).alias("chunk"), "x.*")
    every = one.select(F.lit(False).alias("chunk"), F.col("n_bytes").alias("n"), F.col("ratio").alias("value")).unionByName(parts).where(F.col("n") >= MIN_BYTES)
    return every.withColumn("place", 2 * F.log2(F.col("n").cast("double"))).select("chunk", F.floor("place").cast("int").alias("band"), "place", "value")


def learn_limits(docs: DataFrame, labels: DataFrame) -> Limits:
    """Limits from all labelled good documents."""
    rows = table(labelled_ratios(docs, labels), "ratios")
    middle = quantiles(rows, (0.5,))
    trend = {c: slopes({k: m[0] for (chunk, k), m in middle.items() if chunk == c}) for c in (False, True)}
    slope = [F.element_at(F.array(*(F.lit(trend[c].get(k, 0.0)) for k in range(BANDS))), F.col("band") + 1) for c in (False, True)]
    freed = rows.withColumn("value", F.col("value") - F.when(F.col("chunk"), slope[1]).otherwise(slope[0]) * (F.col("place") - F.col("band") - 0.5))
    tails = quantiles(freed, (TAIL, 1 - TAIL))
    return Limits(*(Lines.through({k: (x[0], x[1]) for (chunk, k), x in tails.items() if chunk == c}) for c in (False, True)))


def judge(measured: DataFrame, limits: Limits = NO_LABELS) -> DataFrame:
    """Adds base_failed, odd_chunks and kept to the columns of measures()."""
    odd = F.size(F.filter(F.arrays_zip("chunk_ratios", "chunk_bytes"), lambda x: limits.chunks.outside(x.chunk_bytes, x.chunk_ratios)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd_text = (F.col("n_bytes") >= MIN_BYTES) & limits.texts.outside(F.col("n_bytes"), F.col("ratio"))
    return measured.withColumns({"base_failed": failed, "odd_chunks": odd}).withColumn("kept", ~F.col("base_failed") & ~odd_text & (2 * F.col("odd_chunks") <= F.size("chunk_ratios")))


def quality(docs: DataFrame, labels: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Counts, ratios and verdict for each row of docs."""
    return judge(measures(docs, keys or ["doc_id"]), learn_limits(docs, labels) if labels is not None else NO_LABELS)
