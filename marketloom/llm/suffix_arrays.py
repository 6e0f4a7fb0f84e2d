"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

Shards get suffix arrays by Larsson-Sadakane refinement: suffixes sorted by their first 7 symbols are refined by the
ranks of the suffixes h later, h doubling, and only groups that are still equal are sorted again. Common prefixes of
neighbours come from Kasai's lemma in its permuted form: a suffix whose neighbour is that of the suffix before, moved
by one, has a common prefix shorter by one, so only the others are compared. Shards of a key that is dealt over several
are merged by binary search in sorted digests (see windows).

Null and empty texts have no bytes and nothing removed; texts shorter than the length keep all; texts of any length are
read whole; a repeated row is a copy, so it and its twin lose all their windows; rows with a null id take part and keep it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.windows import LAST, Kind, covered, matched, runs, with_row

LENGTH, GRAM = 400, 128
PACK = 7


def concatenate(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols 1..256 of byte sequences, each followed by 0, and the starts of the sequences."""
    sizes = np.array([len(s) + 1 for s in x], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(x) else np.zeros(0, np.int64)
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s, a in zip(x, starts.tolist()):
        out[a : a + len(s)] = s
        out[a : a + len(s)] += np.uint64(1)
    return out, starts


def packed(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PACK symbols from each position in one integer, nothing after an end; and whether an end is among them."""
    n = len(symbols)
    out, over = np.zeros(n, np.uint64), np.zeros(n, bool)
    ext = np.concatenate((symbols, np.zeros(PACK, np.uint64)))
    for j in range(PACK):
        out <<= np.uint64(9)
        part = ext[j : j + n]
        out |= np.where(over, np.uint64(0), part)
        over |= part == 0
    return out, over


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first depth symbols at least, ends being symbols that differ by place; and ranks."""
    n = len(symbols)
    head, over = packed(symbols)
    sa = np.lexsort((np.arange(n), head)) if n else np.zeros(0, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = (head[sa[1:]] != head[sa[:-1]]) | over[sa[1:]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h = PACK
    while h < depth:
        # Places in groups of two or more: not fresh, or followed by one that isn't.
        open_ = ~fresh
        open_[:-1] |= ~fresh[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own = sa[at]
        key = (rank[own].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(own + h, n - 1)].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[at] = own
        fresh[at[1:]] |= key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(fresh[at], at, 0))
        h *= 2
    return sa, rank


def compare(symbols: np.ndarray, head: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, which differ; ends match nothing."""
    n, out = len(symbols), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    tail = np.concatenate((symbols, np.zeros(PACK + 1, np.uint64)))
    full = np.concatenate((head, np.zeros(PACK + 1, np.uint64)))
    low = np.uint64(511)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = (full[np.minimum(x, n)] == full[np.minimum(y, n)]) & ((full[np.minimum(x, n)] & low) != 0)
        rest = live[~same]
        if len(rest):
            x, y, go = a[rest] + out[rest], b[rest] + out[rest], np.ones(len(rest), bool)
            for j in range(PACK):
                u, v = tail[np.minimum(x + j, n)], tail[np.minimum(y + j, n)]
                go &= (u == v) & (u != 0)
                out[rest] += go
        live = live[same]
        out[live] += PACK
    return out


def common_prefixes(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, the common prefix with the place before (0 for the first)."""
    n = len(sa)
    if not n:
        return np.zeros(0, np.int64)
    head, _ = packed(symbols)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lone = np.ones(n, bool)
    lone[1:] = (before[1:] != before[:-1] + 1) | (before[1:] < 0) | (before[:-1] < 0)
    length = np.zeros(n, np.int64)
    ask = np.flatnonzero(lone & (before >= 0))
    length[ask] = compare(symbols, head, ask, before[ask])
    at = np.arange(n)
    from_ = np.maximum.accumulate(np.where(lone, at, 0))
    length = length[from_] - (at - from_)
    again = np.flatnonzero((length < 0) & (before >= 0))
    length[again] = compare(symbols, head, again, before[again])
    length[before < 0] = 0
    return length[sa]


def solver(x: list[np.ndarray], n: np.ndarray, doc: np.ndarray, m: np.ndarray, length: int = LENGTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Windows that another region has too; regions of a content that occurs twice count as such whole."""
    symbols, starts = concatenate(x)
    sa, _ = suffix_array(symbols, length)
    deep = common_prefixes(symbols, sa) >= length
    hit = deep.copy()
    hit[:-1] |= deep[1:]
    found = np.zeros(len(symbols), bool)
    found[sa[hit]] = True
    return [found[s : s + k] if w == 1 else np.zeros(k, bool) for s, k, w in zip(starts.tolist(), n.tolist(), m.tolist())], sa


def repeated_bytes(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, texts: bool = False, **options) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs; with texts also spans (start, end) and kept (binary)."""
    kind = Kind("bytes", length, gram)
    found = matched(docs, kind, lambda *a: solver(*a, length=length), False, key, **options)
    out = f"doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', spans array<struct<start:long,end:long>>, kept binary' if texts else ''}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in range(6)]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                start, size, kept = [], [], data
                if spans:
                    gone = covered(len(data), spans, length)
                    start, size = (v.tolist() for v in runs(gone))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for column, v in zip(rows, (len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": s + k} for s, k in zip(start, size)], kept), strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 7 if texts else 5]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds))][: len(names)], names)

    joined = with_row(docs, key).join(found.hint("shuffle_hash"), ["doc", "t"], "left").select("doc", "text", "spans")
    return joined.mapInArrow(run, out).withColumn("doc", F.when(F.col("doc") != LAST, F.col("doc"))).withColumnRenamed("doc", key)
