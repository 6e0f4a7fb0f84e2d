"""Substring dedup: words covered by a long word sequence that also starts in an earlier document.

Suffixes are split into memory-sized groups (see windows), and each group's suffix tree is expanded from the top: the
suffixes at a node are parted by their next words, which lengthens the node's prefix only where suffixes still share it;
a node with a single suffix is a leaf and is left. Nodes that lie `length` words deep are the maximal repeats sought, and
the least document below each decides which of its suffixes are the first.

Null and empty texts have no words and nothing removed; texts with fewer words than a window keep all; texts of any
length are read whole; rows that repeat a doc_id don't make each other lose words (none is smaller); a null id counts as
the last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import word_spans
from marketloom.llm.windows import LAST, Kind, covered, matched, with_row

LENGTH, GRAM = 50, 16


def deep_nodes(symbols: np.ndarray, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes below nodes at the depth that have two or more, and the number of their node.

    symbols are small integers; each suffix has at least depth of them.
    """
    bits = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
    node, at = np.zeros(len(suffixes), np.int64), 0
    while at < depth and len(suffixes):
        width = max(1, bits + 1)
        room = 63 - max(1, int(node.max()).bit_length())
        take = max(1, min(room // width, depth - at))
        key = node.astype(np.uint64)
        if take * width <= room:
            for j in range(take):
                key = (key << np.uint64(width)) | symbols[suffixes + at + j].astype(np.uint64)
        else:
            raise ValueError("too many symbols in a group")
        _, node, count = np.unique(key, return_inverse=True, return_counts=True)
        inner = count[node] > 1
        suffixes, node = suffixes[inner], node[inner]
        _, node = np.unique(node, return_inverse=True)
        at += take
    return suffixes, node


def solver(x: list[np.ndarray], n: np.ndarray, doc: np.ndarray, m: np.ndarray, length: int = LENGTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Windows that also start in a region of a smaller document."""
    sizes = np.array([len(s) for s in x], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    _, symbols = np.unique(np.concatenate(x), return_inverse=True)
    owner = np.repeat(np.arange(len(x)), n)
    suffixes = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[owner]
    region = np.repeat(np.arange(len(x)), sizes)
    deep, node = deep_nodes(symbols.astype(np.int64), suffixes, length)
    found = np.zeros(int(sizes.sum()), bool)
    if len(deep):
        own = doc[region[deep]]
        least = np.full(int(node.max()) + 1, LAST, np.int64)
        np.minimum.at(least, node, own)
        found[deep[own > least[node]]] = True
    return [found[s : s + k] for s, k in zip(starts.tolist(), n.tolist())], node


def repeated_words(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None, **options) -> DataFrame:
    """Rows (key, n_words, n_removed, kept_sha256) for each row of docs; with carry also kept, the text without the removed words, and a struct `row` of these columns."""
    texts = carry is not None
    kind = Kind("words", length, gram)
    found = matched(docs, kind, lambda *a: solver(*a, length=length), True, key, **options)
    rows_in = with_row(docs, key) if not texts else docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("t"), F.col("text"), F.struct(*carry).alias("row"))
    out = "doc long, n_words long, n_removed long, kept_sha256 string" + (f", kept string, row {docs.select(F.struct(*carry).alias('row')).schema[0].dataType.simpleString()}" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in range(4)]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                words, kept, whole = data.split(), None, text
                if spans:
                    gone = covered(len(words), spans, length)
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    if texts:
                        start, _ = word_spans(np.frombuffer(data, np.uint8))
                        ends = np.append(start[1:], len(data))
                        lead = data[: start[0]] if not gone[0] else b""
                        whole = (lead + b"".join([data[start[i] : ends[i]] for i in np.flatnonzero(~gone).tolist()])).decode()
                kept = words if kept is None else kept
                for column, v in zip(rows, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), whole), strict=True):
                    column.append(v)
            names = ["doc", "n_words", "n_removed", "kept_sha256", "kept", "row"][: 6 if texts else 4]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string())))][:5]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(3)] if texts else arrays[:4], names)

    joined = rows_in.join(found.hint("shuffle_hash"), ["doc", "t"], "left").select("doc", "text", "spans", *["row"] * texts)
    return joined.mapInArrow(run, out).withColumn("doc", F.when(F.col("doc") != LAST, F.col("doc"))).withColumnRenamed("doc", key)
