"""Best-fit packing by minimum bin slack.

Documents become token ids, the longest are cut, and the pieces are packed into sequences of a fixed capacity. Only
how many pieces have each length matters to the plan, so the driver sees at most `capacity` counts, whatever the
input. Per bin, the longest length left is placed and a bitset subset-sum over the lengths left, with their
counts, finds the fullest completion; that combination is removed as often as the counts allow, which at least once
exhausts a length, so a plan has a few thousand patterns at most. Pieces are then numbered within their length (in
their task, offset by the counts of the tasks before) and each number is looked up in the plan.

Null and empty texts are one end id; texts of any length are tokenised whole; repeated rows are packed once each;
rows with a null id are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import table
from marketloom.llm.sentencepieces import grouped

CAPACITY = 2048
#: Pieces of texts in the younger generation of one worker's cache at which, before a batch, it becomes the older; it costs time only.
CACHED = 350_000
LONGEST_CACHED = 64
#: Marks that often end a word.
STOPS = frozenset(".,;:!?")
#: One text in so many, by its CRC-32, is also given to the library whole, and the ids compared.
WHOLE = 64
#: White space but the space and the line feed.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = sorted(set(range(256)) - set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Ids by piece: one that isn't here is taken from the older generation or made, and stays unless it is long."""

    def __init__(self, make: Callable[[str], bytes], older: dict[str, bytes]):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece) or self.make(piece)
        if len(piece) <= LONGEST_CACHED:
            self[piece] = got
        return got


class ByteEncoder:
    """Ids by a tokenizers file of byte-level merges; pieces that recur are encoded once while they stay in a bounded cache.

    A text in which a space has no other white space beside it is cut before each space: the file's pattern starts a word there,
    and none of its words goes on beyond the next space. New pieces are parted into words by the pattern, and every new word is
    merged by the tokenizers library's model. Other texts, and those with strings of special tokens, go to the library whole, and
    so does one text in WHOLE besides, whose ids are compared; a difference is an error.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.characters = self.library.model, byte_characters()
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.special = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        self.ids = Pieces(self.make, {})

    def pieces(self, text: str) -> list[str] | None:
        """The text cut before its spaces; None where that may cut a word or a special token."""
        if "  " in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return None
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else None

    def merge(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.characters))
        return array("I", [t.id for t in tokens]).tobytes()

    def make(self, piece: str) -> bytes:
        letters = piece[1:] if piece[:1] == " " else piece
        if letters.isalpha():  # letters, after a space or not, are one word of the pattern
            return self.merge(piece)
        if piece[-1:] in STOPS and letters[:-1].isalpha():  # and a mark after them is another
            return self.ids[piece[:-1]] + self.ids[piece[-1]]
        words = self.split(piece)
        return self.merge(piece) if len(words) == 1 else b"".join([self.ids[w] for w in words])

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.ids) > CACHED:
            self.ids.older = {}  # the generation before goes
            self.ids = Pieces(self.make, self.ids)
        get, out = self.ids.__getitem__, []
        for text in texts:
            own = self.pieces(text)
            if own is None:
                out.append(self.whole(text))
                continue
            out.append(b"".join(map(get, own)))
            if zlib.crc32(text.encode()) % WHOLE == 0 and out[-1] != self.whole(text):
                raise ValueError("a text's ids differ from the tokenizers library's")
        return out


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes what doesn't fill a sequence."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, task, number): number counts the pieces of one length within their task."""
    kept = docs.select(key, F.col("text").alias("__text"))
    out = f"`{key}` {kept.schema[0].dataType.simpleString()}, piece int, start long, length int, ids_crc32 long, task int, number long" + (", ids array<int>" if with_ids else "")
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            at, columns, i = [], [[] for _ in range(6)], 0
            for group in grouped([t or "" for t in batch.column(1).to_pylist()]):
                for ids in own.encode_batch(group):
                    ids += tail
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        at.append(i)
                        part = ids[4 * start : 4 * (start + length)]
                        row = k, start, length, zlib.crc32(part), seen[length], np.frombuffer(part, "<i4")
                        seen[length] += 1
                        for c, x in zip(columns, row if with_ids else row[:5]):
                            c.append(x)
                    i += 1
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)][: 6 if with_ids else 5]
            arrays.insert(4, pa.array(np.full(len(at), task), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], [key, "piece", "start", "length", "ids_crc32", "task", "number", "ids"][: len(arrays) + 1])

    return kept.mapInArrow(run, out)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths, with how often each, whose sum is the largest up to room; counts bounds how often."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        most, k = min(counts[length], room // length), 1
        while most:
            k = min(k, most)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            most -= k
            k *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + k
            total -= length * k
    return out


@dataclass
class Plan:
    """For each length, where its pieces go: arrays of the first number, the first sequence, pieces a sequence and offset there."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Minimum bin slack over counts of lengths."""
    left = {x: n for x, n in counts.items() if n > 0}
    if any(not 0 < x <= capacity for x in left):
        raise ValueError("a length is outside 1..capacity")
    rows: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in left}
    used, sequences = dict.fromkeys(left, 0), 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fullest(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(left[x] // k for x, k in pattern.items()), 0
        for x in sorted(pattern, reverse=True):
            k = pattern[x]
            rows[x].append((used[x], sequences, k, offset))
            used[x] += k * times
            offset += k * x
            left[x] -= k * times
            if not left[x]:
                del left[x]
        sequences += times
    return Plan({x: tuple(np.array(c, np.int64) for c in zip(*own, strict=True)) for x, own in rows.items()}, sequences)


def place(numbered: DataFrame, found: Plan) -> DataFrame:
    """Adds sequence_id and offset to rows that have length and number (a long, the rank within its length)."""
    keep = [c for c in numbered.columns if c != "number"]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1))
            for rows in np.split(order, bounds[1:]) if len(order) else []:
                x = int(length[rows[0]])
                first, base, each, start = found.by_length[x]
                p = np.searchsorted(first, number[rows], "right") - 1
                rank = number[rows] - first[p]
                sequence[rows] = base[p] + rank // each[p]
                offset[rows] = start[p] + rank % each[p] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return numbered.mapInArrow(run, out)


def pack(docs: DataFrame, path: str, key: str = "doc_id", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, sequence_id, offset), and ids if asked for."""
    own = table(pieces(docs, path, key, capacity, end, with_ids), "pieces")
    by_task = own.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = by_task.withColumn("earlier", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    earlier = table(earlier, "counts")
    counts = {r.length: r.n for r in earlier.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    numbered = own.join(earlier.select("length", "task", "earlier").hint("shuffle_hash"), ["length", "task"]).withColumn("number", F.col("number") + F.col("earlier")).drop("earlier", "task")
    names = [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return place(numbered, plan(counts, capacity)).select(*names)
