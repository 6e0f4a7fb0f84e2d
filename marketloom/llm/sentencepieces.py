"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols start as its characters. An agenda holds the adjacent pairs whose join is a piece, best score first
and leftmost among equals; the best pair is merged and its new neighbours join the agenda. Characters outside the
vocabulary become byte pieces. As no piece crosses from another character to the space mark, and none holds a line
feed, text is cut there first and each distinct segment is encoded once while it stays in a bounded cache of two
generations: when the younger is full it becomes the older, and a segment met again moves back to the younger. Every
segment that isn't cached is checked against the sentencepiece library, batch by batch; a difference is an error.

Segments of one length are encoded together: their agendas are the rows of a matrix of pair ranks, of which each round
takes every row's best, leftmost among equals. Segments over LONGEST_ROW characters, and those with characters that the
vocabulary lacks, have an agenda of their own, a heap.

Null is an empty text, which has the begin and end ids only; segments of any length are encoded whole; repeated rows
give equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Segments in the younger generation of one worker's cache at which it becomes the older; it costs time only.
CACHED = 500_000
#: Segments over this many characters are not kept.
LONGEST_CACHED = 64
#: Segments over this many characters have a heap of their own.
LONGEST_ROW = 40
#: No pair of this rank is a piece.
NO_RANK = np.int32((1 << 31) - 1)


class Pieces:
    """A merge-type vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if sp.is_byte(i)}
        self.raw = {i: pieces[i].replace(MARK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.lines = not any("\n" in p for p in self.ids)
        # Symbols are numbered by their ids; characters that are no piece themselves, but stand in one, come after them.
        self.symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - self.ids.keys()):
            self.symbols[c] = len(pieces) + len(self.symbols) - len(self.ids)
        self.width = len(pieces) + len(self.symbols) - len(self.ids) + 1
        self.other = self.width - 1
        self.text = {i: s for s, i in self.symbols.items()}
        scores = {i: sp.get_score(i) for i in plain}
        rank = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        number = self.symbols
        self.pairs = {number[p[:k]] * self.width + number[p[k:]]: (rank[scores[i]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        told = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int32).reshape(-1, 2)
        self.pair_ranks, self.pair_ids = np.append(told[:, 0], NO_RANK), np.append(told[:, 1], 0)
        self.by_char = np.full(0x110000, self.other, np.int64)
        for c, i in number.items():
            if len(c) == 1:
                self.by_char[ord(c)] = i
        kept = np.array(sorted(self.raw), np.int64)
        self.raw_size = np.zeros(len(pieces), np.int64)
        self.raw_size[kept] = [len(self.raw[i]) for i in kept.tolist()]
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_all = np.frombuffer(b"".join(self.raw.get(i, b"") for i in range(len(pieces))), np.uint8)
        self.plain = np.zeros(self.width, bool)
        self.plain[plain] = True

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a text that has the space mark in place of spaces, by a heap of (rank, place)."""
        pairs, width, n = self.pairs, self.width, len(text)
        number, other = self.symbols, self.other
        symbols = [number.get(c, other) for c in text]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [p[0] * n + i for i in range(n - 1) if (p := pairs.get(symbols[i] * width + symbols[i + 1]))]
        heapq.heapify(agenda)
        while agenda:
            rank, i = divmod(heapq.heappop(agenda), n)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            p = pairs.get(symbols[i] * width + symbols[j])
            if p is None or p[0] != rank:  # the pair that stood here is gone
                continue
            symbols[i], symbols[j] = p[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if new := pairs.get(symbols[i] * width + symbols[k]):
                    heapq.heappush(agenda, new[0] * n + i)
            if (h := before[i]) >= 0 and (new := pairs.get(symbols[h] * width + symbols[i])):
                heapq.heappush(agenda, new[0] * n + h)
        out: list[int] = []
        for i, s in enumerate(symbols):
            if s >= 0:
                if self.plain[s]:
                    out.append(s)
                else:  # a character that is no piece
                    out.extend(self.bytes[b] for b in (text[i] if s == other else self.text[s]).encode())
        return out

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in pair_ranks and pair_ids; the last where their join is no piece."""
        key = left * self.width + right
        at = np.searchsorted(self.pair_keys, key)
        none = len(self.pair_keys)
        return np.where(self.pair_keys[np.minimum(at, none - 1)] == key, at, none) if none else np.zeros(key.shape, np.int64)

    def encode_rows(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids) for groups of rows of a matrix of symbols, as soon as no pair of a row is a piece."""
        rows = np.arange(len(symbols))
        at = self.found(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            n = symbols.shape[1]
            if n == 1:
                yield rows, symbols
                return
            ranks = self.pair_ranks[at]
            best = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            done = ranks[each, best] == NO_RANK
            if done.any():
                yield rows[done], symbols[done]
                go = ~done
                rows, symbols, at, best = rows[go], symbols[go], at[go], best[go]
                each = each[: len(rows)]
            merged = self.pair_ids[at[each, best]]
            column = np.arange(n - 1)
            take = column + (column > best[:, None])
            symbols = np.take_along_axis(symbols, take, axis=1)
            symbols[each, best] = merged
            at = np.take_along_axis(at, take[:, : n - 2], axis=1)
            inner = np.flatnonzero(best < n - 2)
            at[inner, best[inner]] = self.found(symbols[inner, best[inner]], symbols[inner, best[inner] + 1])
            inner = np.flatnonzero(best > 0)
            at[inner, best[inner] - 1] = self.found(symbols[inner, best[inner] - 1], symbols[inner, best[inner]])

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(segments)
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            by_length.setdefault(len(s), []).append(k)
        for n, own in by_length.items():
            if n > LONGEST_ROW:
                alone = own
            else:
                symbols = self.by_char[np.frombuffer("".join([segments[k] for k in own]).encode("utf-32-le"), "<u4").reshape(-1, n)]
                whole = self.plain[symbols].all(axis=1)
                at = np.array(own)[whole]
                for rows, ids in self.encode_rows(symbols[whole]):
                    raw, size = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                    for i, k in enumerate(at[rows].tolist()):
                        out[k] = raw[size * i : size * (i + 1)]
                alone = np.array(own)[~whole].tolist()
            for k in alone:
                out[k] = np.array(self.encode_segment(segments[k]), "<u4").tobytes()
        return out

    def raw_bytes(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The pieces' bytes joined, marks as spaces, and where each id's end."""
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        return self.raw_all[np.repeat(self.raw_start[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes(), ends

    def segments(self, text: str) -> list[str]:
        """The text with its mark in front, cut where no piece can cross."""
        if not text:
            return []
        if not self.cuts:
            return [MARK + text.replace(" ", MARK)]
        if self.lines and "  " not in text and MARK not in text and text[0] != " ":
            return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n")).split(" ")
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: pieces joined, marks as spaces, the first one's space dropped."""
        raw, _ = self.raw_bytes(np.asarray(ids, np.int64))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", errors="replace")


class Encoder:
    """Encodes texts with a cache of segments: ids as little-endian 32-bit integers, and the bytes that they decode to."""

    def __init__(self, pieces: Pieces, check: bool = True):
        self.pieces, self.check = pieces, check
        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def learn(self, new: list[str]) -> None:
        """Encode segments, check them against the library as one text, keep them."""
        p = self.pieces
        told = p.encode_segments(new)
        raw, ends = p.raw_bytes(np.frombuffer(b"".join(told), "<u4"))
        bounds = np.append(0, ends)[np.cumsum([0, *(len(b) // 4 for b in told)])].tolist()
        self.ids.update(zip(new, told))
        self.raw.update(zip(new, (raw[a:b] for a, b in zip(bounds, bounds[1:]))))
        if self.check and new:
            self.compare(new, told)

    def compare(self, new: list[str], told: list[bytes]) -> None:
        """One text of all segments: the library's ids of it, and its decoding of these, must be ours."""
        p = self.pieces
        order = sorted(range(len(new)), key=lambda k: not new[k].startswith(MARK))
        if p.lines:  # a line feed on either side parts them; the text's own mark stands before the first
            head, feed = (np.array(p.encode_segment(x), "<u4").tobytes() for x in (MARK, "\n"))
            text = "".join([new[k] if new[k][0] == "\n" else "\n" + new[k] for k in order]).replace(MARK, " ")
            want = np.frombuffer(head + b"".join([told[k] if new[k][0] == "\n" else feed + told[k] for k in order]), "<u4").astype(np.int32)
            if not np.array_equal(p.library.encode(text, out_type="numpy"), want):
                raise ValueError("segments differ from the sentencepiece library")
            if p.library.decode(want) != p.decode(want):
                raise ValueError("decoded segments differ from the sentencepiece library")
        else:
            for k in order:
                if new[k].startswith(MARK) and p.library.encode(new[k][1:]) != np.frombuffer(told[k], "<u4").tolist():
                    raise ValueError("a segment differs from the sentencepiece library")

    def fetch(self, wanted: set[str]) -> None:
        """Have all wanted segments in the younger generation."""
        if len(self.ids) > CACHED:
            self.older = self.ids, self.raw
            self.ids, self.raw = {}, {}
        missing = wanted - self.ids.keys()
        ids, raw = self.older
        known = missing & ids.keys()
        for s in known:
            self.ids[s], self.raw[s] = ids[s], raw[s]
        self.learn(list(missing - known))

    def encode_batch(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text: the number of ids, the ids with begin and end, the decoded text in UTF-8."""
        cut = self.pieces.segments
        parts = [cut(t) for t in texts]
        wanted = set().union(*parts)
        self.fetch(wanted)
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.pieces.begin, self.pieces.end))
        ids, raw, out = self.ids.__getitem__, self.raw.__getitem__, []
        for own in parts:
            body = b"".join(map(ids, own))
            text = b"".join(map(raw, own))
            text = text[1:] if text.startswith(b" ") else text
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", errors="replace").encode()
            out.append((len(body) // 4 + 2, begin + body + end, text))
        for s in wanted:
            if len(s) > LONGEST_CACHED:
                del self.ids[s], self.raw[s]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a model file."""
    if path not in _encoders:
        _encoders[path] = Encoder(Pieces(path))
    return _encoders[path]


def grouped(texts: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of texts of about most characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, keys: list[str], digest: bool = False) -> DataFrame:
    """keys, n_tokens, and ids (array) with decoded (string), or in place of these their SHA-256 in lower-case hex."""
    kept = docs.select(*keys, F.col("text").alias("__text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    out += ", n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for group in grouped([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]):
                for count, ids, text in own.encode_batch(group):
                    n.append(count)
                    a.append(hashlib.sha256(ids).hexdigest() if digest else np.frombuffer(ids, "<u4").astype(np.int32))
                    b.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
            columns = [pa.array(n, pa.int64()), pa.array(a, pa.string() if digest else pa.list_(pa.int32())), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keys, "n_tokens", *names])

    return kept.mapInArrow(run, out)
