"""Katz backoff: Good-Turing discounted bigrams and unigrams with exactly normalised backoff weights.

A text's tokens are its words with A-Z in lower case, then one end; the begin is a history only. With c the counts in
training texts, P(w|h) = d(c(hw)) c(hw) / c(h) where hw was seen, else a(h) P(w), and P(w) = d(c(w)) c(w) / N where w was
seen, else the mass that discounting left, which is that of one unknown word. a(h) is the mass left at h over the
unigram mass of the words not seen after h, so each history's probabilities sum to one.

Texts are dealt into chunks of word numbers. Each chunk sends the words, then the bigrams that it holds, once each, to
the bucket that owns them; buckets count them, keep their part of the model, and answer each chunk in its own order.
Nothing passes through the driver but counts of counts and the sums of hot words, those that make up a 1/HOT of all tokens and a
quarter of a bucket: at most HOT of them, whose bigrams are dealt over all buckets, so no bucket holds a whole hot history. Words'
and bigrams' counts and the histories' sums are kept as tables partitioned by kind, which scoring reads: a token takes the
discounted bigram, or else the history's weight and the word's discounted unigram, or else the unknown word's share.

Each chunk sends a row to each bucket of which it has anything: their number grows with the square of the tokens over
CHUNK_TOKENS * BUCKET_ENTRIES until a row holds a single bigram, and no further; the two are to be raised with the executors' memory
for corpora of terabytes.

fit() leaves the same model as tables, partitioned by history, from which evaluate() scores texts that were not there when it was
counted: a token's history is looked up, else the word with the history's weight, else the unknown word.

Null and empty texts have one token, the end; texts of any length are one row of a chunk; repeated rows count as often
as they stand; ids are integers; without training texts every token has probability one half of itself unknown (N = 0); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import mix, table, word_hashes

CHUNK_TOKENS = 2_000_000
BUCKET_ENTRIES = 1_000_000
HOT = 65_536
CUT = 5
BEGIN, END = np.uint64(0), np.uint64(1)


def pack(x: np.ndarray) -> bytes:
    """An integer or float array by byte planes, compressed."""
    kind = x.dtype.str.encode()
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() if len(x) else b""
    return kind + b":" + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes) -> np.ndarray:
    kind, _, rest = b.partition(b":")
    dtype = np.dtype(kind.decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(rest), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel() if len(planes) else np.zeros(0, dtype)


@dataclass(frozen=True)
class Discounts:
    """d(r) for r up to CUT, from counts of counts; where these can't give a value in (0, 1], r isn't discounted."""

    d: tuple[float, ...]

    @classmethod
    def good_turing(cls, n: list[int]) -> Discounts:
        """n[r] is the number of things seen r times, r from 0 to CUT + 1."""
        if not n[1] or not n[CUT + 1]:
            return cls((1.0,) * (CUT + 1))
        common = (CUT + 1) * n[CUT + 1] / n[1]
        out = [1.0]
        for r in range(1, CUT + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 1.0
            out.append(d if 0 < d <= 1 else 1.0)
        return cls(tuple(out))

    def of(self, r: np.ndarray) -> np.ndarray:
        return np.append(self.d, 1.0)[np.minimum(r, CUT + 1)]


@dataclass(frozen=True)
class Unigrams:
    """P(w) from a count: discounted, and the mass left for the unknown word."""

    total: int
    kinds: int
    discounts: Discounts
    unknown: float
    scale: float

    @classmethod
    def fit(cls, n: list[int], total: int, kinds: int) -> Unigrams:
        d = Discounts.good_turing(n)
        left = sum((1 - d.d[r]) * r * n[r] for r in range(1, CUT + 1)) / total if total else 1.0
        scale = 1.0
        if total and left < 1e-12:  # nothing was discounted: one more token, the unknown word
            scale = total / (total + 1)
            left = 1 / (total + 1)
        return cls(total, kinds, d, left, scale)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.scale * self.discounts.of(count) * count / max(self.total, 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.kinds + 1))


def chunked(docs: DataFrame, held, key: str) -> DataFrame:
    """Rows (chunk, docs, held, ends, tokens, words): numbers of words within the chunk, each text followed by END."""
    kept = docs.select(F.col(key).cast("long").alias("doc"), held.alias("held"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, waiting = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal made, waiting
            parts = [np.append(h, END) for _, _, h in waiting]
            words, tokens = np.unique(np.concatenate([*parts, [END]]), return_inverse=True)
            ends = np.cumsum([len(p) for p in parts])
            row = [[(task << 24) + made], [[d for d, _, _ in waiting]], [[bool(h) for _, h, _ in waiting]], [pack(ends)], [pack(tokens[:-1].astype(np.uint32))], [pack(words)], [len(words)], [len(tokens) - 1]]
            made, waiting = made + 1, []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])], ["chunk", "docs", "held", "ends", "tokens", "words", "n_words", "n_tokens"])

        size = 0
        for batch in batches:
            for doc, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = word_hashes((text or "").encode().lower())[0]
                words[words < 2] += np.uint64(2)  # BEGIN and END are no words
                waiting.append((doc, h, words))
                size += len(words) + 1
                if size >= CHUNK_TOKENS:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    return kept.mapInArrow(run, "chunk long, docs array<long>, held array<boolean>, ends binary, tokens binary, words binary, n_words long, n_tokens long")


@dataclass
class Chunk:
    """A chunk's arrays: words' hashes, tokens, the texts' ends, which tokens train."""

    docs: list
    held: np.ndarray
    ends: np.ndarray
    tokens: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        return cls(row["docs"], np.array(row["held"], bool), unpack(row["ends"]), unpack(row["tokens"]).astype(np.int64), unpack(row["words"]))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    @property
    def trains(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)


def split(owner: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For each bucket, the positions that it owns, ascending."""
    order = np.argsort(owner, kind="stable")
    return np.split(order, np.searchsorted(owner[order], np.arange(1, buckets)))


def word_messages(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk.of(row)
                count = np.bincount(c.tokens[c.trains], minlength=len(c.words))
                own = [(b, i) for b, i in enumerate(split((c.words % np.uint64(buckets)).astype(np.int64), buckets)) if len(i)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in own], pa.int64()), pa.array([row["chunk"]] * len(own), pa.int64()), pa.array([pack(c.words[i]) for _, i in own], pa.binary()), pa.array([pack(count[i].astype(np.uint32)) for _, i in own], pa.binary())], ["bucket", "chunk", "a", "b"])

    return chunks.select("chunk", "docs", "held", "ends", "tokens", "words").mapInArrow(run, "bucket long, chunk long, a binary, b binary")


REPLY = "kind string, bucket long, chunk long, a binary, b binary, n array<long>, h long, sums array<double>"


def reply_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64())]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in REPLY.split(", ")])


def counts_of_counts(r: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(r, CUT + 2), minlength=CUT + 3)[: CUT + 2].tolist()


def word_replies(messages: DataFrame, buckets: int) -> DataFrame:
    """For each message, the words' numbers (few for frequent words) and counts; and counts of counts."""

    def run(own: pa.Table) -> pa.Table:
        bucket, chunk = own.column("bucket")[0].as_py(), own.column("chunk").to_pylist()
        parts = [unpack(b) for b in own.column("a").to_pylist()]
        words, at = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.bincount(at, np.concatenate([unpack(b) for b in own.column("b").to_pylist()]).astype(np.float64), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -count))] = np.arange(len(words))
        number = rank * buckets + bucket + 1  # 0 is BEGIN
        if len(number) and number.max() >> 32:
            raise OverflowError("words are numbered in 32 bits; there are too many distinct ones")
        bounds = np.cumsum([len(p) for p in parts])[:-1]
        rows = [("word", bucket, c, pack(number[i].astype(np.uint32)), pack(count[i]), None, None, None) for c, i in zip(chunk, np.split(at, bounds))]
        return reply_table([*rows, ("counts", bucket, None, None, None, [*counts_of_counts(count), int(count.sum()), int((count > 0).sum())], None, None)])

    return messages.groupBy("bucket").applyInArrow(run, REPLY)


@dataclass
class Pairs:
    """A chunk's distinct bigrams, with the buckets that own them."""

    history: np.ndarray
    word: np.ndarray
    at: np.ndarray
    owned: list[np.ndarray]
    number: np.ndarray
    count: np.ndarray
    hot: np.ndarray


def pairs_of(c: Chunk, answers: list[dict], word_buckets: int, buckets: int, total: int, trained: int) -> Pairs:
    """Number the chunk's words by the answers, and find its bigrams; history and word are places in the chunk's words, -1 being BEGIN."""
    number, count = np.zeros(len(c.words) + 1, np.int64), np.zeros(len(c.words) + 1, np.int64)
    own = split((c.words % np.uint64(word_buckets)).astype(np.int64), word_buckets)
    for r in answers:
        number[own[r["bucket"]]], count[own[r["bucket"]]] = unpack(r["a"]), unpack(r["b"])
    number[-1], count[-1] = 0, trained
    before = np.concatenate(([-1], c.tokens[:-1]))
    before[c.ends[:-1]] = -1
    key = (number[before].astype(np.uint64) << np.uint64(32)) | number[c.tokens].astype(np.uint64)
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    history, word = before[first], c.tokens[first]
    hot = count >= max(BUCKET_ENTRIES // 4, total / HOT)
    hot[-1] = True
    spread = np.where(hot[history], key[first], number[history].astype(np.uint64))
    owner = (mix(spread + np.uint64(0x51ED27)) % np.uint64(buckets)).astype(np.int64)
    return Pairs(history, word, at, split(owner, buckets), number, count, hot)


def pair_messages(chunks: DataFrame, answers: DataFrame, word_buckets: int, buckets: int, total: int, trained: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        c = Chunk.of(row)
        p = pairs_of(c, right.select(["bucket", "a", "b"]).to_pylist(), word_buckets, buckets, total, trained)
        count = np.bincount(p.at, c.trains.astype(np.float64), len(p.history)).astype(np.uint32)
        out = []
        for b, i in enumerate(p.owned):
            if not len(i):
                continue
            h, w = p.number[p.history[i]], p.number[p.word[i]]
            flags = p.hot[p.history[i]]
            out.append((b, row["chunk"], pack(np.diff(h, prepend=0).astype(np.int64)), pack(w.astype(np.uint32)), pack(count[i]), pack(p.count[p.word[i]]), pack(flags.astype(np.uint8))))
        names = ["bucket", "chunk", "h", "w", "r", "cw", "hot"]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), [pa.int64()] * 2 + [pa.binary()] * 5)], names)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "bucket long, chunk long, h binary, w binary, r binary, cw binary, hot binary")


def history_sums(h: np.ndarray, r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct history: how many bigrams were seen 1..CUT times, the rest's counts, the seen words' unigram mass."""
    names, at = np.unique(h, return_inverse=True)
    out = np.zeros((len(names), CUT + 2))
    for k in range(1, CUT + 1):
        out[:, k - 1] = np.bincount(at[r == k], minlength=len(names))
    out[:, CUT] = np.bincount(at, np.where(r > CUT, r, 0).astype(np.float64), len(names))
    out[:, CUT + 1] = np.bincount(at, np.where(r > 0, p, 0.0), len(names))
    return names, out


def pair_replies(messages: DataFrame, unigrams: Unigrams) -> DataFrame:
    """For each message its bigrams' counts and, for each history that isn't hot, its sums; counts of counts; hot histories' sums."""

    def run(own: pa.Table) -> pa.Table:
        bucket, chunk = own.column("bucket")[0].as_py(), own.column("chunk").to_pylist()
        get = lambda name: [unpack(b) for b in own.column(name).to_pylist()]
        hs, ws = [np.cumsum(x) for x in get("h")], get("w")
        key = (np.concatenate(hs).astype(np.uint64) << np.uint64(32)) | np.concatenate(ws).astype(np.uint64)
        pair, first, at = np.unique(key, return_index=True, return_inverse=True)
        r = np.bincount(at, np.concatenate(get("r")).astype(np.float64), len(pair)).astype(np.int64)
        p = unigrams.p(np.concatenate(get("cw"))[first])
        h, hot = (pair >> np.uint64(32)).astype(np.int64), np.concatenate(get("hot"))[first] > 0
        names, sums = history_sums(h[~hot], r[~hot], p[~hot])
        rows = []
        for c, i, own_h, own_hot in zip(chunk, np.split(at, np.cumsum([len(x) for x in hs])[:-1]), hs, get("hot")):
            asked = np.unique(own_h[own_hot == 0])
            rows.append(("pair", bucket, c, pack(r[i].astype(np.uint32)), pack(sums[np.searchsorted(names, asked)].ravel()), None, None, None))
        seen = r > 0
        rows.append(("counts", bucket, None, None, None, counts_of_counts(r[seen]), None, None))
        rows += [("hot", bucket, None, None, None, None, int(x), s.tolist()) for x, s in zip(*history_sums(h[hot], r[hot], p[hot]))]
        return reply_table(rows)

    return messages.groupBy("bucket").applyInArrow(run, REPLY)


def backoff(sums: np.ndarray, count: np.ndarray, d: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """log10 of a(h), and the scale of P(w|h) for seen bigrams, for rows of history sums and the histories' counts."""
    seen = sums[:, :CUT] @ (np.arange(1, CUT + 1) * np.array(d.d[1:])) + sums[:, CUT]
    n = np.maximum(count, 1)
    scale = np.ones(len(n))
    none = (seen >= n * (1 - 1e-12)) & (count > 0)  # nothing was discounted here: one more token, which backs off
    scale[none] = n[none] / (n[none] + 1)
    rest = 1 - np.minimum(sums[:, CUT + 1], 1.0)
    full = (rest < 1e-12) & (count > 0)  # all words were seen here: no backoff
    scale[full] = n[full] / np.maximum(seen[full], 1e-300)
    left = np.where(count > 0, 1 - scale * seen / n, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(full, -300.0, np.log10(np.maximum(left, 1e-300)) - np.log10(np.where(full, 1.0, rest)))
    a[count == 0] = 0.0
    return a, scale


def scored(chunks: DataFrame, answers: DataFrame, word_buckets: int, buckets: int, unigrams: Unigrams, d: Discounts, trained: int, hot: dict[int, list[float]], key: str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk.of(left.to_pylist()[0])
        told = right.select(["kind", "bucket", "a", "b"]).to_pylist()
        p = pairs_of(c, [r for r in told if r["kind"] == "word"], word_buckets, buckets, unigrams.total, trained)
        r, sums = np.zeros(len(p.history), np.int64), np.zeros((len(c.words) + 1, CUT + 2))
        place = np.zeros(0, np.int64)
        order = np.argsort(p.number, kind="stable")
        for answer in told:
            if answer["kind"] == "pair":
                i = p.owned[answer["bucket"]]
                r[i] = unpack(answer["a"])
                asked = np.unique(p.number[p.history[i]][~p.hot[p.history[i]]])
                place = order[np.searchsorted(p.number[order], asked)]
                sums[place] = unpack(answer["b"]).reshape(-1, CUT + 2)
        for i in np.flatnonzero(p.hot).tolist():
            sums[i] = hot.get(int(p.number[i]), [0.0] * (CUT + 2))
        a, scale = backoff(sums, p.count, d)
        low = np.log10(unigrams.p(p.count[p.word]))
        with np.errstate(divide="ignore", invalid="ignore"):
            high = np.log10(scale[p.history] * d.of(r) * r / np.maximum(p.count[p.history], 1))
        each = np.where(r > 0, high, a[p.history] + low)[p.at]
        count = p.count[c.tokens]
        start = np.concatenate(([0], c.ends[:-1]))
        total = lambda x: np.add.reduceat(x, start) if len(start) else x
        n = len(c.docs)
        return pa.Table.from_arrays([pa.array(c.docs, pa.int64()), pa.array(c.held), pa.array(c.sizes.astype(np.int64)), pa.array(total((count > 0).astype(np.int64))), pa.array(np.full(n, unigrams.total, np.int64)), pa.array(total(unigrams.base(count))), pa.array(total(each))], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, held, key: str = "doc_id") -> DataFrame:
    """Rows (key, held_out, n_tokens, n_known, train_tokens, base_score, score); held says which texts don't train."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = table(chunked(docs, held, key), "chunks")
    size = chunks.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("trained")).first()
    trained = size.trained or 0
    word_buckets = max(least, -(-(size.w or 0) // BUCKET_ENTRIES))
    buckets = max(least, -(-(size.t or 0) // BUCKET_ENTRIES))
    words = table(word_replies(word_messages(chunks, word_buckets), word_buckets), "words", "kind")
    found = words.where("kind = 'counts'").agg(*(F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(CUT + 4))).first()
    sums = [x or 0 for x in found]
    unigrams = Unigrams.fit(sums[: CUT + 2], sums[CUT + 2], sums[CUT + 3])
    slim = chunks.select("chunk", "docs", "held", "ends", "tokens", "words")
    told = words.where("kind = 'word'")
    pairs = table(pair_replies(pair_messages(slim, told, word_buckets, buckets, unigrams.total, trained), unigrams), "bigrams", "kind")
    seen = pairs.where("kind = 'counts'").agg(*(F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(CUT + 2))).first()
    hot = {r.h: list(r[1:]) for r in pairs.where("kind = 'hot'").groupBy("h").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(CUT + 2))).collect()}
    answers = told.unionByName(pairs.where("kind = 'pair'"))
    return scored(slim, answers, word_buckets, buckets, unigrams, Discounts.good_turing([x or 0 for x in seen]), trained, hot, key)


@dataclass(frozen=True)
class Model:
    """A model's tables: unigrams (word, p), bigrams (history, word, p) and weights (history, a), all log10, and the unknown word's p."""

    unigrams: DataFrame
    bigrams: DataFrame
    weights: DataFrame
    unknown: float


def token_pairs(docs: DataFrame, key: str) -> DataFrame:
    """Rows (key, history, word, n): how often each bigram, by hashes, stands in each text."""
    kept = docs.select(F.col(key), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = word_hashes((text or "").encode().lower())[0]
                words[words < 2] += np.uint64(2)
                words = np.append(words, END)
                pair = np.stack([np.append(BEGIN, words[:-1]), words])
                own, n = np.unique(pair, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(n), i))), *(pa.array(x.view(np.int64)) for x in np.ascontiguousarray(own)), pa.array(n)], [key, "history", "word", "n"])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[0].dataType.simpleString()}, history long, word long, n long")


def fit(docs: DataFrame, key: str = "doc_id", parts: int | None = None) -> Model:
    """Count all texts of docs and write the model's tables in the shared folder."""
    spark = docs.sparkSession
    pairs = table(token_pairs(docs, key).groupBy("history", "word").agg(F.sum("n").alias("r")), "pairs")
    words = table(pairs.groupBy("word").agg(F.sum("r").alias("c")), "words")

    def tails(df: DataFrame, c: str) -> list[int]:
        got = df.agg(*(F.count_if(F.col(c) == r).alias(f"n{r}") for r in range(CUT + 2))).first()
        return [got[f"n{r}"] for r in range(CUT + 2)]

    size = words.agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).first()
    unigrams, d = Unigrams.fit(tails(words, "c"), size.total or 0, size.kinds), Discounts.good_turing(tails(pairs, "r"))
    discounted = lambda c, own: F.element_at(F.array(*(F.lit(float(x)) for x in (*own.d, 1.0))), F.least(c, F.lit(CUT + 1)).cast("int") + 1) * c
    p = F.lit(unigrams.scale) * discounted(F.col("c"), unigrams.discounts) / F.lit(float(max(unigrams.total, 1)))
    known = words.withColumn("p", p)
    both = pairs.join(known.select("word", "p"), "word").withColumn("seen", discounted(F.col("r"), d))
    sums = both.groupBy("history").agg(F.sum("r").alias("n"), F.sum("seen").alias("seen"), F.sum("p").alias("mass"))
    n, none = F.col("n").cast("double"), F.col("seen") >= F.col("n") * (1 - 1e-12)
    rest = 1 - F.least(F.col("mass"), F.lit(1.0))
    full = rest < 1e-12
    sums = sums.withColumn("scale", F.when(full, n / F.col("seen")).when(none, n / (n + 1)).otherwise(1.0))
    a = F.when(full, -300.0).otherwise(F.log10(F.greatest(1 - F.col("scale") * F.col("seen") / n, F.lit(1e-300))) - F.log10(rest))
    sums = table(sums.select("history", "n", "scale", a.alias("a")), "sums")
    dealt = lambda df, by: df.withColumn("part", F.pmod(by, F.lit(parts or int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int"))
    given = pairs.join(sums, "history").select("history", "word", F.log10(F.col("scale") * discounted(F.col("r"), d) / F.col("n")).alias("p"))
    return Model(
        table(dealt(known.select("word", F.log10("p").alias("p")), F.col("word")), "unigrams", "part"), table(dealt(given, F.col("history")), "bigrams", "part"),
        table(dealt(sums.select("history", "a"), F.col("history")), "weights", "part"), float(np.log10(unigrams.unknown)))


def evaluate(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Rows (key, score): the log10 probability of each key's texts by the model's tables."""
    pairs = token_pairs(docs, key)
    higher = model.bigrams.select("history", "word", F.col("p").alias("high"))
    lower = model.unigrams.select("word", F.col("p").alias("low"))
    told = pairs.join(higher, ["history", "word"], "left").join(model.weights.select("history", "a"), "history", "left").join(lower, "word", "left")
    each = F.coalesce("high", F.coalesce("a", F.lit(0.0)) + F.coalesce("low", F.lit(model.unknown)))
    return told.groupBy(key).agg(F.sum(F.col("n") * each).alias("score"))
