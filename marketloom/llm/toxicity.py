"""Toxicity by a weighted finite-state pattern grammar over clauses.

Each word but articles, and each quotation mark, of a clause is read by a lexicon and becomes a symbol: an insult, a threat verb, a target, a
negation, a reporting verb, a mark or other. Five small transducers rewrite the symbols: quotes (a mark opens one only where
another closes it in the clause), reports, negations (SCOPE words), targets (before an insult, or guessed and then required after
it) and threats (a threat verb and a target). They are composed into one machine, whose best path gives the clause's matches: plain,
aimed, negated, reported insults and threats. A text's score is a logistic function of its clauses' matches, not of words alone.

The lexicon is a trie of words and word beginnings, its states being named by their prefixes. Its weights are smoothed log odds
learned from labelled rows: at most MAX_LABELLED documents, chosen by a hash of doc_id; two thirds give the trie, the rest the
logistic weights. Fixed seed words for each language hold where no labels are given.

Null and empty texts have no clauses and get the score of a text without matches; texts and words of any length are read whole;
repeated rows get equal scores, and rows with one doc_id count each in the lexicon, once for the logistic weights; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.transducers import Transducer

MAX_LABELLED = 20_000
MIN_SUPPORT = 4
MIN_WEIGHT = 1.5
SCOPE = 3
STEMS = range(3, 9)
#: Words and beginnings that a task counts before it hands the counts on.
ENTRIES_HELD = 200_000
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n|]+")
SEEDS = "idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown clowns imbecile cretin vermin filth dummkopf trottel abschaum arschloch ordure connard imbécile crétin raclure idiota estúpido escoria imbécil".split()
THREATS = frozenset("""kill hurt destroy punch beat stab shoot strangle choke smash crush murder slaughter burn hang
töten umbringen umbringe schlagen schlage verprügeln erschießen erstechen erwürgen tuer tuerai frapper frapperai détruire étrangler massacrer brûler
matar mataré golpear golpearé destruir destruiré quemar estrangular""".split())
TARGETS = frozenset("""you your yours yourself yourselves ya u he him his she her hers they them their this these those people everyone everybody
du dich dir dein deine ihr euch euer sie ihn ihm tu te toi ton vous vos votre ils elles lui leur eux tú ti usted ustedes ellos ellas él vosotros os""".split())
NEGATIONS = frozenset("""not no never nobody none neither nor cannot without hardly nicht kein keine keinen keiner keinem nie niemals niemand weder noch ohne
ne pas jamais aucun aucune ni sans personne nunca jamás nadie ningún ninguna tampoco sin""".split())
REPORTS = frozenset("""said says saying tells told telling called calls calling quoted quotes quoting reported reports reporting wrote writes written claimed claims stated states
sagte sagt sagen nannte nennt nennen schrieb schreibt meinte behauptet behauptete dit disait dire appelé appelle écrit écrivait déclare déclaré affirme
dijo dice dicen llamó llama escribió escribe afirma afirmó""".split())
#: Articles are no symbols, so that "don't call him an ..." is as near as without one.
ARTICLES = frozenset("a an the ein eine einen einem einer der die das den dem un une le la les el los las una unos unas".split())
#: Contractions that negate (isn't, don't), words, and marks: a single one opens before a word that it doesn't join to another, and closes after one.
TOKEN = re.compile(r"[^\W\d_]*n['’]t(?![^\W\d_])|[^\W\d_]+|[\"“”«»„]|(?<![^\W\d_])['‘‚](?=[^\W\d_])|(?<=[^\W\d_])['’](?![^\W\d_])")
FEATURES = ["plain", "aimed", "negated", "reported", "threat", "best", "density"]


class Lexicon:
    """The insult transducer: weights of whole words and of word beginnings."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        heads: dict[int, set[str]] = {}
        for s in stems:
            heads.setdefault(len(s), set()).add(s)
        self.lengths = sorted(heads)
        self.first3 = {w[:3] for w in words} | {s[:3] for s in stems}

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            w = self.stems.get(word[:n], 0.0)
            if w > best:
                best = w
        return best


#: Symbols: other, negation, report, quotation mark, target, threat verb, insult; and what becomes of insults and targets.
OTHER, NEGATION, REPORT, QUOTE, TARGET, THREAT, INSULT = "ONRQTHI"
KINDS = {"p": "plain", "a": "aimed", "n": "negated", "r": "reported", "h": "threat"}


def copied(machine: Transducer, state: object, to: object, symbols: str) -> None:
    for x in symbols:
        machine.add(state, x, x, to)


def quotes() -> Transducer:
    """Insults between two marks are reported; a mark without another is other."""
    m = Transducer("out", finals={"out": 0.0})
    copied(m, "out", "out", "ONRTHI")
    m.add("out", QUOTE, OTHER, "out")
    m.add("out", QUOTE, OTHER, "in", 0.1)
    copied(m, "in", "in", "ONRTH")
    m.add("in", INSULT, "r", "in")
    m.add("in", QUOTE, OTHER, "out")
    return m


def scope(opens: str, kind: str, length: int, rest: str) -> Transducer:
    """Insults up to length symbols after one that opens are of the kind."""
    m = Transducer(0, finals=dict.fromkeys(range(length + 1), 0.0))
    for k in range(length + 1):
        after = max(k - 1, 0)
        m.add(k, opens, OTHER, length)
        copied(m, k, after, rest)
        m.add(k, INSULT, kind if k else INSULT, after)
    return m


def targets() -> Transducer:
    """Insults are aimed up to SCOPE symbols after a target, or before one: that is guessed, and a path without the target ends."""
    m = Transducer((0, 0), finals={(k, 0): 0.0 for k in range(SCOPE + 1)})
    for k in range(SCOPE + 1):
        for due in range(SCOPE + 1):
            m.add((k, due), TARGET, TARGET, (SCOPE, 0))
            if due == 1:  # the guess was wrong
                continue
            after, still = max(k - 1, 0), max(due - 1, 0)
            copied(m, (k, due), (after, still), "OHrn")
            if k:
                m.add((k, due), INSULT, "a", (after, still))
            else:
                m.add((k, due), INSULT, "p", (after, still))
                m.add((k, due), INSULT, "a", (after, still or SCOPE), 1.0)
    return m


def threats() -> Transducer:
    """A target up to SCOPE symbols after a threat verb makes a threat."""
    m = Transducer(0, finals=dict.fromkeys(range(SCOPE + 1), 0.0))
    for k in range(SCOPE + 1):
        m.add(k, THREAT, OTHER, SCOPE)
        copied(m, k, max(k - 1, 0), "Ornap")
        m.add(k, TARGET, "h" if k else OTHER, 0)
    return m


@lru_cache
def grammar() -> Transducer:
    """The composed machine."""
    return quotes().compose(scope(REPORT, "r", 2 * SCOPE, "ONTHr")).compose(scope(NEGATION, "n", SCOPE, "OTHr")).compose(targets()).compose(threats())


#: All scopes have ended after so many other symbols.
LONGEST_RUN = 2 * SCOPE + 1
RUN = re.compile(f"{OTHER}{{{LONGEST_RUN + 1},}}")


@lru_cache(maxsize=100_000)
def rewritten(symbols: str) -> str:
    """The best path's output without other symbols; the paths don't depend on the insults' weights."""
    return grammar().best(symbols)[1].replace(OTHER, "")


ROLES = {w: x for x, own in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT, THREATS), (TARGET, TARGETS)) for w in own} | dict.fromkeys("\"“”«»„'‘’‚", QUOTE)


def role(token: str) -> str:
    """The symbol of a token that is no insult."""
    return ROLES.get(token) or (NEGATION if len(token) > 3 and token[-1] == "t" and token[-2] in "'’" else OTHER)


def clause_matches(clause: str, lexicon: Lexicon) -> list[tuple[str, float]]:
    """Kinds and weights of a lower-case clause's matches, in order."""
    words = WORD.findall(clause)
    weights = {w: x for w in set(words) if w[:3] in lexicon.first3 and (x := lexicon.weight(w))}
    if not weights and THREATS.isdisjoint(words):
        return []
    tokens = [t for t in TOKEN.findall(clause) if t not in ARTICLES or t in weights]
    symbols = "".join([INSULT if t in weights else role(t) for t in tokens])
    own = iter([weights[t] for t in tokens if t in weights])
    return [(KINDS[x], 1.0 if x == "h" else next(own)) for x in rewritten(RUN.sub(OTHER * LONGEST_RUN, symbols))]


def text_features(text: str, lexicon: Lexicon) -> list[float]:
    """FEATURES of a text: weight of each kind over the text (log-scaled), the best clause, and matches a word."""
    sums = dict.fromkeys(FEATURES, 0.0)
    words, best, hits = 1, 0.0, 0.0
    for clause in CLAUSE.split(text.lower()):
        words += clause.count(" ") + 1
        found = clause_matches(clause, lexicon)
        total = 0.0
        for kind, x in found:
            sums[kind] += x
            total = max(total, x)
            hits += x
        best = max(best, total)
    out = [math.log1p(sums[k]) for k in FEATURES[:5]]
    return [*out, best, 100 * hits / (words + 20)]


def _over_texts(docs: DataFrame, keys: list[str], out: str, each) -> DataFrame:
    kept = docs.select(*keys, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", " + out
    names, (kind,) = [*keys, out.split()[0]], {pa.list_(pa.float64()) if "array" in out else pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [each(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names)

    return kept.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, train=None) -> DataFrame:
    """Rows (doc_id, text, toxic, fold) of at most MAX_LABELLED labelled documents that train allows, all rows of a doc_id; fold 2 of 0..2 is for the logistic weights."""
    few = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    few = few if train is None else few.where(train)
    few = few.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Smoothed log odds of words and word beginnings; those with MIN_SUPPORT toxic texts and MIN_WEIGHT stay. The labelled rows, at most MAX_LABELLED, bound their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x[1] for x in found.values()], pa.int64()), pa.array([x[0] for x in found.values()], pa.int64())], ["entry", "pos", "neg"])
            found.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in WORD.findall((text or "").lower()) if len(w) > 2}
                for x in words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}:
                    found.setdefault(x, [0, 0])[1 if toxic else 0] += 1
                if len(found) > ENTRIES_HELD:
                    yield told()
        yield told()

    totals = rows.groupBy("toxic").count().collect()
    pos, neg = (sum(r["count"] for r in totals if bool(r.toxic) is k) for k in (True, False))
    if not pos or not neg:
        return Lexicon(dict.fromkeys(SEEDS, 4.0), {})
    weight = F.log((F.col("pos") + 0.25) / (pos + 0.5)) - F.log((F.col("neg") + 0.75) / (neg + 1.5))
    found = rows.select("text", "toxic").mapInArrow(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = found.where(F.col("pos") >= MIN_SUPPORT).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT).collect()
    return Lexicon({r.entry: r.weight for r in best if r.entry[-1] != "*"} | {}, {r.entry[:-1]: r.weight for r in best if r.entry[-1] == "*"})


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Ridge logistic weights, the last being the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """A fitted grammar: a lexicon and logistic weights."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, [float(w) for w in weights]

    def score(self, text: str) -> float:
        z = self.weights[-1] + sum(a * b for a, b in zip(self.weights, text_features(text, self.lexicon)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: Without labels: the best clause counts, negated and reported ones count less.
DEFAULT = Model(Lexicon(dict.fromkeys(SEEDS, 4.0), {}), np.array([0.5, 1.0, -1.0, -1.0, 1.5, 1.0, 0.1, -4.0]))


def fit(docs: DataFrame, labels: DataFrame, train=None) -> Model:
    """Learn the grammar's weights from labelled rows."""
    rows = labelled(docs, labels, train)
    lexicon = learn_lexicon(rows.where("fold < 2"))
    got = _over_texts(rows.where("fold = 2"), ["doc_id", "toxic"], "features array<double>", lambda t: text_features(t, lexicon))
    got = got.groupBy("doc_id").agg(F.min(F.struct("toxic", "features")).alias("x")).select("x.*").collect()
    if len({bool(r.toxic) for r in got}) < 2:
        return Model(lexicon, np.array(DEFAULT.weights))
    return Model(lexicon, fit_logistic(np.array([r.features for r in got]), np.array([float(bool(r.toxic)) for r in got])))


def score(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """keys and score for each row of docs."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    return _over_texts(docs, keys, "score double", lambda t: shared.value.score(t))
