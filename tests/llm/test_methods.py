"""The methods of the corpus operators: transducers, limits, recall at the stated similarity, merging, regions, hot groups."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from marketloom.llm import caps, common, components, katz, licenses, packing, quality, queries, sentencepieces, simhash, suffix_arrays, suffix_trees, toxicity, windows
from marketloom.llm.transducers import Transducer

CLASH = "doc_id long, text string, lang string, source string, kept int, score int, path string, license string, n_tokens int, length int, held_out string, fold int, x int, node int, label int"


def random_words(n, seed, vocabulary=100_000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def paths(machine, symbols):
    """Weights and outputs of all paths."""
    now = [(machine.start, 0.0, "")]
    for x in symbols:
        now = [(to, w + v, told + write) for state, w, told in now for write, v, to in machine.arcs.get(state, {}).get(x, ())]
    return [(w + machine.finals[s], told) for s, w, told in now if s in machine.finals]


def random_machine(r, reads, writes, states=3):
    m = Transducer(0, finals={s: r.randrange(3) for s in range(states) if s == 0 or r.random() < 0.6})
    for s, x in itertools.product(range(states), reads):
        for _ in range(r.randrange(0, 3)):
            m.add(s, x, r.choice(writes), r.randrange(states), float(r.randrange(4)))
    return m


def test_composition_against_enumerated_paths():
    r = random.Random(5)
    for _ in range(60):
        a, b = random_machine(r, "ab", "xyz"), random_machine(r, "xyz", "12")
        both = a.compose(b)
        for n in range(4):
            for word in itertools.product("ab", repeat=n):
                want = [(w + v, told) for w, between in paths(a, word) for v, told in paths(b, between)]
                best = min(want, key=lambda e: (-e[0], e[1])) if want else None
                assert both.best(word) == best


def test_grammar_against_its_rules():
    """Every clause of up to five symbols against the rules written out."""
    scope = toxicity.SCOPE
    for n in range(1, 6):
        for symbols in itertools.product("ONRTHI", repeat=n):
            want, report, negation, target, threat = "", -99, -99, -99, -99
            for i, x in enumerate(symbols):
                if x == "I":
                    ahead = "T" in symbols[i + 1 : i + 1 + scope]
                    want += "r" if i - report <= 2 * scope else "n" if i - negation <= scope else "a" if i - target <= scope or ahead else "p"
                report, negation, target = (i if x == "R" else report), (i if x == "N" else negation), (i if x == "T" else target)
                if x == "T" and i - threat <= scope:
                    want, threat = want + "h", -99
                threat = i if x == "H" else threat
            assert toxicity.rewritten("".join(symbols)) == want, symbols
    assert toxicity.rewritten("IQIQI") == "prp" and toxicity.rewritten("QI") == "p"


def test_toxicity_of_ties_repeats_and_long_texts(spark):
    text = "you are an idiot. " + "calm words follow here " * 20_000
    rows = [(1, "you idiot"), (1, "you idiot"), (2, "you idiot"), (3, text), (4, "x" * 100_000)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), toxicity.DEFAULT, ["doc_id"]).collect()
    assert len({r.score for r in got if r.doc_id < 3}) == 1 and len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.labelled(spark.createDataFrame(rows, "doc_id long, text string"), labels).count() == 3  # both rows of doc 1, that of doc 2
    assert 0 <= toxicity.fit(spark.createDataFrame([], "doc_id long, text string"), labels).score("a") <= 1


def test_clashing_columns_and_empty_tables(spark, tmp_path, tables):
    words = " ".join(random_words(80, 3))
    rows = [(1, words, "en", "s", 1, 1, "p", "l", 1, 1, "h", 1, 1, 1, 1), (None, None, None, None, *[None] * 11), (3, "", "en", None, 1, 1, "p", "l", 1, 1, "h", 1, 1, 1, 1)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    pages = [(1, "http://a/", "<p>", 1, 1, "c", 1), (None, None, None, 1, 1, "c", 1), (3, "", "", 1, 1, "c", 1)]
    names = [n for n in queries.QUERIES if n not in ("op7_caps", "op13_negatives")]  # those of vectors have tests of their own
    for k, own in enumerate((rows, [])):
        folder = str(tmp_path / str(k))
        spark.createDataFrame(own, CLASH).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
        labels.where(F.lit(bool(own))).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(pages if own else [], "page_id long, url string, html string, row int, first int, capture string, same int").write.parquet(f"{folder}/pages.parquet")
        for n in names:
            got = queries.QUERIES[n](spark, folder).collect()
            assert len(got) == len(own), n
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 2, 1, 1, "a"), (1, [1.0, 0.1], 2, 1, 1, "a"), (1, [1.0, 0.0], 2, 1, 1, "a"), (2, [1.0, 0.01], 2, 1, 1, "b"), (None, [1.0, 0.0], 2, 1, 1, "c")], "vec_id long, embedding array<float>, label int, node int, f int, places string")
    got = caps.near_duplicates(vectors).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id) == [(1, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1)]
    assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]


def test_quality_verdicts_by_brute_force(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    limits = quality.learn_limits(docs, labels)
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress

    def outside(lines, n, ratio):
        place = 2 * math.log2(max(n, 1))
        known = lines.low and lines.first <= place < lines.first + len(lines.low)
        if not known:
            low, high = quality.fixed_band(int(place))
        else:
            at = lines.first + 0.5 + np.arange(len(lines.low))
            low, high = np.interp(place, at, lines.low), np.interp(place, at, lines.high)
        return ratio < low - 1e-12 or ratio > high + 1e-12

    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    kept = 0
    for r in docs.select("doc_id", "text").collect():
        data, own = (r.text or "").encode(), got[r.doc_id]
        parts = [data[i : i + quality.CHUNK] for i in range(0, len(data), quality.CHUNK)] if len(data) > quality.CHUNK else []
        parts = [p for p in parts if len(p) >= quality.MIN_BYTES]
        odd = sum(outside(limits.chunks, len(p), len(p) / len(compress(p))) for p in parts)
        bad = len(data) >= quality.MIN_BYTES and outside(limits.texts, len(data), len(data) / len(compress(data)))
        assert own.kept == (not own.base_failed and not bad and 2 * odd <= len(parts)), r.doc_id
        kept += own.kept
    assert kept


def test_limits_come_from_every_label(spark, monkeypatch):
    """More good texts than any sample would hold: limits are numpy's over all of them, and a document's repeats count once."""
    rng, rows = random.Random(5), []
    for i in range(24_000):
        n = rng.choice([9, 14, 20, 29]) if i else 3000
        rows.append((i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "epsilon")) for _ in range(n))))
    docs = spark.createDataFrame([*rows, rows[7], (None, "x " * 50)], "doc_id long, text string").repartition(4)
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 <> 3) AS quality")
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    told = [quality.measure(t, compress) for i, t in rows if i % 10 != 3]
    monkeypatch.setattr(quality, "MIN_IN_BAND", 2)
    got = quality.learn_limits(docs, labels.union(labels))
    texts = quality.Lines.fit(np.array([m[0] for m in told]), np.array([m[6] for m in told]))
    chunks = quality.Lines.fit(np.array([n for m in told for n in m[8]]), np.array([x for m in told for x in m[7]]))
    for a, b in ((got.texts, texts), (got.chunks, chunks)):
        assert a.first == b.first and np.allclose(a.low, b.low, 1e-12, 0) and np.allclose(a.high, b.high, 1e-12, 0) and b.low
    assert quality.learn_limits(docs, labels.where("quality = 2")) == quality.NO_LABELS


def test_limits_tell_symbols_from_prose():
    """Of held-out labelled texts at most 1 % of the good ones lie beyond the limits, and most bad ones of 1 KB or more do."""
    import duckdb

    rows = duckdb.sql("SELECT min(text), min(quality) FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE quality IS NOT NULL GROUP BY doc_id ORDER BY doc_id").fetchall()
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    told = [(quality.measure(t or "", compress), q) for t, q in rows]
    told = [(m, q) for m, q in told if m[1] >= 50 and 2 * m[5] <= m[1]]
    learn, held = told[::2], told[1::2]
    texts = quality.Lines.fit(np.array([m[0] for m, q in learn if q]), np.array([m[6] for m, q in learn if q]))
    chunks = quality.Lines.fit(np.array([n for m, q in learn if q for n in m[8]]), np.array([x for m, q in learn if q for x in m[7]]))

    def outside(lines, n, ratio):
        place, at = 2 * math.log2(n), lines.first + 0.5 + np.arange(len(lines.low))
        return lines.first <= place < lines.first + len(at) and not np.interp(place, at, lines.low) <= ratio <= np.interp(place, at, lines.high)

    def beyond(m):
        return outside(texts, m[0], m[6]) or 2 * sum(outside(chunks, n, x) for x, n in zip(m[7], m[8])) > len(m[7])

    good, bad = [m for m, q in held if q], [m for m, q in held if not q and m[0] >= 1024]
    assert sum(map(beyond, good)) <= 0.01 * len(good) and sum(map(beyond, bad)) >= 0.85 * len(bad)


def test_recall_at_similarities(spark):
    """At 0.80, 0.85 and 0.90 at least 95 of 100 pairs are found."""
    rows, want = [], {}
    for level in (0.80, 0.85, 0.90):
        for p in range(100):
            n, seed = 300 + 3 * p, int(level * 100) * 1000 + p
            base = random_words(n, seed)
            grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            own, changed, places = grams(base), base[:], list(range(10, n - 10, 5))
            random.Random(seed).shuffle(places)
            for at in places:
                trial = changed[:]
                trial[at] = "changed"
                other = grams(trial)
                if len(own & other) / len(own | other) < level:
                    break
                changed = trial
            other = grams(changed)
            assert level <= len(own & other) / len(own | other) < level + 0.03
            want[2 * seed] = level
            rows += [(2 * seed, " ".join(base)), (2 * seed + 1, " ".join(changed))]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for level in (0.80, 0.85, 0.90):
        assert sum(got[d + 1] == got[d] == d for d, x in want.items() if x == level) >= 95
    assert all(got[d] // 2 == d // 2 for d in got)


def test_large_components_by_tiles(spark, monkeypatch):
    """A family of copies over many tiles, with chains that only rows outside the largest class have, against brute force."""
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "PIVOTS", 3)
    base, r, rows = random_words(260, 77), random.Random(8), []
    for k in range(90):
        own = base[:]
        for at in r.sample(range(5, 255), r.randrange(0, 12)):
            own[at] = f"x{k}-{at}"
        rows.append((k, " ".join(own)))
    grams = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    group = {d: d for d in grams}
    links = [(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8]
    for _ in range(90):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = {x.doc_id: x.component_id for x in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    missed = sum(got[d] != group[d] for d in group)
    assert missed <= 2 and len(set(group.values())) > 2


def test_block_edges_join_small_blocks_and_star_large_ones(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    k = np.array([1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 4])
    node, sketch = np.arange(11), np.array([0, 0, 1, 0, 255, 1] + [0] * 5, np.uint64)
    got = {(int(a), int(b)) for u, v in simhash.block_edges(k, node, sketch, 2) for a, b in zip(u, v)}
    assert got == {(1, 2), (5, 3)} | {(i, 6) for i in range(7, 11)}


def test_long_words_that_a_polynomial_takes_for_equal():
    even = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    odd = even.translate({97: "b", 98: "a"})
    h, _, _ = common.word_hashes(f"{even} {odd} x x".encode())
    assert h[0] != h[1] and h[2] == h[3]


def test_long_periodic_regions_are_cut():
    kind = windows.Kind("bytes", 400, 128)
    for period in (1, 3, 256):
        x = np.frombuffer((bytes(range(period)) * (300_000 // period)), np.uint8)
        key, start, count, _ = windows.regions(x, kind)
        assert count.max() <= windows.PIECE and count.sum() == len(x) - 399
        assert (start[1:] == start[:-1] + count[:-1]).all() and start[0] == 0


@pytest.mark.parametrize("operator", ["bytes", "words"])
def test_long_repeats(spark, operator):
    """A long run of one byte or word, and its like in another row."""
    unit = "x" if operator == "bytes" else "w "
    rows = [(1, unit * 30_000), (2, "y z " + unit * 9_000), (3, "other text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    if operator == "bytes":
        got = {r.doc_id: r.n_removed for r in suffix_arrays.repeated_bytes(frame).collect()}
        assert got == {1: 30_000, 2: 9_000, 3: 0}
    else:
        got = {r.doc_id: r.n_removed for r in suffix_trees.repeated_words(frame).collect()}
        assert got == {1: 0, 2: 9_000, 3: 0}


def test_windows_merge_by_binary_search():
    r = np.random.default_rng(2)
    parts = []
    for k in range(5):
        n = int(r.integers(0, 40))
        digest = np.frombuffer(b"".join(bytes([int(x)]) + b"\0" * 15 for x in r.integers(0, 9, n)), windows.DIGEST)
        parts.append(windows.Windows(digest, np.stack([np.full(n, k), np.arange(n), *r.integers(0, 5, (3, n))])).sorted())
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(windows.Windows.unpacked(p.packed()))
    assert (whole.digest[1:] >= whole.digest[:-1]).all()
    rows = lambda w: sorted((bytes(d), *c) for d, c in zip(w.digest.tolist(), w.rows.T.tolist()))
    assert rows(whole) == sorted(x for p in parts for x in rows(p))


@pytest.mark.parametrize("few", [0, 250_000])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, few):
    """Stars, chains and random edges with hot nodes, by rounds over all tasks and by a single one."""
    monkeypatch.setattr(components, "HOT", 5)
    monkeypatch.setattr(components, "MANY", 0)
    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(4)
    edges = [(0, i) for i in range(1, 40)] + [(50, i) for i in range(51, 90)] + [(60, 20), (201, 200), (7, 7), (None, 3)] + [(300 + i, 301 + i) for i in range(40)] + [(400 + r.randrange(60), 400 + r.randrange(60)) for _ in range(30)]
    name = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in name:
        for a, b in edges:
            if a in name and b in name:
                name[a] = name[b] = min(name[a], name[b])
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    assert got == name


def test_least_reached():
    r = np.random.default_rng(3)
    for n in (0, 1, 50, 400):
        u, v = r.integers(0, 300, n), r.integers(0, 300, n)
        name = {int(x): int(x) for x in np.concatenate((u, v))}
        for _ in name:
            before = dict(name)
            for a, b in zip(u.tolist(), v.tolist()):
                name[a] = name[b] = min(name[a], name[b])
            if before == name:
                break
        nodes, least = components.least_reached(u, v)
        assert dict(zip(nodes.tolist(), least.tolist())) == name


def test_caps_decode_is_the_full_list():
    c = caps.Caps(32, 16)
    x = caps.unit(np.random.default_rng(4).standard_normal((40, 32)))
    rotation, codes, threshold = c.parts()
    y, lists = x @ rotation, c.decode(x)
    for i, own in enumerate(lists):
        s = [y[i, 8 * k : 8 * k + 8] @ codes[k].T for k in range(4)]
        sums = (s[0][:, None, None, None] + s[1][:, None, None] + s[2][:, None] + s[3]).ravel()
        want = np.flatnonzero(sums >= threshold)
        want = want if len(want) >= caps.FLOOR else np.sort(np.argsort(-sums, kind="stable")[: caps.FLOOR])
        assert np.array_equal(own, want)


def test_packing_is_close_to_the_least_number(spark):
    counts = Counter(r.length for r in packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), queries.tokenizer("byte_bpe_50k.json")).collect())
    least = -(-sum(n * x for x, n in counts.items()) // packing.CAPACITY)
    assert packing.plan(dict(counts)).sequences <= least + 1


def test_pieces_of_texts_are_the_librarys():
    own = packing.ByteEncoder(queries.tokenizer("byte_bpe_50k.json"))
    texts = ["a", " a", "a ", "a b", "a  b", "a \nb", "a\n b", "a\nb", "\n\na b\n", "it's 'tis we'll", "x's y", "tab\tz", "nb\xa0sp", "é ü ñ 日本 語", "a,b ,c", "1 23,4", "😀 😀😀", " ", "\n", "", "z\0 z", "end\n", "<|endoftext|> x", "a b c", "w" * 200 + " w"]
    assert own.encode_batch(texts) == [own.whole(t) for t in texts]


def test_rows_of_agendas_are_the_heap():
    p = sentencepieces.Pieces(queries.tokenizer("piece_bpe_32k.model"))
    r = random.Random(3)
    texts = ["▁" + "".join(r.choices("abcdefgeeiouéßxyz'.,日", k=r.randrange(0, 60))) for _ in range(400)]
    assert [np.frombuffer(b, "<u4").tolist() for b in p.encode_segments(texts)] == [p.encode_segment(t) for t in texts]


def test_generations_of_the_cache(monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHED", 5)
    own = sentencepieces.Encoder(sentencepieces.Pieces(queries.tokenizer("piece_bpe_32k.model")))
    for k in range(6):
        text = " ".join([*"common words stay", *(f"n{k}{i}" for i in range(4))])
        (n, ids, raw), = own.encode_batch([text])
        assert raw.decode() == text and np.frombuffer(ids, "<u4").tolist()[1:-1] == own.pieces.library.encode(text)


def test_license_of_a_text_much_longer_than_its_cues():
    own = licenses.Templates(licenses.TEMPLATES)
    text = "License:\n" + "released under the mit\n" * 100
    name, cosine = own.best(text)
    assert cosine >= licenses.LEAST_FILE and licenses.scan_text(text, own) == (name.partition("#")[0], pytest.approx(cosine), True)


def test_licenses_whole_operator_by_brute_force(spark):
    """Each file's own license by cosines over all terms, and the nearest directory's by walking up."""
    own, r = licenses.Templates(licenses.TEMPLATES), random.Random(6)
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "code only", "", None, "All rights reserved.", "# SPDX-License-Identifier: ISC\n" + "x = 1\n" * 400, "License\n" + "word " * 5000]
    files = [(i, "/".join(r.choices("abc", k=r.randrange(0, 4)) + [f"f{i}"]), r.choice(texts)) for i in range(60)] + [(100, None, texts[0]), (101, "a/b/f", "x" * 200_000)]
    told = {i: licenses.scan_text(t or "", own) for i, _, t in files}
    holders = {}
    for i, p, _ in files:
        if told[i][2] and p is not None:
            d = p.rpartition("/")[0]
            holders[d] = min(holders.get(d, told[i][0]), told[i][0])

    def want(i, p):
        if told[i][2]:
            return told[i][0], "file"
        if told[i][0]:
            return told[i][0], "header"
        while p:
            p = p.rpartition("/")[0]
            if p in holders:
                return holders[p], "inherited"
        return None, "none"

    got = {x.id: (x.license, x.origin) for x in licenses.licenses(spark.createDataFrame(files, "id long, path string, text string"), "id").collect()}
    assert got == {i: want(i, p) for i, p, _ in files}
    assert licenses.licenses(spark.createDataFrame([], "id long, path string, text string"), "id").count() == 0


def good_turing(counts, cut=5):
    """Discounts by Katz's formula, written out."""
    n = Counter(counts)
    if not n[1] or not n[cut + 1]:
        return [1.0] * (cut + 1)
    common_ = (cut + 1) * n[cut + 1] / n[1]
    out = [1.0]
    for r in range(1, cut + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - common_) / (1 - common_) if n[r] and common_ != 1 else 1.0
        out.append(d if 0 < d <= 1 else 1.0)
    return out


def test_discounts():
    r = random.Random(9)
    for _ in range(50):
        counts = [min(30, int(r.paretovariate(0.8))) for _ in range(r.randrange(0, 400))]
        n = Counter(counts)
        assert list(katz.Discounts.good_turing([n[k] for k in range(katz.CUT + 2)]).d) == pytest.approx(good_turing(counts))


def test_shared_folder_is_asked_for_off_local_mode():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def rule_features(text, lexicon):
    """Features of a text by the rules written out, clause by clause, without transducers."""
    sums, words, best, hits = Counter(), 1, 0.0, 0.0
    for clause in toxicity.CLAUSE.split(text.lower()):
        words += clause.count(" ") + 1
        tokens = toxicity.TOKEN.findall(clause)
        weight = [lexicon.weight(t) if t[:3] in lexicon.first3 else 0.0 for t in tokens]
        role = [None if w else toxicity.ROLES.get(t) for t, w in zip(tokens, weight)]
        marks = [i for i, x in enumerate(role) if x == "Q"]
        assert len(marks) < 3 or not any(weight)  # more marks may pair in several ways
        quoted = range(marks[0], marks[1]) if len(marks) > 1 else ()
        near = lambda i, kind, span: any(role[j] == kind for j in range(max(0, i - span), i))
        total, free = 0.0, True
        for i, w in enumerate(weight):
            found = []
            if w:
                ahead = any(x == "T" for x in role[i + 1 : i + 1 + toxicity.SCOPE])
                kind = "reported" if i in quoted or near(i, "R", 2 * toxicity.SCOPE) else "negated" if near(i, "N", toxicity.SCOPE) else "aimed" if ahead or near(i, "T", toxicity.SCOPE) else "plain"
                found.append((kind, w))
            if role[i] == "T" and free and near(i, "H", toxicity.SCOPE):
                found.append(("threat", 1.0))
                free = False
            free = free or role[i] == "H"
            for kind, x in found:
                sums[kind] += x
                total, hits = max(total, x), hits + x
        best = max(best, total)
    return [*(math.log1p(sums[k]) for k in toxicity.FEATURES[:5]), best, 100 * hits / (words + 20)]


def test_pipeline_by_brute_force(spark, tables):
    """Every stage but the first (see the verdicts above) against plain Python on the smallest tables."""
    import corpus_pipeline as P
    import hashlib

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    good = P.quality_rules(spark, docs, tables).cache()
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    model = toxicity.fit(good, labels, ~common.bucket_of("doc_id", 2, 4))
    logistic = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    score = {r.doc_id: logistic(model.weights[-1] + sum(a * b for a, b in zip(model.weights, rule_features(r.text or "", model.lexicon)))) for r in good.collect()}
    clean = P.drop_toxic(spark, good, tables).cache()
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert sorted(rows) == sorted(d for d, x in score.items() if x < P.TOXIC) and 0 < len(rows) < len(score)
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, simhash.text_words(t)) for d, t in rows.items())}
    group = {d: d for d in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(rows), 2) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    for _ in rows:
        before = dict(group)
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    single = P.near_copies(spark, clean, tables).cache()
    left = sorted(r.doc_id for r in single.collect())
    assert left == sorted(d for d in rows if group[d] == d)
    first, words = {}, {d: (rows[d] or "").encode().split() for d in left}
    for d in left:
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    want = {}
    for d in left:
        gone = {j for i in range(len(words[d]) - 49) if first[tuple(words[d][i : i + 50])] < d for j in range(i, i + 50)}
        kept = [w for j, w in enumerate(words[d]) if j not in gone]
        if kept or not words[d]:
            want[d] = hashlib.sha256(b" ".join(kept)).hexdigest()
    cut = P.repeated_passages(spark, single, tables).cache()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert {d: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for d, t in texts.items()} == want
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    sizes = Counter()
    for r in P.pack(spark, cut, tables).collect():
        sizes[r.doc_id] += r.length
    assert sizes == {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts.items()}


def test_stored_katz_model(spark):
    """Texts scored from the stored tables have the scores that counting them along gives held-out texts."""
    r = random.Random(12)
    pool = [f"W{int(r.paretovariate(0.9))}" for _ in range(3000)]
    rows = [(i, " ".join(r.choices(pool, k=r.randrange(0, 60)))) for i in range(150)] + [(500, None), (501, "never Seen before")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 5 == 0
    want = {x.doc_id: x.score for x in katz.score(frame, held).collect()}
    model = katz.fit(frame.where(~held), parts=3)
    got = {x.doc_id: x.score for x in katz.evaluate(frame, model).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in got)
    mass = model.bigrams.join(model.weights, "history").groupBy("history", "a").agg(F.sum(F.pow(F.lit(10.0), "p")).alias("seen"), F.collect_set("word").alias("words")).limit(20).collect()
    unigram = {x.word: 10**x.p for x in model.unigrams.collect()}
    for h in mass:
        rest = 10**model.unknown + sum(p for w, p in unigram.items() if w not in set(h.words))
        assert h.seen + 10**h.a * rest == pytest.approx(1)
    nothing = katz.fit(frame.limit(0))
    assert katz.evaluate(frame.where("doc_id = 501"), nothing).first().score == pytest.approx(0.0)


def test_unrelated_fingerprints_give_few_candidates():
    """A million unrelated fingerprints: under a hundredth of an edge a text over all blocks, and no component of note from a share of them."""
    import numpy as np

    from marketloom.llm import simhash
    from marketloom.llm.components import least_reached

    n, rng = 1_000_000, np.random.default_rng(3)
    raw = rng.integers(0, 256, (n, 8 * simhash.WORDS), np.uint8)
    bits, samples = simhash.block_plan(n, simhash.differing(0.8, simhash.BLOCK_DEVIATIONS) / (64 * simhash.WORDS))
    tried, found = 8, []
    for i in range(tried):
        picks = rng.choice(64 * simhash.WORDS, (1, bits), replace=False)
        k, word = simhash.block_keys(raw, picks)
        order = np.argsort(k[0], kind="stable")
        found += list(simhash.block_edges(k[0][order], order, word[0].view(np.uint64)[order], simhash.differing(0.8, simhash.WORD_DEVIATIONS, 64)))
    u, v = (np.concatenate(x) for x in zip(*found))
    assert len(u) * samples / tried < 0.01 * n
    assert len(u) == 0 or np.unique(least_reached(u, v)[1], return_counts=True)[1].max() < 10


def test_related_fingerprints_meet(spark):
    """At the least similarity the blocks and their words miss a few of a hundred pairs, and fewer above it."""
    import numpy as np

    from marketloom.llm import simhash

    rng = np.random.default_rng(4)
    for least, share in ((0.8, 0.95), (0.85, 0.99), (0.9, 0.999)):
        n = 3000
        raw = rng.integers(0, 256, (n, 8 * simhash.WORDS), np.uint8)
        flip = rng.random((n, 64 * simhash.WORDS)) < np.arccos(2 * least / (1 + least)) / np.pi
        other = raw ^ np.packbits(flip, axis=1)
        bits, samples = simhash.block_plan(1_000_000, simhash.differing(0.8, simhash.BLOCK_DEVIATIONS) / (64 * simhash.WORDS))
        picks = np.array([rng.choice(64 * simhash.WORDS, bits, replace=False) for _ in range(samples)])
        (a, x), (b, y) = simhash.block_keys(raw, picks), simhash.block_keys(other, picks)
        near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= simhash.differing(0.8, simhash.WORD_DEVIATIONS, 64)
        assert ((a == b) & near).any(axis=0).mean() >= share


def test_contractions_quotes_and_far_negations():
    from marketloom.llm import toxicity

    lexicon = toxicity.Lexicon({"idiot": 4.0, "idiota": 4.0}, {})
    kinds = lambda s: [k for k, _ in toxicity.clause_matches(s, lexicon)]
    for text, want in {
        "he isn't an idiot": "negated", "you aren't an idiot": "negated", "you aren’t an idiot": "negated", "they don't call him an idiot": "negated", "no one is an idiot": "negated",
        "you cannot be an idiot": "negated", "'you are an idiot' she said": "reported", "‘an idiot’ was the word": "reported", "she tells everyone what an idiot": "reported",
        "l'idiot": "plain", "you're an idiot": "aimed", "the boys' idiot": "plain", "du bist kein idiot": "negated", "nadie es un idiota": "negated", "vous êtes un idiot": "aimed", "what an idiot he is": "aimed",
    }.items():
        assert kinds(text) == [want], text
    assert kinds("i will strangle them") == ["threat"] and kinds("te mataré a ti") == ["threat"] and kinds("don't") == []


def test_license_notices_and_expressions():
    from marketloom.llm import licenses

    own = licenses.Templates(licenses.TEMPLATES)
    scan = lambda text, name="": licenses.scan_text(text, own, name)
    code = "\nx = compute(y)" * 300
    for holder in ("Jane Doe", "2019-2024 Example Widgets GmbH & Co.", "(c) 2020, the authors,"):
        assert scan(f"// Copyright {holder}. All rights reserved.{code}")[0] == "Proprietary"
    assert scan("Copyright (c) 2020 Jane Doe. All rights reserved.")[0] == "Proprietary"
    assert scan(f"Copyright (c) 2020 Jane Doe{code}")[0] is None
    for tag, want in {"Apache-2.0 OR MIT": "Apache-2.0 OR MIT", "(MIT AND BSD-2-Clause)": "(MIT AND BSD-2-Clause)", "GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0 WITH Classpath-exception-2.0", "MIT or Unlicense": "MIT OR Unlicense"}.items():
        assert scan(f"# SPDX-License-Identifier: {tag}{code}")[::2] == (want, False)
    assert scan(f"# SPDX-License-Identifier: Unlicense OR WTFPL{code}")[0] is None
    for known in ("GPL-2.0-only", "MIT", "BSD-2-Clause", "CC-BY-NC-SA-4.0"):
        assert scan(f"# SPDX-License-Identifier: {known}") [2] is False  # a tag alone is no license file
        assert scan(f"SPDX-License-Identifier: {known}", "LICENSE.txt")[2] is True
    assert scan("license: mit")[::2] in (("MIT", False), (None, False))


def test_words_beyond_their_numbers_are_an_error(spark, monkeypatch):
    """Numbers of 32 bits would mix words up; a bucket number of that size stands for as many words."""
    import numpy as np

    from marketloom.llm import katz

    row = (1 << 33, 0, bytes(katz.pack(np.array([5, 9], np.uint64))), bytes(katz.pack(np.array([1, 2], np.uint32))))
    messages = spark.createDataFrame([row], "bucket long, chunk long, a binary, b binary")
    with pytest.raises(Exception, match="32 bits"):
        katz.word_replies(messages, 4).collect()
