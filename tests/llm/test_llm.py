"""Corpus operators against brute force on small fixtures, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import caps, katz, licenses, packing, quality, sentencepieces, simhash, suffix_arrays, suffix_trees, toxicity
from marketloom.llm.components import connected_components
from marketloom.llm.queries import QUERIES, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, row string, t string, key string, s int, doc int, m int"


def words(n, seed, vocabulary=300):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é" for _ in range(n)]


def corpus():
    """Copies, shared passages, repeats within a text, nulls, empties, a very long text, clashing columns."""
    base = [words(n, n) for n in (3, 60, 120, 400, 150, 90)]
    passage = words(80, 99)
    texts = [" ".join(w) for w in base]
    texts += [" ".join(base[2][:40] + passage + base[3][:60]), " ".join(base[4] + passage), " ".join(passage * 3), texts[3], texts[3], "ab" * 900, "x" * 30_000, None, "", "  \n\t", "one", "ONE\n two　three\x1cfour", texts[1] + "\n" + texts[1], "\n".join(["same line here"] * 40)]
    near = base[3][:]
    near[200] = "changed"
    texts.append(" ".join(near))
    return list(enumerate(texts, 10))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "r", "t", "k", 1, 2, 3) for d, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def byte_brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = {}
    for (d, _), b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def word_brute(rows, length):
    split = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d, w in sorted(split.items()):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), d)
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("shard", [2_000_000, 1500])
def test_suffix_arrays(docs, shard):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_arrays.repeated_bytes(docs, shard_bytes=shard).collect()}
    assert got == byte_brute(corpus(), 400)


@pytest.mark.parametrize("shard", [2_000_000, 1500])
def test_suffix_trees(docs, shard):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_trees.repeated_words(docs, shard_bytes=shard).collect()}
    assert got == word_brute(corpus(), 50)


def test_suffix_edges(spark, empty):
    assert suffix_arrays.repeated_bytes(empty).count() == 0 and suffix_trees.repeated_words(empty).count() == 0
    long = " ".join(words(80, 1))
    twice = spark.createDataFrame([(1, long), (1, long), (None, long)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in suffix_trees.repeated_words(twice).collect()) == [(False, 0), (False, 0), (True, 80)]
    assert all(r.n_removed == r.n_bytes for r in suffix_arrays.repeated_bytes(twice).collect())
    kept = suffix_trees.repeated_words(spark.createDataFrame([(1, long), (2, f" a\n{long}\nb ")], "doc_id long, text string"), carry=["doc_id"]).where("doc_id = 2").first()
    assert kept.kept == " a\nb " and kept.row.doc_id == 2


def test_suffix_array_order_and_prefixes():
    r = random.Random(3)
    parts = [np.frombuffer(bytes(r.choice(b"ab") for _ in range(n)), np.uint8) for n in (40, 1, 25, 40)]
    symbols, starts = suffix_arrays.concatenate(parts)
    sa, _ = suffix_arrays.suffix_array(symbols, 64)
    ends = np.append(starts[1:], len(symbols)) - 1
    tail = lambda i: symbols[i : ends[np.searchsorted(ends, i)]].tolist()
    inner = [i for i in sa.tolist() if symbols[i]]
    texts = [tail(i) for i in inner]
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    prefixes = suffix_arrays.common_prefixes(symbols, sa)
    place = {int(i): k for k, i in enumerate(sa)}
    for a, b in zip(inner, inner[1:]):
        k = place[b]
        if sa[k - 1] == a:
            assert prefixes[k] == shared(tail(a), tail(b))
    for k in (4, 16):
        heads = [tuple(t[:k]) for t in texts if len(t) >= k]
        assert len({h for h in heads}) == sum(x != y for x, y in zip(heads, heads[1:])) + 1


def simhash_brute(text, width=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    rows = corpus()
    want = {d: simhash_brute(t) for d, t in rows}
    group = {d: d for d in want}
    for _ in want:
        for a in want:
            for b in want:
                if (want[a] ^ want[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (want[d], group[d]) for d in want}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_hot_block(spark):
    r = random.Random(5)
    centre = r.getrandbits(64)
    prints = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(30)} | {r.getrandbits(64) for _ in range(50)})
    rows = [(simhash._signed(p),) for p in prints]
    edges = simhash.near_pairs(spark.createDataFrame(rows, "fp long"))
    pairs = edges.collect()
    assert all(((e.u ^ e.v) % (1 << 64)).bit_count() <= 2 for e in pairs)
    got = {c.node: c.component for c in connected_components(edges).collect()}
    group = {p: p for p in prints}
    for _ in range(3):
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    sizes = sorted(v for v in Counter(group.values()).values() if v > 1)
    assert sorted(Counter(got.values()).values()) == sizes
    assert len(pairs) < 64 * len(prints)


def test_similar_texts(spark, empty):
    base = words(400, 7, 5000)
    near = base[:]
    near[10], near[300] = "a", "b"
    far = words(400, 8, 5000)
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base)), (5, None)]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    assert simhash.similar_texts(empty).count() == 0


def test_similar_texts_near_the_limit(spark):
    """Pairs at 0.78 to 0.85, on both sides of 0.8, and a text that repeats a passage, against brute force."""
    rows = []
    for p in range(120):
        base = words(320 + p, 1000 + p, 100_000)
        other = base[:]
        aim = (0.84, 0.82, 0.805, 0.79, 0.78)[p % 5]
        changed = round((1 - aim) / (1 + aim) * len(base) / 5)
        for k in range(changed):
            other[20 + k * (len(base) - 40) // changed] = "changed"
        rows += [(2 * p, " ".join(base)), (2 * p + 1, " ".join(other))]
    passage = words(40, 5000, 100_000)
    rows += [(1000, " ".join(passage * 20 + base)), (1001, " ".join(passage + base))]
    grams = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    similarity = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    pairs = [similarity(2 * p, 2 * p + 1) for p in range(120)]
    assert all(0.75 < s < 0.87 for s in pairs) and sum(0.8 <= s < 0.83 for s in pairs) > 20 and sum(0.77 < s < 0.8 for s in pairs) > 20
    group = {d: d for d in grams}
    for _ in range(3):
        for a in grams:
            for b in grams:
                if a < b and similarity(a, b) >= 0.8:
                    group[a] = group[b] = min(group[a], group[b])
    assert group[1001] == group[1000]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == group


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (100, 102), (7, 7), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 260)}


TRICKY = ["", " ", "a", "  two  spaces ", "line\nfeed\n\nx", " lead", "▁mark ▁", "日本語 テキスト", "😀 emoji‍", "tab\tand\x00nul", "x" * 500, "ÀÉÎ naïve", "<s> </s> <unk> <0x41>", "a\r\nb", "trailing\n", "\n", "1234 56.78", "▁"]


def test_sentencepieces(spark, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rows = corpus() + list(enumerate(TRICKY, 1000))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sentencepieces.encode(frame, tokenizer("piece_bpe_32k.model"), ["doc_id"]).collect()}
    for d, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[d].ids == ids and got[d].decoded == sp.decode(ids) and got[d].n_tokens == len(ids), repr(t)[:60]
    assert sentencepieces.encode(empty, tokenizer("piece_bpe_32k.model"), ["doc_id"], digest=True).count() == 0


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = corpus() + list(enumerate([*TRICKY, "a <|endoftext|> b"], 1000))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer("byte_bpe_50k.json"), capacity=64).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, t in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        own, at = sorted(by_doc[d], key=lambda r: r.piece), 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and (r.length == 64 or (k == 0 and r.length <= 64))
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(empty, tokenizer("byte_bpe_50k.json")).count() == 0


def test_fullest_is_the_best_sum():
    r = random.Random(1)
    for _ in range(40):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(6)}
        room = r.randrange(1, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
        got = packing.fullest(counts, room)
        assert sum(x * n for x, n in got.items()) == max(sums) and all(n <= counts[x] for x, n in got.items())
    assert packing.plan({3: 10, 7: 10}, 10).sequences == 10


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for d, t in corpus():
        w, r = WORD.findall(t or ""), got[d]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), dup, len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(empty).count() == 0


def test_quality_bands(spark):
    r = random.Random(2)
    prose = " ".join("".join(r.choices(["th", "er", "ing", "an", "ou", "ble", "st", "on", "ea", "wh", "mi", "dro", "pul", "ka", "sev", "gry", "lo", "fi", "cu", "ne"], k=r.randrange(1, 5))) for _ in range(300))
    junk = " ".join("".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=40)) for _ in range(80))
    rows = [(1, prose), (2, " ".join(["spam and more eggs today"] * 400)), (3, junk)]
    assert {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: True, 2: False, 3: False}


def test_toxicity_grammar():
    lexicon = toxicity.Lexicon({"idiot": 4.0}, {"scum": 3.0})
    kinds = lambda s: [k for k, _ in toxicity.clause_matches(s, lexicon)]
    assert kinds("you are an idiot") == ["aimed"]
    assert kinds("such an idiot") == ["plain"]
    assert kinds("he is not an idiot") == ["negated"]
    assert kinds('she said "idiot" aloud') == ["reported"]
    assert kinds("i will kill you") == ["threat"]
    assert kinds("scumbags here") == ["plain"] and kinds("fine day") == []
    assert toxicity.DEFAULT.score("you idiot") > 0.5 > toxicity.DEFAULT.score("a fine day")


def test_toxicity_learns(spark, empty, tables):
    held = QUERIES["op1_toxicity"](spark, tables).join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id")
    rows = held.where("held_out").collect()
    assert rows and sum(r.predicted == r.toxic for r in rows) >= 0.8 * len(rows)
    assert toxicity.score(empty, toxicity.DEFAULT, ["doc_id"]).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert len({r.score for r in toxicity.score(none, toxicity.DEFAULT, ["doc_id"]).collect()}) == 1


def katz_brute(rows, held):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {d: [*WORD.findall(low(t)), "\n"] for d, t in rows}
    uni, big, n = Counter(), Counter(), 0
    for d, w in tokens.items():
        if not held(d):
            uni.update(w)
            big.update(zip([" ", *w], w))
            n += 1
    total = sum(uni.values())

    def discount(counts):
        c = Counter(counts.values())
        d = katz.Discounts.good_turing([c[r] for r in range(katz.CUT + 2)]).d
        return lambda r: d[r] if r <= katz.CUT else 1.0

    du, db = discount(uni), discount(big)
    unknown = sum((1 - du(c)) * c for c in uni.values()) / total
    scale = 1.0
    if unknown < 1e-12:
        scale, unknown = total / (total + 1), 1 / (total + 1)
    p = lambda w: scale * du(uni[w]) * uni[w] / total if uni[w] else unknown
    count = dict(uni) | {" ": n}
    back = {}
    for h in {h for h, _ in big}:
        own = {w: c for (g, w), c in big.items() if g == h}
        seen, mass, s = sum(db(c) * c for c in own.values()), sum(map(p, own)), 1.0
        if seen >= count[h] * (1 - 1e-12):
            s = count[h] / (count[h] + 1)
        back[h] = ((1 - s * seen / count[h]) / (1 - mass), s)
        whole = s * seen / count[h] + back[h][0] * (unknown + sum(p(w) for w in uni) - mass)
        assert whole == pytest.approx(1)
    score = lambda h, w: math.log10(back[h][1] * db(big[h, w]) * big[h, w] / count[h]) if big[h, w] else math.log10(p(w)) + (math.log10(back[h][0]) if h in back else 0)
    return {d: (len(w), sum(uni[x] > 0 for x in w), total, sum(math.log10((uni[x] + 1) / (total + len(uni) + 1)) for x in w), sum(score(h, x) for h, x in zip([" ", *w], w))) for d, w in tokens.items()}


def test_katz(spark, empty):
    r = random.Random(4)
    pool = [f"W{int(r.paretovariate(0.9))}" for _ in range(3000)]
    rows = [(i, " ".join(r.choices(pool, k=r.randrange(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "never Seen before")]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    from marketloom.llm.common import bucket_of

    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket_of("doc_id", 2, 7)).collect()
    want = katz_brute(rows, held)
    assert len(got) == len(rows)
    for x in got:
        n, known, total, base, score = want[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(x.doc_id), n, known, total)
        assert x.base_score == pytest.approx(base) and x.score == pytest.approx(score)
    assert katz.score(empty, F.lit(False)).count() == 0


def test_caps(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64))
    x[100:200] = x[0] + 0.08 * rng.standard_normal((100, 64))
    x[250] = x[251]
    rows = [(i, [float(np.float32(v)) for v in e], int(i % 2) if i >= 250 or i < 100 else 0) for i, e in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 64, 0), (902, [None] + [1.0] * 63, 0), (903, [float("nan")] * 64, 0), (904, rows[0][1], None), (905, rows[0][1], 0)]
    got = {r.vec_id: r for r in caps.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), tile=64).collect()}
    own = [r for r in rows if True] + [odd[-1]]
    u = np.array([e for _, e, _ in own])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.array([r[2] for r in own])[:, None] == np.array([r[2] for r in own]))
    np.fill_diagonal(near, False)
    found = sum(got[r[0]].n_links for r in own)
    assert 0.97 * near.sum() <= found <= near.sum()
    name = caps.forest(near)
    ids = np.array([r[0] for r in own])
    assert np.mean([got[i].component_id == ids[k] for i, k in zip(ids.tolist(), name.tolist())]) > 0.98
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904))
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_licenses(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "print()"), ("a/y.py", "# Licensed under the Apache License, Version 2.0.\ncode " + "word " * 100), ("z/n.py", "code"), (None, None), ("top.py", ""), ("ab/x.py", "code")]
    frame = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "id long, path string, text string")
    got = {r.id: (r.license, r.origin, r.from_directory) for r in licenses.licenses(frame, "id").collect()}
    assert got == {0: ("MIT", "file", None), 1: ("MIT", "inherited", "a"), 2: ("Apache-2.0", "header", None), 3: (None, "none", None), 4: (None, "none", None), 5: (None, "none", None), 6: (None, "none", None)}


def test_license_texts_and_headers():
    own = licenses.Templates(licenses.TEMPLATES)
    name = lambda text: licenses.scan_text(text, own)[::2]
    code = "\nx = compute(y)" * 300
    for path in (licenses.Path(licenses.__file__).parent / "license_texts").glob("*.txt"):
        assert name("Copyright (c) 2021 Some One\n\n" + path.read_text()) == (path.stem, True)
        if path.stem in ("MIT", "ISC", "BSD-3-Clause"):
            assert name("\n".join(f"# {x}" for x in path.read_text().split("\n")) + code * 8)[0] == path.stem
    for known in licenses.NAMES:
        assert name(f"// SPDX-License-Identifier: {known}\n{code}") == (known, False)
    assert name(f"SPDX-License-Identifier: GPL-2.0-or-later{code}") == ("GPL-2.0", False)
    assert name(f"SPDX-License-Identifier: Unlicense{code}") == (None, False)
    assert name(f"This project is licensed under the MIT License - see the LICENSE file{code}") == ("MIT", False)
    assert name(f"All rights reserved.{code}") == ("Proprietary", False)
    assert name(f"licensed under the Example Foundation License{code}") == (None, False)
    header = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version."""
    for kind, version, known in (("", 2, "GPL-2.0"), ("", 3, "GPL-3.0"), ("Affero ", 3, "AGPL-3.0"), ("Lesser ", 3, "LGPL-3.0")):
        assert name(header.format(kind, version) + code) == (known, False)


def test_licenses_brute(spark):
    own = licenses.Templates(licenses.TEMPLATES)
    text = "Released under the MIT License, version 2."
    c = licenses.terms(text)
    idf = lambda t: own.idf.get(t, own.other)
    cosine = {}
    for name, body in licenses.TEMPLATES.items():
        d = licenses.terms(body)
        dot = sum(n * d[t] * idf(t) ** 2 for t, n in c.items())
        cosine[name] = dot / math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()) * sum((n * idf(t)) ** 2 for t, n in d.items()))
    best = max(cosine, key=cosine.get)
    name, value = own.best(text)
    assert name == best and value == pytest.approx(cosine[best])


def test_pipeline(spark, tables):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs = docs.withColumns({c: F.lit(1) for c in ("kept", "score", "n_words", "row", "t", "ratio", "fp", "component_id")})
    columns = docs.columns
    kept = docs
    for _, stage in P.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, tables)
        assert kept.columns == columns
        assert kept.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    packed = P.STAGES[-1][1](spark, kept, tables)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert P.run(spark, tables).columns == packed.columns


def test_pipeline_edges(spark, tables):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(words(200, 31, 3000))
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (2, good, "en", "s", 5), (2, good, "en", "s", 5), (3, good, None, "s", None)]):
        kept = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES[:-1]:
            kept = stage(spark, kept, tables)
            assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert kept.where("doc_id IS NULL OR doc_id = 1 OR doc_id = 3").count() == 0 and kept.count() <= 1
        P.STAGES[-1][1](spark, kept, tables).count()


def test_near_copies_keeps_one_row(spark):
    """Near copies whose ids are all null, and those whose smallest id is on several texts, leave one row each."""
    import corpus_pipeline as P

    def near(seed):
        base = words(300, seed, 100_000)
        return [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (50, 150, 250)]

    rows = [(None, t) for t in near(61)] + [(7, t) for t in near(62)] + list(zip((8, 8, 9), near(63)))
    for order in (rows, rows[::-1]):
        kept = P.near_copies(spark, spark.createDataFrame(order, "doc_id long, text string"), "").collect()
        assert sorted(str(r.doc_id) for r in kept) == ["7", "8", "None"]
