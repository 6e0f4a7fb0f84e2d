"""Manifests, archives and hard negatives against brute force, and their edge cases."""

import base64
import gzip
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marketloom.llm import merkle, negatives, warc
from marketloom.llm.queries import QUERIES


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + fanout]) for i in range(0, len(now), fanout)])
    return levels


def steps(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        r = i // fanout * fanout
        out.append(("".join(level[r:i]), "".join(level[i + 1 : r + fanout])))
        i //= fanout
    return out


def manifest_brute(rows, fanout):
    """rows of (doc_id, lang, text, n_chars); n_chars is one more where the crc32 of the id is divisible by 7."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, more=0: h(field(r[0]), field(r[1]), field(r[3] if r[3] is None else r[3] + more), field(r[2]))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda x: b"" if x is None else b"=" + x.encode())
    trees = {g: tree([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))], fanout) for g in order}
    top = tree([trees[g][-1][0] for g in order], fanout)
    out = []
    for place, g in enumerate(order):
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        for i, r in enumerate(own):
            path = steps(trees[g], i, fanout) + steps(top, place, fanout)
            now = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for a, b in path:
                now = h(a, now, b)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*(x for s in path for x in s)), now, now == top[-1][0]))
    return sorted(map(repr, out))


DOCS = "doc_id long, lang string, text string, n_chars long, tree string, leaf string, key string, idx int"


def doc_rows():
    r = random.Random(5)
    rows = [(i, r.choice(["en", "en", "en", "de", None, "é", "", "EN"]), r.choice(["", "a", "text of row", None, "é" * 900]), r.choice([None, i, 7])) for i in range(230)]
    return [*rows, (None, "en", "x", 1), (None, "en", "y", 1), (None, None, None, None), (3, "en", "again", 2), rows[9], rows[9], (900, "only", "one", 3)]


def manifest(docs, fanout, **more):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return merkle.manifest(docs, ["doc_id", "lang", "n_chars", "text"], changes={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, fanout=fanout, **more)


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "SPAN", 2)
    monkeypatch.setattr(merkle, "CHUNK", 8)
    rows = doc_rows()
    docs = spark.createDataFrame([(*r, "t", "l", "k", 1) for r in rows], DOCS).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "9")  # many partitions, so runs that begin and end anywhere
    try:
        got = sorted(repr(tuple(r)) for r in manifest(docs, fanout).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == manifest_brute(rows, fanout)


def test_manifest_edges(spark):
    none = spark.createDataFrame([], DOCS)
    assert manifest(none, 2).count() == 0
    one = spark.createDataFrame([(2, "en", "x", None, "t", "l", "k", 1)], DOCS)
    row = manifest(one, 2, keep=True).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof == "" and row.proof_sha256 == h()
    same = spark.createDataFrame([(1, "en", "x", 1, "t", "l", "k", 1)] * 40, DOCS)
    assert {r.subroot for r in manifest(same, 2).collect()} == {tree([merkle_leaf(1)] * 40, 2)[-1][0]}
    with pytest.raises(ValueError):
        manifest(one, 1)


def merkle_leaf(i):
    return h(f"1:{i}", "2:en", "1:1", "1:x")


def test_proofs_stand_alone(spark):
    docs = spark.createDataFrame([(*r, "t", "l", "k", 1) for r in doc_rows()], DOCS)
    for r in manifest(docs, 2, keep=True).collect():
        assert merkle.folded(r.leaf, r.proof) == r.root


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_mountains(fanout):
    """Any cuts of the leaves, merged in any groups, give the tree."""
    r = random.Random(fanout)
    for n in [1, 2, 3, 7, 8, 9, 64, 200]:
        leaves = [h(str(i)) for i in range(n)]
        levels = tree(leaves, fanout)
        want = {(k, i): x for k, level in enumerate(levels) for i, x in enumerate(level) if k}
        cuts = sorted({0, n, *(r.randrange(n + 1) for _ in range(5))})
        open_, found = [], {}
        for a, b in zip(cuts, cuts[1:]):
            peaks = merkle.Mountains(fanout)
            at = a
            while at < b:
                step = min(b - at, r.randrange(1, 9))
                found.update({(k, i): x for k, i, x in peaks.push(at, leaves[at : at + step])})
                at += step
            open_.append(peaks.open())
        while len(open_) > 1:
            k = r.randrange(len(open_) - 1)
            both = merkle.merge(open_[k] + open_[k + 1], n, fanout)
            found.update({x[:2]: x[2] for x in both if x[3] != merkle.OPEN and x[0]})
            open_[k : k + 2] = [[x[:3] for x in both if x[3] != merkle.NODE]]
        last = merkle.merge(open_[0], n, fanout)
        found.update({x[:2]: x[2] for x in last if x[0]})
        assert found == want, n


def negatives_brute(rows, positives=5, few=3, every=5):
    last = 1 << 63
    own = [(i, v, lab, [math.floor(256 * x) for x in e]) for i, (v, e, lab) in enumerate(rows) if e is not None and lab is not None and all(x is not None and math.isfinite(x) for x in e)]
    score = lambda a, b: sum(x * y for x, y in zip(a[3], b[3]))
    out = []
    for a in own:
        if a[1] is None or a[1] % every:
            continue
        ranked = sorted(((-score(a, b), last if b[1] is None else b[1], b) for b in own if b[0] != a[0]), key=lambda x: x[:2])
        for p in [x for x in ranked if x[2][2] == a[2]][:positives]:
            fit = [x for x in ranked if x[2][2] != a[2] and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]][:few]
            out += [(a[1], p[2][1], k, x[2][1], -p[0], -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(map(repr, out))


VECTORS = "vec_id long, embedding array<double>, label int, row int, x int, anchor int, id int"


def vector_rows(scale=1.0):
    r = random.Random(8)
    rows = [(i, [r.uniform(-0.2, 1) * scale for _ in range(6)], r.randrange(4)) for i in range(90)]
    rows += [(100 + i, rows[4][1], i % 3) for i in range(30)]  # many ties
    rows += [rows[10], rows[10], (None, rows[10][1], 1), (None, rows[5][1], 2), (200, [0.5, 0.5], 0), (205, [], 1), (210, None, 1), (215, [0.1, None], 1), (220, [float("nan")], 1), (225, [float("inf")], 1), (230, [0.4] * 6, None)]
    return rows


@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_negatives(spark, scale):
    rows = vector_rows(scale)
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS).repartition(3)
    got = negatives.mine(table, F.col("label"), F.col("vec_id") % 5 == 0, block_rows=7)
    assert sorted(repr(tuple(r)) for r in got.collect()) == negatives_brute(rows)


def test_negatives_edges(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.mine(none, F.col("label"), F.col("vec_id") % 5 == 0).count() == 0
    lone = spark.createDataFrame([(5, [1.0], 1, 1, 2, 3, 4), (6, [1.0], 2, 1, 2, 3, 4)], VECTORS)
    assert negatives.mine(lone, F.col("label"), F.col("vec_id") % 5 == 0).count() == 0
    huge = spark.createDataFrame([(5, [1e300], 1, 1, 2, 3, 4), (6, [1e300], 1, 1, 2, 3, 4)], VECTORS)
    with pytest.raises(Exception, match="fit into a long"):
        negatives.mine(huge, F.col("label"), F.col("vec_id") % 5 == 0).count()


def test_exact_products():
    import numpy as np

    a, b = np.array([[2.0**27, 2.0**27 + 1]]), np.array([[2.0**26 + 1, 2.0**25 - 1]])
    assert negatives.products(a, b).tolist() == [[2**27 * (2**26 + 1) + (2**27 + 1) * (2**25 - 1)]]


PAGES = "page_id long, url string, html string, row int, id int, first int, capture string"


def page_rows():
    quoted = "".join(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n<p>not a record</p>\r\n\r\n" for n in (5, 10**9))
    texts = ["<p>a</p>", "<p>a</p>", "", None, quoted, "x\r\n\r\n" + quoted, "é" * 50_000, "ü", "\r\n\r\n", "tail\r\n\r\n"]
    rows = [(i, f"http://h{i % 3}.example/p?q={i}", t) for i, t in enumerate(texts)]
    rows += [(20, None, "<p>a</p>"), (None, "http://x/", "<p>a</p>"), (None, "no address", "alone"), (21, "http://y/a b\r\nX: 1", "z"), (22, "http://z", "same"), (22, "http://z", "same"), (-4, "http://w/", "ü")]
    return rows + [(100 + i, "http://hot/", "hot page") for i in range(60)]


def pages_brute(rows, least):
    out, first = [], {}
    for place, (i, _, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        b = (t or "").encode()
        kind = "revisit" if len(b) >= least and b in first else "response"
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, first[b] if kind == "revisit" else None))
        first.setdefault(b, i)
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, 1, 2, 3, "c") for r in rows], PAGES).repartition(3)
    assert sorted(repr(tuple(r)) for r in warc.round_trip(pages, least).collect()) == pages_brute(rows, least)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_whole_captures(spark, tmp_path):
    """Payloads come back whole, in one nested row with request and metadata; names are unique."""
    rows = page_rows()
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame([(*r, 1, 2, 3, "c") for r in rows], PAGES), path)
    found = warc.captures(warc.records(spark, path)).collect()
    assert len(found) == len(rows) and len({r.capture for r in found}) == len(rows)
    assert all(len(r.requests) == len(r.metadata) == 1 and not r.others and r.requests[0].concurrent == [r.capture] for r in found)
    kept = sorted(bytes(r.record.payload) for r in found if r.record.type == "response")
    assert kept == sorted({(t or "").encode() for _, _, t in rows})
    by_name = {r.capture: r for r in found}
    for r in found:
        assert r.record.digest == "sha1:" + r.record.payload_sha1 or r.record.type == "revisit"
        if r.record.type == "revisit":
            assert by_name[r.record.refers].record.digest == r.record.digest and not r.record.payload
    assert any(r.record.url == "http://y/a%20b%20X:%201" for r in found)
    member = gzip.open(next((tmp_path / "a").glob("*.gz"))).read()
    assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")


def warc_text(kind, name, body, version="1.0", concurrent=(), content="text/plain"):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *(f"WARC-Concurrent-To: {c}" for c in concurrent), f"Content-Type: {content}", f"content-length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, tmp_path, packed):
    """Members of their own, older versions, binary payloads, records joined over another one, and some that belong to none."""
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    binary = bytes(range(256)) * 40
    records = [
        warc_text("warcinfo", "<i>", b"software: x"),
        warc_text("request", "<q1>", b"GET / HTTP/1.0\r\n\r\n", content="application/http; msgtype=request"),
        warc_text("response", "<r1>", http + binary, concurrent=["<q1>"], content="application/http;msgtype=response"),
        warc_text("metadata", "<m1>", b"via: http://x/\r\n", "1.1", ["<q1>"], "application/warc-fields"),
        warc_text("request", "<q9>", b"", concurrent=["<gone>"]),
        warc_text("resource", "<r2>", b"", "1.1"),
        warc_text("metadata", "<m2>", b"a: b", "1.1", ["<r2>"], "application/warc-fields"),
    ]
    if packed:
        (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    else:
        (tmp_path / "x.warc").write_bytes(b"".join(records))
    found = {r.capture: r for r in warc.captures(warc.records(spark, str(tmp_path))).collect()}
    assert set(found) == {"<i>", "<r1>", "<q9>", "<r2>"}
    assert bytes(found["<r1>"].record.payload) == binary and found["<r1>"].record.http == "HTTP/1.1 200 OK\r\nServer: x"
    assert [x.id for x in found["<r1>"].requests] == ["<q1>"] and [x.id for x in found["<r1>"].metadata] == ["<m1>"]
    assert found["<q9>"].record is None and found["<i>"].others[0].type == "warcinfo" and found["<r2>"].metadata[0].id == "<m2>"


def test_broken_archives(spark, tmp_path):
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(warc_text("response", "<r>", b"0123456789" * 5)[:-30]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.records(spark, str(tmp_path / "cut.warc.gz")).count()
    (tmp_path / "odd.warc.gz").write_bytes(gzip.compress(warc_text("response", "<r>", b"0123456789") + b"rubbish"))
    with pytest.raises(Exception, match="no record"):
        warc.records(spark, str(tmp_path / "odd.warc.gz")).count()


def test_new_queries(spark, tables):
    for name in ("op11_merkle", "op12_warc", "op13_negatives"):
        assert QUERIES[name](spark, tables).count() > 0
