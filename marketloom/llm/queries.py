"""Queries op1 to op13 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import caps, katz, licenses, merkle, negatives, packing, quality, sentencepieces, simhash, suffix_arrays, suffix_trees, toxicity, warc
from marketloom.llm.common import bucket_of, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~bucket_of("doc_id", 2, 4))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", bucket_of("doc_id", 2, 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), ["doc_id"], digest=True)


@query
def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.repeated_bytes(read(spark, sf_dir, "documents"))


ORACLE["op3_suffix_arrays"] = """WITH b AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS x FROM documents),
 w AS (SELECT r, i, md5(x[i:i + 399]) AS h FROM (SELECT r, x, unnest(range(1, CAST(octet_length(x) AS BIGINT) - 398)) AS i FROM b WHERE octet_length(x) >= 400)),
 hit AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1)),
 runs AS (SELECT r, min(i) AS a, max(i) + 399 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i - 400 <= lag(i) OVER (PARTITION BY r ORDER BY i) THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY r, g),
 gaps AS (SELECT r, a, z, lag(z) OVER (PARTITION BY r ORDER BY a) AS before FROM runs),
 kept AS (SELECT b.r, count(*) AS n, sum(z - a + 1) AS gone, string_agg(hex(x[coalesce(before, 0) + 1:a - 1]), '' ORDER BY a) || hex(any_value(x)[max(z) + 1:]) AS k FROM gaps JOIN b ON gaps.r = b.r GROUP BY b.r)
 SELECT doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN n IS NULL THEN x ELSE unhex(k) END) AS kept_sha256 FROM b LEFT JOIN kept ON b.r = kept.r"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return found.withColumn("length", F.col("length").cast("long"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


@query
def op10_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.repeated_words(read(spark, sf_dir, "documents"))


@query
def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read(spark, sf_dir, "documents"), bucket_of("doc_id", 2, 7))


@query
def op7_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of a document is source/lang/doc_id, - for a null."""
    path = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("source", "lang", "doc_id")))
    return licenses.licenses(read(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")), "doc_id")


ORACLE["op10_suffix_trees"] = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 w AS (SELECT doc_id, r, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM (SELECT doc_id, r, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
 hit AS (SELECT r, i FROM w JOIN (SELECT h, min(doc_id) AS least FROM w GROUP BY 1) USING (h) WHERE doc_id > least),
 gone AS (SELECT DISTINCT r, i + k AS p FROM hit, range(50) t(k)),
 kept AS (SELECT x.r, count(gone.p) AS n, string_agg(x.word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL) AS k FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) x LEFT JOIN gone ON gone.r = x.r AND gone.p = x.p GROUP BY x.r)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r"""


@query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0)


ORACLE["op13_negatives"] = """WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.r <> b.r),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
 SELECT * FROM n WHERE rank <= 3"""


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changes = {"n_chars": F.when(F.coalesce(hit, F.lit(False)), F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return merkle.manifest(read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], changes=changes)


FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
LEAF = lambda n_chars: "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"
CRC32 = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT)] || range(7)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
UP = "list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"
STEP = "CASE WHEN (p >> level) & 1 = 1 THEN l[(p >> level)] || '|' ELSE '|' || coalesce(l[(p >> level) + 2], '') END"
ORACLE["op11_merkle"] = f"""WITH RECURSIVE e AS (SELECT doc_id, lang, {LEAF('n_chars')} AS leaf, CASE WHEN coalesce({CRC32} % 7 = 0, false) THEN {LEAF('(n_chars + 1)')} END AS changed FROM documents),
 n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM e),
 levels AS (SELECT lang, 0 AS level, list(leaf ORDER BY p) AS l FROM n GROUP BY lang UNION ALL SELECT lang, level + 1, {UP} FROM levels WHERE len(l) > 1),
 subroots AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p FROM levels WHERE len(l) = 1),
 tops AS (SELECT 0 AS level, list(subroot ORDER BY p) AS l FROM subroots UNION ALL SELECT level + 1, {UP} FROM tops WHERE len(l) > 1),
 above AS (SELECT p, list({STEP} ORDER BY level) AS steps FROM subroots, tops WHERE len(l) > 1 GROUP BY p),
 inside AS (SELECT n.lang, n.p, list({STEP} ORDER BY level) AS steps FROM n JOIN levels ON n.lang IS NOT DISTINCT FROM levels.lang WHERE len(l) > 1 GROUP BY 1, 2),
 w AS (SELECT n.doc_id, n.leaf, n.changed, s.subroot, list_concat(coalesce(i.steps, []), coalesce(a.steps, [])) AS steps FROM n JOIN subroots s ON n.lang IS NOT DISTINCT FROM s.lang LEFT JOIN inside i ON n.lang IS NOT DISTINCT FROM i.lang AND n.p = i.p LEFT JOIN above a ON a.p = s.p),
 f AS (SELECT *, (SELECT l[1] FROM tops WHERE len(l) = 1) AS root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
  list_reduce(list_concat([coalesce(changed, leaf)], steps), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root FROM w)
 SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), least=0)


DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ORACLE["op12_warc"] = f"""WITH p AS (SELECT page_id, row_number() OVER () AS r, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS s FROM pages),
 f AS (SELECT *, first_value(r) OVER w AS first_row, first_value(page_id) OVER w AS first_id FROM p WINDOW w AS (PARTITION BY x ORDER BY page_id NULLS LAST, r))
 SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda n: substr({DIGITS}, CAST(((CAST('0x' || substr(s, CAST(5 * i + 1 AS INT), 5) AS BIGINT) >> n) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN r = first_row THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> first_row THEN first_id END AS refers_to FROM f"""
