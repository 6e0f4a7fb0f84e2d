"""Queries of the shape search and of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import shape as H
from marketloom.operators import vectors as V
from marketloom.plans.views import nation_bars, query, read, view
from marketloom.streaming.stores import shared_dir

M, FWD, K = 20, 5, 10
WEIGHTS = H.recency_weights(M)
PART = "PARTITION BY sym ORDER BY d"
view("q", "SELECT " + ", ".join(f"list({c} ORDER BY d) AS q{c}, avg({c}) AS m{c}, stddev_pop({c}) AS s{c}" for c in H.CHANNELS) + f", arg_max(isodow(d), d) AS wd FROM (SELECT * FROM nbars WHERE sym = (SELECT min(sym) FROM nbars) ORDER BY d DESC LIMIT {M})", ("nbars",))
SNAP = "CASE WHEN stddev_pop({c}) OVER f ^ 2 < (1e-5 * abs(avg({c}) OVER f)) ^ 2 THEN 0 ELSE stddev_pop({c}) OVER f END"
view("stats", "SELECT *, " + ", ".join(f"CASE WHEN row_number() OVER w >= {M} THEN avg({c}) OVER f END AS mean_{c}, CASE WHEN row_number() OVER w >= {M} THEN {SNAP.format(c=c)} END AS std_{c}" for c in "cv") + ", row_number() OVER w AS bar_no, lead(c, 5) OVER w AS nxt, " + ", ".join(f"list({c}) OVER f AS x{c}" for c in H.CHANNELS) + f" FROM nbars WINDOW w AS ({PART}), f AS ({PART} ROWS {M - 1} PRECEDING)", ("nbars",))


def dist(c: str, s: str, weights: list[float] | None, cv: float = 0.0) -> str:
    w = f"{weights}[i]" if weights else "1.0"
    return f"CASE WHEN NOT std_{s} < greatest(1e-10, {cv} * abs(mean_{s})) THEN sqrt(list_sum(list_transform(range(1, {M + 1}), lambda i: {w} * ((q{c}[i] - m{s}) / s{s} - (x{c}[i] - mean_{s}) / nullif(std_{s}, 0)) ^ 2))) END"


view("dists", "SELECT stats.*, wd, mc, sc, " + ", ".join(f"{dist(c, 'c', WEIGHTS, 0.005 if c == 'c' else 0.0)} AS d{c}" for c in "ohlc") + f", {dist('v', 'v', WEIGHTS)} AS dv, {dist('v', 'v', None)} AS dv1, abs(mean_c) / abs(mc) AS rc, abs(mean_v) / abs(mv) AS rv FROM stats, q", ("stats", "q"))
view("top", f"""SELECT sym, d, bar_no, score, mean_c, std_c, mc, sc FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY score, d) AS r FROM (SELECT *, CASE WHEN rc >= 0.01 AND rc <= 100 AND rv >= 0.01 AND rv <= 100 THEN 0.6 * (dopen + dh + dl + dc) / 4.0 + 0.4 * dv END AS score FROM (SELECT *, "do" AS dopen FROM dists))
 WHERE score >= 0.05 AND nxt IS NOT NULL AND isodow(d) = wd) WHERE r = 1 ORDER BY score, sym LIMIT {K}""", ("dists",))
view("pool", f"SELECT t.sym, p.pos, n.c, (n.c - t.mean_c) * (t.sc / nullif(t.std_c, 0)) + t.mc AS proj_c, n.v, n.c / b.c - 1 AS ret FROM top t, (SELECT CAST(unnest(range({1 - M}, {FWD + 1})) AS INT) AS pos) p JOIN stats n ON n.sym = t.sym AND n.bar_no = t.bar_no + p.pos JOIN stats b ON b.sym = t.sym AND b.bar_no = t.bar_no", ("top", "stats"))


def base(spark, sf_dir, weighted=True):
    """Bars as a working table, as the query's own bars are read before the search, and the query."""
    where = f"{shared_dir(spark)}/bars"
    nation_bars(spark, sf_dir).write.parquet(where)
    own = spark.read.parquet(where)
    return own, H.Query.last(own.join(own.agg(F.min("sym").alias("sym")), "sym"), M, weights=WEIGHTS if weighted else None)


def matches(spark, sf_dir):
    own, q = base(spark, sf_dir)
    return own, q, H.search(own, q, K, FWD)


def pool(spark, sf_dir):
    own, q, top = matches(spark, sf_dir)
    return H.forward_returns(H.projected(H.match_bars(top, own, M, FWD), q), ["sym"])


@query("sliding_mean_std", "SELECT sym, d, round(mean_c, 6) AS mean_c, round(std_c, 6) AS std_c FROM stats", "stats")
def sliding_mean_std(spark, sf_dir):
    return H.with_stats(nation_bars(spark, sf_dir), "c", M, held="").select("sym", "d", F.round("mean_c", 6).alias("mean_c"), F.round("std_c", 6).alias("std_c"))


@query("mass_volume", "SELECT sym, d, round(dv1, 6) AS distance FROM dists", "dists")
def mass_volume(spark, sf_dir):
    own, q = base(spark, sf_dir, False)
    return H.with_stats(own, "v", M, held="v").select("sym", "d", F.round(H.distance("v", "v", q), 6).alias("distance"))


@query("mass_candle_shared", 'SELECT sym, d, round("do", 6) AS d_o, round(dh, 6) AS d_h, round(dl, 6) AS d_l, round(dc, 6) AS d_c FROM dists', "dists")
def mass_candle_shared(spark, sf_dir):
    own, q = base(spark, sf_dir)
    return H.with_stats(own, "c", M, held="ohlc").select("sym", "d", *(F.round(H.distance(c, "c", q, 0.005 if c == "c" else 0.0), 6).alias(f"d_{c}") for c in "ohlc"))


@query("shape_scale_gate", "SELECT sym, d, NOT coalesce(rc >= 1 / 1.05 AND rc <= 1.05, false) OR NOT coalesce(rv >= 1 / 1.25 AND rv <= 1.25, false) AS rejected FROM dists", "dists")
def shape_scale_gate(spark, sf_dir):
    own, q = base(spark, sf_dir)
    stats = H.with_stats(H.with_stats(own, "c", M, held=""), "v", M, held="")
    return stats.select("sym", "d", (H.scale_rejected("c", q, 1.05) | H.scale_rejected("v", q, 1.25)).alias("rejected"))


@query("shape_topk", "SELECT sym, d, bar_no, round(score, 6) AS score FROM top", "top")
def shape_topk(spark, sf_dir):
    return matches(spark, sf_dir)[2].select("sym", "d", F.col("bar_no").cast("long").alias("bar_no"), F.round("score", 6).alias("score"))


@query("shape_projection", "SELECT sym, pos, round(proj_c, 6) AS proj_c FROM pool", "pool")
def shape_projection(spark, sf_dir):
    return pool(spark, sf_dir).select("sym", "pos", F.round("proj_c", 6).alias("proj_c"))


@query("shape_bar_stats", "SELECT pos, round(avg(proj_c), 6) AS mean, round(stddev_pop(proj_c), 6) AS std, count(proj_c) AS n, round(stddev_pop(proj_c) / abs(avg(proj_c)) * 100, 6) AS cv FROM pool GROUP BY 1", "pool")
def shape_bar_stats(spark, sf_dir):
    got = H.bar_stats(pool(spark, sf_dir), "proj_c")
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "std", "cv")})


@query("shape_return_buckets", "SELECT pos, count(*) FILTER (ret >= 0.01) AS up, count(*) FILTER (ret > -0.01 AND ret < 0.01) AS flat, count(*) FILTER (ret <= -0.01) AS down FROM pool WHERE pos > 0 GROUP BY 1", "pool")
def shape_return_buckets(spark, sf_dir):
    return H.return_bands(pool(spark, sf_dir))


@query("embedding_topk", "SELECT query, vec_id, rank FROM (SELECT a.vec_id AS query, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5")
def embedding_topk(spark, sf_dir):
    own = read(spark, sf_dir, "embeddings")
    return V.nearest_vectors(own, own.where("vec_id % 100 = 0"), 5).select("query", "vec_id", "rank")


view("vpool", f"SELECT p.sym, p.pos, p.v * (q.sv / nullif(s.sv, 0)) + (q.mv - s.mv * (q.sv / nullif(s.sv, 0))) AS proj_v, q.sv / nullif(s.sv, 0) AS gain FROM pool p JOIN (SELECT sym, avg(v) AS mv, stddev_pop(v) AS sv FROM pool WHERE pos <= 0 GROUP BY 1) s ON s.sym = p.sym, q", ("pool", "q"))


@query("shape_volume_stats", f"SELECT pos, round(avg(proj_v), 6) AS mean, round(stddev_pop(proj_v), 6) AS std, any_value(CASE WHEN pos <= 0 THEN qv[pos + {M}] END) AS actual, round(avg(proj_v) - any_value(CASE WHEN pos <= 0 THEN qv[pos + {M}] END), 6) AS deviation FROM vpool, q GROUP BY 1", "vpool")
def shape_volume_stats(spark, sf_dir):
    own, q, top = matches(spark, sf_dir)
    got = H.bar_stats(H.projected(H.match_bars(top, own, M, FWD), q), "proj_v", q, "v")
    return got.select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "actual", F.round("deviation", 6).alias("deviation"))


@query("shape_scan_stats", f"SELECT (SELECT count(DISTINCT sym) FROM nbars) AS series, (SELECT count(*) FROM (SELECT sym FROM nbars GROUP BY 1 HAVING count(*) >= {M})) AS scanned, (SELECT count(*) FROM top) AS matched", "top")
def shape_scan_stats(spark, sf_dir):
    own, q = base(spark, sf_dir)
    return H.scan_stats(*H.search_observed(own, q, k=K, forward=FWD))


@query("shape_topk_indexed", "SELECT sym, d, bar_no, round(score, 6) AS score FROM top", "top")
def shape_topk_indexed(spark, sf_dir):
    """shape_topk by the lower bounds of an index of windows."""
    own, q = base(spark, sf_dir)
    where = f"{shared_dir(spark)}/index"
    H.window_index(own, M).write.parquet(where)
    found, _ = H.search_indexed(own, spark.read.parquet(where), q, K, FWD)
    return found.select("sym", "d", F.col("bar_no").cast("long").alias("bar_no"), F.round("score", 6).alias("score"))
