"""Popularity, clustered index and samplers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codebook as C
from ..operators import negatives as N
from .inputs import VECTORS, query_vectors, uniform_sql, vectors
from .retrieval import CDF, frequencies

K = 8
DRAWS = 5


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


def w12_popularity_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frequencies(spark, sf_dir)
    out = None
    for mode in (0, 1, 2):
        part = N.popularity_cdf(f, mode).select("item_id", F.lit(mode).alias("mode"), "prob", "cdf")
        out = part if out is None else out.unionByName(part)
    return _rounded(out, "prob", "cdf", digits=9)


def n1_sample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return N.sample_uniform(query_vectors(spark, sf_dir), v.count(), DRAWS)


def n2_sample_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    cdf = N.popularity_cdf(frequencies(spark, sf_dir), 2)
    return _rounded(N.sample_popular(query_vectors(spark, sf_dir), cdf, DRAWS), "log_q")


def fixed_centers(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the first K vectors, so that codes can be told in SQL."""
    rows = vectors(spark, sf_dir).where(F.col("item_id") <= K).orderBy("item_id").collect()
    x = np.array([r["vec"] for r in rows], float)
    half = -(-x.shape[1] // 2)
    return x[:, :half], x[:, half:]


#: Rounds of the loops, all of them told in SQL; a negative tolerance lets none stop before.
ROUNDS, HALF_ROUNDS, SEED_ROUNDS = 20, 10, 3


def n3_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters after ROUNDS rounds from seeded rows, and their loss."""
    v = vectors(spark, sf_dir)
    _, found, loss = C.kmeans(v, 10, max_iter=ROUNDS, tol=-1.0)
    return found.withColumn("loss", F.lit(round(loss, 4)))


def n3_bounded_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As n3_kmeans, with rows that keep distance bounds from round to round."""
    _, found, loss = C.kmeans(vectors(spark, sf_dir), 10, max_iter=ROUNDS, tol=-1.0, bounds=True)
    return found.withColumn("loss", F.lit(round(loss, 4)))


def n3_parallel_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate centers drawn by distance in SEED_ROUNDS rounds, and how many vectors are nearest to each."""
    ids, _, drawn, weights = C.parallel_seeds(vectors(spark, sf_dir), 10, SEED_ROUNDS)
    rows = [(int(i), int(n), int(w)) for i, n, w in zip(ids, drawn, weights, strict=True)]
    return spark.createDataFrame(rows, "item_id long, round int, weight long")


def n3_kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and sizes of one round from the first K vectors' first halves."""
    c0, _ = fixed_centers(spark, sf_dir)
    parts = C.halves(vectors(spark, sf_dir)).select("item_id", F.col("v0").alias("vec"))
    sums = C._partial_sums(parts, c0)
    n = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.round(F.sum("loss"), 4).alias("loss"))
    return sums.select("cluster", "dim", F.round("s", 4).alias("s")).join(n, "cluster").where("n > 0")


def _codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    c0, c1 = fixed_centers(spark, sf_dir)
    return C.assign_codes(vectors(spark, sf_dir), c0, c1), c0, c1


def _weighted(spark: SparkSession, sf_dir: str, mode: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    codes, c0, c1 = _codes(spark, sf_dir)
    v = vectors(spark, sf_dir)
    freq = v.select("item_id", F.log(F.col("label") + 2.0).alias("weight"))
    return C.item_weights(codes, mode, freq, v), c0, c1


def n4_build_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by clusters of both halves after HALF_ROUNDS rounds."""
    _, _, codes = C.build_codebooks(vectors(spark, sf_dir), K, max_iter=HALF_ROUNDS, tol=-1.0)
    return codes


def n5_build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _, _ = _codes(spark, sf_dir)
    return C.build_index(codes, K).select("item_id", "k0", "k1", F.col("pos").cast("long").alias("pos"), "start")


def n6_joint_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for mode in ("count", "pop", "norm", "pop*norm"):
        part = C.joint_weights(_weighted(spark, sf_dir, mode)[0]).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return _rounded(out, "weight")


def w13_cluster_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.cluster_cdf(_weighted(spark, sf_dir, "pop")[0]).select("item_id", "k0", "k1", "lo", "cdf"), "lo", "cdf", digits=9)


def n7_sample_index_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, c0, c1 = _codes(spark, sf_dir)
    return _rounded(N.sample_index_uniform(query_vectors(spark, sf_dir), C.build_index(codes, K), c0, c1, 50), "log_q")


def n8_sample_index_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, c0, c1 = _weighted(spark, sf_dir, "pop")
    return _rounded(N.sample_index_weighted(query_vectors(spark, sf_dir), C.cluster_cdf(w), c0, c1, 50), "log_q")


def n9_index_log_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, c0, c1 = _weighted(spark, sf_dir, "pop")
    q = query_vectors(spark, sf_dir)
    near = q.select("query_id", F.explode(F.array(F.lit(0).cast("long"), F.col("query_id"), F.col("query_id") + 1, F.col("query_id") + 2)).alias("item_id")).where(F.col("item_id") <= q.count())
    plain = N.index_log_q(q, near, w, c0, c1).withColumn("form", F.lit("even"))
    return _rounded(plain.unionByName(N.index_log_q(q, near, w, c0, c1, weighted=True).withColumn("form", F.lit("weighted"))), "log_q")


def n10_index_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, c0, c1 = _weighted(spark, sf_dir, "pop")
    return _rounded(N.index_proposal(query_vectors(spark, sf_dir), w, c0, c1), "prob", digits=9)


def n10_asked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proposal's probabilities of each query's two next items only."""
    w, c0, c1 = _weighted(spark, sf_dir, "pop")
    q = query_vectors(spark, sf_dir)
    near = q.select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") + 2)).alias("item_id"))
    return _rounded(N.index_proposal(q, w, c0, c1, near), "prob", digits=9)


def n11_sample_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(N.sample_sphere(query_vectors(spark, sf_dir), vectors(spark, sf_dir), DRAWS), "log_q")


def n12_rff_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = N.rff_features(vectors(spark, sf_dir).select("item_id", "vec"))
    return v.select("item_id", F.size("vec").alias("width"), F.transform("vec", lambda x: F.round(x, 6) + 0.0).alias("vec"))


def n13_sample_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(N.sample_rff(query_vectors(spark, sf_dir), vectors(spark, sf_dir), DRAWS), "log_q", digits=5)


def n14_sample_sphere_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return _rounded(N.sample_sphere_approx(query_vectors(spark, sf_dir), v, v.count(), DRAWS), "log_q")


def n15_sample_rff_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return _rounded(N.sample_rff_approx(query_vectors(spark, sf_dir), v, v.count(), DRAWS), "log_q", digits=5)


def n16_sample_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return N.sample_hard(query_vectors(spark, sf_dir), v, v.count(), DRAWS)


def n17_sample_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return N.sample_resampled(query_vectors(spark, sf_dir), v, v.count(), DRAWS)


def n2_positive_log_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-weights of each query's two next items under the proposals, those of the exact kernel with its correction."""
    q, v = query_vectors(spark, sf_dir), vectors(spark, sf_dir)
    near = q.select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") + 2)).alias("item_id")).join(v.select("item_id"), "item_id", "left_semi")
    cdf = N.popularity_cdf(frequencies(spark, sf_dir), 2)
    parts = [N.positive_log_q(near, "uniform"), N.positive_log_q(near, "popular", cdf), N.positive_log_q(near, "hard"), N.positive_log_q(near, "sphere", queries=q, items=v, n=DRAWS, correct_pos=True)]
    out = None
    for form, part in zip(("uniform", "popular", "hard", "sphere"), parts, strict=True):
        part = part.select("query_id", "item_id", "log_q", F.lit(form).alias("form"))
        out = part if out is None else out.unionByName(part)
    return _rounded(out, "log_q")


QUERIES = {f.__name__: f for f in (w12_popularity_cdf, n1_sample_uniform, n2_sample_popular, n2_positive_log_q, n3_kmeans, n3_bounded_kmeans, n3_parallel_seeds, n3_kmeans_step, n4_build_codebooks, n5_build_index, n6_joint_weights, w13_cluster_cdf, n7_sample_index_uniform, n8_sample_index_weighted, n9_index_log_q, n10_index_proposal, n10_asked_pairs, n11_sample_sphere, n12_rff_features, n13_sample_rff, n14_sample_sphere_approx, n15_sample_rff_approx, n16_sample_hard, n17_sample_resampled)}

_DIST = lambda a, b: f"(list_dot_product({a}, {a}) + list_dot_product({b}, {b}) - 2 * list_dot_product({a}, {b}))"
CODES = f"""{VECTORS}, hv AS (SELECT item_id, label, vec, vec[1:32] AS v0, vec[33:64] AS v1 FROM vecs), ce AS (SELECT (item_id - 1)::int AS k, v0 AS c0, v1 AS c1 FROM hv WHERE item_id <= 8),
ds AS (SELECT item_id, k, {_DIST("v0", "c0")} AS d0, {_DIST("v1", "c1")} AS d1 FROM hv CROSS JOIN ce),
co AS (SELECT item_id, arg_min(k, (d0, k)) AS k0, arg_min(k, (d1, k)) AS k1 FROM ds GROUP BY 1),
wt AS (SELECT co.*, label, 1.0::double AS w_count, ln(label + 2.0::double) AS w_pop, exp(-0.5::double * list_dot_product(vec, vec)) AS w_norm FROM co JOIN vecs USING (item_id))"""
_PS = "ps AS (SELECT query_id, a.k AS k0, b.k AS k1, list_dot_product(q.vec[1:32], a.c0) + list_dot_product(q.vec[33:64], b.c1) AS s FROM qs q CROSS JOIN ce a CROSS JOIN ce b)"
_N = "(SELECT count(*) FROM vecs)"
UNI = lambda n: f"un AS (SELECT query_id, q.vec AS qv, draw::int AS draw, (floor({uniform_sql(42, 'uniform', 'query_id::varchar', 'draw::varchar')} * {_N}) + 1)::bigint AS item_id FROM qs q, range(1, {n + 1}) t(draw)), us AS (SELECT un.*, list_dot_product(qv, v.vec) AS score FROM un JOIN vecs v USING (item_id))"

_PICK = lambda stage: f"""dr AS (SELECT query_id, draw::int AS draw, {uniform_sql(42, stage + '0', 'query_id::varchar', 'draw::varchar')} AS u0, {uniform_sql(42, stage + '1', 'query_id::varchar', 'draw::varchar')} AS u1, {uniform_sql(42, stage + '2', 'query_id::varchar', 'draw::varchar')} AS u2 FROM qs, range(1, 51) t(draw)),
pr AS (SELECT query_id, k0, k1, s, w * exp(s - max(s) OVER (PARTITION BY query_id)) AS p FROM ps JOIN jw USING (k0, k1)),
f0 AS (SELECT query_id, k0, sum(p) AS p FROM pr GROUP BY ALL), g0 AS (SELECT query_id, k0, sum(p) OVER (PARTITION BY query_id ORDER BY k0) AS hi, sum(p) OVER (PARTITION BY query_id) AS t FROM f0),
a0 AS (SELECT dr.query_id, draw, u1, u2, min(k0) AS k0 FROM dr JOIN g0 USING (query_id) WHERE hi > u0 * t GROUP BY ALL),
g1 AS (SELECT query_id, k0, k1, s, sum(p) OVER (PARTITION BY query_id, k0 ORDER BY k1) AS hi, sum(p) OVER (PARTITION BY query_id, k0) AS t FROM pr),
a1 AS (SELECT query_id, draw, u2, k0, min((k1, s)) AS x FROM a0 JOIN g1 USING (query_id, k0) WHERE hi > u1 * t GROUP BY ALL),
dp AS (SELECT query_id, draw, u2, k0, x[1] AS k1, x[2] AS s FROM a1)"""  # noqa: E731
_KERNEL = lambda stage, weight, digits: f"""kw AS (SELECT query_id, v.item_id, {weight} AS w FROM fq q CROSS JOIN fv v), kc AS (SELECT query_id, item_id, w, sum(w) OVER (PARTITION BY query_id ORDER BY item_id) AS hi, sum(w) OVER (PARTITION BY query_id) AS z FROM kw),
dr AS (SELECT query_id, draw::int AS draw, {uniform_sql(42, stage, 'query_id::varchar', 'draw::varchar')} AS u FROM qs, range(1, 6) t(draw)),
hit AS (SELECT dr.query_id, draw, min((kc.item_id, kc.w, kc.z)) AS x FROM dr JOIN kc USING (query_id) WHERE hi > u * z GROUP BY ALL)
SELECT query_id, draw, x[1] AS item_id, round(ln(5 * x[2] / x[3]), {digits}) AS log_q FROM hit"""  # noqa: E731


def _fourier(scale: float) -> str:
    """Features of all vectors by the W that the operator draws, as a table fv; fq has those of the queries."""
    w = np.random.default_rng([42, 64]).normal(0, 1 / np.sqrt(scale), (64, 32))
    rows = ", ".join("(" + "[" + ", ".join(f"{float(x)!r}::double" for x in w[:, j]) + f"], {j})" for j in range(32))
    return f"""ww(w, j) AS (VALUES {rows}), pj AS (SELECT item_id, j, list_dot_product(vec, w) / sqrt(list_dot_product(vec, vec)) AS x FROM vecs CROSS JOIN ww),
fv AS (SELECT item_id, list_concat(list(cos(x) / sqrt(32) ORDER BY j), list(sin(x) / sqrt(32) ORDER BY j)) AS f FROM pj GROUP BY 1), fq AS (SELECT item_id AS query_id, f FROM fv)"""


_W4, _W5 = _fourier(4.0), _fourier(5.0)



def _rounds(source: str, k: int, seed: int, name: str, rounds: int) -> str:
    """Tables of Lloyd's rounds over source (item_id, vec): {name}_c0.. the centers, {name}_a the assignment to the last."""
    parts = [f"{name}_c0 AS (SELECT (row_number() OVER (ORDER BY item_id) - 1)::int AS k, vec AS c FROM (SELECT item_id, vec FROM {source} ORDER BY {uniform_sql(seed, 'centers', 'item_id::varchar')}, item_id LIMIT {k}))"]
    near = lambda r: f"SELECT item_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT item_id, k, {_DIST('vec', 'c')} AS d FROM {source} CROSS JOIN {name}_c{r}) GROUP BY 1"
    for r in range(rounds):
        parts.append(f"{name}_n{r} AS MATERIALIZED ({near(r)})")
        means = f"SELECT k, i, avg(x) AS x FROM (SELECT n.k, unnest(range(0, len(vec))) AS i, unnest(vec) AS x FROM {name}_n{r} n JOIN {source} USING (item_id)) GROUP BY ALL"
        parts.append(f"{name}_c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM {name}_c{r} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM ({means}) GROUP BY k) m USING (k))")
    parts.append(f"{name}_a AS MATERIALIZED ({near(rounds)})")
    return ", ".join(parts)


def _seed_rounds(k: int, seed: int, rounds: int) -> str:
    """Tables s0 to s<rounds> of the candidates so far, each drawn by the distances to those before."""
    parts = [f"s0 AS (SELECT item_id, vec, 0 AS round FROM (SELECT item_id, vec FROM vecs ORDER BY {uniform_sql(seed, 'seed0', 'item_id::varchar')}, item_id LIMIT 1))"]
    for n in range(1, rounds + 1):
        parts.append(f"n{n} AS (SELECT v.item_id, v.vec, min(list_distance(v.vec, s.vec) ** 2) AS d FROM vecs v CROSS JOIN s{n - 1} s GROUP BY v.item_id, v.vec)")
        parts.append(f"s{n} AS (SELECT * FROM s{n - 1} UNION ALL SELECT item_id, vec, {n} FROM n{n} WHERE {uniform_sql(seed, f'seed{n}', 'item_id::varchar')} * (SELECT sum(d) FROM n{n}) < {2.0 * k} * d)")
    return ", ".join(parts)


ORACLE_SQL = {
    "n3_parallel_seeds": f"WITH {VECTORS}, {_seed_rounds(10, 42, SEED_ROUNDS)}, ow AS (SELECT v.item_id AS v, arg_min(s.item_id, (list_distance(v.vec, s.vec), s.item_id)) AS item_id FROM vecs v CROSS JOIN s{SEED_ROUNDS} s GROUP BY 1) SELECT s.item_id, s.round::int AS round, count(ow.v) AS weight FROM s{SEED_ROUNDS} s LEFT JOIN ow USING (item_id) GROUP BY ALL",
    "n3_kmeans": f"WITH {VECTORS}, {_rounds('vecs', 10, 42, 'km', ROUNDS)} SELECT item_id, k AS cluster, (SELECT round(sum(greatest(d, 0.0)), 4) FROM km_a) AS loss FROM km_a",
    "n4_build_codebooks": f"WITH {VECTORS}, ha AS (SELECT item_id, vec[1:32] AS vec FROM vecs), hb AS (SELECT item_id, vec[33:64] AS vec FROM vecs), {_rounds('ha', K, 42, 'ka', HALF_ROUNDS)}, {_rounds('hb', K, 43, 'kb', HALF_ROUNDS)} SELECT item_id, ka_a.k AS k0, kb_a.k AS k1 FROM ka_a JOIN kb_a USING (item_id)",
    "n2_positive_log_q": f"WITH {VECTORS}, {CDF}, nr AS (SELECT query_id, unnest([query_id + 1, query_id + 2]) AS item_id FROM qs), ne AS (SELECT nr.* FROM nr JOIN vecs USING (item_id)), kw AS (SELECT query_id, v.item_id, 100.0::double * list_dot_product(q.vec, v.vec) * list_dot_product(q.vec, v.vec) + 1 AS w FROM qs q CROSS JOIN vecs v), kz AS (SELECT *, sum(w) OVER (PARTITION BY query_id) AS z FROM kw) SELECT query_id, item_id, 1.0::double AS log_q, 'uniform' AS form FROM ne UNION ALL SELECT query_id, item_id, 0.0, 'hard' FROM ne UNION ALL SELECT ne.query_id, ne.item_id, coalesce(round(ln(prob), 6), 0.0), 'popular' FROM ne LEFT JOIN pc ON pc.item_id = ne.item_id UNION ALL SELECT query_id, item_id, round(ln(5 * w / z), 6), 'sphere' FROM ne JOIN kz USING (query_id, item_id)",
    "n7_sample_index_uniform": f"WITH {CODES}, {_PS}, jw AS (SELECT k0, k1, count(*) AS w FROM co GROUP BY ALL), {_PICK('index')}, ix AS (SELECT item_id, k0, k1, row_number() OVER (PARTITION BY k0, k1 ORDER BY item_id) - 1 AS pos FROM co) SELECT query_id, draw, item_id, round(s, 6) AS log_q FROM dp JOIN jw USING (k0, k1) JOIN ix ON ix.k0 = dp.k0 AND ix.k1 = dp.k1 AND ix.pos = floor(u2 * w)",
    "n8_sample_index_weighted": f"WITH {CODES}, {_PS}, jw AS (SELECT k0, k1, sum(w_pop) AS w FROM wt GROUP BY ALL), {_PICK('weighted')}, ix AS (SELECT item_id, k0, k1, w_pop, sum(w_pop) OVER (PARTITION BY k0, k1 ORDER BY item_id) / sum(w_pop) OVER (PARTITION BY k0, k1) AS hi FROM wt), hit AS (SELECT query_id, draw, s, min((ix.item_id, w_pop)) AS x FROM dp JOIN ix USING (k0, k1) WHERE hi >= u2 GROUP BY ALL) SELECT query_id, draw, x[1] AS item_id, round(s + ln(x[2]), 6) AS log_q FROM hit",
    "n11_sample_sphere": f"WITH {VECTORS}, fq AS (SELECT query_id, vec AS f FROM qs), fv AS (SELECT item_id, vec AS f FROM vecs), {_KERNEL('sphere', '100.0::double * list_dot_product(q.f, v.f) * list_dot_product(q.f, v.f) + 1', 6)}",
    "n13_sample_rff": f"WITH {VECTORS}, {_W4}, {_KERNEL('rff', 'greatest(list_dot_product(q.f, v.f), 1e-8::double)', 5)}",
    "n15_sample_rff_approx": f"WITH {VECTORS}, {_W5}, {UNI(5)} SELECT un.query_id, draw, un.item_id, round(ln(greatest(list_dot_product(a.f, b.f), 1e-8::double)), 5) AS log_q FROM un JOIN fq a ON a.query_id = un.query_id JOIN fv b ON b.item_id = un.item_id",
    "w12_popularity_cdf": f"WITH {CDF}, m AS (SELECT item_id, 0 AS mode, w0 AS w FROM pw UNION ALL SELECT item_id, 1, w1 FROM pw UNION ALL SELECT item_id, 2, w2 FROM pw) SELECT item_id, mode, round(w / sum(w) OVER (PARTITION BY mode), 9) AS prob, round(sum(w) OVER (PARTITION BY mode ORDER BY item_id) / sum(w) OVER (PARTITION BY mode), 9) AS cdf FROM m",
    "n1_sample_uniform": f"WITH {VECTORS}, {UNI(5)} SELECT query_id, draw, item_id, 1.0::double AS log_q FROM un",
    "n2_sample_popular": f"WITH {VECTORS}, {CDF}, dr AS (SELECT query_id, draw::int AS draw, {uniform_sql(42, 'popular', 'query_id::varchar', 'draw::varchar')} AS u FROM qs, range(1, 6) t(draw)) SELECT query_id, draw, pc.item_id, round(ln(prob), 6) AS log_q FROM dr ASOF JOIN pc ON dr.u <= pc.cdf",
    "n3_kmeans_step": f"WITH {CODES}, e AS (SELECT k0 AS cluster, unnest(range(0, 32))::int AS dim, unnest(v0) AS x FROM co JOIN hv USING (item_id)), s AS (SELECT cluster, dim, round(sum(x), 4) AS s FROM e GROUP BY ALL), n AS (SELECT k0 AS cluster, count(*) AS n, round(sum(d0), 4) AS loss FROM co JOIN ds ON ds.item_id = co.item_id AND ds.k = co.k0 GROUP BY 1) SELECT cluster, dim, s, n::bigint AS n, loss FROM s JOIN n USING (cluster)",
    "n5_build_index": f"WITH {CODES}, z AS (SELECT k0, k1, count(*) AS n FROM co GROUP BY ALL), st AS (SELECT k0, k1, (sum(n) OVER (ORDER BY k0, k1) - n)::bigint AS start FROM z) SELECT item_id, k0, k1, row_number() OVER (PARTITION BY k0, k1 ORDER BY item_id) - 1 AS pos, start FROM co JOIN st USING (k0, k1)",
    "n6_joint_weights": f"WITH {CODES} " + " UNION ALL ".join(f"SELECT k0, k1, count(*) AS n, round(sum({w}), 6) AS weight, '{m}' AS mode FROM wt GROUP BY k0, k1" for m, w in (("count", "w_count"), ("pop", "w_pop"), ("norm", "w_norm"), ("pop*norm", "w_pop * w_norm"))),
    "w13_cluster_cdf": f"WITH {CODES}, c AS (SELECT item_id, k0, k1, w_pop, sum(w_pop) OVER (PARTITION BY k0, k1 ORDER BY item_id) AS r, sum(w_pop) OVER (PARTITION BY k0, k1) AS t FROM wt) SELECT item_id, k0, k1, round((r - w_pop) / t, 9) AS lo, round(r / t, 9) AS cdf FROM c",
    "n9_index_log_q": f"WITH {CODES}, {_PS}, nr AS (SELECT query_id, unnest([query_id, query_id + 1, query_id + 2]) AS item_id FROM qs), b AS (SELECT nr.query_id, nr.item_id, s, w_pop FROM nr JOIN wt USING (item_id) JOIN ps ON ps.query_id = nr.query_id AND ps.k0 = wt.k0 AND ps.k1 = wt.k1) SELECT query_id, item_id, round(s, 6) AS log_q, 'even' AS form FROM b UNION ALL SELECT query_id, item_id, round(s + ln(w_pop), 6), 'weighted' FROM b UNION ALL SELECT query_id, 0, 0.0, unnest(['even', 'weighted']) FROM qs",
    "n10_index_proposal": f"WITH {CODES}, {_PS}, e AS (SELECT query_id, item_id, w_pop * exp(s) AS x FROM ps JOIN wt USING (k0, k1)) SELECT query_id, item_id, round(x / sum(x) OVER (PARTITION BY query_id), 9) AS prob FROM e",
    "n10_asked_pairs": f"WITH {CODES}, {_PS}, e AS (SELECT query_id, item_id, w_pop * exp(s) AS x FROM ps JOIN wt USING (k0, k1)), p AS (SELECT query_id, item_id, round(x / sum(x) OVER (PARTITION BY query_id), 9) AS prob FROM e) SELECT * FROM p WHERE item_id - query_id IN (1, 2)",
    "n12_rff_features": f"WITH {VECTORS}, {_W4} SELECT item_id, len(f)::int AS width, list_transform(f, lambda x: round(x, 6) + 0.0::double) AS vec FROM fv",
    "n14_sample_sphere_approx": f"WITH {VECTORS}, {UNI(5)} SELECT query_id, draw, item_id, round(ln(100.0::double * score * score + 1), 6) AS log_q FROM us",
    "n16_sample_hard": f"WITH {VECTORS}, {UNI(10)}, r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, draw)::int AS draw, item_id FROM us) SELECT query_id, draw, item_id, 0.0::double AS log_q FROM r WHERE draw <= 5",
    "n17_sample_resampled": f"WITH {VECTORS}, {UNI(10)}, h AS (SELECT query_id, draw, item_id, sum(exp(score)) OVER (PARTITION BY query_id ORDER BY draw) / sum(exp(score)) OVER (PARTITION BY query_id) AS hi FROM us), dr AS (SELECT query_id, d::int AS draw, {uniform_sql(42, 'resample', 'query_id::varchar', 'd::varchar')} AS u FROM qs, range(1, 6) t(d)) SELECT dr.query_id, dr.draw, h.item_id, 0.0::double AS log_q FROM dr ASOF JOIN h ON dr.query_id = h.query_id AND dr.u < h.hi",
}
ORACLE_SQL["n3_bounded_kmeans"] = ORACLE_SQL["n3_kmeans"]
