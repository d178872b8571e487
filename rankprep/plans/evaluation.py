"""Losses and metrics over scores of the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import losses as L
from ..operators import metrics as M
from ..operators import negatives as N
from ..operators import retrieval as R
from .inputs import VECTORS, query_vectors, vectors
from .retrieval import TOP, _SC, targets
from .sampling import UNI


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


def _positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, item_id, score): the vector after each query's."""
    q = query_vectors(spark, sf_dir)
    pairs = q.select("query_id", (F.col("query_id") + 1).alias("item_id"))
    return N.candidate_scores(pairs, q, vectors(spark, sf_dir)).select(F.col("query_id").alias("row_id"), "item_id", "score")


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = query_vectors(spark, sf_dir), vectors(spark, sf_dir)
    drawn = N.sample_sphere_approx(q, v, v.count(), 5)
    neg = N.candidate_scores(drawn, q, v).select(F.col("query_id").alias("row_id"), F.lit("neg").alias("kind"), "item_id", "score", "log_q")
    pos = _positives(spark, sf_dir).select("row_id", F.lit("pos").alias("kind"), "item_id", "score", F.lit(0.0).alias("log_q"))
    return pos.unionByName(neg)


def l1_full_softmax_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(L.full_softmax_loss(query_vectors(spark, sf_dir), vectors(spark, sf_dir), _positives(spark, sf_dir)))


def l2_sampled_softmax_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(L.sampled_softmax_loss(score_table(spark, sf_dir)))


def _both(spark: SparkSession, sf_dir: str, loss, gamma: float) -> DataFrame:
    s = score_table(spark, sf_dir)
    return _round(loss(s, gamma, True).withColumnRenamed("loss", "weighted")).join(_round(loss(s, gamma, False).withColumnRenamed("loss", "even"))).join(_round(loss(s, gamma, True, sqrt=True).withColumnRenamed("loss", "rooted")))


def l3_margin_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, L.margin_loss, 2.0)


def l4_pairwise_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, L.pairwise_log_loss, 0.5)


def l5_rotate_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score_table(spark, sf_dir)
    return _round(L.rotate_loss(s, 3.0).withColumnRenamed("loss", "weighted")).join(_round(L.rotate_loss(s, 3.0, legacy=True).withColumnRenamed("loss", "legacy"))).join(_round(L.rotate_loss(s, 3.0, sqrt=True).withColumnRenamed("loss", "rooted")))


def m1_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_vectors(spark, sf_dir).withColumn("target", F.col("query_id") + 1)
    return _round(M.rank_metrics(R.target_rank(q, vectors(spark, sf_dir))))


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    told = targets(spark, sf_dir)
    return R.mark_group_hits(R.top_k(query_vectors(spark, sf_dir), vectors(spark, sf_dir), 50), *told), R.group_targets(*told)


def m2_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.precision_at_k(*_marked(spark, sf_dir)))


def m3_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.recall_at_k(*_marked(spark, sf_dir)))


def m4_ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.ndcg_at_k(*_marked(spark, sf_dir)))


def _nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.full_softmax_nll(query_vectors(spark, sf_dir), vectors(spark, sf_dir), _positives(spark, sf_dir)).withColumnRenamed("row_id", "query_id").withColumn("batch", F.col("query_id") % 7)


def m5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of tokens, which are the queries here, in sequences of ever more of them; and of batches of sequences, in which tokens of
    long sequences count less."""
    nll = _nll(spark, sf_dir).withColumn("query_id", F.floor(F.sqrt("query_id"))).withColumn("batch", F.col("query_id") % 7 % 3)
    return _round(M.perplexity(nll)).join(_round(M.perplexity(nll, "batch").withColumnRenamed("perplexity", "by_batch")))


def m6_combine_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _nll(spark, sf_dir).groupBy("batch").agg(F.avg("nll").alias("nll"), F.max("nll").alias("worst"), F.count("*").alias("n"))
    return _round(M.combine_batches(per, ["nll", "worst"]))


QUERIES = {f.__name__: f for f in (l1_full_softmax_loss, l2_sampled_softmax_loss, l3_margin_loss, l4_pairwise_log_loss, l5_rotate_loss, m1_rank_metrics, m2_precision_at_k, m3_recall_at_k, m4_ndcg_at_k, m5_perplexity, m6_combine_batches)}

_POS = "po AS (SELECT query_id, score AS p FROM sc WHERE item_id = query_id + 1)"
_NLL = f"{_SC}, {_POS}, z AS (SELECT query_id, ln(sum(exp(score))) AS lse FROM sc GROUP BY 1), nl AS (SELECT query_id, lse - p AS nll, query_id % 7 AS batch FROM z JOIN po USING (query_id))"
_NEG = f"{_SC}, {_POS}, {UNI(5)}, ng AS (SELECT query_id, score AS s, ln(100.0::double * score * score + 1) AS lq FROM us), w AS (SELECT query_id, s, lq, exp(s - lq) / sum(exp(s - lq)) OVER (PARTITION BY query_id) AS w, 1.0::double / count(*) OVER (PARTITION BY query_id) AS e FROM ng)"
_SP = lambda x: f"ln(1 + exp({x}))"
_ROOT = lambda x: f"-sqrt(greatest(-({x}), 0.0::double))"
_PAIR = lambda term: f"{_NEG}, t AS (SELECT query_id, sum(w * {term.format(p='p', s='s')}) AS a, sum(e * {term.format(p='p', s='s')}) AS b, sum(w * {term.format(p=_ROOT('p'), s='(' + _ROOT('s') + ')')}) AS c FROM w JOIN po USING (query_id) GROUP BY 1) SELECT round(avg(a), 6) AS weighted, round(avg(b), 6) AS even, round(avg(c), 6) AS rooted FROM t"
_MARK = f"{_SC}, {TOP}, n AS (SELECT query_id, count(*) AS n FROM sc WHERE ql = vl AND item_id <> query_id GROUP BY 1), h AS (SELECT query_id, rank, (ql = vl AND item_id <> query_id)::int AS hit FROM tk WHERE rank <= 50)"


def _at(ks: tuple[int, ...], expr: str, name: str) -> str:
    per = ", ".join(f"{expr.format(k=k)} AS x_{k}" for k in ks)
    return f"{_MARK}, g AS (SELECT query_id, n, {per} FROM n LEFT JOIN h USING (query_id) GROUP BY query_id, n) SELECT " + ", ".join(f"round(avg(x_{k}), 6) AS {name}_{k}" for k in ks) + " FROM g"


ORACLE_SQL = {
    "l1_full_softmax_loss": f"{_NLL} SELECT round(avg(nll), 6) AS loss FROM nl",
    "l2_sampled_softmax_loss": f"{_NEG}, t AS (SELECT query_id, sum(exp(s - lq)) AS z FROM ng GROUP BY 1) SELECT round(avg(ln(z + exp(p)) - p), 6) AS loss FROM t JOIN po USING (query_id)",
    "l3_margin_loss": _PAIR("greatest(0.0::double, 2.0 - ({p}) + {s})"),
    "l4_pairwise_log_loss": _PAIR(_SP("{s} - ({p}) + 0.5::double")),
    "l5_rotate_loss": f"{_NEG}, t AS (SELECT query_id, p, -sum(w * {_SP('3.0::double + s')}) AS a, sum(s) AS b, -sum(w * {_SP(f"3.0::double + ({_ROOT('s')})")}) AS c FROM w JOIN po USING (query_id) GROUP BY ALL) SELECT round(avg(({_SP('-(3.0::double + p)')} - a) / 2), 6) AS weighted, round(avg(({_SP('-(3.0::double + p)')} - b) / 2), 6) AS legacy, round(avg(({_SP(f"-(3.0::double + ({_ROOT('p')}))")} - c) / 2), 6) AS rooted FROM t",
    "m1_rank_metrics": f"{_SC}, {_POS}, r AS (SELECT query_id, count(*) FILTER (round(score, 10) > round(p, 10)) + 1 AS rank FROM sc JOIN po USING (query_id) GROUP BY 1) SELECT round(avg(rank), 6) AS mr, round(avg(1.0::double / rank), 6) AS mrr, round(avg((rank <= 1)::int), 6) AS hits_1, round(avg((rank <= 3)::int), 6) AS hits_3, round(avg((rank <= 10)::int), 6) AS hits_10 FROM r",
    "m2_precision_at_k": _at((1, 3, 5), "coalesce(sum(hit) FILTER (rank <= {k}), 0) / {k}::double", "precision"),
    "m3_recall_at_k": _at((10, 20, 50), "coalesce(sum(hit) FILTER (rank <= {k}), 0) / n::double", "recall"),
    "m4_ndcg_at_k": _at((10, 20, 50), "coalesce(sum(hit / log2(rank + 1)) FILTER (rank <= {k}), 0) / list_sum(list_transform(range(1, least({k}, n) + 1), lambda r: 1.0::double / log2(r + 1)))", "ndcg"),
    "m5_perplexity": f"{_NLL}, sq AS (SELECT floor(sqrt(query_id))::bigint AS s, nll FROM nl), bt AS (SELECT s % 7 % 3 AS b, avg(nll) AS m, count(DISTINCT s) AS n FROM sq GROUP BY 1) SELECT (SELECT round(exp(avg(nll)), 6) FROM nl) AS perplexity, round(exp(sum(m * n) / sum(n)), 6) AS by_batch FROM bt",
    "m6_combine_batches": f"{_NLL}, b AS (SELECT batch, avg(nll) AS a, max(nll) AS m, count(*) AS n FROM nl GROUP BY 1) SELECT round(sum(a * n) / sum(n), 6) AS nll, round(sum(m * n) / sum(n), 6) AS worst FROM b",
}
