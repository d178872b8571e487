"""Losses over score tables (row_id, kind, item_id, score, log_q), kind 'pos' or 'neg'. Item 0 is padding.

Every loss is the mean over rows of the mean over a row's positives; rows with only padding don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import catalogue_log_sum_exp


def _mean(per_positive: DataFrame) -> DataFrame:
    return per_positive.groupBy("row_id").agg(F.avg("loss").alias("loss")).agg(F.avg("loss").alias("loss"))


def _softplus(x: Column) -> Column:
    """-log sigmoid(-x)."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def full_softmax_nll(queries: DataFrame, items: DataFrame, positives: DataFrame, scorer: str = "inner") -> DataFrame:
    """(row_id, item_id, nll) of each positive (row_id, item_id, score): the log of the sum over all items, less its score."""
    lse = catalogue_log_sum_exp(queries, items, scorer).withColumnRenamed("query_id", "row_id")
    return positives.where("item_id <> 0").join(lse, "row_id").select("row_id", "item_id", (F.col("lse") - F.col("score")).alias("nll"))


def full_softmax_loss(queries: DataFrame, items: DataFrame, positives: DataFrame, scorer: str = "inner") -> DataFrame:
    return _mean(full_softmax_nll(queries, items, positives, scorer).withColumnRenamed("nll", "loss"))


def sampled_softmax_loss(scores: DataFrame) -> DataFrame:
    """Softmax over a row's positives and negatives, every score corrected by its log proposal."""
    rows = scores.where("item_id <> 0").withColumn("s", F.col("score") - F.col("log_q"))
    own = Window.partitionBy("row_id")
    shifted = rows.withColumn("top", F.max("s").over(own)).withColumn("lse", F.col("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top"))).over(own)))
    return _mean(shifted.where("kind = 'pos'").select("row_id", (F.col("lse") - F.col("s")).alias("loss")))


def _pairs(scores: DataFrame, weighted: bool, sqrt: bool = False) -> DataFrame:
    """(row_id, item_id, p, s, w): each positive with its row's negatives and their weights; with ``sqrt`` p and s are
    minus the roots of the distances -score (0 at least)."""
    rooted = lambda c: -F.sqrt(F.greatest(-F.col(c), F.lit(0.0))) if sqrt else F.col(c)
    neg = scores.where("kind = 'neg'")
    own = Window.partitionBy("row_id")
    logit = F.col("score") - F.col("log_q")
    if weighted:
        neg = neg.withColumn("_z", logit).withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(own))).withColumn("w", F.col("_e") / F.sum("_e").over(own))
    else:
        neg = neg.withColumn("w", 1.0 / F.count("*").over(own))
    pos = scores.where("kind = 'pos' AND item_id <> 0").select("row_id", "item_id", rooted("score").alias("p"))
    return pos.join(neg.select("row_id", rooted("score").alias("s"), F.col("score").alias("raw"), "w"), "row_id")


def margin_loss(scores: DataFrame, gamma: float = 2.0, weighted: bool = True, sqrt: bool = False) -> DataFrame:
    """Sum of w max(0, gamma + d+ - d-), with distances d = -score, or their roots; weights even or the corrected softmax."""
    term = F.col("w") * F.greatest(F.lit(0.0), F.lit(gamma) - F.col("p") + F.col("s"))
    return _mean(_pairs(scores, weighted, sqrt).groupBy("row_id", "item_id").agg(F.sum(term).alias("loss")))


def pairwise_log_loss(scores: DataFrame, gamma: float = 0.0, weighted: bool = True, sqrt: bool = False) -> DataFrame:
    """-Sum of w log sigmoid(d- - d+ - gamma)."""
    term = F.col("w") * _softplus(F.col("s") - F.col("p") + F.lit(gamma))
    return _mean(_pairs(scores, weighted, sqrt).groupBy("row_id", "item_id").agg(F.sum(term).alias("loss")))


def rotate_loss(scores: DataFrame, gamma: float = 10.0, weighted: bool = True, legacy: bool = False, sqrt: bool = False) -> DataFrame:
    """Half of -log sigmoid(gamma - d+) less the weighted sum of log sigmoid(d- - gamma).

    ``legacy`` takes the plain sum of the negatives' scores for the second term.
    """
    pairs = _pairs(scores, weighted, sqrt)
    second = F.sum("raw") if legacy else -F.sum(F.col("w") * _softplus(F.lit(gamma) + F.col("s")))
    per = pairs.groupBy("row_id", "item_id", "p").agg(second.alias("t"))
    return _mean(per.select("row_id", ((_softplus(-(F.lit(gamma) + F.col("p"))) - F.col("t")) / 2).alias("loss")))
