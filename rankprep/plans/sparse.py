"""Sparse multi-label rows: label counts and bags of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sparse as X
from .inputs import SPARSE, VECTORS, sparse_rows, vectors


def a5_label_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.label_freq(X.shift_for_pad(X.drop_unlabelled(sparse_rows(spark, sf_dir))))


def a12_feature_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = X.feature_bag(X.shift_for_pad(sparse_rows(spark, sf_dir)), vectors(spark, sf_dir), "doc_id")
    return bags.select("doc_id", F.round(F.get("vec", F.lit(0)), 4).alias("first"), F.round(F.get("vec", F.lit(63)), 4).alias("last"))


QUERIES = {f.__name__: f for f in (a5_label_freq, a12_feature_bag)}

ORACLE_SQL = {
    "a5_label_freq": f"WITH {SPARSE}, e AS (SELECT unnest(labels)::bigint + 1 AS id FROM labs) SELECT id, count(*) AS freq FROM e GROUP BY 1 UNION ALL SELECT 0, 0",
    "a12_feature_bag": f"WITH {SPARSE}, {VECTORS} SELECT doc_id, round(sum(val * vec[1]), 4) AS first, round(sum(val * vec[64]), 4) AS last FROM wordlens JOIN vecs ON item_id = idx + 1 GROUP BY 1",
}
