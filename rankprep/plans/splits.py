"""Splits, shuffles and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import split as S
from .inputs import EVENTS, INTER, ORDER, events, interactions, table, uniform_sql


def w1_split_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_by_ratio(interactions(spark, sf_dir), ["tie"]).select("tie", "user_id", "split")


def w2_split_by_ratio_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_by_ratio(interactions(spark, sf_dir), ["tie"], mode="entry").select("tie", "split")


def w3_split_by_ratio_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_by_ratio(interactions(spark, sf_dir), ["tie"], mode="user").select("tie", "user_id", "split")


def w4_leave_n_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leave_n_out(interactions(spark, sf_dir), ORDER).select("tie", "user_id", "part")


def w5_leave_last_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leave_last_distinct(events(spark, sf_dir), ["ts"]).select("user_id", "item_id", "part")


def w6_shuffle_within_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shuffle_within_user(interactions(spark, sf_dir), ["tie"]).select("tie", "user_id", F.col("place").cast("long").alias("place"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")


def w10_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.random_split(_docs(spark, sf_dir), ["doc_id"], [0.7, 0.2, 0.1])


def w11_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("bench").alias("lang"), F.length("text").cast("long").alias("n_chars"))
    return S.holdout_split(_docs(spark, sf_dir), test, ["doc_id"], 0.9)


def t4_assign_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions(spark, sf_dir).select("tie")
    plain = S.assign_batches(rows, 256, ["tie"]).withColumn("form", F.lit("order"))
    return plain.unionByName(S.assign_batches(rows, 256, ["tie"], shuffle=True, drop_last=True).withColumn("form", F.lit("shuffled")))


def t5_assign_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", "n_chars")
    plain = S.assign_length_buckets(rows, 16, "n_chars", ["doc_id"]).withColumn("form", F.lit("order"))
    return plain.unionByName(S.assign_length_buckets(rows, 16, "n_chars", ["doc_id"], shuffle=True, drop_last=True).withColumn("form", F.lit("shuffled")))


QUERIES = {f.__name__: f for f in (w1_split_by_ratio, w2_split_by_ratio_entry, w3_split_by_ratio_user, w4_leave_n_out, w5_leave_last_distinct, w6_shuffle_within_user, w10_random_split, w11_holdout_split, t4_assign_batches, t5_assign_length_buckets)}


def _cut_sql(n: str, place: str) -> str:
    """The part of a 0-based place among n rows, by .8/.1/.1 with the fix-ups of short users."""
    v, t = f"floor({n} * 0.1::double)", f"floor({n} * 0.1::double)"
    t1 = f"(CASE WHEN {t} = 0 AND {n} - {v} - {t} > 1 THEN 1 ELSE 0 END)"
    v1 = f"(CASE WHEN {v} = 0 AND {n} - {v} - {t} - {t1} > 1 THEN 1 ELSE 0 END)"
    train = f"({n} - {v} - {t} - {t1} - {v1})"
    return f"CASE WHEN {place} < {train} THEN 'train' WHEN {place} < {train} + {v} + {v1} THEN 'valid' ELSE 'test' END"


_U = lambda stage, *keys: uniform_sql(42, stage, *keys)
_LEAVE = "CASE WHEN p = 1 AND n > 1 THEN 0 WHEN n - p < 2 THEN 2 - (n - p) ELSE 0 END::int"

ORACLE_SQL = {
    "w1_split_by_ratio": f"WITH {INTER}, r AS (SELECT tie, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY {_U('within', 'user_id::varchar', 'tie')}, tie) - 1 AS p FROM inter) SELECT tie, user_id, {_cut_sql('n', 'p')} AS split FROM r",
    "w2_split_by_ratio_entry": f"WITH {INTER}, r AS (SELECT tie, count(*) OVER () AS n, row_number() OVER (ORDER BY {_U('entry', 'tie')}, tie) - 1 AS p FROM inter) SELECT tie, {_cut_sql('n', 'p')} AS split FROM r",
    "w3_split_by_ratio_user": f"WITH {INTER}, u AS (SELECT DISTINCT user_id FROM inter), r AS (SELECT user_id, count(*) OVER () AS m, row_number() OVER (ORDER BY {_U('user', 'user_id::varchar')}, user_id) - 1 AS p FROM u), s AS (SELECT user_id, CASE WHEN p < m - 2 * floor(m * 0.1::double) THEN 'train' WHEN p < m - floor(m * 0.1::double) THEN 'valid' ELSE 'test' END AS split FROM r) SELECT tie, user_id, split FROM inter JOIN s USING (user_id)",
    "w4_leave_n_out": f"WITH {INTER}, r AS (SELECT tie, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, tie) AS p FROM inter) SELECT tie, user_id, {_LEAVE} AS part FROM r",
    "w5_leave_last_distinct": f"WITH {EVENTS}, d AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts) = 1), r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS p FROM d) SELECT user_id, item_id, {_LEAVE} AS part FROM r",
    "w6_shuffle_within_user": f"WITH {INTER} SELECT tie, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {_U('within', 'user_id::varchar', 'tie')}, tie) - 1 AS place FROM inter",
    "w10_random_split": f"WITH r AS (SELECT doc_id, lang, n_chars, count(*) OVER () AS n, row_number() OVER (ORDER BY {_U('random', 'doc_id::varchar')}, doc_id) - 1 AS p FROM documents) SELECT doc_id, lang, n_chars, CASE WHEN p < floor(n * 0.7::double) THEN 'train' WHEN p < floor(n * (0.7::double + 0.2::double)) THEN 'valid' ELSE 'test' END AS split FROM r",
    "w11_holdout_split": f"WITH r AS (SELECT doc_id, lang, n_chars, count(*) OVER () AS n, row_number() OVER (ORDER BY {_U('holdout', 'doc_id::varchar')}, doc_id) - 1 AS p FROM documents) SELECT doc_id, lang, n_chars, CASE WHEN p < floor(n * 0.9::double) THEN 'train' ELSE 'valid' END AS split FROM r UNION ALL SELECT item_id, 'bench', length(text), 'test' FROM benchmark",
    "t4_assign_batches": f"WITH {INTER}, o AS (SELECT tie, row_number() OVER (ORDER BY tie) - 1 AS r FROM inter), s AS (SELECT tie, row_number() OVER (ORDER BY {_U('batch', 'tie')}, tie) - 1 AS r, count(*) OVER () AS n FROM inter) SELECT tie, r // 256 AS batch, (r % 256)::int AS place, 'order' AS form FROM o UNION ALL SELECT tie, r // 256, (r % 256)::int, 'shuffled' FROM s WHERE r // 256 < n // 256",
    "t5_assign_length_buckets": f"WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r FROM documents), g AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY {_U('bucket', 'doc_id::varchar')}, doc_id) - 1) // 160 AS g, count(*) OVER () AS n FROM documents), s AS (SELECT doc_id, n_chars, n, row_number() OVER (ORDER BY g, n_chars, doc_id) - 1 AS r FROM g) SELECT doc_id, n_chars, r // 16 AS batch, (r % 16)::int AS place, 'order' AS form FROM o UNION ALL SELECT doc_id, n_chars, r // 16, (r % 16)::int, 'shuffled' FROM s WHERE r // 16 < n // 16",
}
