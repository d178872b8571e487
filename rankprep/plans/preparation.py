"""Ratings, sequences, times, joins of ids, dictionaries, k-core, statistics, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ids as I
from ..operators import interact as P
from .inputs import EVENTS, INTER, ORDER, SPARSE, TOKENS, events, interactions, sparse_rows, table, tokens
from ..operators import sparse as X

#: k-core thresholds at which the driver's interactions shrink for some rounds and then stay.
LEAST = 22


def with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with labels of some documents: rows with nulls."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic")


def p1_drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drop_incomplete(with_holes(spark, sf_dir))


def p2_implicit_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.implicit_rating(interactions(spark, sf_dir).select("user_id", "item_id", "tie"))


def p3_threshold_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions(spark, sf_dir).select("tie", "rating")
    return P.threshold_ratings(rows, 25, False).withColumn("form", F.lit("binary")).unionByName(P.threshold_ratings(rows, 25, True).withColumn("form", F.lit("drop"))).unionByName(P.threshold_ratings(rows, None).withColumn("form", F.lit("same")))


def p4_split_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.split_sequence(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("words")), "words", " ")
    return rows.withColumn("longest", F.lit(P.max_length(rows, "words")))


def p5_pad_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.history(interactions(spark, sf_dir), ORDER)
    return P.pad_sequence(rows.select("id", "items"), "items", 10)


def p6_parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "item_id", F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("ts"))
    parsed = P.parse_time(rows, "ts", "yyyy/MM/dd HH:mm:ss")
    return parsed.select("user_id", "item_id", F.unix_timestamp("ts").alias("seconds"))


def p7_drop_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.drop_unlabelled(sparse_rows(spark, sf_dir)).select("doc_id", F.size("labels").alias("n_labels"))


def p8_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_occurrence(events(spark, sf_dir), ["ts"]).select("user_id", "item_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "first")


def p9_keep_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keep_fields(interactions(spark, sf_dir), ["user_id", "item_id"])


def p10_shift_for_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.shift_for_pad(sparse_rows(spark, sf_dir))
    return rows.select("doc_id", F.sort_array("labels").alias("labels"), F.sort_array(F.col("features.idx")).alias("idx"))


def p11_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_holes(spark, sf_dir).select("doc_id", F.col("quality").cast("double").alias("quality"), "toxic")
    return P.fill_missing(rows, {"quality": "float", "toxic": "token"}).withColumn("quality", F.round("quality", 9))


def j1_encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions(spark, sf_dir)
    vocab = I.build_dictionary(rows, ["item_id"], ORDER)
    scalar = I.encode_tokens(rows.select("tie", "item_id"), vocab, ["item_id"])
    lists = P.history(rows, ORDER).select("id", "items")
    arrays = I.encode_tokens(lists, vocab, ["items"], key=["id"]).select(F.col("id").cast("string").alias("key"), "items")
    return scalar.select(F.col("tie").alias("key"), F.array("item_id").alias("items")).unionByName(arrays)


def j2_decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions(spark, sf_dir).select("tie", "item_id", "ts")
    vocab = I.build_dictionary(rows, ["item_id"], ORDER)
    return I.decode_ids(I.encode_tokens(rows, vocab, ["item_id"]), vocab, ["item_id"]).select("tie", "item_id")


def j3_reindex_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).unionByName(spark.range(-1, 0).toDF("id"))
    attributes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("quality"), "toxic")
    return P.reindex_catalogue(attributes, dim, {"quality": "float", "toxic": "token"}).withColumn("quality", F.round("quality", 9))


def j4_attach_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("size"))
    return P.attach_features(interactions(spark, sf_dir).select("tie", "user_id", "item_id"), users, items)


def a1_build_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build_dictionary(P.kcore(interactions(spark, sf_dir), LEAST, LEAST), ["item_id"], ORDER)


def a2_frequency_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frequency_vocab(tokens(spark, sf_dir), ["pos"])


def a6_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return P.history(interactions(spark, sf_dir), ORDER, dim=dim)


def a8_kcore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kcore(interactions(spark, sf_dir), LEAST, LEAST).select("user_id", "item_id", "rating", "tie")


def a9_drop_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drop_duplicate_pairs(interactions(spark, sf_dir), ORDER).select("user_id", "item_id", "tie")


def a10_dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dataset_stats(interactions(spark, sf_dir))


def t1_order_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with its place in what the ordering gives."""
    ordered = P.order_interactions(interactions(spark, sf_dir), ORDER)
    id_ = F.monotonically_increasing_id()
    first = F.min("id").over(Window.partitionBy("user_id"))
    return ordered.withColumn("id", id_).select("tie", "user_id", (F.col("id") - first).alias("place"))


QUERIES = {f.__name__: f for f in (p1_drop_incomplete, p2_implicit_rating, p3_threshold_ratings, p4_split_sequence, p5_pad_sequence, p6_parse_time, p7_drop_unlabelled, p8_first_occurrence, p9_keep_fields, p10_shift_for_pad, p11_fill_missing, j1_encode_tokens, j2_decode_ids, j3_reindex_catalogue, j4_attach_features, a1_build_dictionary, a2_frequency_vocab, a6_history, a8_kcore, a9_drop_duplicate_pairs, a10_dataset_stats, t1_order_interactions)}

_ROUND = "i{n} AS (SELECT * FROM {p} WHERE item_id IN (SELECT item_id FROM {p} GROUP BY item_id HAVING count(*) >= 22)), r{n} AS (SELECT * FROM i{n} WHERE user_id IN (SELECT user_id FROM i{n} GROUP BY user_id HAVING count(*) >= 22))"
KCORE = ", ".join([INTER, *[_ROUND.format(n=n, p="inter" if n == 1 else f"r{n - 1}") for n in range(1, 7)]]).replace("inter AS (", "inter AS MATERIALIZED (", 1)
_DICT = "first AS (SELECT item_id::varchar AS token, min((ts, tie)) AS f FROM {t} GROUP BY 1), dict AS (SELECT token, row_number() OVER (ORDER BY f) AS id FROM first UNION ALL SELECT '[PAD]', 0)"
_HOLES = "h AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"

ORACLE_SQL = {
    "p1_drop_incomplete": f"WITH {_HOLES} SELECT * FROM h WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL",
    "p2_implicit_rating": f"WITH {INTER} SELECT user_id, item_id, tie, 1.0::double AS rating FROM inter",
    "p3_threshold_ratings": f"WITH {INTER} SELECT tie, CASE WHEN rating >= 25 THEN 1.0 ELSE 0.0 END::double AS rating, 'binary' AS form FROM inter UNION ALL SELECT tie, 1.0::double, 'drop' FROM inter WHERE rating >= 25 UNION ALL SELECT tie, rating, 'same' FROM inter",
    "p4_split_sequence": "WITH w AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS words FROM documents) SELECT *, (SELECT max(len(words)) FROM w)::int AS longest FROM w",
    "p5_pad_sequence": f"WITH {INTER}, l AS (SELECT user_id AS id, list(item_id ORDER BY ts, tie)[1:10] AS items FROM inter GROUP BY 1) SELECT id, list_concat(items, list_transform(range(len(items), 10), lambda x: 0::bigint)) AS items FROM l",
    "p6_parse_time": f"WITH {EVENTS} SELECT user_id, item_id, floor(epoch(ts))::bigint AS seconds FROM ev",
    "p7_drop_unlabelled": f"WITH {SPARSE} SELECT doc_id, len(labels)::int AS n_labels FROM labs WHERE len(labels) > 0",
    "p8_first_occurrence": f"WITH {EVENTS} SELECT user_id, item_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts) = 1 AS first FROM ev",
    "p9_keep_fields": f"WITH {INTER} SELECT user_id, item_id, rating FROM inter",
    "p10_shift_for_pad": f"WITH {SPARSE}, f AS (SELECT doc_id, list((idx + 1)::int ORDER BY idx) AS idx FROM wordlens GROUP BY 1) SELECT l.doc_id, list_sort(list_transform(labels, lambda x: x + 1)) AS labels, coalesce(f.idx, []) AS idx FROM labs l LEFT JOIN f USING (doc_id)",
    "p11_fill_missing": f"WITH {_HOLES} SELECT doc_id, round(coalesce(quality, (SELECT avg(quality) FROM h))::double, 9) AS quality, coalesce(toxic, 0) AS toxic FROM h",
    "j1_encode_tokens": f"WITH {INTER}, {_DICT.format(t='inter')}, e AS (SELECT i.*, d.id FROM inter i JOIN dict d ON d.token = i.item_id::varchar) SELECT tie AS key, [id] AS items FROM e UNION ALL SELECT user_id::varchar, list(id ORDER BY ts, tie) FROM e GROUP BY user_id",
    "j2_decode_ids": f"WITH {INTER} SELECT tie, item_id::varchar AS item_id FROM inter",
    "j3_reindex_catalogue": "WITH d AS (SELECT doc_id AS id FROM documents UNION ALL SELECT -1), a AS (SELECT d.id, quality, toxic FROM d LEFT JOIN labels l ON l.doc_id = d.id) SELECT id, round(coalesce(quality, (SELECT avg(quality) FROM a))::double, 9) AS quality, coalesce(toxic, 0) AS toxic FROM a",
    "j4_attach_features": f"WITH {INTER} SELECT tie, user_id, item_id, c_nationkey AS nation, p_size AS size FROM inter LEFT JOIN customer ON c_custkey = user_id LEFT JOIN part ON p_partkey = item_id",
    "a1_build_dictionary": f"WITH {KCORE}, {_DICT.format(t='r6')} SELECT token, id FROM dict",
    "a2_frequency_vocab": f"WITH {TOKENS}, c AS (SELECT token, count(*) AS freq, min((s, doc, sub, pl)) AS f FROM tok GROUP BY 1) SELECT token, row_number() OVER (ORDER BY freq DESC, f) AS id, freq FROM c",
    "a6_history": f"WITH {INTER}, l AS (SELECT user_id, list(item_id ORDER BY ts, tie) AS items FROM inter GROUP BY 1) SELECT c_custkey AS id, coalesce(items, []) AS items, len(coalesce(items, []))::int AS n FROM customer LEFT JOIN l ON user_id = c_custkey",
    "a8_kcore": f"WITH {KCORE} SELECT user_id, item_id, rating, tie FROM r6",
    "a9_drop_duplicate_pairs": f"WITH {INTER} SELECT user_id, item_id, tie FROM inter QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, tie) = 1",
    "a10_dataset_stats": f"WITH {INTER} SELECT count(DISTINCT user_id) + 1 AS n_users, count(DISTINCT item_id) + 1 AS n_items, count(*) AS n_interactions FROM inter",
    "t1_order_interactions": f"WITH {INTER} SELECT tie, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, tie) - 1 AS place FROM inter",
}
