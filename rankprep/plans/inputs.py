"""The driver's tables as interactions, triples, tokens, sparse rows and vectors; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of interactions of one user: time, then a key that tells all rows apart.
ORDER = ["ts", "tie"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TIE = (("l_orderkey", 10), ("l_linenumber", 3), ("l_partkey", 10), ("l_suppkey", 10), ("l_quantity", 4), ("round(l_extendedprice * 100)", 12), ("round(l_discount * 100)", 3), ("round(l_tax * 100)", 3))
_TIE_SQL = " || '-' || ".join(f"lpad(cast(cast({c} AS bigint) AS {{text}}), {n}, '0')" for c, n in _TIE) + " || '-' || l_returnflag || l_linestatus || '-' || substr(cast(l_shipdate AS {text}), 1, 10)"


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, rating, ts, tie from line items and their orders."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    return rows.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("rating"), F.col("o_orderdate").alias("ts"), F.expr(_TIE_SQL.format(text="string")).alias("tie"))


INTER = f"inter AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS rating, o_orderdate AS ts, {_TIE_SQL.format(text='varchar')} AS tie FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, rating, ts of events: few items, many repeats; ts is unique."""
    return table(spark, sf_dir, "events").select("user_id", F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("long").alias("item_id"), F.col("value").alias("rating"), "ts")


EVENTS = "ev AS (SELECT user_id, regexp_extract(props, '\"k\":\\s*(\\d+)', 1)::bigint AS item_id, value AS rating, ts FROM events)"


def uniform_sql(seed: int, stage: str, *keys: str) -> str:
    """The deterministic draw in SQL; keys are expressions of the same text as in Spark."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{stage}', {', '.join(keys)})), 1, 13))::bigint / 4503599627370496.0::double)"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """head, relation, tail, split, key from line items; about a tenth of the rows in valid and in test."""
    from ..functions import uniform

    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.expr(_TIE_SQL.format(text="string")))
    u = uniform(1, "split", "key")
    split = F.when(u < 0.8, "train").when(u < 0.9, "valid").otherwise("test")
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("head"), F.col("l_returnflag").alias("relation"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tail"), split.alias("split"), "key")


TRIPLES = f"""keyed AS (SELECT *, {_TIE_SQL.format(text="varchar")} AS key FROM lineitem),
drawn AS (SELECT *, {uniform_sql(1, "split", "key")} AS u FROM keyed),
tri AS (SELECT 's' || l_suppkey::varchar AS head, l_returnflag AS relation, 'p' || l_partkey::varchar AS tail,
  CASE WHEN u < 0.8::double THEN 'train' WHEN u < 0.9::double THEN 'valid' ELSE 'test' END AS split, key FROM drawn)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, doc, sub, text: documents as train, conversations as valid, benchmark items as test."""
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("s"), F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("sub"), "text")
    conv = table(spark, sf_dir, "conversations").select(F.lit(1).alias("s"), F.col("conv_id").alias("doc"), F.col("turn").cast("long").alias("sub"), "text")
    bench = table(spark, sf_dir, "benchmark").select(F.lit(2).alias("s"), F.col("item_id").alias("doc"), F.lit(0).cast("long").alias("sub"), "text")
    return docs.unionByName(conv).unionByName(bench)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, pos, token of all texts, split at spaces."""
    from ..operators.ids import token_stream

    return token_stream(texts(spark, sf_dir), ["s", "doc", "sub"], keep=("s",))


TOKENS = """texts AS (SELECT 0 AS s, doc_id AS doc, 0 AS sub, text FROM documents UNION ALL SELECT 1, conv_id, turn, text FROM conversations UNION ALL SELECT 2, item_id, 0, text FROM benchmark),
listed AS (SELECT s, doc, sub, string_split(text, ' ') AS words FROM texts WHERE text IS NOT NULL),
tok AS (SELECT s, doc, sub, unnest(range(0, len(words))) AS pl, unnest(words) AS token FROM listed)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id (from 1), vec array<double>, label."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, vec, label: all vectors as queries, too."""
    return vectors(spark, sf_dir).select(F.col("item_id").alias("query_id"), "vec", "label")


VECTORS = "vecs AS (SELECT vec_id + 1 AS item_id, embedding::double[] AS vec, label FROM embeddings), qs AS (SELECT item_id AS query_id, vec, label FROM vecs)"


#: Between words, as the SQL takes it: a vertical tab is none.
SPACES = r"[ \t\n\f\r]+"


def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, labels, features, zero-based: the lengths of a document's words and their counts; and what labels
    it has (language, quality, toxicity)."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    size = F.array_sort(F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda x: x != ""), lambda x: F.least(F.length(x), F.lit(40))))
    features = F.transform(F.array_distinct(size), lambda n: F.struct(n.cast("int").alias("idx"), F.size(F.filter(size, lambda y: y == n)).cast("double").alias("val")))
    labels = F.filter(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("quality") == 0, 1), F.when(F.col("toxic") == 1, 2)), lambda x: x.isNotNull())
    return docs.select("doc_id", labels.alias("labels"), features.alias("features"))


SPARSE = """wordlens AS (SELECT doc_id, least(length(w), 40) AS idx, count(*)::double AS val FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
labs AS (SELECT d.doc_id, list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN quality = 0 THEN 1 END, CASE WHEN toxic = 1 THEN 2 END], lambda x: x IS NOT NULL) AS labels FROM documents d LEFT JOIN labels USING (doc_id))"""
