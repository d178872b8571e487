"""Sources and sinks: the tables are written in each format by Spark and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources as S
from ..tables import new_path
from .inputs import INTER, SPACES, SPARSE, TRIPLES, interactions, sparse_rows, table, triples

_SPECS = ["user_id:token", "item_id:token", "rating:float", "timestamp:float"]


def _delimited(spark: SparkSession, sf_dir: str, sep: str, header: bool) -> str:
    path = new_path(spark)
    rows = interactions(spark, sf_dir).select("user_id", "item_id", "rating", F.unix_timestamp("ts").cast("double").alias("timestamp"), "tie")
    rows.write.csv(path, sep=sep, header=header)
    return path


def s1_field_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema with a sequence field, applied to products: a name and the words of its type. Nulls have a sign, so empty fields
    stay empty; no word has a space."""
    path = new_path(spark)
    form = {"sep": "\t", "quote": '"', "escape": '"', "header": True, "nullValue": "\\N \\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, sf_dir, "documents").select("doc_id", "source", F.array_join(F.split("text", SPACES), "~").alias("words")).write.csv(path, **form)
    schema, separators = S.field_schema(["doc_id:token", "source:token", 'words:token_seq:"~"'])
    rows = spark.read.csv(path, schema="doc_id string, source string, words string", **form)
    from ..operators.interact import split_sequence

    rows = split_sequence(rows.withColumn("known", F.col("words").isNotNull()), "words", separators["words"]).withColumn("words", F.when(F.col("known"), F.col("words")))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def s2_read_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["user_id", "item_id", "rating", "timestamp", "tie"]
    tabs = S.read_interactions(spark, _delimited(spark, sf_dir, "\t", True), _SPECS, columns=names)
    colons = S.read_interactions(spark, _delimited(spark, sf_dir, "::", False), _SPECS, sep="::", header=False, encoding="ISO-8859-1", columns=names)
    return tabs.withColumn("form", F.lit("tab")).unionByName(colons.withColumn("form", F.lit("colons")))


def s3_read_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    rows = triples(spark, sf_dir)
    for role in ("train", "valid", "test"):
        rows.where(F.col("split") == role).select("head", "relation", "tail").write.csv(f"{path}/{role}.txt", sep="\t")
    return S.read_triples(spark, path).groupBy("split", "head", "relation", "tail").agg(F.count("*").alias("n"))


def s4_read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens with their places, of texts in files as Spark writes them: a space first, then the tokens, as the reader drops
    a file's first character. The third file's name holds two roles, of which it has the first. Places are by file, so each corpus is one file, written by one task and read by many."""
    path = new_path(spark)
    for file, name, key in (("valid.txt", "documents", ["doc_id"]), ("test.txt", "benchmark", ["item_id"])):
        rows = table(spark, sf_dir, name).where("text IS NOT NULL").orderBy(*key).select(F.concat(F.lit(" "), "text").alias("value"))
        rows.coalesce(1).write.option("lineSep", "\x00").text(f"{path}/{file}")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").orderBy("conv_id", "turn").select(F.concat(F.lit(" "), "text").alias("value"))
    rows.coalesce(1).write.option("lineSep", "\x00").text(f"{path}/latest_train_test.txt")
    rows = S.read_corpus(spark, path)
    return rows.withColumn("token", F.md5("token"))


def _sparse_file(spark: SparkSession, sf_dir: str) -> str:
    path, rows = new_path(spark), sparse_rows(spark, sf_dir)
    _lines(spark, rows, rows.count()).write.text(path)
    return path


def _lines(spark: SparkSession, rows: DataFrame, n: int) -> DataFrame:
    line = F.concat_ws(" ", F.array_join(F.col("labels").cast("array<string>"), ","), F.array_join(F.transform("features", lambda x: F.concat_ws(":", x["idx"], x["val"])), " "))
    header = spark.range(1).select(F.lit(f"{n} 41 3").alias("value"))
    return header.unionByName(rows.select(line.alias("value")))


def s5_read_sparse_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = S.read_sparse_multilabel(spark, _sparse_file(spark, sf_dir))
    return rows.select(F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), F.array_join(F.transform("features", lambda x: F.concat_ws(":", x["idx"], x["val"].cast("long"))), " ").alias("features"))


def s6_check_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, header = S.read_sparse_multilabel(spark, _sparse_file(spark, sf_dir))
    h = header.first()
    missing = S.check_header(rows, *h)
    return header.withColumn("missing", F.lit(missing).cast("long"))


def s6_header_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a train and a test file, whose headers agree, read as one data set."""
    path = new_path(spark)
    for name, test in (("train.txt", False), ("test.txt", True)):
        rows = sparse_rows(spark, sf_dir).where(F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)) == test)
        _lines(spark, rows, rows.count()).write.text(f"{path}/{name}")
    rows, headers = S.read_sparse_dataset(spark, path)
    counted = rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum(F.size("labels")).alias("n_labels"), F.min("row").alias("first"), F.max("row").alias("last"))
    return counted.withColumn("declared", F.lit(headers["test"]["n_features"]).cast("long"))


def s7_write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    S.write_table(triples(spark, sf_dir), path, ["split"])
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"), F.countDistinct("head").alias("heads"))


QUERIES = {f.__name__: f for f in (s1_field_schema, s2_read_interactions, s3_read_triples, s4_read_corpus, s5_read_sparse_multilabel, s6_check_header, s6_header_agreement, s7_write_table)}

ORACLE_SQL = {
    "s1_field_schema": "SELECT doc_id::varchar AS doc_id, source, list_filter(string_split(array_to_string(string_split_regex(text, '\\s+'), '~'), '~'), lambda x: x <> '') AS words FROM documents",
    "s2_read_interactions": f"WITH {INTER} SELECT user_id::varchar AS user_id, item_id::varchar AS item_id, rating, epoch(ts)::double AS timestamp, form FROM inter, (SELECT unnest(['tab', 'colons']) AS form)",
    "s3_read_triples": f"WITH {TRIPLES} SELECT split, head, relation, tail, count(*) AS n FROM tri GROUP BY ALL",
    "s4_read_corpus": """WITH t AS (SELECT 'valid' AS split, text, doc_id AS a, 0 AS b FROM documents UNION ALL SELECT 'test', text, item_id, 0 FROM benchmark UNION ALL SELECT 'train', text, conv_id, turn FROM conversations),
whole AS (SELECT split, string_agg(text, chr(0) || ' ' ORDER BY a, b) || chr(0) AS text FROM t WHERE text IS NOT NULL GROUP BY split),
tok AS (SELECT split, string_split(text, ' ') AS w FROM whole) SELECT split, unnest(range(0, len(w))) AS pos, md5(unnest(w)) AS token FROM tok""",
    "s5_read_sparse_multilabel": f"WITH {SPARSE} SELECT array_to_string(l.labels, ',') AS labels, coalesce(string_agg(w.idx || ':' || w.val::bigint, ' ' ORDER BY w.idx), '') AS features FROM labs l LEFT JOIN wordlens w USING (doc_id) GROUP BY l.doc_id, l.labels",
    "s6_header_agreement": f"WITH {SPARSE} SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows, sum(len(labels))::bigint AS n_labels, 0::bigint AS first, count(*) - 1 AS last, 41::bigint AS declared FROM labs GROUP BY 1",
    "s6_check_header": "SELECT count(*) AS n_samples, 41::bigint AS n_features, 3::bigint AS n_labels, 0::bigint AS missing FROM documents",
    "s7_write_table": f"WITH {TRIPLES} SELECT split, count(*) AS n, count(DISTINCT head) AS heads FROM tri GROUP BY split",
}
