"""Line dedup: lines that many documents hold stay in one of them only; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_IDS, free_name, release, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty ones have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space (ASCII) at its ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(SPACE))
    plain = F.octet_length(bare) == F.char_length(bare)  # ASCII, where lower() does the same and is faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def repeated_lines(docs: DataFrame, min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """(key_md5, n_docs, keeper) of the keys of at least ``min_length`` code points that at least ``min_docs`` documents
    of ``docs`` (doc_id, text) hold; the keeper is the largest doc_id, null where no holder has one."""
    return _over(_repeated(docs, min_length, min_docs), min_docs)


def _keyed(docs: DataFrame, min_length: int) -> DataFrame:
    """_doc, _text (a hash of the text, as rows of one doc_id may differ), _at, _key of all lines that are long enough."""
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"), F.posexplode(lines_of(F.col("text"))).alias("_at", "_line"))
    # a key is at most as long as its line: most short lines need no trimming
    return rows.where(F.char_length("_line") >= min_length).select("_doc", "_text", "_at", line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= min_length)


def _few(df: DataFrame) -> bool:
    return df.limit(FEW_IDS + 1).count() <= FEW_IDS


def _repeated(docs: DataFrame, min_length: int, min_docs: int) -> DataFrame:
    """(_doc, _text, _at, _key as its md5) of all lines whose key stands in ``min_docs`` places at least.

    Hashes of 64 bits are counted, with partial counts in each task, so a line of any frequency is no hot key; what
    reaches the count is looked up in the texts again, by broadcast where the hashes are counted to be few.
    """
    hashed = _keyed(docs, min_length).select(F.xxhash64("_key").alias("_h"))
    often = saved(hashed.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs).select("_h"))
    lines = _keyed(docs, min_length).withColumn("_h", F.xxhash64("_key"))
    lines = lines.select("_doc", "_text", "_at", "_h", F.unhex(F.md5("_key")).alias("_key"))
    dups = saved(lines.join(F.broadcast(often) if _few(often) else often, "_h").drop("_h"))
    release(often)
    return dups


def _over(dups: DataFrame, min_docs: int) -> DataFrame:
    """Documents are told apart by doc_id, those without one by their text; each is counted once, spread by key and
    document before it is counted by key."""
    holder = F.when(F.col("_doc").isNull(), F.col("_text"))
    once = dups.select("_key", "_doc", holder.alias("_holder")).distinct()
    counted = once.groupBy("_key").agg(F.count("*").alias("n_docs"), F.max("_doc").alias("keeper"))
    return counted.where(F.col("n_docs") >= min_docs).withColumnRenamed("_key", "key_md5")


def drop_repeated_lines(docs: DataFrame, min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) with line_text, the text without the lines that it loses, line_count (lines before)
    and line_dropped.

    A line's key is the line without ASCII white space at its ends, with A-Z lower-cased. Keys of at least ``min_length``
    code points that at least ``min_docs`` documents hold lose all their lines except in the largest doc_id that holds
    them; the other lines stay in place. Null and empty texts are one empty line, so null gives an empty line_text.
    Documents are told apart by doc_id: rows that repeat one count once, lose their own lines only, and all keep what
    their doc_id keeps. Rows without a doc_id are documents by their text, come before all others, and keep a line that
    only such rows hold. Very long texts are handled whole, in time proportional to their lines; texts are shuffled once,
    to the places of the lines that they lose. An empty table gives an empty one. Other columns pass through; those of the
    names above are replaced.
    """
    dups = _repeated(docs, min_length, min_docs)
    over = saved(_over(dups, min_docs).select(F.col("key_md5").alias("_key"), "keeper"))
    gone = dups.join(F.broadcast(over) if _few(over) else over, "_key").where(~F.col("_doc").eqNullSafe(F.col("keeper")))
    gone = saved(gone.groupBy("_doc", "_text").agg(F.collect_set("_at").alias("_gone")))
    release(dups, over)
    names = docs.columns
    key, lost = free_name(names, "_line_text"), free_name(names, "_line_gone")
    own, same = free_name(names, "_line_own"), free_name(names, "_line_same")
    found = gone.select(F.col("_doc").alias(own), F.col("_text").alias(same), F.col("_gone").alias(lost))
    marked = docs.withColumn(key, F.xxhash64("text"))
    out = marked.join(found, marked["doc_id"].eqNullSafe(found[own]) & (marked[key] == found[same]), "left").drop(own, same, key)
    count, dropped = F.size(lines_of(F.col("text"))).cast("long"), F.coalesce(F.size(lost), F.lit(0)).cast("long")
    text = F.when(F.col(lost).isNull(), F.coalesce("text", F.lit(""))).otherwise(_without(lines_of(F.col("text")), F.col(lost)))
    return out.withColumns({"line_text": text, "line_count": count, "line_dropped": F.when(F.col(lost).isNull(), F.lit(0).cast("long")).otherwise(dropped)}).drop(lost)


def _without(lines: Column, gone: Column) -> Column:
    """The lines but those at the 0-based places, joined again. Both are bound once, so work is linear in the lines."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    bound = F.transform(F.array(F.struct(lines.alias("lines"), kept.alias("kept"))), lambda x: F.array_join(F.transform(x["kept"], lambda i: F.get(x["lines"], i)), "\n"))
    return F.get(bound, F.lit(0))


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id",
        F.col("line_count").alias("n_lines"),
        F.col("line_dropped").alias("n_dropped"),
        F.sha2("line_text", 256).alias("kept_sha256"),
    )


def line_sql(documents: str = "documents") -> str:
    """DuckDB SQL of the query, over a table (doc_id, text) of unique doc_ids."""
    space = " || ".join(f"chr({ord(c)})" for c in SPACE)
    return f"""
WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pl, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents})),
k AS (SELECT doc_id, pl, line, translate(trim(line, {space}), '{UPPER}', '{LOWER}') AS key FROM l),
o AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, pl, line, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pl) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
