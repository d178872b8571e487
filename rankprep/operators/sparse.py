"""Sparse multi-label rows: labels array<int>, features array<struct<idx, val>>."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .retrieval import catalogue, is_small


def drop_unlabelled(df: DataFrame) -> DataFrame:
    return df.where(F.size("labels") > 0)


def shift_for_pad(df: DataFrame) -> DataFrame:
    """Feature and label indices from 1 on, so that 0 is padding."""
    features = F.transform("features", lambda x: F.struct((x["idx"] + 1).alias("idx"), x["val"].alias("val")))
    return df.withColumn("labels", F.transform("labels", lambda x: x + 1)).withColumn("features", features)


def label_freq(train: DataFrame) -> DataFrame:
    """(id, freq) of the labels of train rows; the pad 0 has 0."""
    counts = train.select(F.explode(F.col("labels").cast("array<bigint>")).alias("id")).groupBy("id").agg(F.count("*").alias("freq"))
    return counts.unionByName(train.sparkSession.createDataFrame([(0, 0)], "id long, freq long"))


def feature_bag(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, vec): the sum of the features' vectors, each times its value; features without a vector count nothing.

    Where all vectors hold at most BROADCAST numbers, which are counted first, they go to every task and a row is summed
    where it is. Else features and vectors meet in blocks of vectors, each of which gives a row one partial sum.
    """
    if is_small(vectors) and not vectors.isEmpty():
        return _bag_in_place(rows.select(key, "features"), vectors)
    return _bag_by_blocks(rows, vectors, key)


#: Numbers of a block of vectors (32 MB), and features of rows that meet it in one task.
BLOCK, ROWS = 1 << 22, 1_000_000


def _bag_by_blocks(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """A block is dealt out by rows where many features fall into it, so a frequent feature is no hot key."""
    n, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n * dim // BLOCK)))).alias("_block")
    cells = rows.select(key, F.explode("features").alias("f")).select(key, F.col("f.idx").cast("long").alias("item_id"), F.col("f.val").cast("double").alias("val")).select("*", block)
    salts = cells.groupBy("_block").agg(F.ceil(F.count("*") / ROWS).alias("_salts"))
    own = vectors.select(F.col("item_id").cast("long").alias("item_id"), F.col("vec").cast("array<double>").alias("vec")).select("*", block).join(salts, "_block")
    own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    cells = cells.join(salts, "_block").withColumn("_salt", F.pmod(F.xxhash64(key), F.col("_salts"))).drop("_salts")
    schema = StructType([rows.schema[key], StructField("vec", ArrayType(DoubleType()))])
    target = to_arrow_schema(schema)

    def table(keys: pa.Array, sums: np.ndarray) -> pa.Table:
        vec = pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1], sums.ravel())
        return pa.table([keys.cast(target.types[0]), vec.cast(target.types[1])], schema=target)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        ids = np.asarray(right["item_id"].combine_chunks())
        order = np.argsort(ids)
        x = np.asarray(right["vec"].combine_chunks().flatten()).reshape(len(ids), -1)
        idx, val = np.asarray(left["item_id"].combine_chunks()), np.asarray(left["val"].combine_chunks())
        at = np.minimum(np.searchsorted(ids[order], idx), len(ids) - 1)
        ok = ids[order][at] == idx
        if not ok.any():
            return target.empty_table()
        keys = left[key].combine_chunks().filter(pa.array(ok)).dictionary_encode()
        sums = np.zeros((len(keys.dictionary), x.shape[1]))
        np.add.at(sums, np.asarray(keys.indices), val[ok, None] * x[order[at[ok]]])
        return table(keys.dictionary, sums)

    def add(parts: pa.Table) -> pa.Table:
        x = np.asarray(parts["vec"].combine_chunks().flatten()).reshape(parts.num_rows, -1)
        return table(parts[key].combine_chunks().slice(0, 1), x.sum(0, keepdims=True))

    parts = cells.groupBy("_block", "_salt").cogroup(own.groupBy("_block", "_salt")).applyInArrow(meet, schema)
    return parts.groupBy(key).applyInArrow(add, schema)


def _bag_in_place(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(catalogue(vectors))
    schema = StructType([rows.schema.fields[0], StructField("vec", ArrayType(DoubleType()))])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                lists = batch.column(1)
                flat = lists.flatten()
                idx, val = np.asarray(flat.field("idx")).astype(np.int64), np.asarray(flat.field("val")).astype(float)
                row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
                at = np.minimum(np.searchsorted(ids, idx), len(ids) - 1)
                ok = ids[at] == idx
                sums = np.zeros((batch.num_rows, table.shape[1]))
                np.add.at(sums, row[ok], val[ok, None] * table[at[ok]])
                some = np.unique(row[ok])
                vec = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * table.shape[1], sums[some].ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)).cast(target.types[0]), vec.cast(target.types[1])], schema=target)

    return rows.mapInArrow(run, schema)
