"""Negative samples with the log-weights of their proposals: (query_id, draw, item_id, log_q).

All draws are hashes of seed, stage, query and draw, so they don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions import inner_product, uniform
from ..functions.vectors import SCORERS
from ..tables import saved
from . import sampling_tree
from .ids import with_prefix_sum


def draws(queries: DataFrame, n: int, seed: int = 42, stage: str = "draw") -> DataFrame:
    """(query_id, draw, u) of n draws for each query."""
    rows = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    return rows.withColumn("u", uniform(seed, stage, "query_id", "draw"))


def sample_uniform(queries: DataFrame, n_items: int, n: int, seed: int = 42) -> DataFrame:
    """Items 1..n_items evenly; the log-weight is the constant 1, which cancels out in the loss."""
    item = (F.floor(F.col("u") * n_items) + 1).cast("long")
    return draws(queries, n, seed, "uniform").select("query_id", "draw", item.alias("item_id"), F.lit(1.0).alias("log_q"))


def popularity_weight(freq: Column, mode: int) -> Column:
    if mode == 0:
        return F.log(freq + 1.0)
    if mode == 1:
        return F.log(freq + 1.0) + 1e-6
    if mode == 2:
        return F.pow(freq.cast("double"), F.lit(0.75))
    raise ValueError(f"unknown mode {mode}")


def popularity_cdf(freq: DataFrame, mode: int = 0) -> DataFrame:
    """(item_id, freq, weight, prob, lo, cdf) of the items but the pad, cumulated by item; the last one's cdf is 1."""
    rows = freq.where("item_id <> 0").withColumn("weight", popularity_weight(F.col("freq"), mode))
    total, last = rows.agg(F.sum("weight"), F.max("item_id")).first()
    run = with_prefix_sum(rows, "weight", ["item_id"], "_run")
    cdf = F.when(F.col("item_id") == F.lit(last), 1.0).otherwise(F.col("_run") / F.lit(total))
    return run.select("item_id", "freq", "weight", (F.col("weight") / F.lit(total)).alias("prob"), ((F.col("_run") - F.col("weight")) / F.lit(total)).alias("lo"), cdf.alias("cdf"))


def cdf_lookup(drawn: DataFrame, cdf: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``drawn`` with the first row of ``cdf`` (lo, cdf, ...) whose cdf is at least u, within equal ``keys``.

    A merge: draws and rows are range-partitioned together by keys and number and sorted from the end, and each draw takes
    the row met last. A row of any weight is one row, and the draws that fall into it spread over tasks; draws at the end of
    a part take the first row of a later part, of which there is one for each part. Draws beyond the last row are left out.
    """
    own, more = drawn.columns, [c for c in cdf.columns if c not in keys]
    rows = cdf.where("cdf > lo OR lo IS NULL")
    kinds = {c: drawn.schema[c].dataType for c in keys}
    of = lambda df, number, kind, draw, row: df.select(*[F.col(c).cast(kinds[c]) for c in keys], F.col(number).cast("double").alias("_v"), F.lit(kind).alias("_kind"), draw.alias("_draw"), row.alias("_row"))
    draw, row = F.struct(*own), F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in keys], *more)
    draw_kind, row_kind = (StructType([StructField(f.name, f.dataType) for f in df.select(c.alias("x")).schema["x"].dataType]) for df, c in ((drawn, draw), (rows, row)))
    both = of(drawn, "u", 0, draw.cast(draw_kind), F.lit(None).cast(row_kind)).unionByName(of(rows, "cdf", 1, F.lit(None).cast(draw_kind), row.cast(row_kind)))
    order = [*keys, "_v", "_kind"]
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*[F.desc(c) for c in order])
    schema = StructType([StructField("_part", LongType()), StructField("_first", BooleanType()), StructField("_draw", draw_kind), StructField("_row", row_kind)])
    target = to_arrow_schema(schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = pa.nulls(1, target.field("_row").type), None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, part = np.asarray(batch.column(0)), batch.column(3)[0].as_py()
            met = pa.concat_arrays([last, batch.column(2).cast(last.type)])
            at = np.maximum.accumulate(np.where(kind == 1, np.arange(1, len(kind) + 1), 0))
            asked = np.flatnonzero(kind == 0)
            last = met.slice(int(at[-1]), 1)
            yield as_batch([pa.array([part] * len(asked), pa.int64()), pa.array([False] * len(asked)), batch.column(1).take(pa.array(asked)), met.take(pa.array(at[asked]))])
        if part is not None:
            yield as_batch([pa.array([part], pa.int64()), pa.array([True]), pa.nulls(1, target.field("_draw").type), last])

    def as_batch(columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    found = saved(ranged.select("_kind", "_draw", "_row", F.spark_partition_id().cast("long").alias("_part")).mapInArrow(merge, schema))
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    ahead = found.where("_first").select("_part", F.last("_row", ignorenulls=True).over(later).alias("_ahead"))
    out = found.where("NOT _first").join(F.broadcast(ahead), "_part").withColumn("_row", F.coalesce("_row", "_ahead")).where("_row IS NOT NULL")
    for c in keys:
        out = out.where(F.col(f"_draw.{c}") == F.col(f"_row.{c}"))
    return out.select(*[F.col(f"_draw.{c}").alias(c) for c in own], *[F.col(f"_row.{c}").alias(c) for c in more])


def sample_popular(queries: DataFrame, cdf: DataFrame, n: int, seed: int = 42) -> DataFrame:
    found = cdf_lookup(draws(queries, n, seed, "popular"), cdf.select("item_id", "prob", "lo", "cdf"))
    return found.select("query_id", "draw", "item_id", F.log("prob").alias("log_q"))


def _literal(centers: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in centers])


def _pair_scores(queries: DataFrame, c0: np.ndarray, c1: np.ndarray) -> DataFrame:
    """(query_id, r0, r1): inner products of each half of a query with the centers, which are K x D numbers."""
    half = c0.shape[1]
    vec = F.col("vec").cast("array<double>")
    own = lambda part, c: F.transform(_literal(c), lambda x: inner_product(part, x))
    return queries.select("query_id", own(F.slice(vec, 1, half), c0).alias("r0"), own(F.slice(vec, half + 1, c1.shape[1]), c1).alias("r1"))


def index_log_q(queries: DataFrame, pairs: DataFrame, codes: DataFrame, c0: np.ndarray, c1: np.ndarray, weighted: bool = False) -> DataFrame:
    """(query_id, item_id, log_q) of given pairs: q0 c0 + q1 c1 of the item's codes, plus its log weight if ``weighted``.

    The pad 0 stands for zero vectors and gets 0.
    """
    known = pairs.join(codes, "item_id", "left").join(_pair_scores(queries, c0, c1), "query_id")
    base = F.get("r0", F.col("k0")) + F.get("r1", F.col("k1"))
    if weighted:
        base = base + F.log("weight")
    return known.select("query_id", "item_id", F.coalesce(base, F.lit(0.0)).alias("log_q"))


def index_proposal(queries: DataFrame, weighted: DataFrame, c0: np.ndarray, c1: np.ndarray, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, prob): the index samplers' distribution, w(i) exp(q0 c0 + q1 c1) / Z, in closed form.

    Z is summed over pairs of clusters, not items. With ``pairs`` (query_id, item_id) only these are told, else all.
    """
    joint = weighted.groupBy("k0", "k1").agg(F.sum("weight").alias("total"))
    scores = _pair_scores(queries, c0, c1).crossJoin(F.broadcast(joint)).withColumn("s", F.get("r0", F.col("k0")) + F.get("r1", F.col("k1")))  # k x k pairs
    own = Window.partitionBy("query_id")
    scores = scores.withColumn("top", F.max("s").over(own)).withColumn("e", F.exp(F.col("s") - F.col("top"))).withColumn("z", F.sum(F.col("e") * F.col("total")).over(own))
    items = weighted.select("item_id", "k0", "k1", "weight")
    asked = (["k0", "k1"], items) if pairs is None else (["query_id", "k0", "k1"], pairs.select("query_id", "item_id").join(items, "item_id"))
    return scores.select("query_id", "k0", "k1", "e", "z").join(asked[1], asked[0]).select("query_id", "item_id", (F.col("weight") * F.col("e") / F.col("z")).alias("prob"))


def _drawn_pairs(queries: DataFrame, joint: DataFrame, c0: np.ndarray, c1: np.ndarray, n: int, seed: int, stage: str) -> DataFrame:
    """(query_id, draw, k0, k1, s): k0 by its share given all k1, then k1 given k0, for each draw."""
    k = len(c0)
    w = np.zeros((k, len(c1)))
    for r in joint.collect():  # k x k numbers
        w[r["k0"], r["k1"]] = r["weight"]
    shared = queries.sparkSession.sparkContext.broadcast((c0, c1, w))
    rows = draws(queries, n, seed, f"{stage}0").withColumnRenamed("u", "u0").withColumn("u1", uniform(seed, f"{stage}1", "query_id", "draw"))
    grouped = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("draw", "u0", "u1"))).alias("d"))
    ready = queries.select("query_id", "vec").join(grouped, "query_id")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, w = shared.value
        for batch in batches:
            x = np.asarray(batch.column(1).flatten().cast(pa.float64())).reshape(batch.num_rows, -1)
            r0, r1 = x[:, : a.shape[1]] @ a.T, x[:, a.shape[1] :] @ b.T
            d = batch.column(2).flatten()  # every query has the same number of draws
            draw, u0, u1 = (np.asarray(d.field(c)).reshape(batch.num_rows, -1) for c in ("draw", "u0", "u1"))
            for lo in range(0, batch.num_rows, 64):
                rows = slice(lo, lo + 64)
                e0, e1 = (np.exp(r[rows] - r[rows].max(1, keepdims=True)) for r in (r0, r1))
                p = e0[:, :, None] * w * e1[:, None]
                at0 = _first_above(p.sum(2)[:, None], u0[rows])
                at1 = _first_above(p[np.arange(len(p))[:, None], at0], u1[rows])
                one = np.arange(len(p))[:, None]
                s = r0[rows][one, at0] + r1[rows][one, at1]
                ids = np.repeat(np.asarray(batch.column(0))[rows], draw.shape[1])
                yield pa.RecordBatch.from_pydict({"query_id": ids, "draw": draw[rows].ravel(), "k0": at0.ravel().astype(np.int32), "k1": at1.ravel().astype(np.int32), "s": s.ravel()}, schema=pa.schema([("query_id", pa.int64()), ("draw", pa.int32()), ("k0", pa.int32()), ("k1", pa.int32()), ("s", pa.float64())]))

    return ready.mapInArrow(pick, "query_id long, draw int, k0 int, k1 int, s double")


def _first_above(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """By query and draw, the first place of positive weight whose cumulative share of p (query, 1 or draw, place) is above u."""
    run = np.cumsum(p, 2)
    last = p.shape[2] - 1 - np.argmax(p[:, :, ::-1] > 0, 2)
    return np.minimum((run <= u[:, :, None] * run[:, :, -1:]).sum(2), last)


def sample_index_uniform(queries: DataFrame, index: DataFrame, c0: np.ndarray, c1: np.ndarray, n: int, seed: int = 42) -> DataFrame:
    """Pairs of clusters by size and score, an item of the pair evenly; log_q = q0 c0 + q1 c1."""
    sizes = index.groupBy("k0", "k1").agg(F.count("*").alias("n"))
    pairs = _drawn_pairs(queries, sizes.withColumn("weight", F.col("n").cast("double")), c0, c1, n, seed, "index")
    place = F.floor(uniform(seed, "index2", "query_id", "draw") * F.col("n")).cast("int")
    return pairs.join(sizes, ["k0", "k1"]).withColumn("pos", place).join(index.select("k0", "k1", "pos", "item_id"), ["k0", "k1", "pos"]).select("query_id", "draw", "item_id", F.col("s").alias("log_q"))


def sample_index_weighted(queries: DataFrame, cdf: DataFrame, c0: np.ndarray, c1: np.ndarray, n: int, seed: int = 42) -> DataFrame:
    """Pairs by weight and score, an item by its share of the pair's weight (``cluster_cdf``); log_q gets log w(item)."""
    joint = cdf.groupBy("k0", "k1").agg(F.sum("weight").alias("weight"))
    pairs = _drawn_pairs(queries, joint, c0, c1, n, seed, "weighted").withColumn("u", uniform(seed, "weighted2", "query_id", "draw"))
    found = cdf_lookup(pairs, cdf.select("k0", "k1", "item_id", "weight", "lo", "cdf"), ("k0", "k1"))
    return found.select("query_id", "draw", "item_id", (F.col("s") + F.log("weight")).alias("log_q"))


def sample_sphere(queries: DataFrame, items: DataFrame, n: int, alpha: float = 100.0, seed: int = 42) -> DataFrame:
    """p in proportion to alpha s^2 + 1 over the whole catalogue; log_q = ln(n p). Draws go down a tree of summed features."""
    return sampling_tree.sample(queries, sampling_tree.build(items, sampling_tree.Sphere(alpha)), n, seed, "sphere")


def rff_features(vectors: DataFrame, m: int = 32, scale: float = 4.0, seed: int = 42) -> DataFrame:
    """``vectors`` with vec replaced by [cos Wx, sin Wx] / sqrt(m) of the unit vector, with one W ~ N(0, 1 / scale) for all."""

    @F.pandas_udf("array<double>")
    def features(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, float) for v in column])
        w = np.random.default_rng([seed, x.shape[1]]).normal(0, 1 / np.sqrt(scale), (x.shape[1], m))
        y = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ w
        return pd.Series(list(np.concatenate([np.cos(y), np.sin(y)], 1) / np.sqrt(m)))

    return vectors.withColumn("vec", features("vec"))


def sample_rff(queries: DataFrame, items: DataFrame, n: int, m: int = 32, scale: float = 4.0, seed: int = 42) -> DataFrame:
    """p in proportion to the inner product of random Fourier features, 1e-8 at least, over the whole catalogue."""
    tree = sampling_tree.build(rff_features(items, m, scale, seed), sampling_tree.Clamped(1e-8))
    return sampling_tree.sample(rff_features(queries, m, scale, seed), tree, n, seed, "rff")


def candidate_scores(drawn: DataFrame, queries: DataFrame, items: DataFrame, scorer: str = "inner") -> DataFrame:
    """``drawn`` with the score of each query and item."""
    q = queries.select("query_id", F.col("vec").alias("_q"))
    x = items.select("item_id", F.col("vec").alias("_x"))
    return drawn.join(q, "query_id").join(x, "item_id").withColumn("score", SCORERS[scorer]("_q", "_x")).drop("_q", "_x")


def sample_sphere_approx(queries: DataFrame, items: DataFrame, n_items: int, n: int, alpha: float = 100.0, seed: int = 42) -> DataFrame:
    """Items evenly, with log_q = ln(alpha s^2 + 1)."""
    s = candidate_scores(sample_uniform(queries, n_items, n, seed), queries, items)
    return s.select("query_id", "draw", "item_id", F.log(F.lit(alpha) * F.col("score") * F.col("score") + 1.0).alias("log_q"))


def sample_rff_approx(queries: DataFrame, items: DataFrame, n_items: int, n: int, m: int = 32, scale: float = 5.0, seed: int = 42) -> DataFrame:
    """Items evenly, with log_q = ln of the inner product of Fourier features, 1e-8 at least."""
    s = candidate_scores(sample_uniform(queries, n_items, n, seed), rff_features(queries, m, scale, seed), rff_features(items, m, scale, seed))
    return s.select("query_id", "draw", "item_id", F.log(F.greatest("score", F.lit(1e-8))).alias("log_q"))


def sample_hard(queries: DataFrame, items: DataFrame, n_items: int, n: int, pool: int | None = None, seed: int = 42, scorer: str = "inner") -> DataFrame:
    """The n best of an even pool (2n by default) by score, ties by draw; log_q = 0."""
    s = candidate_scores(sample_uniform(queries, n_items, pool or 2 * n, seed), queries, items, scorer)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "draw"))
    return s.withColumn("_r", place).where(F.col("_r") <= n).select("query_id", F.col("_r").alias("draw"), "item_id", F.lit(0.0).alias("log_q"))


def sample_resampled(queries: DataFrame, items: DataFrame, n_items: int, n: int, pool: int | None = None, seed: int = 42, scorer: str = "inner") -> DataFrame:
    """n draws with replacement from an even pool (2n by default), in proportion to the softmax of the scores; log_q = 0."""
    s = candidate_scores(sample_uniform(queries, n_items, pool or 2 * n, seed), queries, items, scorer)
    own = Window.partitionBy("query_id")
    line = own.orderBy("draw")
    s = s.withColumn("e", F.exp(F.col("score") - F.max("score").over(own)))
    run, last = F.sum("e").over(line.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(own.orderBy(F.desc("draw"))) == 1
    s = s.withColumn("cdf", F.when(last, 1.0).otherwise(run / F.sum("e").over(own))).withColumn("lo", F.coalesce(F.lag("cdf").over(line), F.lit(0.0)))
    again = draws(queries, n, seed, "resample")
    found = cdf_lookup(again, s.select("query_id", "item_id", "lo", "cdf"), ("query_id",))
    return found.select("query_id", "draw", "item_id", F.lit(0.0).alias("log_q"))


def positive_log_q(positives: DataFrame, sampler: str, cdf: DataFrame | None = None, queries: DataFrame | None = None, items: DataFrame | None = None, n: int = 1, alpha: float = 100.0, correct_pos: bool = False) -> DataFrame:
    """Rows (query_id, item_id) with the log-weight that the sampler's proposal gives them.

    Even draws have the constant 1, popular ones ln p (the pad's p is 1), hard and resampled ones 0. The exact kernel
    samplers leave positives at 0; ``correct_pos`` gives them ln(n p), from the scores of these rows alone and the weight
    of all items, which the sampling tree of ``items`` tells (for ``rff`` both sides are Fourier features). Of the index
    samplers see ``index_log_q``.
    """
    if sampler == "uniform":
        return positives.withColumn("log_q", F.lit(1.0))
    if sampler == "popular":
        p = cdf.select("item_id", "prob")
        return positives.join(p, "item_id", "left").withColumn("log_q", F.coalesce(F.log("prob"), F.lit(0.0))).drop("prob")
    if sampler in ("sphere", "rff") and correct_pos:
        kernel = sampling_tree.Sphere(alpha) if sampler == "sphere" else sampling_tree.Clamped(1e-8)
        totals = sampling_tree.total_weights(queries, sampling_tree.build(items, kernel))
        score = F.col("score")
        weight = F.lit(alpha) * score * score + 1.0 if sampler == "sphere" else F.greatest(score, F.lit(1e-8))
        scored = candidate_scores(positives, queries, items).join(totals, "query_id")
        return scored.withColumn("log_q", F.log(F.lit(n) * weight / F.col("total"))).drop("score", "total")
    return positives.withColumn("log_q", F.lit(0.0))


#: Samplers by name.
SAMPLERS = {
    "uniform": sample_uniform,
    "popular": sample_popular,
    "index_uniform": sample_index_uniform,
    "index_weighted": sample_index_weighted,
    "sphere": sample_sphere,
    "rff": sample_rff,
    "sphere_approx": sample_sphere_approx,
    "rff_approx": sample_rff_approx,
    "hard": sample_hard,
    "resampled": sample_resampled,
    "none": None,
}
