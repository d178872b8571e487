"""Clustered two-part index over item vectors: k-means, codebooks, offsets, joint weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inner_product, l2_normalize, uniform
from ..tables import release, saved
from .ids import with_group_places


def _assign(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """(item_id, cluster, loss): the nearest center of each vector, ties by the smaller one."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)  # K x D numbers

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = np.asarray(batch.column(1).flatten().cast(pa.float64())).reshape(batch.num_rows, -1)
            d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
            at = d.argmin(1)
            yield pa.RecordBatch.from_pydict({"item_id": batch.column(0), "cluster": pa.array(at.astype(np.int32)), "loss": np.maximum(d[np.arange(len(at)), at], 0)})

    return vectors.select("item_id", "vec").mapInArrow(nearest, "item_id long, cluster int, loss double")


def _partial_sums(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """(cluster, dim, s, n, loss): per task and cluster the sum of vectors, their number and loss (n, loss on dim 0).

    Where ``vectors`` has a cluster for each row, that is taken instead of the nearest center.
    """
    known = "cluster" in vectors.columns
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, count, loss = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten().cast(pa.float64())).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            if known:
                at = np.asarray(batch.column(1))
                own = ((x - c[at]) ** 2).sum(1)
            else:
                d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
                at = d.argmin(1)
                own = np.maximum(d[np.arange(len(at)), at], 0)
            np.add.at(total, at, x)
            count += np.bincount(at, minlength=len(c))
            loss += np.bincount(at, own, len(c))
        k, dims = c.shape
        first = np.tile(np.arange(dims) == 0, k)
        yield pa.RecordBatch.from_pydict({"cluster": np.repeat(np.arange(k, dtype=np.int32), dims), "dim": np.tile(np.arange(dims, dtype=np.int32), k), "s": total.ravel(), "n": np.where(first, np.repeat(count, dims), 0), "loss": np.where(first, np.repeat(loss, dims), 0.0)})

    parts = vectors.select("vec", *["cluster"][: int(known)]).mapInArrow(sums, "cluster int, dim int, s double, n long, loss double")
    return parts.groupBy("cluster", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("loss").alias("loss"))


def lloyd_step(vectors: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """New centers (empty clusters keep theirs), sizes and loss of one round. K x D numbers reach the driver."""
    k, dims = centers.shape
    new, count, loss = np.zeros((k, dims)), np.zeros(k, np.int64), 0.0
    for r in _partial_sums(vectors, centers).collect():
        new[r["cluster"], r["dim"]] = r["s"]
        count[r["cluster"]] += r["n"]
        loss += r["loss"]
    return np.where(count[:, None] > 0, new / np.maximum(count, 1)[:, None], centers), count, loss


def _some_vectors(vectors: DataFrame, n: int, seed: int, stage: str) -> np.ndarray:
    rows = vectors.orderBy(uniform(seed, stage, "item_id"), "item_id").limit(n).collect()
    return np.array([r["vec"] for r in sorted(rows, key=lambda r: r["item_id"])], float)


def parallel_seeds(vectors: DataFrame, k: int, rounds: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item ids, vectors, rounds, weights) of candidate centers, drawn with many at once by distance.

    One seeded row comes first. In each round every row is drawn with a chance of 2 k times its share of the squared
    distances to the candidates so far, so that about 2 k come to the driver; in the end a candidate weighs as many rows
    as are nearest to it. An empty table has none.
    """
    vectors = vectors.select("item_id", "vec")
    found = [(r["item_id"], np.array(r["vec"], float), 0) for r in vectors.orderBy(uniform(seed, "seed0", "item_id"), "item_id").limit(1).collect()]
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for step in range(1, rounds + 1):
        near = saved(_assign(vectors, np.array([x for _, x, _ in found])))
        total = near.agg(F.sum("loss")).first()[0]
        drawn = near.where(uniform(seed, f"seed{step}", "item_id") * F.lit(total) < F.lit(2.0 * k) * F.col("loss")).select("item_id")
        rows = vectors.join(F.broadcast(drawn), "item_id").collect()
        release(near)
        found = sorted([*found, *((r["item_id"], np.array(r["vec"], float), step) for r in rows)], key=lambda x: x[0])
    centers = np.array([x for _, x, _ in found])
    weights = np.zeros(len(found), np.int64)
    for r in _assign(vectors, centers).groupBy("cluster").agg(F.count("*").alias("n")).collect():
        weights[r["cluster"]] = r["n"]
    return np.array([i for i, _, _ in found]), centers, np.array([n for _, _, n in found]), weights


def spread_seeds(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """``k`` of the weighted candidates (all, if there are no more), each by its weight times its squared distance."""
    rng = np.random.default_rng(seed)
    chosen, far = [], np.ones(len(candidates))
    while len(chosen) < min(k, len(candidates)):
        chance = weights * far
        chance[chosen] = 0
        if not chance.sum():  # what is left equals chosen ones
            chance = np.ones(len(candidates))
            chance[chosen] = 0
        at = int(rng.choice(len(candidates), p=chance / chance.sum()))
        own = ((candidates - candidates[at]) ** 2).sum(1)
        far = np.minimum(far, own) if chosen else own
        chosen.append(at)
    return candidates[chosen]


def bounded_round(rows: DataFrame, centers: np.ndarray, moves: np.ndarray) -> DataFrame:
    """``rows`` (item_id, vec, cluster, upper, lower) with the nearest of the centers, and whether it was ``asked`` for.

    ``upper`` bounds the distance to the row's own center, ``lower`` that to any other; both are moved by how far centers
    went since (``moves``). A row keeps its cluster without any distance where its own center must be nearer than the
    others, by ``lower`` or by half the way from its center to the next one.
    """
    size = (centers * centers).sum(1)
    half = np.zeros(len(centers))  # with very many centers the lower bounds do alone
    if len(centers) <= 4096:
        apart = np.maximum(size[:, None] + size[None] - 2 * centers @ centers.T, 0)
        np.fill_diagonal(apart, np.inf)
        half = np.sqrt(apart.min(1)) / 2
    most = np.full(len(moves), moves.max(initial=0.0))
    if len(moves) > 1:
        top = int(moves.argmax())
        most[top] = np.delete(moves, top).max()
    shared = rows.sparkSession.sparkContext.broadcast((centers, moves, most, half))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, moves, most, half = shared.value
        squares = (c * c).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten().cast(pa.float64())).reshape(batch.num_rows, -1)
            at, upper, lower = (np.array(batch.column(i)) for i in (2, 3, 4))
            size = (x * x).sum(1)
            upper, lower = upper + moves[at], lower - most[at]
            slack = 1e-6 * np.sqrt(size + squares.max())  # more than the distances' rounding
            ask = upper + slack >= np.maximum(lower, half[at])
            if ask.any():
                d = np.maximum(size[ask][:, None] + squares[None] - 2 * x[ask] @ c.T, 0)
                near = d.argmin(1)
                at[ask], upper[ask] = near, np.sqrt(d[np.arange(len(d)), near])
                d[np.arange(len(d)), near] = np.inf
                lower[ask] = np.sqrt(d.min(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), pa.array(upper), pa.array(lower), pa.array(ask)], names=["item_id", "vec", "cluster", "upper", "lower", "asked"])

    return rows.select("item_id", F.col("vec").cast("array<double>").alias("vec"), "cluster", "upper", "lower").mapInArrow(step, "item_id long, vec array<double>, cluster int, upper double, lower double, asked boolean")


def unbounded(vectors: DataFrame) -> DataFrame:
    """Rows for the first ``bounded_round``, which asks for all."""
    return vectors.select("item_id", "vec", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))


def kmeans(
    vectors: DataFrame,
    k: int,
    centers: np.ndarray | None = None,
    max_iter: int = 100,
    tol: float = 1e-6,
    seed: int = 42,
    seeding: str = "rows",
    bounds: bool = False,
) -> tuple[np.ndarray, DataFrame, float]:
    """Centers, assignment (item_id, cluster) and loss of Lloyd's rounds over (item_id, vec).

    Begins with the given centers, seeded rows, or with ``seeding`` "spread" ``parallel_seeds``; stops when the loss gains
    less than ``tol`` of the one before. Empty clusters are seeded anew from rows. The assignment is to the centers that
    are returned. With ``bounds`` rows keep distance bounds from round to round, and most need no distances later on; the
    result is the same. Each round then writes the rows, which pays where there are many more centers than dimensions.
    """
    vectors = saved(vectors.select("item_id", "vec"))
    if centers is None:
        if seeding == "spread":
            _, candidates, _, weights = parallel_seeds(vectors, k, seed=seed)
            centers = spread_seeds(candidates, weights, k, seed)
        else:
            centers = _some_vectors(vectors, k, seed, "centers")
    before, rows, moves = None, unbounded(vectors), np.zeros(len(centers))
    for step in range(max_iter):
        if bounds:
            after = saved(bounded_round(rows, centers, moves))
            if step:
                release(rows)
            rows = after
        old = centers
        centers, count, loss = lloyd_step(rows if bounds else vectors, centers)
        if before is not None and before - loss < tol * before:
            break
        before = loss
        empty = np.flatnonzero(count == 0)
        if len(empty):
            fresh = _some_vectors(vectors, len(empty), seed, f"empty{step}")
            if len(fresh):
                centers[empty[: len(fresh)]] = fresh
        moves = np.sqrt(((centers - old) ** 2).sum(1))
    if bounds and max_iter:
        release(rows)
    found = saved(_assign(vectors, centers))
    total = found.agg(F.sum("loss")).first()[0] or 0.0
    return centers, found.select("item_id", "cluster"), total


def halves(vectors: DataFrame, normalize: bool = False) -> DataFrame:
    """(item_id, v0, v1): each vector in two parts, the first the longer one if they differ."""
    vec = l2_normalize("vec") if normalize else F.col("vec").cast("array<double>")
    half = F.ceil(F.size("v") / 2).cast("int")
    return vectors.select("item_id", vec.alias("v")).select("item_id", F.slice("v", F.lit(1), half).alias("v0"), F.slice("v", half + 1, F.size("v")).alias("v1"))


def build_codebooks(items: DataFrame, k: int, normalize: bool = False, max_iter: int = 100, tol: float = 1e-6, seed: int = 42) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Centers of both halves and (item_id, k0, k1) of each item."""
    parts = halves(items, normalize)
    c0, a0, _ = kmeans(parts.select("item_id", F.col("v0").alias("vec")), k, max_iter=max_iter, tol=tol, seed=seed)
    c1, a1, _ = kmeans(parts.select("item_id", F.col("v1").alias("vec")), k, max_iter=max_iter, tol=tol, seed=seed + 1)
    return c0, c1, a0.withColumnRenamed("cluster", "k0").join(a1.withColumnRenamed("cluster", "k1"), "item_id")


def assign_codes(items: DataFrame, c0: np.ndarray, c1: np.ndarray) -> DataFrame:
    """(item_id, k0, k1) by given centers."""
    parts = halves(items)
    a0, a1 = (_assign(parts.select("item_id", F.col(v).alias("vec")), c).select("item_id", F.col("cluster").alias(n)) for v, c, n in (("v0", c0, "k0"), ("v1", c1, "k1")))
    return a0.join(a1, "item_id")


def item_weights(codes: DataFrame, mode: str = "count", freq: DataFrame | None = None, items: DataFrame | None = None, legacy_shift: bool = False) -> DataFrame:
    """``codes`` with ``weight``: 1, the item's popularity weight, exp(-|v|^2 / 2), or the product of the last two.

    With ``legacy_shift`` each item gets the popularity weight of the id before it, the first that of the pad (0).
    """
    out = codes.withColumn("weight", F.lit(1.0))
    if "pop" in mode:
        w = freq.select((F.col("item_id") + int(legacy_shift)).alias("item_id"), F.col("weight").alias("_w"))
        out = out.join(w, "item_id", "left").withColumn("weight", F.col("weight") * F.coalesce("_w", F.lit(0.0))).drop("_w")
    if "norm" in mode:
        w = items.select("item_id", F.exp(-0.5 * inner_product("vec", "vec")).alias("_w"))
        out = out.join(w, "item_id").withColumn("weight", F.col("weight") * F.col("_w")).drop("_w")
    return out


def build_index(codes: DataFrame, k: int) -> DataFrame:
    """(item_id, k0, k1, pos, start): place within the pair of clusters, and how many items earlier pairs have.

    Pairs number k x k, so their running total is over that many rows.
    """
    pair = F.col("k0") * k + F.col("k1")
    placed = with_group_places(codes, ["k0", "k1"], ["item_id"])
    sizes = placed.groupBy("k0", "k1").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(pair).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("k0", "k1", before.alias("start"))
    return placed.withColumn("pos", F.col("_place").cast("int")).join(starts, ["k0", "k1"]).select("item_id", "k0", "k1", "pos", "start", *[c for c in ("weight",) if c in codes.columns])


def joint_weights(weighted: DataFrame) -> DataFrame:
    """(k0, k1, n, weight) of the pairs of clusters that have items."""
    return weighted.groupBy("k0", "k1").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def cluster_cdf(weighted: DataFrame) -> DataFrame:
    """``weighted`` with lo and cdf: the running share of the weight within the pair, by item; the last is 1."""
    out = with_group_places(weighted, ["k0", "k1"], ["item_id"], "weight")
    last, first = F.col("_place") == F.col("_size") - 1, F.col("_place") == 0
    out = out.withColumn("lo", F.when(first, 0.0).otherwise((F.col("_run") - F.col("weight")) / F.col("_total")))
    return out.withColumn("cdf", F.when(last, 1.0).otherwise(F.col("_run") / F.col("_total"))).drop("_place", "_size", "_run", "_total")
