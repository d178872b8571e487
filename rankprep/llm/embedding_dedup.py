"""Embedding near-duplicates by NN-descent: a neighbour graph that neighbours of neighbours refine, cut at a cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, connected_components, map_arrow, saved

#: Length of a neighbour list, vectors of a leaf, vectors of a block when a component is compared as a whole.
K, LEAF, CHUNK = 8, 256, 512
SLACK = 1e-9
#: True links of a class of the audit, from which on its share counts by itself; how far below the threshold its vectors' best go.
LEAST_TRUE, MARGIN = 50, 0.1


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, dim, v): usable vectors at length 1, as bytes of doubles. Null ids, null or zero vectors and those with null
    or non-finite components are left out; of rows with one id the smallest vector counts."""
    clean = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    clean = clean.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    clean = clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def unit(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, dims, out = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = v.values.to_numpy(zero_copy_only=False)
            top = np.abs(x).max(initial=0)
            if len(x) and np.isfinite(x).all() and top > 0:
                x = x / top
                ids.append(i)
                dims.append(len(x))
                out.append((x / np.sqrt(x @ x)).tobytes())
        yield {"id": ids, "dim": dims, "v": out}

    return map_arrow(clean, unit, "id long, dim int, v binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 1))


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def leaves(nodes: DataFrame, trees: range, count: int, seed: int) -> DataFrame:
    """(tree, leaf, part, id, v): each vector in one leaf of each tree, by the sides of random planes that it is on.

    Leaves have about LEAF vectors; one that has many more, as of near copies, is dealt into parts by a hash.
    """
    bits = max(0, math.ceil(math.log2(max(1, count / LEAF))))

    def sides(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, dims, raw = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            vs = raw.take(pa.array(own))
            x = np.frombuffer(b"".join(vs.to_pylist()), np.float64).reshape(len(own), dim)
            for tree in trees:
                planes = np.random.default_rng([seed, tree, int(dim)]).normal(size=(dim, bits))
                leaf = ((x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(own), np.int64)
                yield {"tree": np.full(len(own), tree), "dim": dims[own], "leaf": leaf, "id": ids[own], "v": vs}

    rows = map_arrow(nodes, sides, "tree int, dim int, leaf long, id long, v binary")
    sizes = rows.groupBy("tree", "dim", "leaf").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / (4 * LEAF))
    return rows.join(sizes, ["tree", "dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), parts)).drop("size")


def leaf_edges(rows: DataFrame, k: int) -> DataFrame:
    """(u, w, s): the k nearest of each vector within each of its leaves."""

    def nearest(table: pa.Table) -> pa.Table:
        ids, x = np.asarray(table["id"].combine_chunks()), _matrix(table["v"])
        scores = x @ x.T
        np.fill_diagonal(scores, -2)
        top = _top(scores, k)
        u = np.repeat(np.arange(len(ids)), top.shape[1])
        w = top.ravel()
        ok = u != w
        return pa.table({"u": ids[u[ok]], "w": ids[w[ok]], "s": scores[u[ok], w[ok]]})

    return rows.groupBy("tree", "dim", "leaf", "part").applyInArrow(nearest, "u long, w long, s double")


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each u."""
    one = edges.groupBy("u", "w").agg(F.max("s").alias("s"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "w"))).where(F.col("r") <= k).drop("r")


def refine(graph: DataFrame, nodes: DataFrame, homes: DataFrame, k: int) -> DataFrame:
    """One round: every vector is compared with the neighbours of its neighbours, in both directions.

    ``homes`` (id, home) gathers vectors that are near each other; a home fetches each vector it needs once.
    """
    back = best_lists(graph.select(F.col("w").alias("u"), F.col("u").alias("w"), "s"), k)
    near = saved(graph.unionByName(back).select("u", "w").distinct())
    lists = near.groupBy("u").agg(F.collect_list("w").alias("around"))  # at most 2k each
    second = near.join(lists.withColumnRenamed("u", "w"), "w").select("u", F.array_append("around", F.col("w")).alias("around"))
    asks = second.join(homes.withColumnRenamed("id", "u"), "u").select("home", "u", "around")
    asks = saved(asks.groupBy("home", "u").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("around")))
    wanted = asks.select(F.col("home").alias("place"), F.explode("around").alias("id")).unionByName(asks.select(F.col("home").alias("place"), F.col("u").alias("id"))).distinct()
    vectors = wanted.join(nodes, "id").select("place", "id", "v")

    def compare(asked: pa.Table, known: pa.Table) -> pa.Table:
        ids, raw = np.asarray(known["id"].combine_chunks()), known["v"].to_pylist()
        order = np.argsort(ids)
        ids = ids[order]
        out: list[list[np.ndarray]] = [[], [], []]
        x = np.frombuffer(b"".join(raw[i] for i in order), np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        for u, around in zip(asked["u"].to_pylist(), asked["around"], strict=True):
            w = around.values.to_numpy()
            w = w[w != u]
            at = np.searchsorted(ids, w)
            scores = x[at] @ x[np.searchsorted(ids, u)]
            top = _top(scores[None], k)[0]
            out[0].append(np.full(len(top), u))
            out[1].append(w[top])
            out[2].append(scores[top])
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, t) for n, c, t in zip(("u", "w", "s"), out, (np.int64, np.int64, np.float64), strict=True)})

    found = asks.groupBy("home").cogroup(vectors.groupBy("place")).applyInArrow(compare, "u long, w long, s double")
    return best_lists(graph.unionByName(found), k)


def audit(nodes: DataFrame, classes: DataFrame, links: DataFrame, members: DataFrame, threshold: float, sample: int = 64) -> float:
    """Share of the true links of a sample that are among the links (a, b) or join two ``members`` (id, component) of one
    component, all of whose links are counted.

    The sample has ``sample`` vectors of each of the ``classes`` (id, class), chosen by a hash. The share is the lowest of
    that of all and those of the classes with LEAST_TRUE true links at least.
    """
    dealt = Window.partitionBy("class").orderBy(F.xxhash64("id", F.lit("audit")), "id")
    chosen = classes.withColumn("r", F.row_number().over(dealt)).where(F.col("r") <= sample).select("id", "class")
    rows = nodes.join(chosen, "id").collect()
    known: dict[int, list] = {}
    for r in rows:
        known.setdefault(r["dim"], []).append(r)
    asked = {d: (np.array([r["id"] for r in own]), np.array([r["class"] for r in own]), np.frombuffer(b"".join(bytes(r["v"]) for r in own), np.float64).reshape(len(own), d)) for d, own in known.items()}

    def against(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, dims, raw = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
        for d, (q, kind, x) in asked.items():
            own = np.flatnonzero(dims == d)
            y = np.frombuffer(b"".join(raw.take(pa.array(own)).to_pylist()), np.float64).reshape(len(own), d)
            i, j = np.nonzero(y @ x.T >= threshold)
            i, j = i[ids[own[i]] != q[j]], j[ids[own[i]] != q[j]]
            yield {"a": ids[own[i]], "b": q[j], "class": kind[j]}

    true = saved(map_arrow(nodes, against, "a long, b long, class long"))
    ends = [members.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    marked = true.join(links.withColumn("linked", F.lit(1)), ["a", "b"], "left").join(ends[0], "a", "left").join(ends[1], "b", "left")
    found = F.col("linked").isNotNull() | F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))
    counts = marked.groupBy("class").agg(F.count("*").alias("n"), F.sum(found.cast("long")).alias("f")).collect()
    if not counts:
        return 1.0
    return min([sum(r["f"] for r in counts) / sum(r["n"] for r in counts), *[r["f"] / r["n"] for r in counts if r["n"] >= LEAST_TRUE]])


def audit_classes(nodes: DataFrame, graph: DataFrame, components: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """(id, class): vectors by the magnitude of their component and by whether their list is full; those without a link by
    whether their best neighbour is near the threshold."""
    sizes = components.groupBy("component").agg(F.floor(F.log2(F.count("*"))).alias("class"))
    grouped = components.join(sizes, "component").select("id", "class")
    best = graph.groupBy(F.col("u").alias("id")).agg(F.max("s").alias("best"))
    rows = nodes.select("id").join(grouped, "id", "left").join(best, "id", "left").join(full.select("id", F.lit(1).alias("full")), "id", "left")
    single = F.when(F.col("best") >= threshold - MARGIN, -1).otherwise(-2)
    return rows.select("id", (2 * F.coalesce("class", single) + F.coalesce("full", F.lit(0))).cast("long").alias("class"))


def block_links(members: DataFrame, nodes: DataFrame, threshold: float, key: str = "component") -> DataFrame:
    """(id, other, n): how many others with its ``key`` each vector of ``members`` (id, component, key) links with
    (``other`` is null there), and for each component but its own that it links with a vector of that (``n`` is null).

    What has one key is compared chunk by chunk, whatever its size; only counts and one link a component leave a task.
    """
    sizes = members.groupBy(key).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    rows = members.join(sizes, key).join(nodes.select("id", "v"), "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    rows = saved(rows.select(F.col(key).alias("place"), F.col("component").alias("own"), "chunks", "chunk", "id", "v"))
    left = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("side", F.lit(0))
    right = rows.withColumn("other", F.col("chunk")).drop("chunk").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("side", F.lit(1))
    both = left.select("place", "chunk", "other", "side", "own", "id", "v").unionByName(right.select("place", "chunk", "other", "side", "own", "id", "v"))

    def count(table: pa.Table) -> pa.Table:
        side, ids, x = np.asarray(table["side"].combine_chunks()), np.asarray(table["id"].combine_chunks()), _matrix(table["v"])
        own = np.asarray(table["own"].combine_chunks())
        a, b = side == 0, side == 1
        near = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None])
        i, j = np.nonzero(near & (own[a][:, None] != own[b][None]))
        _, first = np.unique(np.stack([i, own[b][j]]), axis=1, return_index=True)
        n = near.sum(1).astype(np.int64)
        some, none = n > 0, np.zeros(len(first), bool)
        ends = np.concatenate([np.zeros(some.sum(), np.int64), ids[b][j[first]]])
        is_count = np.concatenate([some[some], none])
        return pa.table({"id": np.concatenate([ids[a][some], ids[a][i[first]]]), "other": pa.array(ends, mask=is_count), "n": pa.array(np.concatenate([n[some], np.zeros(len(first), np.int64)]), mask=~is_count)})

    return both.groupBy("place", "chunk", "other").applyInArrow(count, "id long, other long, n long")


def counted(found: DataFrame) -> DataFrame:
    return found.where("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))


def cells(full: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(cell, dim, component, id, radius, v): vectors of ``full`` (id, component) around one of them, the id of which is
    the cell's name, at a cosine of ``threshold`` at least; ``radius`` is the angle to it."""
    sizes = full.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    rows = full.join(sizes, "component").join(nodes, "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, x = np.asarray(table["id"].combine_chunks()), _matrix(table["v"])
        lead, angle, free = np.full(len(ids), -1), np.zeros(len(ids)), np.ones(len(ids), bool)
        while free.any():
            at = int(np.argmax(free))
            cosine = x @ x[at]
            near = free & (cosine >= threshold)
            near[at] = True
            lead[near], angle[near], free[near] = at, np.arccos(np.clip(cosine[near], -1, 1)), False
        return pa.table({"cell": ids[lead], "dim": table["dim"], "component": table["component"], "id": ids, "radius": angle, "v": table["v"]})

    return rows.select("component", "chunk", "dim", "id", "v").groupBy("component", "chunk").applyInArrow(gather, "cell long, dim int, component long, id long, radius double, v binary")


def links_across(full: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a link of each two cells of vectors with full lists that are in different components and link.

    Full lists may hide such links, however good they are. The cells' middles are all compared, blocks against blocks; by
    the angles between them and their radii, two cells are left out where no pair can be near enough, else compared whole.
    """
    around = saved(cells(full, nodes, threshold))
    middles = around.groupBy("cell", "dim", "component").agg(F.max("radius").alias("radius"), F.max(F.when(F.col("id") == F.col("cell"), F.col("v"))).alias("v"))
    chunks = max(1, math.ceil(middles.count() / (4 * CHUNK)))
    dealt = middles.withColumn("home", F.pmod(F.xxhash64("cell"), F.lit(chunks)))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    dealt = dealt.withColumn("low", F.least("home", "with")).withColumn("high", F.greatest("home", "with"))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def near(table: pa.Table) -> pa.Table:
        ids, own, home = (np.asarray(table[c].combine_chunks()) for c in ("cell", "component", "home"))
        r, x = np.asarray(table["radius"].combine_chunks()), _matrix(table["v"])
        a, b = home == table["low"][0].as_py(), home == table["high"][0].as_py()
        most = np.minimum(r[a][:, None] + r[b][None] + reach, math.pi)
        ok = (x[a] @ x[b].T >= np.cos(most) - 1e-9) & (own[a][:, None] != own[b][None])
        i, j = np.nonzero(ok)
        p, q = ids[a][i], ids[b][j]
        return pa.table({"p": np.minimum(p, q), "q": np.maximum(p, q)})

    pairs = dealt.select("dim", "low", "high", "home", "cell", "component", "radius", "v").groupBy("dim", "low", "high").applyInArrow(near, "p long, q long").distinct()
    pairs = saved(pairs)
    vectors = around.select("cell", "id", "v")
    sides = [pairs.join(vectors.withColumnRenamed("cell", c), c).select("p", "q", F.lit(i).alias("side"), "id", "v") for i, c in enumerate("pq")]

    def first(table: pa.Table) -> pa.Table:
        side, ids, x = np.asarray(table["side"].combine_chunks()), np.asarray(table["id"].combine_chunks()), _matrix(table["v"])
        a, b = side == 0, side == 1
        i, j = np.nonzero(x[a] @ x[b].T >= threshold)
        return pa.table({"a": ids[a][i[:1]], "b": ids[b][j[:1]]})

    return sides[0].unionByName(sides[1]).groupBy("p", "q").applyInArrow(first, "a long, b long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, k: int = K, max_rounds: int = 6, recall: float = 0.98, seed: int = 11
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: links are pairs with a cosine of ``threshold`` at least.

    Starts from the nearest vectors within random trees' leaves, refines the lists of ``k`` neighbours by neighbours of
    neighbours until a round finds hardly any new link, and audits the recall of a sample by brute force; if it is too
    low, more trees and rounds follow, and in the end a comparison of all by blocks. A list whose every entry is a link is
    saturated: links between saturated vectors of different components are looked for apart, and the links of their whole
    components are counted by blocks instead. Labels are not looked at.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths; rows of one vec_id are one vector (the smallest) and get equal results; a null vec_id links with nothing and
    has a null component; an empty table gives an empty one.
    """
    limit = threshold - SLACK * 1e-6
    rows = vectors.select("vec_id", "embedding")
    nodes = saved(unit_vectors(rows))
    count = nodes.count()
    trees = 2 + max(0, math.ceil(math.log2(max(1, count / LEAF))))
    graph = None
    for attempt in range(3):
        dealt = leaves(nodes, range(attempt * trees, (attempt + 1) * trees), count, seed)
        edges = leaf_edges(dealt, max(4, k // 2))
        graph = saved(best_lists(edges if graph is None else edges.unionByName(graph), k))
        if not attempt:
            homes = saved(leaves(nodes, range(1), count, seed).select("id", F.xxhash64("dim", "leaf", "part").alias("home")))
        strong = -1
        for _ in range(max_rounds):
            now = graph.where(F.col("s") >= limit).count()
            if now - strong <= 0.002 * now:
                break
            strong = now
            graph = saved(refine(graph, nodes, homes, k))
        edges = graph.where(F.col("s") >= limit)
        links = saved(edges.select(F.col("u").alias("a"), F.col("w").alias("b")).unionByName(edges.select(F.col("w").alias("a"), F.col("u").alias("b"))).distinct())
        components = saved(connected_components(links))
        full = edges.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("u").alias("id"))
        full = saved(components.join(full, "id"))
        across = saved(links_across(full, nodes, limit))
        if not across.isEmpty():
            components = saved(connected_components(links.unionByName(across)))
        saturated = components.join(full.select("id"), "id").select("component").distinct()
        members = saved(components.join(saturated, "component"))
        good = audit(nodes, audit_classes(nodes, graph, components, full, limit), links, members, limit) >= recall
        if good:
            break
    own = links.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("id"), "n")
    if good:
        more = counted(block_links(members, nodes, limit))
    else:
        everyone = nodes.select("id", "dim").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
        found = saved(block_links(everyone, nodes, limit, "dim"))
        more = counted(found)
        joins = found.where("n IS NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
        components = saved(connected_components(joins.unionByName(components.select(F.col("id").alias("a"), F.col("component").alias("b")))))
    n_links = own.join(more.select("id", F.col("n").alias("m")), "id", "full").select("id", F.coalesce("m", "n").alias("n_links"))
    found = components.join(n_links, "id", "left").select(F.col("id").alias("vec_id"), "n_links", "component")
    component = F.coalesce("component", "vec_id")
    return rows.join(found, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
