"""Draws over a whole catalogue in proportion to a kernel of the score, without scoring all of it.

Items, in the order of their ids, are the leaves of a tree. A node keeps summed features of its items from which its weight
follows for any query: of alpha s^2 + 1 the sum of the products x x', of max(s, least) the sum of the vectors, with a
ball around them that tells on which side of ``least`` all scores are. A draw goes down from the root, at each node to the
child that its share of the weight falls into, and scores the items of one leaf only. The tree, the order of the items
and the arithmetic are the same for any size; what differs is whether a level is in memory or met by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import uniform
from ..tables import release, saved
from . import retrieval
from .ids import with_row_number

#: Rows (query, node) that meet a node in one task.
ROWS = 20_000
OUT = "query_id long, draw int, item_id long, log_q double"
_FRONTIER = "query_id long, vec array<double>, node long, d array<struct<draw:int,rest:double,z:double>>"


class _Kernel:
    """``leaf`` items make a leaf and ``fanout`` nodes one above them; both are part of the order of the arithmetic."""

    def __init__(self, leaf: int = 128, fanout: int = 32):
        self.leaf, self.fanout = leaf, fanout


class Sphere(_Kernel):
    """alpha s^2 + 1: s^2 = q' x x' q, so a node keeps the sum of x x' (its upper half) and its number of items."""

    def __init__(self, alpha: float, **shape: int):
        super().__init__(**shape)
        self.alpha = alpha

    def weights(self, scores: np.ndarray) -> np.ndarray:
        return self.alpha * scores**2 + 1

    def features(self, x: np.ndarray) -> np.ndarray:
        i, j = np.triu_indices(x.shape[1])
        return np.append((x.T @ x)[i, j], float(len(x)))

    def combined(self, f: np.ndarray) -> np.ndarray:
        return f.sum(0)

    def masses(self, q: np.ndarray, f: np.ndarray) -> np.ndarray:
        i, j = np.triu_indices(q.shape[1])
        return self.alpha * (q[:, i] * q[:, j] * np.where(i == j, 1.0, 2.0)) @ f[:, :-1].T + f[:, -1]


class Clamped(_Kernel):
    """max(s, least): a node keeps the sum of its vectors, their number and the radius of a ball around their mean.

    Where the ball lies on one side of ``least`` the node's weight follows, else it is not known (nan) and is found from
    its children.
    """

    def __init__(self, least: float, **shape: int):
        super().__init__(**shape)
        self.least = least

    def weights(self, scores: np.ndarray) -> np.ndarray:
        return np.maximum(scores, self.least)

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x.sum(0), [float(len(x)), np.linalg.norm(x - x.mean(0), axis=1).max()]])

    def combined(self, f: np.ndarray) -> np.ndarray:
        total, n = f[:, :-2].sum(0), f[:, -2].sum()
        away = np.linalg.norm(f[:, :-2] / f[:, -2:-1] - total / n, axis=1) + f[:, -1]
        return np.concatenate([total, [n, away.max()]])

    def masses(self, q: np.ndarray, f: np.ndarray) -> np.ndarray:
        s, n = q @ f[:, :-2].T, f[:, -2]
        reach = np.linalg.norm(q, axis=1)[:, None] * f[:, -1] * (1 + 1e-9) + 1e-12
        return np.where(s / n - reach >= self.least, s, np.where(s / n + reach <= self.least, n * self.least, np.nan))


Kernel = Sphere | Clamped
#: Of the levels in memory, by level: node -> features of its children, on level 0 node -> (ids, vectors).
Memory = dict[int, dict[int, object]]


class Tree:
    """``tables`` by level: (node, f), f the features of all children one after the other, on level 0 (node, ids, x);
    ``memory`` has the levels from the root on that are small enough together, all of them for a small catalogue."""

    def __init__(self, kernel: Kernel, top: int, memory: Memory, tables: dict[int, DataFrame]):
        self.kernel, self.top, self.memory, self.tables = kernel, top, memory, tables
        self.bottom = min(memory) if memory else 0


def build(items: DataFrame, kernel: Kernel) -> Tree:
    return _in_memory(items, kernel) if retrieval.is_small(items) else _by_jobs(items, kernel)


def _in_memory(items: DataFrame, kernel: Kernel) -> Tree:
    ids, x = retrieval.catalogue(items)
    memory: Memory = {0: {k: (ids[a : a + kernel.leaf], x[a : a + kernel.leaf]) for k, a in enumerate(range(0, len(ids), kernel.leaf))}}
    f = [kernel.features(part) for _, part in memory[0].values()]
    top = 0
    while f:
        top += 1
        memory[top] = {k: np.stack(f[a : a + kernel.fanout]) for k, a in enumerate(range(0, len(f), kernel.fanout))}
        f = [kernel.combined(part) for part in memory[top].values()]
        if len(f) == 1:
            break
    return Tree(kernel, top, memory if len(ids) else {}, {})


def _by_jobs(items: DataFrame, kernel: Kernel) -> Tree:
    """Level by level, each a fanout-th of the one below; the upper levels are fetched as long as they are small."""
    ranked = with_row_number(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("vec").cast("array<double>").alias("vec")), ["item_id"], "_row")

    def leaf(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_row")
        x = retrieval._matrix(rows["vec"])
        return pa.table({"node": [rows["_row"][0].as_py() // kernel.leaf], "ids": pa.array([rows["item_id"].to_pylist()], pa.list_(pa.int64())), "x": pa.array([x.ravel()], pa.list_(pa.float64())), "own": pa.array([kernel.features(x)], pa.list_(pa.float64()))})

    def parent(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        f = retrieval._matrix(rows["own"])
        return pa.table({"node": [rows["node"][0].as_py() // kernel.fanout], "f": pa.array([f.ravel()], pa.list_(pa.float64())), "own": pa.array([kernel.combined(f)], pa.list_(pa.float64()))})

    above = lambda c, n: F.floor(F.col(c) / n).cast("long").alias("_above")
    tables = {0: saved(ranked.groupBy(above("_row", kernel.leaf)).applyInArrow(leaf, "node long, ids array<long>, x array<double>, own array<double>"))}
    numbers = {0: tables[0].agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0]}
    top = 0
    while numbers[0]:
        top += 1
        tables[top] = saved(tables[top - 1].groupBy(above("node", kernel.fanout)).applyInArrow(parent, "node long, f array<double>, own array<double>"))
        nodes, numbers[top] = tables[top].agg(F.count("*"), F.sum(F.size("f"))).first()
        if nodes == 1:
            break
    memory: Memory = {}
    held = 0
    for level in range(top, 0, -1):
        held += numbers[level]
        if held > max(retrieval.BROADCAST, numbers[top]):
            break
        memory[level] = {r["node"]: np.array(r["f"]).reshape(-1, len(r["own"])) for r in tables[level].collect()}  # counted
    return Tree(kernel, top, memory, tables)


# ---- going down ------------------------------------------------------------------------------------------------------


def _node_masses(kernel: Kernel, memory: Memory, level: int, node: int, q: np.ndarray, rows: np.ndarray, known: dict) -> np.ndarray:
    """(row, child): the weights of a node's children for the queries ``rows``. Those that don't follow from the features are
    summed further down, or, below what is in memory, looked up in ``known`` by (row, child); what is not there stays nan."""
    m = kernel.masses(q[rows], memory[level][node])
    for c in np.flatnonzero(np.isnan(m).any(0)):
        bad = np.flatnonzero(np.isnan(m[:, c]))
        child = node * kernel.fanout + int(c)
        if level - 1 == 0 and 0 in memory:
            m[bad, c] = kernel.weights(q[rows[bad]] @ memory[0][child][1].T).sum(1)
        elif level - 1 in memory:
            m[bad, c] = _node_masses(kernel, memory, level - 1, child, q, rows[bad], known).sum(1)
        else:
            m[bad, c] = [known.get((int(r), child), np.nan) for r in rows[bad]]
    return m


def _chosen(m: np.ndarray, row: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each draw the column of m[row] that ``rest`` falls into, and what is left of it there."""
    run = np.cumsum(m, 1)
    last = m.shape[1] - 1 - np.argmax(m[:, ::-1] > 0, 1)
    at = np.minimum((run[row] <= rest[:, None]).sum(1), last[row])
    return at, rest - np.where(at > 0, run[row, np.maximum(at - 1, 0)], 0.0)


def _go_down(tree: Tree, memory: Memory, q: np.ndarray, row: np.ndarray, u: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each draw (its row of q, its number in [0, 1)) the node below the levels in memory, or the item; what is left
    of its share there, or the item's weight; and the weight of all items."""
    at, z = np.zeros(len(row), np.int64), np.zeros(len(row))
    rest = u
    for level in range(tree.top, max(tree.bottom, 1) - 1, -1):
        after = at.copy()
        for node in np.unique(at):
            mine = np.flatnonzero(at == node)
            rows, back = np.unique(row[mine], return_inverse=True)
            m = _node_masses(tree.kernel, memory, level, int(node), q, rows, known)
            if level == tree.top:
                z = m.sum(1)[back]
                rest = u * z
            child, rest[mine] = _chosen(m, back, rest[mine])
            after[mine] = node * tree.kernel.fanout + child
        at = after
    if tree.bottom:
        return at, rest, z, at
    found, weight = np.zeros(len(row), np.int64), np.zeros(len(row))
    for node in np.unique(at):
        mine = np.flatnonzero(at == node)
        rows, back = np.unique(row[mine], return_inverse=True)
        ids, x = memory[0][int(node)]
        w = tree.kernel.weights(q[rows] @ x.T)
        child, _ = _chosen(w, back, rest[mine])
        found[mine], weight[mine] = ids[child], w[back, child]
    return found, weight, z, at


def _frontier(ids: np.ndarray, vecs: np.ndarray, row: np.ndarray, node: np.ndarray, draw: np.ndarray, rest: np.ndarray, z: np.ndarray) -> pa.Table:
    """One row for each query and node, with its draws."""
    order = np.lexsort((draw, node, row))
    row, node, draw, rest, z = row[order], node[order], draw[order], rest[order], z[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (node[1:] != node[:-1])
    first = np.flatnonzero(new)
    d = pa.StructArray.from_arrays([pa.array(draw, pa.int32()), pa.array(rest), pa.array(z)], ["draw", "rest", "z"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), d)
    width = vecs.shape[1]
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(first) + 1) * width, width), pa.int32()), pa.array(vecs[row[first]].ravel()))
    return pa.table({"query_id": pa.array(ids[row[first]], pa.int64()), "vec": flat, "node": node[first], "d": lists})


def sample(queries: DataFrame, tree: Tree, n: int, seed: int, stage: str) -> DataFrame:
    """(query_id, draw, item_id, log_q) of n draws for each query, p in proportion to the kernel; log_q = ln(n p)."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    spark = queries.sparkSession
    if not tree.top:
        return spark.createDataFrame([], OUT)
    rows = q.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("u", uniform(seed, stage, "query_id", "draw"))
    asked = q.join(rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("draw", "u"))).alias("d")), "query_id")
    asked, unknown = _with_known(asked, q, tree)
    shared = spark.sparkContext.broadcast(tree.memory)
    plain = Tree(tree.kernel, tree.top, {}, {})
    plain.bottom = tree.bottom
    target = to_arrow_schema(StructType.fromDDL(_FRONTIER if tree.bottom else OUT))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = pa.Table.from_batches([batch.slice(a, 512)])
                ids, x, row, draw, u = _unpacked(part, "draw", "u")
                known = _known(part)
                at, rest, z, _ = _go_down(plain, shared.value, x, row, u, known)
                if plain.bottom:
                    out = _frontier(ids, x, row, at, draw, rest, z)
                else:
                    out = pa.table({"query_id": ids[row], "draw": draw, "item_id": at, "log_q": np.log(n * rest / z)})
                yield from out.cast(target).to_batches()

    frontier = asked.mapInArrow(first, _FRONTIER if tree.bottom else OUT)
    for level in range(tree.bottom - 1, 0, -1):
        frontier = _met(tree, level, saved(frontier), unknown.get(level), _inner(tree.kernel), _FRONTIER)
    return _met(tree, 0, saved(frontier), None, _leaf(tree.kernel, n), OUT) if tree.bottom else frontier


def _with_known(asked: DataFrame, queries: DataFrame, tree: Tree) -> tuple[DataFrame, dict[int, DataFrame]]:
    """``asked`` with own, the weights below memory that features don't tell, where there are any; and those further down."""
    unknown = _weighed(queries, tree) if tree.bottom and isinstance(tree.kernel, Clamped) else {}
    if unknown:
        own = unknown[tree.bottom].groupBy("query_id").agg(F.collect_list(F.struct("child", "mass")).alias("own"))
        asked = asked.join(own, "query_id", "left")
    return asked, unknown


def total_weights(queries: DataFrame, tree: Tree) -> DataFrame:
    """(query_id, total): the weight of all items together, from the root's features; none for an empty catalogue."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    if not tree.top:
        return q.select("query_id", F.lit(0.0).alias("total"))
    asked, _ = _with_known(q, q, tree)
    shared, kernel, top = queries.sparkSession.sparkContext.broadcast(tree.memory), tree.kernel, tree.top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            x = retrieval._matrix(part["vec"])
            if len(x):
                m = _node_masses(kernel, shared.value, top, 0, x, np.arange(len(x)), _known(part))
                yield pa.RecordBatch.from_pydict({"query_id": part["query_id"].combine_chunks(), "total": m.sum(1)})

    return asked.mapInArrow(run, "query_id long, total double")


def _unpacked(part: pa.Table, *fields: str) -> tuple[np.ndarray, ...]:
    """Ids and vectors of the queries; of their draws the row and the fields."""
    d = part["d"].combine_chunks()
    row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(d.offsets)))
    return (np.asarray(part["query_id"].combine_chunks()), retrieval._matrix(part["vec"]), row, *[np.array(d.flatten().field(f)) for f in fields])


def _known(part: pa.Table) -> dict:
    if "own" not in part.column_names:
        return {}
    return {(row, x["child"]): x["mass"] for row, own in enumerate(part["own"].to_pylist()) for x in own or ()}


def _met(tree: Tree, level: int, frontier: DataFrame, own: DataFrame | None, meet, schema: str) -> DataFrame:
    """What ``meet`` makes of the rows (query, node) of each node and the node itself; many rows are dealt out by query."""
    if own is not None:
        lists = own.groupBy("query_id", "node").agg(F.collect_list(F.struct("child", "mass")).alias("own"))
        frontier = frontier.join(lists, ["query_id", "node"], "left")
    salts = frontier.groupBy("node").agg(F.ceil(F.count("*") / ROWS).alias("_salts"))
    rows = frontier.join(salts, "node").withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.col("_salts"))).drop("_salts")
    nodes = tree.tables[level].drop("own").join(salts, "node").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    return rows.groupBy("node", "_salt").cogroup(nodes.groupBy("node", "_salt")).applyInArrow(meet, schema)


def _inner(kernel: Kernel):
    def meet(rows: pa.Table, node: pa.Table) -> pa.Table:
        ids, x, row, draw, rest, z = _unpacked(rows, "draw", "rest", "z")
        m = _filled(kernel, rows, node, x)
        child, rest = _chosen(m, row, rest)
        return _frontier(ids, x, row, node["node"][0].as_py() * kernel.fanout + child, draw, rest, z)

    return meet


def _filled(kernel: Kernel, rows: pa.Table, node: pa.Table, x: np.ndarray) -> np.ndarray:
    f, first = np.asarray(node["f"].combine_chunks().flatten()), node["node"][0].as_py() * kernel.fanout
    m = kernel.masses(x, f.reshape(-1, len(kernel.features(x[:1]))))
    for (r, child), mass in _known(rows).items():
        m[r, child - first] = mass
    return m


def _leaf(kernel: Kernel, n: int):
    def meet(rows: pa.Table, node: pa.Table) -> pa.Table:
        ids, x, row, draw, rest, z = _unpacked(rows, "draw", "rest", "z")
        items = np.asarray(node["ids"].combine_chunks().flatten())
        w = kernel.weights(x @ np.asarray(node["x"].combine_chunks().flatten()).reshape(len(items), -1).T)
        child, _ = _chosen(w, row, rest)
        return pa.table({"query_id": ids[row], "draw": draw, "item_id": items[child], "log_q": np.log(n * w[row, child] / z)})

    return meet


# ---- weights that don't follow from the features ---------------------------------------------------------------------


def _weighed(queries: DataFrame, tree: Tree) -> dict[int, DataFrame]:
    """By level (query_id, node, child, mass): the weights of children that a node's features don't tell, below what is in
    memory. Asked from the top down, only where they are needed, and added up from the leaves."""
    kernel, shared = tree.kernel, queries.sparkSession.sparkContext.broadcast(tree.memory)
    bottom = tree.bottom
    asking = "query_id long, vec array<double>, node long"
    target = to_arrow_schema(StructType.fromDDL(asking))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            x = retrieval._matrix(part["vec"])
            row, child = _open(kernel, shared.value, bottom, x)
            out = pa.table({"query_id": part["query_id"].combine_chunks().take(pa.array(row)), "vec": part["vec"].combine_chunks().take(pa.array(row)), "node": child})
            yield from out.cast(target).to_batches()

    def deeper(rows: pa.Table, node: pa.Table) -> pa.Table:
        x = retrieval._matrix(rows["vec"])
        m = _filled(kernel, rows, node, x)
        one = node["node"][0].as_py()
        r, c = np.nonzero(np.isnan(m))
        at = np.concatenate([np.arange(len(x)), r])  # the sum of what is told, then what is not
        return pa.table({"query_id": rows["query_id"].combine_chunks().take(pa.array(at)), "vec": rows["vec"].combine_chunks().take(pa.array(at)), "node": np.full(len(at), one), "child": pa.array(np.concatenate([np.full(len(x), -1), one * kernel.fanout + c])), "mass": np.concatenate([np.nansum(m, 1), np.zeros(len(r))])})

    def exact(rows: pa.Table, node: pa.Table) -> pa.Table:
        x = retrieval._matrix(rows["vec"])
        items = np.asarray(node["x"].combine_chunks().flatten()).reshape(-1, x.shape[1])
        return pa.table({"query_id": rows["query_id"], "node": rows["node"], "mass": kernel.weights(x @ items.T).sum(1)})

    open_ = saved(queries.mapInArrow(find, asking))
    if not open_.limit(1).count():
        release(open_)
        return {}
    parts: dict[int, DataFrame] = {}
    for level in range(bottom - 1, 0, -1):
        parts[level] = saved(_met(tree, level, open_, None, deeper, f"{asking}, child long, mass double"))
        open_ = saved(parts[level].where("child >= 0").select("query_id", "vec", F.col("child").alias("node")))
    mass = saved(_met(tree, 0, open_, None, exact, "query_id long, node long, mass double"))
    out: dict[int, DataFrame] = {}
    for level in range(1, bottom):
        below = mass.select("query_id", F.col("node").alias("child"), "mass")
        out[level] = saved(parts[level].where("child >= 0").select("query_id", "node", "child").join(below, ["query_id", "child"]))
        told = parts[level].where("child < 0").select("query_id", "node", "mass")
        mass = saved(told.unionByName(out[level].select("query_id", "node", "mass")).groupBy("query_id", "node").agg(F.sum("mass").alias("mass")))
    out[bottom] = mass.select("query_id", F.col("node").alias("child"), "mass")
    return out


def _open(kernel: Kernel, memory: Memory, bottom: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of the nodes just below memory whose weight is not told."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for node, f in memory[bottom].items():
        r, c = np.nonzero(np.isnan(kernel.masses(x, f)))
        found.append((r, node * kernel.fanout + c))
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])
