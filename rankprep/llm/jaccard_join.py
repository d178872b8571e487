"""N-gram Jaccard join: globally ordered n-gram sets, stored in prefix trees that are traversed to find the pairs.

Only n-grams that several documents hold can make an overlap, and almost all n-grams of prose are held by one. They are
counted exactly, in sorted runs that travel as compressed blobs, and each document gets back those that it shares. Sets
whose n-grams are ordered from rare to frequent then fall into small blocks by the n-grams of their prefixes; the sets of
a block meet once, in one task, as a prefix tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Rolling, anti_join, arrow_schema, as_batch, connected_components, free_name, key_groups, map_arrow, mix, release, saved, signed, text_slices, words

#: n-grams are told apart by so many leading bits of their hashes.
BITS = 56
#: n-grams, and documents, that one task sorts at a time.
RUN_GRAMS, RUN_DOCS = 1 << 19, 1 << 14
#: A block of more sets or n-grams than these is dealt over several tasks, two parts of it to each.
PART_SETS, PART_GRAMS = 4000, 2_000_000
#: (probe, n-gram) cells, and (path, n-gram) look-ups, in memory at a time.
CELLS, LOOKUPS = 1 << 25, 1 << 21


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the n-grams of lower-cased words of each text; fewer words count as one gram."""
    _, _, at, hashes = words(data, offsets, lower=True)
    rolling = Rolling(hashes)
    grams = rolling.windows(n)
    whole = rolling(at[:-1], at[1:])
    out = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else whole[i : i + 1] if b > a else grams[:0])
    return out


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2): size and 128-bit signature of each set; equal sets have equal signatures."""

    def emit(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b, data, offsets in text_slices(batch):
            sets = ngram_sets(data, offsets, n)
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, U64)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(x)]) for x in (flat, mix(flat ^ U64(0x5BD1E995)))]
            yield {"doc_id": batch.column(0).slice(a, b - a), "n_shingles": sizes, **{f"s{i + 1}": signed(x[edge[1:]] - x[edge[:-1]]) for i, x in enumerate(sums)}}

    return map_arrow(docs.select("doc_id", "text"), emit, "doc_id long, n_shingles long, s1 long, s2 long")


# ---- n-grams that several documents hold -----------------------------------------------------------------------------


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of numbers as one zstandard frame, byte by byte of their places, which is what compresses."""
    import zstandard

    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueezed(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    rows, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + rows * width].reshape(width, rows).T).view(kind).reshape(rows))
        at += rows * width
    return out


def steps(grams: np.ndarray) -> np.ndarray:
    """Ascending numbers as the first and the steps between them; ``np.cumsum`` takes it back."""
    return np.diff(grams, prepend=U64(0))


def _runs(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, run, role, blob): sorted n-grams of a run of documents, by bucket (role 0); the run's documents (role 1)."""
    schema = "bucket int, run long, role int, blob binary"
    target = arrow_schema(docs.sparkSession, schema)
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**BITS / buckets)).astype(U64)

    def cut(ids: list[np.ndarray], sets: list[np.ndarray], run: int) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        grams = np.concatenate(sets) >> U64(64 - BITS)
        order = np.argsort(grams, kind="stable")
        grams, own = grams[order], np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)[order]
        at = np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])
        some = np.flatnonzero(at[1:] > at[:-1])
        blobs = [squeezed(steps(grams[at[i] : at[i + 1]]), own[at[i] : at[i + 1]]) for i in some.tolist()]
        blobs.append(squeezed(np.concatenate(ids).astype(np.int64), sizes.astype(np.int32)))
        return as_batch({"bucket": np.append(some, run % buckets), "run": np.full(len(blobs), run), "role": np.append(np.zeros(len(some), np.int32), 1), "blob": pa.array(blobs, pa.binary())}, target)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, ids, sets, grams = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                own = ngram_sets(data, offsets, n)
                some = np.array([len(s) > 0 for s in own], bool)
                ids.append(np.asarray(batch.column(0).slice(a, b - a))[some])
                sets += [s for s in own if len(s)]
                grams += sum(map(len, own))
                if sets and (grams >= RUN_GRAMS or len(sets) >= RUN_DOCS):
                    yield cut(ids, sets, run)
                    run, ids, sets, grams = run + 1, [], [], 0
        if sets:
            yield cut(ids, sets, run)

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(emit, schema)


def _answered(runs: DataFrame) -> DataFrame:
    """(run, role, blob): of each run and bucket the n-grams that other documents hold too, with how many do."""
    schema = "run long, role int, blob binary"
    target = arrow_schema(runs.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_groups(batches, ["bucket"], rows=1):
            bucket, run, role = (np.asarray(table[c].combine_chunks()) for c in ("bucket", "run", "role"))
            for b in np.unique(bucket).tolist():
                at = np.flatnonzero((bucket == b) & (role == 0)).tolist()
                out: list[tuple[int, int, bytes]] = [(int(run[i]), 1, table["blob"][i].as_py()) for i in np.flatnonzero((bucket == b) & (role == 1)).tolist()]
                if at:
                    parts = [unsqueezed(table["blob"][i].as_py(), "<u8", "<u4") for i in at]
                    own = [p[1] for p in parts]
                    edge = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                    grams = np.concatenate([np.cumsum(p[0]) for p in parts])
                    order = np.argsort(grams, kind="stable")
                    low = grams[order]
                    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                    times = np.diff(np.append(new, len(low)))
                    held = np.empty(len(low), np.int64)
                    held[order] = np.repeat(times, times)
                    for k, i in enumerate(at):
                        x = slice(edge[k], edge[k + 1])
                        some = held[x] > 1
                        if some.any():
                            out.append((int(run[i]), 0, squeezed(steps(grams[x][some]), own[k][some], np.minimum(held[x][some], 65535).astype(np.uint16))))
                if out:
                    r, kind, blob = zip(*out, strict=True)
                    yield as_batch({"run": list(r), "role": list(kind), "blob": pa.array(blob, pa.binary())}, target)

    return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, schema)


def shared_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n, prefix, grams) of the documents that may be similar to another one.

    ``grams`` are the n-grams of the set that other documents hold too (a blob of ascending hashes), ``n`` is the size
    of the whole set. ``prefix`` are those among the first n - ceil(n * percent / 100) + 1 in the global order, by number
    of holders, then hash; n-grams of one holder come first and match nothing, so where they fill the prefix the
    document is left out.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n int, prefix array<bigint>, grams binary"
    target = arrow_schema(spark, schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_groups(batches, ["run"], rows=1):
            run, role = (np.asarray(table[c].combine_chunks()) for c in ("run", "role"))
            for r in np.unique(run).tolist():
                at = np.flatnonzero((run == r) & (role == 0)).tolist()
                head = np.flatnonzero((run == r) & (role == 1)).tolist()
                if not at:
                    continue
                ids, size = unsqueezed(table["blob"][head[0]].as_py(), "<i8", "<i4")
                parts = [unsqueezed(table["blob"][i].as_py(), "<u8", "<u4", "<u2") for i in at]
                grams, own, held = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
                order = np.lexsort((grams, held, own))
                grams, edge = grams[order], np.searchsorted(own[order], np.arange(len(ids) + 1))
                size = size.astype(np.int64)
                left = edge[1:] - edge[:-1] - (size * percent + 99) // 100 + 1
                live = np.flatnonzero(left > 0).tolist()
                if live:
                    yield as_batch(
                        {
                            "doc_id": ids[live],
                            "n": size[live].astype(np.int32),
                            "prefix": [signed(grams[edge[i] : edge[i] + left[i]]) for i in live],
                            "grams": pa.array([squeezed(steps(np.sort(grams[edge[i] : edge[i + 1]]))) for i in live], pa.binary()),
                        },
                        target,
                    )

    return _answered(_runs(docs, n, buckets)).repartition("run").sortWithinPartitions("run").mapInArrow(gather, schema)


# ---- the prefix tree -------------------------------------------------------------------------------------------------


class Trie:
    """The prefix tree of ordered sets; a node is a stretch of a path, its sets are a range of the sets in lexical order.

    Stretches get longer with depth (8, 8, 16, 32, ... n-grams), so long sets have few levels.
    """

    def __init__(self, grams: np.ndarray, at: np.ndarray, size: np.ndarray, turn: np.ndarray):
        self.grams, self.at, self.size, self.turn = grams, at, size, turn
        length = np.diff(at)
        n = len(length)
        common = np.zeros(n, np.int64)
        for i in range(1, n):
            a, b = grams[at[i - 1] : at[i]], grams[at[i] : at[i + 1]]
            k = min(len(a), len(b))
            differ = a[:k] != b[:k]
            common[i] = int(np.argmax(differ)) if differ.any() else k
        equal = np.zeros(n, bool)
        equal[1:] = (common[1:] == length[1:]) & (length[1:] == length[:-1])
        self.levels = []
        start, end = 0, 8
        while start < int(length.max(initial=0)):
            own = np.flatnonzero(length > start)
            first = np.flatnonzero((common[own] < end) & ~equal[own])
            last = np.append(first[1:], len(own)) - 1
            low = own[first]
            ends = np.add.reduceat((length[own] <= end).astype(np.int64), first)
            self.levels.append(
                {
                    "sets": own, "first": first, "low": low, "high": own[last] + 1, "ends": ends, "from": at[low] + start, "to": np.minimum(at[low] + end, at[low + 1]),
                    "least": np.minimum.reduceat(size[own], first), "most": np.maximum.reduceat(size[own], first),
                    "left": np.maximum(np.maximum.reduceat(length[own], first) - end, 0), "turn": np.maximum.reduceat(turn[own], first),
                }
            )
            start, end = end, 2 * end

    def links(self, probes: np.ndarray, label: np.ndarray, percent: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, set) that reach the similarity, among sets of a later turn; not all of those with one label.

        All probes go down together, level by level. What a path has in common with a probe is counted once for all sets
        below it. A branch is left where its sets are of one label, the probe's, or had their turn, or where the overlap so
        far and the shorter of the remaining lengths can't reach what the smallest set below needs.
        """
        at, size = self.at, self.size
        inside = np.zeros((len(probes), width), bool)
        for k, x in enumerate(probes.tolist()):
            inside[k, self.grams[at[x] : at[x + 1]]] = True
        keys = np.concatenate([k * width + self.grams[at[x] : at[x + 1]] for k, x in enumerate(probes.tolist())])
        key_end = np.cumsum([at[x + 1] - at[x] for x in probes.tolist()])
        p, v = np.repeat(np.arange(len(probes)), len(self.levels[0]["low"])), np.tile(np.arange(len(self.levels[0]["low"])), len(probes))
        o = np.zeros(len(p), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for depth, level in enumerate(self.levels):
            one = np.minimum.reduceat(label[level["sets"]], level["first"])
            one = np.where(one == np.maximum.reduceat(label[level["sets"]], level["first"]), one, -1)
            x = probes[p]
            ok = (level["turn"][v] > self.turn[x]) & (one[v] != label[x]) & (level["most"][v] * 100 >= percent * size[x]) & (size[x] * 100 >= percent * level["least"][v])
            p, v, o = p[ok], v[ok], o[ok]
            if not len(p):
                break
            spans = level["to"][v] - level["from"][v]
            cuts = np.searchsorted(np.cumsum(spans), np.arange(LOOKUPS, int(spans.sum()) + LOOKUPS, LOOKUPS), "right")
            kept = []
            for a, b in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True):
                b = max(b, a)
                if a == b:
                    continue
                q, w, span = p[a:b], v[a:b], spans[a:b]
                begin = np.cumsum(span) - span
                place = np.repeat(level["from"][w] - begin, span) + np.arange(int(span.sum()))
                over = o[a:b] + np.add.reduceat(inside[np.repeat(q, span), self.grams[place]], begin, dtype=np.int64)
                own = probes[q]
                rest = key_end[q] - np.searchsorted(keys, q * width + self.grams[level["to"][w] - 1], "right")
                smallest = np.maximum(level["least"][w], -(-percent * size[own] // 100))
                need = -(-percent * (size[own] + smallest) // (100 + percent))
                go = over + np.minimum(rest, level["left"][w]) >= need
                q, w, over, own = q[go], w[go], over[go], own[go]
                ends = level["ends"][w]
                if ends.any():
                    y = np.repeat(level["low"][w] - (np.cumsum(ends) - ends), ends) + np.arange(int(ends.sum()))
                    x, both = np.repeat(own, ends), np.repeat(over, ends)
                    hit = (100 * both >= percent * (size[x] + size[y] - both)) & (self.turn[y] > self.turn[x])
                    found.append((x[hit], y[hit]))
                more = level["high"][w] - level["low"][w] > ends
                kept.append((q[more], w[more], over[more]))
            if depth + 1 == len(self.levels):
                break
            q, w, over = (np.concatenate(c) for c in zip(*kept, strict=True))
            below = self.levels[depth + 1]["low"]
            first = np.searchsorted(below, level["low"][w])
            children = np.searchsorted(below, level["high"][w]) - first
            p, o = np.repeat(q, children), np.repeat(over, children)
            v = np.repeat(first - (np.cumsum(children) - children), children) + np.arange(int(children.sum()))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip((none, none), *found, strict=True))


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after the links (x, y): the smallest of each component."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.get(i, i) != i:
            root[i] = root.get(root[i], root[i])
            i = root[i]
        return i

    for a, b in np.unique(np.stack([label[x], label[y]], 1), axis=0).tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    old = np.array(list(root), np.int64)
    if not len(old):
        return label
    to = np.arange(len(label))
    to[old] = [find(i) for i in old.tolist()]
    return to[label]


def block_labels(sets: list[np.ndarray], size: np.ndarray, percent: int) -> np.ndarray:
    """For each set of shared n-grams the first set of its component. ``size`` counts the n-grams not shared, too.

    The n-grams are ordered anew, by how many sets of the block hold them. The sets take turns as probes, the most
    central first, which soon gives most members of a class of near copies one label.
    """
    label = np.arange(len(sets))
    flat = np.concatenate(sets)
    own = np.repeat(label, [len(s) for s in sets])
    _, inverse, held = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(held), np.int64)
    rank[np.lexsort((np.arange(len(held)), held))] = np.arange(len(held))
    center = np.bincount(own, weights=held[inverse], minlength=len(sets)) / size
    shared = held[inverse] > 1
    flat, own = rank[inverse[shared]] - int((held == 1).sum()), own[shared]
    width = int((held > 1).sum())
    fits = np.bincount(own, minlength=len(sets)) * 100 >= percent * size  # a partner has percent of this set at least
    keys = np.sort((own * width + flat)[fits[own]])
    own, flat = keys // max(1, width), keys % max(1, width)
    edge = np.searchsorted(own, np.arange(len(sets) + 1))
    lexical = sorted(np.flatnonzero(fits).tolist(), key=lambda i: flat[edge[i] : edge[i + 1]].astype(">u4").tobytes())
    if len(lexical) < 2:
        return label
    order = np.array(lexical)
    at = np.concatenate([[0], np.cumsum(edge[order + 1] - edge[order])])
    turn = np.empty(len(order), np.int64)
    turn[np.lexsort((np.arange(len(order)), -center[order]))] = np.arange(len(order))
    trie = Trie(np.concatenate([flat[edge[i] : edge[i + 1]] for i in lexical]), at, size[order], turn)
    by_turn = np.argsort(turn)
    inner, done, step = np.arange(len(order)), 0, 1
    while done < len(order) and inner.any():
        x, y = trie.links(by_turn[done : done + step], inner, percent, width)
        inner = _joined(inner, x, y)
        done, step = done + step, min(4 * step, 256, max(1, CELLS // width))
    # from places in lexical order to the first of each component
    first = np.full(len(order), len(sets))
    np.minimum.at(first, inner, order)
    label[order] = first[inner]
    return label


def block_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): each document of (block, part, doc_id, n, grams) with the smallest that links reach in its part."""
    schema = "a long, b long"
    target = arrow_schema(members.sparkSession, schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_groups(batches, ["block", "part"], rows=2000):
            block, part, ids, size = (np.asarray(table[c].combine_chunks()) for c in ("block", "part", "doc_id", "n"))
            edges = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1, [len(block)]]).tolist()
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    sets = [np.cumsum(unsqueezed(x, "<u8")[0]) for x in table["grams"][a:b].to_pylist()]
                    label = block_labels(sets, size[a:b].astype(np.int64), percent)
                    low = np.full(b - a, np.iinfo(np.int64).max)
                    np.minimum.at(low, label, ids[a:b])
                    low = low[label]
                    out.append((ids[a:b][low != ids[a:b]], low[low != ids[a:b]]))
            if out:
                x, y = (np.concatenate(c) for c in zip(*out, strict=True))
                if len(x):
                    yield as_batch({"a": x, "b": y}, target)

    return members.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(join, schema)


# ---- the join --------------------------------------------------------------------------------------------------------


def similar_classes(docs: DataFrame, n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles) of all documents, and (doc_id, component) of those linked with smaller ones.

    1. Equal sets are one class, by signature; one member stands for it from here on.
    2. Every document gets back the n-grams of its set that others hold, see ``shared_sets``.
    3. Similar sets share an n-gram of their prefixes: what such n-grams connect is a block, and no link leaves it.
    4. Each block is a prefix tree in one task. A block of very many sets is dealt out in parts; any two parts meet in a
       task, and the links of all tasks are joined.
    """
    sets = saved(set_rows(docs, n))
    known = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    of = known.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    of = saved(of)  # a table of its own, so that Spark can split the rows of a frequent text over tasks
    copies = saved(known.join(of, ["s1", "s2", "n_shingles"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    twice = saved(known.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    several = not twice.isEmpty()
    settled = copies.select(F.col("a").alias("doc_id"))
    settled = settled.join(twice, "doc_id", "left_anti") if several else settled

    live = saved(shared_sets(anti_join(docs.select("doc_id", "text"), settled), n, percent))
    live_ones = live if several else live.join(settled, "doc_id", "left_anti")
    posted = live_ones.select("doc_id", F.explode("prefix").alias("gram"))
    groups = posted.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("gram", "low")
    blocks = saved(connected_components(posted.join(groups, "gram").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))))
    members = live.select("doc_id", "n", "grams").join(blocks.select(F.col("id").alias("doc_id"), F.col("component").alias("block")), "doc_id")

    grams = F.length("grams") / 6  # compressed, an n-gram takes about so many bytes
    big = members.groupBy("block").agg(F.count("*").alias("sets"), F.sum(grams).alias("weight"))
    big = saved(big.select("block", F.ceil(F.greatest(F.col("sets") / PART_SETS, F.col("weight") / PART_GRAMS)).alias("parts")).where("parts > 1"))
    one = members.join(F.broadcast(big) if big.count() <= 100_000 else big, "block", "left_anti").withColumn("part", F.lit(0).cast("long"))
    links, parted = block_links(one, percent), not big.isEmpty()
    if parted:
        own = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
        dealt = members.join(big, "block").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("own <> other")
        part = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
        links = links.unionByName(block_links(dealt.select("block", part.cast("long").alias("part"), "doc_id", "n", "grams"), percent))
    links = saved(links)
    release(of, live, blocks, big)
    if parted or several:
        found = saved(connected_components(links.unionByName(copies)).select(F.col("id").alias("doc_id"), "component").where("component < doc_id"))
    else:
        of_rep = links.select(F.col("a").alias("b"), F.col("b").alias("component"))
        found = links.select(F.col("a").alias("doc_id"), F.col("b").alias("component")).unionByName(copies.join(of_rep, "b", "left").select(F.col("a").alias("doc_id"), F.coalesce("component", "b").alias("component")))
    return sets.select("doc_id", "n_shingles"), found


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: near-duplicate classes by Jaccard similarity of n-gram sets.

    Two documents link when 100 * intersection >= percent * union of their sets of lower-cased word n-grams; the
    component is the smallest doc_id that links reach. Null and empty texts have empty sets and link with nothing, nor
    does a null doc_id (its component is null); texts with fewer words are one gram; repeated rows of one doc_id are one
    document with the sets of each; very long texts are sets like any others; columns but doc_id and text are not looked
    at; an empty table gives an empty one.
    """
    sets, found = similar_classes(docs, n, percent)
    return sets.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: the one whose doc_id is the component.

    Of repeated rows of one doc_id one stays (the smallest text); rows with a null doc_id stay.
    """
    _, found = similar_classes(docs, n, percent)
    kept = anti_join(docs, found.select("doc_id"))
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    nth = free_name(docs.columns, "_nth")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    single = kept.join(twice, "doc_id").select(*docs.columns, first.alias(nth)).where(F.col(nth) == 1).drop(nth)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(single)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
