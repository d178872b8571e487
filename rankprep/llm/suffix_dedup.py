"""Suffix-array deduplication of bytes: maximal repeats from the interval tree of an enhanced suffix array.

A suffix array of all suffixes of a large corpus would be hundreds of times its size, so only the suffixes at sampled
positions are sorted: every string of ``length`` bytes contains, at an offset that depends on its bytes alone, the
smallest hash of its ``seed``-byte windows. Suffixes at these anchors that share the seed form one bucket. Within a
bucket the suffixes are sorted and their common prefixes scanned with a stack, which visits every interval of suffixes
with its common length; an interval's members are told apart by what stands to their left (their left extension), and
each group that agrees far enough is a repeat with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASES, U64, Rolling, arrow_schema, as_batch, joined_bytes, key_groups, map_arrow, mix, packed, saved, signed, slices, text_slices, unpack, with_own_ids

#: Arrow holds strings of less than 2**31 bytes, so their places take 31 bits; the rest of a word orders the hashes.
_PLACE = (1 << 31) - 1


def seed_for(length: int) -> int:
    return max(1, length // 2)


def anchor_positions(seeds: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Places of the smallest seed hash (ties: the first) in each string of ``length`` bytes that lies in one text."""
    span = length - seed + 1
    n = len(seeds) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (seeds & ~U64(_PLACE)) | np.arange(len(seeds), dtype=U64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    starts = np.arange(n)
    doc = np.searchsorted(offsets, starts, "right") - 1
    low = low[:n][starts + length <= offsets[doc + 1]]
    if not len(low):
        return np.zeros(0, np.int64)
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return np.unique(low & U64(_PLACE)).astype(np.int64)


def anchors(docs: DataFrame, length: int = 400) -> DataFrame:
    """(h, u, doc_id, pos): anchors with the hash of their seed and of the whole surroundings that matter to them."""
    seed = seed_for(length)

    def emit(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column(0)
        for a, b, data, offsets in text_slices(batch):
            if len(data) < length:
                continue
            first = Rolling(data)
            at = anchor_positions(first.windows(seed), offsets, length, seed)
            if not len(at):
                continue
            second = Rolling(data, BASES[1])
            doc = np.searchsorted(offsets, at, "right") - 1
            lo, hi = np.maximum(offsets[doc], at - (length - seed)), np.minimum(offsets[doc + 1], at + length)
            whole = mix(second(lo, hi) + (at - lo).astype(U64) * U64(BASES[2]) + (hi - at).astype(U64))
            yield {"h": signed(mix(first(at, at + seed) + second(at, at + seed) * U64(BASES[2]))), "u": signed(whole), "doc_id": ids.slice(a, b - a).take(pa.array(doc)), "pos": at - offsets[doc]}

    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return map_arrow(known, emit, "h long, u long, doc_id long, pos long")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(lcp: list[int], floor: int) -> Iterator[tuple[int, int, int]]:
    """(common length, first, last) of the intervals of suffixes: a scan of neighbours' common lengths with a stack.

    ``lcp[i]`` belongs to suffixes i - 1 and i; lcp[0] is not read. Every interval comes after those inside it.
    """
    stack = [(floor, 0)]
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        left = i - 1
        while stack and stack[-1][0] > now:
            depth, left = stack.pop()
            if i - 1 > left:
                yield depth, left, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def repeats_of(lefts: list[bytes], rights: list[bytes], length: int, seed: int) -> list[tuple[int, int, int]]:
    """(member, bytes before the anchor, bytes from the anchor on) of all repeats in one bucket.

    ``rights`` are sorted; they begin after the seed, ``lefts`` run backwards from the anchor.
    """
    out = []
    lcp = [0] + [seed + _common(a, b) for a, b in zip(rights, rights[1:], strict=False)]
    for depth, lo, hi in intervals(lcp, seed):
        need = max(0, length - depth)
        members = sorted((lefts[i], i) for i in range(lo, hi + 1) if len(lefts[i]) >= need)
        best = [0] * len(members)
        ok = [False] * len(members)
        for j in range(1, len(members)):
            same = _common(members[j - 1][0], members[j][0])
            if same >= need:
                for x in (j - 1, j):
                    best[x], ok[x] = max(best[x], same), True
        out += [(i, best[j], depth) for j, (_, i) in enumerate(members) if ok[j]]
    return out


def _bucket_repeats(blocks: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, stop) of the repeats in buckets (h, doc_id, pos, lefts, rights) that fit one task each."""
    seed = seed_for(length)
    schema = "doc_id long, start long, stop long"
    target = arrow_schema(blocks.sparkSession, schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_groups(batches, ["h"]):
            h, doc, pos = (np.asarray(table[c].combine_chunks()) for c in ("h", "doc_id", "pos"))
            lefts, rights = table["lefts"].to_pylist(), table["rights"].to_pylist()
            edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    out += [(a + i, before, after) for i, before, after in repeats_of(lefts[a:b], rights[a:b], length, seed)]
            if out:
                i, before, after = np.array(out).T
                yield as_batch({"doc_id": doc[i], "start": pos[i] - before, "stop": pos[i] + after}, target)

    return blocks.repartition("h").sortWithinPartitions("h", "rights").mapInArrow(scan, schema)


def _large_bucket_repeats(blocks: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size: offsets of the strings around the anchor are halved until all is decided.

    All strings that contain the seed at offsets lo..hi share a core; together they span a hull. A hull that occurs
    twice means that all of them repeat, a core that occurs once that none does. Only counts by hash are shuffled, so a
    bucket spreads over all tasks.
    """
    reach = length - seed_for(length)
    part = lambda c, n: F.substring(c, F.lit(1), n)
    todo = blocks.select("h", "doc_id", "pos", "lefts", "rights", F.lit(0).alias("lo"), F.lit(reach).alias("hi"))
    found = None
    while True:
        hull = [part("lefts", F.col("hi")), part("rights", F.lit(reach) - F.col("lo"))]
        core = [part("lefts", F.col("lo")), part("rights", F.lit(reach) - F.col("hi"))]
        has = lambda lo, hi: (F.length("lefts") >= lo) & (F.length("rights") >= F.lit(reach) - hi)
        key = lambda salt, parts: F.struct(F.xxhash64("h", "lo", "hi", F.lit(salt), *parts).alias("a"), F.xxhash64(F.lit(salt + 1), *reversed(parts), "h", "lo", "hi").alias("b"))
        todo = saved(todo.where(has(F.col("lo"), F.col("hi"))).withColumn("hull", F.when(has(F.col("hi"), F.col("lo")), key(1, hull))).withColumn("core", key(3, core)))
        hulls = todo.where("hull IS NOT NULL").groupBy("hull").agg(F.count("*").alias("n_hull"), F.min(F.struct("doc_id", "pos")).alias("least"))
        cores = todo.groupBy("core").agg(F.count("*").alias("n_core")).where("n_core > 1")
        seen = saved(todo.join(cores, "core").join(hulls, "hull", "left"))
        done = seen.where("n_hull > 1").select("doc_id", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("stop"))
        found = done if found is None else found.unionByName(done)
        # one row of each hull goes on, as a partner for other hulls with the same core
        rest = seen.where("lo < hi AND (hull IS NULL OR n_core > n_hull AND struct(doc_id, pos) = least)")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        todo = rest.select("h", "doc_id", "pos", "lefts", "rights", F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi")))).alias("o")).select("h", "doc_id", "pos", "lefts", "rights", "o.lo", "o.hi")
        if rest.isEmpty():
            return found


def repeated_spans(texts: DataFrame, docs: DataFrame, length: int = 400, bucket_rows: int = 50_000) -> DataFrame:
    """(doc_id, spans): [start, stop) byte ranges whose strings of ``length`` bytes all start somewhere else too.

    Occurrences with equal surroundings (same ``u``) are settled by counting. Of each such class one occurrence goes to
    its bucket's suffix array, if the bucket has several classes. A bucket of more than ``bucket_rows`` classes is
    decided exactly without gathering it.
    """
    seed = seed_for(length)
    reach = length - seed
    found = anchors(docs, length).repartition("h")
    found = found.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1")
    found = found.withColumn("alike", F.count("*").over(Window.partitionBy("h", "u"))).withColumn("first", F.row_number().over(Window.partitionBy("h", "u").orderBy("doc_id", "pos")) == 1)
    found = found.withColumn("classes", F.sum(F.col("first").cast("int")).over(Window.partitionBy("h")))
    found = saved(found.where("alike > 1 OR classes > 1").select("h", "doc_id", "pos", "alike", (F.col("first") & (F.col("classes") > 1)).alias("open"), "classes"))

    chosen = found.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos", "alike", "classes")).alias("at"))

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        for a in range(0, batch.num_rows, 200):
            rows = batch.slice(a, 200)
            out: dict[str, list] = {k: [] for k in ("h", "doc_id", "pos", "lefts", "rights", "classes")}
            for doc, text, at in zip(rows.column(0).to_pylist(), unpack(rows.column(1).to_pylist()), rows.column(2).to_pylist(), strict=True):
                for x in at:
                    p = x["pos"]
                    out["h"].append(x["h"])
                    out["doc_id"].append(doc)
                    out["pos"].append(p)
                    out["classes"].append(x["classes"])
                    out["lefts"].append(text[max(0, p - reach) : p][::-1])
                    out["rights"].append(text[p + seed : p + length])
            yield out

    blocks = map_arrow(texts.join(chosen, "doc_id").select("doc_id", "packed", "at"), cut, "h long, doc_id long, pos long, lefts binary, rights binary, classes long")
    spans = _bucket_repeats(blocks.where(F.col("classes") <= bucket_rows), length)
    if not found.where(F.col("open") & (F.col("classes") > bucket_rows)).isEmpty():
        large = map_arrow(
            texts.join(found.where(F.col("open") & (F.col("classes") > bucket_rows)).groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos", "alike", "classes")).alias("at")), "doc_id").select("doc_id", "packed", "at"),
            cut, "h long, doc_id long, pos long, lefts binary, rights binary, classes long",
        )
        spans = spans.unionByName(_large_bucket_repeats(large, length))
    equal = found.where("alike > 1").select("doc_id", F.greatest(F.lit(0), F.col("pos") - reach).alias("start"), (F.col("pos") + length).alias("stop"))
    return spans.unionByName(equal).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _union(spans: list[dict], n: int, length: int) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted((x["start"], min(x["stop"], n)) for x in spans):
        if b - a < length:
            continue
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = True, bucket_rows: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) of each row: bytes without repeated strings.

    A byte of the whole UTF-8 text goes if a string of ``length`` bytes that covers it also starts anywhere else, in
    the same document or another; matches never cross documents and are judged on the input. ``kept`` is binary, as a
    cut may fall inside a character.

    Null text is empty; shorter texts keep all; texts of any length are handled whole. Rows without a doc_id, and rows of
    one doc_id, are documents each: what one of them repeats of another goes, and nothing else; equal rows repeat each
    other. An empty table gives an empty one. Other columns are not read.
    """
    docs = with_own_ids(docs)
    texts = packed(docs, "own_id")
    joined = texts.join(repeated_spans(texts, docs, length, bucket_rows), "doc_id", "left").select("own_id", "packed", "spans")

    def keep(batch: pa.RecordBatch) -> Iterator[dict]:
        for a in range(0, batch.num_rows, 500):
            rows = batch.slice(a, 500)
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for text, spans in zip(unpack(rows.column(1).to_pylist()), rows.column(2).to_pylist(), strict=True):
                gone = _union(spans or [], len(text), length)
                edges = [0, *[x for s in gone for x in s], len(text)]
                kept = text if not gone else b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept"].append(kept)
                    out["spans"].append([{"start": x, "stop": y} for x, y in gone])
            yield {"doc_id": rows.column(0), **out}

    more = ", kept binary, spans array<struct<start: bigint, stop: bigint>>" * with_text
    return map_arrow(joined, keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False)
