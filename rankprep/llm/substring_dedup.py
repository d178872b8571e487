"""Substring deduplication by words: anchors at difference-cover positions, extended to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASES, U64, Rolling, joined_bytes, map_arrow, mix, packed, signed, slices, text_slices, unpack, with_own_ids, words

#: Perfect difference sets. Every residue modulo the period is a difference of two members.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}


def period_for(window: int) -> int:
    """The largest period that leaves anchors of about two fifths of the window."""
    return max(v for v in COVERS if v == 1 or v <= 0.65 * window)


def _cover(period: int) -> np.ndarray:
    inside = np.zeros(period, bool)
    inside[list(COVERS[period])] = True
    return inside


def anchors(docs: DataFrame, window: int = 50) -> DataFrame:
    """(h, u, doc_id, pos) of every anchor: a run of ``window - period + 1`` words that starts at a cover position.

    Any two equal windows contain, at the same offset, a pair of anchors that both stand at cover positions. ``h``
    hashes the anchor's words; ``u`` hashes all words of the windows that contain it, and where a text's ends clip them.
    """
    period = period_for(window)
    inside, k = _cover(period), window - period + 1

    def emit(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column(0)
        for a, b, data, offsets in text_slices(batch):
            _, _, at, hashes = words(data, offsets)
            sizes = np.diff(at)
            doc = np.repeat(np.arange(b - a), sizes)
            i = np.arange(len(hashes))
            local = i - at[doc]
            i = i[inside[local % period] & (local + k <= sizes[doc]) & (sizes[doc] >= window)]
            if not len(i):
                continue
            first, second = Rolling(hashes), Rolling(hashes, BASES[1])
            own = doc[i]
            lo, hi = np.maximum(at[own], i - period + 1), np.minimum(at[own + 1], i + window)
            whole = mix(second(lo, hi) + (i - lo).astype(U64) * U64(BASES[2]) + (hi - i).astype(U64))
            yield {"h": signed(first(i, i + k)), "u": signed(whole), "doc_id": ids.slice(a, b - a).take(pa.array(own)), "pos": (i - at[own]).astype(np.int32)}

    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return map_arrow(known, emit, "h long, u long, doc_id long, pos int")


def _ranges(points: np.ndarray, before: int, limit: int) -> np.ndarray:
    """A flag for each position 0..limit-1 that lies in [point - before, point] of some point."""
    edge = np.zeros(limit + 1, np.int32)
    points = points[points - before < limit]
    np.add.at(edge, np.maximum(points - before, 0), 1)
    np.add.at(edge, np.minimum(points + 1, limit), -1)
    return np.cumsum(edge)[:limit] > 0


def covered_windows(texts: DataFrame, docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """Marks (doc_id, marks) and windows (doc_id, starts): what of each document also starts in a smaller doc_id.

    A mark is an anchor position times two, plus one if all windows around it are covered. Anchors that share both
    ``h`` and ``u`` have equal surroundings, so only the smallest document of each such class is looked at more closely,
    and only if its anchor occurs in other surroundings too: these extend word by word to whole windows, which are
    compared by 128-bit hashes.
    """
    period = period_for(window)
    found = anchors(docs, window).repartition("h")
    alike = Window.partitionBy("h")
    found = found.select("*", *[f("doc_id").over(alike).alias(n) for f, n in ((F.min, "d0"), (F.max, "d1"))], *[f("u").over(alike).alias(n) for f, n in ((F.min, "u0"), (F.max, "u1"))])
    found = found.where("d0 < d1").withColumn("least", F.min("doc_id").over(Window.partitionBy("h", "u")))
    found = found.where("doc_id > least OR u0 <> u1")
    code = (F.col("pos") * 2 + F.when(F.col("doc_id") > F.col("least"), 1).otherwise(0)).alias("code")
    marks = found.select("doc_id", code).groupBy("doc_id").agg(F.collect_list("code").alias("marks"))

    def extend(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = np.asarray(batch.column(0))
        texts, lists = batch.column(1), batch.column(2)
        for a in range(0, batch.num_rows, 200):
            data, offsets = joined_bytes(unpack(texts.slice(a, 200).to_pylist()))
            for x, y in slices(offsets):
                part, own = data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                _, _, at, hashes = words(part, own)
                pick = []
                for i in range(y - x):
                    codes = np.asarray(lists[a + x + i].as_py(), np.int64)
                    n = at[i + 1] - at[i] - window + 1
                    if n > 0:
                        open_ = _ranges(codes[codes % 2 == 0] // 2, period - 1, n) & ~_ranges(codes[codes % 2 == 1] // 2, period - 1, n)
                        pick.append(np.flatnonzero(open_) + at[i])
                p = np.concatenate(pick) if pick else np.zeros(0, np.int64)
                if not len(p):
                    continue
                doc = np.searchsorted(at, p, "right") - 1
                w1, w2 = (signed(Rolling(hashes, base)(p, p + window)) for base in BASES[:2])
                yield {"w1": w1, "w2": w2, "doc_id": ids[a + x + doc], "pos": (p - at[doc]).astype(np.int32)}

    opened = map_arrow(texts.join(marks.where("exists(marks, x -> x % 2 = 0)"), "doc_id").select("doc_id", "packed", "marks"), extend, "w1 long, w2 long, doc_id long, pos int")
    least = F.min("doc_id").over(Window.partitionBy("w1", "w2"))
    windows = opened.repartition("w1", "w2").withColumn("least", least).where("doc_id > least")
    return marks, windows.groupBy("doc_id").agg(F.collect_list("pos").alias("starts"))


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of each row: words without those that earlier documents repeat.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A word goes if it is in a window of ``window`` words whose
    sequence also starts in a document with a smaller doc_id; windows are judged on the input. ``kept`` is the kept
    words, joined by one space.

    Null text has no words; texts shorter than a window keep all; texts of any length are handled whole. Rows without a
    doc_id come before all others; rows of one doc_id, and rows without, come in the order of the md5 of their texts, and
    a later one loses what an earlier one holds; equal rows get equal results and don't remove each other. An empty table
    gives an empty one. Other columns are not read.
    """
    docs = with_own_ids(docs)
    texts = packed(docs, "own_id")
    marks, windows = covered_windows(texts, docs, window)
    period = period_for(window)
    joined = texts.join(marks, "doc_id", "left").join(windows, "doc_id", "left").select("own_id", "packed", "marks", "starts")

    def keep(batch: pa.RecordBatch) -> Iterator[dict]:
        for a in range(0, batch.num_rows, 500):
            rows = batch.slice(a, 500)
            total, gone, kept = [], [], []
            for text, codes, starts in zip(unpack(rows.column(1).to_pylist()), rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                own = text.split()  # of bytes: at ASCII white space, which is what separates words here
                n = len(own)
                removed = 0
                if (codes or starts) and n >= window:
                    codes = np.asarray(codes or [], np.int64)
                    covered = _ranges(codes[codes % 2 == 1] // 2, period - 1, n - window + 1)
                    extra = np.asarray(starts or [], np.int64)
                    covered[extra[extra < len(covered)]] = True
                    stay = ~_ranges(np.flatnonzero(covered) + window - 1, window - 1, n)
                    own = [own[i] for i in np.flatnonzero(stay)]
                    removed = n - len(own)
                total.append(n)
                gone.append(removed)
                kept.append(b" ".join(own))
            out = {"doc_id": rows.column(0), "n_words": total, "n_removed": gone, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
            yield out | {"kept": pa.array(kept, pa.binary())} if with_text else out

    return map_arrow(joined, keep, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False)
