"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

A CGK walk copies a sequence, repeating each token or moving on by random bits that depend on the step and the token, so
that an edit distance turns into a Hamming distance: two walks that have been shifted against each other by an edit soon
fall into step again. Sampling a few steps of the walk is then a locality-sensitive hash. Windows of the size of the
items are hashed so at every word of every document, over as many repetitions as the target recall takes, and what meets
an item's hash is confirmed by the edit distance itself.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, U64, joined_bytes, map_arrow, mix, text_slices, words

#: Items are held in memory in blocks of at most so many; the documents are read once for each block.
ITEMS_PER_BLOCK = 20_000
#: Sampled steps of a hash.
SAMPLES = 4
#: Where the target recall is not reached by so many repetitions, a warning says so.
MAX_REPETITIONS = 256


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without punctuation, each row followed by a 0; and where the rows begin."""
    _, _, at, hashes = words(data, offsets, lower=True, between=NOT_ALNUM)
    rows = len(at) - 1
    out = np.zeros(len(hashes) + rows, U64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(at))] = np.maximum(hashes, U64(1))
    return out, at + np.arange(rows + 1)


def allowed_edits(n_words: int, rate: float) -> int:
    return int(n_words * rate)


@dataclass
class SizeClass:
    """Items of about one size: the smallest size, the most edits, sampled steps and sorted hashes by repetition."""

    low: int
    edits: int
    items: list[int]
    steps: list[np.ndarray] = field(default_factory=list)
    bits: list[np.ndarray] = field(default_factory=list)
    partial: list[list[np.ndarray]] = field(default_factory=list)
    of_hash: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    recall: float = 0.0

    def matches(self, rep: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash that an item has too: its place in ``key``, and the item."""
        known, items = self.of_hash[rep]
        first = np.searchsorted(known, key, "left")
        n = np.searchsorted(known, key, "right") - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(np.arange(len(key)), n), items[at]

    def walk(self, rep: int, tokens: np.ndarray, at: np.ndarray, prune: bool) -> tuple[np.ndarray, np.ndarray]:
        """Walks from the positions ``at``: which of them (by index) get to the end, and their hashes.

        With ``prune``, a walk ends at the first sampled step at which no item's walk has the same tokens so far.
        """
        steps, bits = self.steps[rep], self.bits[rep]
        which, at, key = np.arange(len(at)), at.copy(), np.zeros(len(at), U64)
        taken = 0
        for j in range(int(steps[-1]) + 1):
            token = tokens[at]
            if j == steps[taken]:
                key = mix(key + token)
                if prune:
                    known = self.partial[rep][taken]
                    ok = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                    which, at, key, token = which[ok], at[ok], key[ok], token[ok]
                taken += 1
            at += ((token * bits[j]) >> U64(63)).astype(np.int64)
        return which, key

    def add_repetition(self, rng: np.random.Generator, tokens: list[np.ndarray]) -> None:
        reach = max(SAMPLES, int(1.5 * self.low))
        self.steps.append(np.sort(rng.choice(reach, SAMPLES, replace=False)))
        self.bits.append(rng.integers(0, 1 << 63, reach, dtype=np.int64).astype(U64) * U64(2) + U64(1))
        flat = np.concatenate([np.append(tokens[i], U64(0)) for i in self.items])
        starts = np.concatenate([[0], np.cumsum([len(tokens[i]) + 1 for i in self.items])[:-1]])
        kept = []
        steps = self.steps[-1]
        for n in range(1, SAMPLES + 1):
            self.steps[-1] = steps[:n]
            _, key = self.walk(len(self.steps) - 1, flat, starts, prune=False)
            kept.append(np.unique(key))
        order = np.argsort(key, kind="stable")
        self.partial.append(kept)
        self.of_hash.append((key[order], np.array(self.items, np.int32)[order]))


@dataclass
class Index:
    ids: list[int | None]
    tokens: list[np.ndarray]
    rate: float
    classes: list[SizeClass]
    short: dict[tuple[int, ...], list[int]]  # items of too few words for a window, by their words
    min_words: int
    vocabulary: np.ndarray  # by the leading bits of a word's hash, a bit for each size class that has such a word

    def flags(self, tokens: np.ndarray) -> np.ndarray:
        shift = 64 - (len(self.vocabulary).bit_length() - 1)
        return self.vocabulary[(tokens >> U64(shift)).astype(np.int64)]


def _grams(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on."""
    key = np.zeros(max(0, len(tokens) - n + 1), U64)
    for j in range(n):
        key = mix(key + tokens[j : j + len(key)])
    return key


def _edited(tokens: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = tokens.tolist()
    for _ in range(edits):
        i, kind = rng.integers(len(out)), rng.integers(3)
        if kind == 0 and len(out) > 1:
            del out[i]
        elif kind == 1:
            out.insert(i, int(rng.integers(1, 1 << 62)))
        else:
            out[i] = int(rng.integers(1, 1 << 62))
    return np.array(out, U64)


def build_index(items: list[tuple[int | None, str]], rate: float = 0.2, min_words: int = 5, recall: float = 0.99, seed: int = 5) -> Index:
    """Hash tables of one block of items. Repetitions are added until edited copies of the items are found.

    The trial copies have as many random edits as are allowed, the hardest case, and each walk begins at the copy's
    first word only; in documents the neighbouring words begin walks of the same passage.
    """
    data, offsets = joined_bytes([t.encode() for _, t in items])
    flat, at = _tokens(data, offsets)
    tokens = [flat[a : b - 1] for a, b in zip(at[:-1], at[1:], strict=True)]
    rng = np.random.default_rng(seed)
    classes: dict[int, SizeClass] = {}
    short: dict[tuple[int, ...], list[int]] = {}
    for i, t in enumerate(tokens):
        if 0 < len(t) < min_words:
            short.setdefault(tuple(t.tolist()), []).append(i)
        if len(t) >= min_words:
            low = min_words
            while int(low * 1.25) + 1 <= len(t):
                low = int(low * 1.25) + 1
            own = classes.setdefault(low, SizeClass(low, 0, []))
            own.items.append(i)
            own.edits = max(own.edits, allowed_edits(len(t), rate))
    for c in classes.values():
        trial = [(i, _edited(tokens[i], allowed_edits(len(tokens[i]), rate), rng)) for i in np.resize(c.items, 300).tolist()]
        trial_flat = np.concatenate([np.append(t, U64(0)) for _, t in trial])
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in trial])[:-1]])
        found, of_trial = np.zeros(len(trial), bool), np.array([i for i, _ in trial])
        while found.mean() < recall and len(c.steps) < MAX_REPETITIONS:
            c.add_repetition(rng, tokens)
            which, key = c.walk(len(c.steps) - 1, trial_flat, starts, prune=True)
            place, item = c.matches(len(c.steps) - 1, key)
            found[which[place][of_trial[which[place]] == item]] = True
        c.recall = float(found.mean())
    found_classes = [classes[k] for k in sorted(classes)]
    bits = max(18, (16 * len(flat)).bit_length())
    vocabulary = np.zeros(1 << bits, U64)
    for n, c in enumerate(found_classes):  # sizes grow by a quarter, so 64 classes are far more than texts can fill
        own = np.unique(np.concatenate([tokens[i] for i in c.items]) >> U64(64 - bits)).astype(np.int64)
        vocabulary[own] |= U64(1 << min(n, 63))
    return Index([i for i, _ in items], tokens, rate, found_classes, short, min_words, vocabulary)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end): the stretch of the text with the smallest edit distance to the item; ties: the first end."""
    n = len(text)
    cost, begin, along = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for i, token in enumerate(item.tolist()):
        change = cost[:-1] + (text != U64(token))
        drop = cost[1:] + 1
        new, start = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], start[0] = i + 1, 0
        take = change <= drop
        new[1:], start[1:] = np.where(take, change, drop), np.where(take, begin[:-1], begin[1:])
        level = new - along  # a run of inserted words costs one each: the lowest level so far goes on
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, along, 0))
        cost, begin = low + along, start[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def search_short(index: Index, tokens: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """As ``search``, the first exact place of each item of too few words for a window."""
    out = []
    by_size: dict[int, list[tuple[int, ...]]] = {}
    for own in index.short:
        by_size.setdefault(len(own), []).append(own)
    for n, some in by_size.items():
        known = np.unique(_grams(np.array([t for own in some for t in own], U64), n)[::n])
        key = _grams(tokens, n)
        p = np.flatnonzero(np.isin(key, known))
        row = np.searchsorted(at, p, "right") - 1
        _, first = np.unique(np.stack([row.astype(U64), key[p]]), axis=1, return_index=True)
        for k in np.sort(first).tolist():
            x = int(p[k] - at[row[k]])
            out += [(int(row[k]), i, 0, x, x + n) for i in index.short.get(tuple(tokens[p[k] : p[k] + n].tolist()), ())]
    return out


def search(index: Index, tokens: np.ndarray, at: np.ndarray, short_inside: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, end word) of the best passage for each row and item that is near enough."""
    hits: dict[tuple[int, int], list[int]] = {}
    rows = len(at) - 1
    flags = index.flags(tokens)
    for n, c in enumerate(index.classes):
        if len(tokens) < c.low - c.edits:
            continue
        # at most ``edits`` words of a passage are in no item of its size, so no more of its first ``low`` words are
        seen = np.zeros(len(tokens) + c.low + 1, np.int32)
        np.cumsum((flags >> U64(min(n, 63))) & U64(1), out=seen[1 : len(tokens) + 1])
        seen[len(tokens) + 1 :] = seen[len(tokens)]
        start = np.flatnonzero((seen[c.low : c.low + len(tokens)] - seen[: len(tokens)] >= c.low - c.edits) & (tokens != 0))
        for rep in range(len(c.steps)):
            which, key = c.walk(rep, tokens, start, prune=True)
            place, item = c.matches(rep, key)
            p = start[which[place]]
            for row, i, x in zip((np.searchsorted(at, p, "right") - 1).tolist(), item.tolist(), p.tolist(), strict=True):
                hits.setdefault((row, i), []).append(x)
    out = search_short(index, tokens, at) if short_inside and index.short else []
    if index.short and not short_inside:
        for row in np.flatnonzero(np.diff(at) <= index.min_words).tolist():
            own = tokens[at[row] : at[row + 1] - 1]
            out += [(row, i, 0, 0, len(own)) for i in index.short.get(tuple(own.tolist()), ())]
    for (row, i), places in hits.items():
        item = index.tokens[i]
        edits = allowed_edits(len(item), index.rate)
        places = sorted(set(places))
        best = None
        a = 0
        for b in range(1, len(places) + 1):
            if b == len(places) or places[b] - places[b - 1] > len(item):
                lo = max(int(at[row]), places[a] - 2 * edits - 1)
                hi = min(int(at[row + 1]) - 1, places[b - 1] + len(item) + 2 * edits + 1)
                a = b
                if np.isin(tokens[lo:hi], item).sum() < len(item) - edits:
                    continue
                cost, x, y = best_match(item, tokens[lo:hi])
                if cost <= edits and (best is None or cost < best[0]):
                    best = (cost, lo - int(at[row]) + x, lo - int(at[row]) + y)
        if best:
            out.append((row, i, *best))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, min_words: int = 5, recall: float = 0.99, short_inside: bool = True) -> DataFrame:
    """(doc_id, item_id, item_words, edits, first_word, end_word) for each document and item it holds a copy of.

    A copy is a stretch of the document's words (lower-cased, without punctuation) whose word edit distance to the whole
    item is at most ``rate`` of the item's words; the best one is given, the first of equals. Items of fewer than
    ``min_words`` words are found word for word, at their first place; ``item_words`` tells them apart, as they stand by
    chance in any prose. Without ``short_inside`` they are found only where they are a document's only words. Null and
    empty items are not searched for; an item without an id is told with a null one. The search is by hashing and aims at
    ``recall``, and warns where trial copies are found less often; nothing is reported that the edit distance doesn't
    confirm. Very long texts are searched whole. Null and empty texts hold nothing; repeated rows of documents or items are
    reported for each; further columns are not looked at; empty tables give an empty result.
    """
    result = None
    for shared in _indexes(benchmark, rate, min_words, recall):

        def find(batch: pa.RecordBatch, shared=shared) -> Iterator[dict]:
            index = shared.value
            for a, b, data, offsets in text_slices(batch):
                found = search(index, *_tokens(data, offsets), short_inside)
                if found:
                    row, item, edits, first, end = zip(*found, strict=True)
                    yield {"doc_id": batch.column(0).slice(a, b - a).take(pa.array(row)), "item_id": [index.ids[i] for i in item], "item_words": [len(index.tokens[i]) for i in item], "edits": list(edits), "first_word": list(first), "end_word": list(end)}

        found = map_arrow(docs.select("doc_id", "text"), find, "doc_id long, item_id long, item_words long, edits long, first_word long, end_word long")
        result = found if result is None else result.unionByName(found)
    return result


def without_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, min_words: int = 5, recall: float = 0.99, short_inside: bool = False) -> DataFrame:
    """``docs`` without the rows that hold a copy of an item, as ``contaminated`` finds them. Nothing is shuffled.

    Short items inside a text don't drop it unless ``short_inside`` says so: an item of one common word would drop all.
    """
    place = docs.columns.index("text")
    for shared in _indexes(benchmark, rate, min_words, recall):

        def drop(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in text_slices(batch, batch.schema.names[place]):
                    for row, *_ in search(shared.value, *_tokens(data, offsets), short_inside):
                        keep[a + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(drop, docs.schema)
    return docs


def _indexes(benchmark: DataFrame, rate: float, min_words: int, recall: float) -> Iterator[Broadcast]:
    """Broadcast indexes of blocks of at most about ITEMS_PER_BLOCK items; one, of no items, for an empty table."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = build_index(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])), rate, min_words, recall)
        for c in index.classes:
            if c.recall < recall:
                warnings.warn(f"items of {c.low} words and more: {c.recall:.3f} of edited copies found, not {recall}", stacklevel=2)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
