"""Spelling variants: words one edit apart, found as equal pairs of trie nodes, and the frequent form of a rare word.

The prefixes of all words are the nodes of a trie, their suffixes those of a second one. Both are numbered by a scan of the
sorted words: a node's number is the place of the first word that goes through it, with its depth. A word with one code
point skipped, or with a gap between two, is then a pair of integers (prefix node, suffix node), and words one edit apart
are those that share a pair. Numbers are exact, so no string is compared and no candidate has to be checked.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, key_groups, release, saved

#: Distinct words that a task gathers before it sends them on.
HELD = 400_000
#: What a pair of nodes stands for: a gap between two code points, one skipped, or one skipped that begins a run of equal
#: ones (skipping any other of the run gives the same word).
GAP, SKIP, SKIP_FIRST = 0, 1, 2


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, drop_every: int = 0) -> DataFrame:
    """(word, n): the runs of Latin letters of at least ``min_length`` code points, with A-Z lower-cased and nothing else,
    that occur at least ``min_count`` times in ``docs`` (doc_id, text).

    With ``drop_every`` a document's run, all its occurrences there, loses a code point first where that number divides the
    crc32 of ``<doc_id>:<run>``, namely that at the crc32 modulo the run's length; a null doc_id counts as ''. Tasks send
    partial counts, so no word is a hot key.
    """
    target = arrow_schema(docs.sparkSession, "word string, n long")
    letters = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def sent(held: Counter) -> Iterator[pa.RecordBatch]:
        words = list(held)
        for a in range(0, len(words), 50_000):
            yield as_batch({"word": words[a : a + 50_000], "n": [held[w] for w in words[a : a + 50_000]]}, target)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                runs = Counter(letters.findall(text.as_py().lower().decode()))
                if drop_every:
                    for run, n in runs.items():
                        held[_dropped(doc, run, drop_every)] += n
                else:
                    held.update(runs)
                if len(held) > HELD:
                    yield from sent(held)
                    held = Counter()
        yield from sent(held)

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    parts = docs.select(doc, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "word string, n long")
    return parts.where(F.char_length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _dropped(doc: str, run: str, every: int) -> str:
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _scanned(df: DataFrame, key: str) -> DataFrame:
    """``df`` with _part, _row and _starts, saved: range partitions in the order of ``key``, a column of distinct strings,
    the place within the part, and of each prefix (by length from 1) the place of the part's first row that has it."""
    kinds = {**dict(df.dtypes), "_part": "long", "_row": "long", "_starts": "array<long>"}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items())
    target, names = arrow_schema(df.sparkSession, schema), df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, starts, row = "", [], 0
        for batch in batches:
            found = []
            for word in batch.column(batch.schema.get_field_index(key)).to_pylist():
                same, most = 0, min(len(word), len(last))
                while same < most and word[same] == last[same]:
                    same += 1
                starts = starts[:same] + [row] * (len(word) - same)
                found.append(starts)
                last = word
                row += 1
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            yield as_batch({**columns, "_part": batch.column(batch.schema.get_field_index("_part")), "_row": np.arange(row - batch.num_rows, row), "_starts": found}, target)

    ranged = df.repartitionByRange(key).sortWithinPartitions(key)
    return saved(ranged.withColumn("_part", F.spark_partition_id().cast("long")).mapInArrow(scan, schema))


def _carried(scanned: DataFrame, key: str) -> dict[int, tuple[int, list[int]]]:
    """For each part its rows before it, and the first rows overall of the prefixes that its first word shares with the
    part before: one row for each part reaches the driver."""
    parts = scanned.groupBy("_part").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(F.struct(key, "_starts")).alias("last")).orderBy("_part").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    before, word, opened = 0, "", []
    for r in parts:
        shared = 0
        while shared < min(len(word), len(r["first"])) and word[shared] == r["first"][shared]:
            shared += 1
        out[r["_part"]] = (before, opened[:shared])
        word = r["last"][key]
        opened = [opened[d] if s == 0 and d < shared else before + s for d, s in enumerate(r["last"]["_starts"])]
        before += r["n"]
    return out


def _nodes(starts: list[int], before: int, carried: list[int], width: int) -> np.ndarray:
    """The numbers of the trie nodes of the prefixes of one word, by length from 0."""
    first = np.array(starts, np.int64)
    whole = first + before
    shared = min(len(carried), len(first))
    whole[:shared] = np.where(first[:shared] == 0, np.array(carried[:shared], np.int64), whole[:shared])
    out = np.zeros(len(first) + 1, np.int64)
    out[1:] = whole * width + np.arange(1, len(first) + 1)
    return out


def _forward(words: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(id, word, n, pre), ids in the order of the words and pre the node of each prefix; and what it reads."""
    scanned = _scanned(words.select("word", "n"), "word")
    shared = words.sparkSession.sparkContext.broadcast(_carried(scanned, "word"))
    target = arrow_schema(words.sparkSession, schema := "id long, word string, n long, pre array<long>")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            known = [shared.value[p] for p in x["_part"]]
            pre = [_nodes(s, before, carried, width) for s, (before, carried) in zip(x["_starts"], known, strict=True)]
            yield as_batch({"id": [before + r for r, (before, _) in zip(x["_row"], known, strict=True)], "word": batch.column(batch.schema.get_field_index("word")), "n": batch.column(batch.schema.get_field_index("n")), "pre": pre}, target)

    return scanned.mapInArrow(number, schema), scanned


def node_pairs(forward: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(p, s, id, n, kind): the pairs of nodes of all words, 2 * length + 1 for each; and what it reads."""
    scanned = _scanned(forward.select(F.reverse("word").alias("back"), "id", "n", "pre"), "back")
    shared = forward.sparkSession.sparkContext.broadcast(_carried(scanned, "back"))
    target = arrow_schema(forward.sparkSession, schema := "p long, s long, id long, n long, kind byte")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 5000):
                x = batch.slice(a, 5000).to_pydict()
                suf = [_nodes(s, *shared.value[part], width)[::-1] for s, part in zip(x["_starts"], x["_part"], strict=True)]
                size = np.array([len(w) for w in x["back"]], np.int64)
                p, s = np.concatenate([np.array(v, np.int64) for v in x["pre"]]), np.concatenate(suf)
                row = np.repeat(np.arange(len(size)), size + 1)
                ids, n = np.array(x["id"], np.int64)[row], np.array(x["n"], np.int64)[row]
                ends = np.cumsum(size + 1) - 1
                inner = np.ones(len(p), bool)
                inner[ends] = False  # places before a code point, not at the end
                letters = np.frombuffer("".join(w[::-1] for w in x["back"]).encode("utf-32-le"), np.uint32)
                begins = np.ones(len(letters), bool)
                begins[1:] = letters[1:] != letters[:-1]
                begins[np.cumsum(size)[:-1]] = True
                skip = np.flatnonzero(inner)
                yield as_batch({"p": p, "s": s, "id": ids, "n": n, "kind": np.full(len(p), GAP, np.int8)}, target)
                yield as_batch({"p": p[skip], "s": s[skip + 1], "id": ids[skip], "n": n[skip], "kind": np.where(begins, SKIP_FIRST, SKIP).astype(np.int8)}, target)

    return scanned.mapInArrow(pairs, schema), scanned


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best): of each word that has near ones their number, and the largest n with its smallest id.

    Words that share a pair of nodes by a skip differ in that code point; one with a gap and one with a skip differ by an
    insertion. A pair of nodes is shared by at most one word for each letter and one with a gap, so no group is large, and
    each group is told by its two most frequent words, not by all pairs.
    """
    target = arrow_schema(pairs.sparkSession, schema := "id long, near long, best_n long, best long")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_groups(batches, ["p", "s"]):
            p, s, ids, n, kind = (np.asarray(table[c].combine_chunks()) for c in ("p", "s", "id", "n", "kind"))
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            if several.any():
                yield from _told(group[several], ids[several], n[several], kind[several], target)

    return pairs.repartition("p", "s").sortWithinPartitions("p", "s").mapInArrow(groups, schema).groupBy("id").agg(
        F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("b")
    ).select("id", "n_near", F.col("b.best_n").alias("best_n"), (-F.col("b.best")).alias("best"))


def _told(group: np.ndarray, ids: np.ndarray, n: np.ndarray, kind: np.ndarray, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((ids, -n, group))
    group, ids, n, kind = group[order], ids[order], n[order], kind[order]

    def tops(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First of ``rows`` and their number, by group; -1 and 0 where a group has none."""
        first, count = np.full(group[-1] + 1, -1), np.bincount(group[rows], minlength=group[-1] + 1)
        at, where = np.unique(group[rows], return_index=True)
        first[at] = rows[where]
        return first, count

    def out(rows: np.ndarray, near: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        return as_batch({"id": ids[rows], "near": near, "best_n": n[best], "best": ids[best]}, target)

    # replaced: all words that skip here differ in one code point
    skips = np.flatnonzero(kind != GAP)
    first, count = tops(skips)
    skips = skips[count[group[skips]] > 1]
    if len(skips):
        is_first = first[group[skips]] == skips
        others = skips[~is_first]
        second, _ = tops(others)
        yield out(skips, count[group[skips]] - 1, np.where(is_first, second[group[skips]], first[group[skips]]))
    # inserted or deleted: the word with the gap, and the words that have one code point more there
    gaps, longer = np.flatnonzero(kind == GAP), np.flatnonzero(kind == SKIP_FIRST)
    gap, _ = tops(gaps)
    best, count = tops(longer)
    gaps, longer = gaps[count[group[gaps]] > 0], longer[gap[group[longer]] >= 0]
    if len(gaps):
        yield out(gaps, count[group[gaps]], best[group[gaps]])
        yield out(longer, np.ones(len(longer), np.int64), gap[group[longer]])


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from links (id, form) that lead to ever larger counts: the end of each chain, by doubling the steps."""
    now = saved(forms.select("id", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = saved(now.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(now)
        now = step
        if not step.where("moved").limit(1).count():
            return now.select("id", "root")


def spelling_groups(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all rows of ``words`` (word, n), whose words are distinct.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; n_near counts a word's near
    ones. Its form is the near word of largest n (the smallest in code-point order of equal ones) if that n is at least
    ``factor`` (2 at least) times its own, else null, and form_n is the form's n. Its root is the end of the chain of
    forms, the word itself where it has none. Words of any length are handled whole, null words are left out, an empty
    table gives an empty one. Other columns are not read.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = saved(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    width = (words.agg(F.max(F.char_length("word"))).first()[0] or 0) + 1
    forward, first = _forward(words, width)
    pairs, second = node_pairs(forward, width)
    found = saved(near_words(pairs))
    known = saved(second.select("id", F.reverse("back").alias("word"), "n"))
    release(words, first, second)
    formed = known.join(found, "id", "left").withColumn("form", F.when(F.col("best_n") >= F.col("n") * factor, F.col("best")))
    formed = saved(formed.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")))
    release(found)
    ends = roots(formed.where("form IS NOT NULL"))
    name = lambda on, as_: known.select(F.col("id").alias(on), F.col("word").alias(as_))
    linked = formed.where("form IS NOT NULL").join(ends, "id").join(name("form", "form_word"), "form").join(name("root", "root_word"), "root")
    linked = linked.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = formed.where("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return linked.unionByName(alone)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_groups(word_counts(docs, drop_every=31))
