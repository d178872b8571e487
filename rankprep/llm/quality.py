"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text scores every document.

The model is over bytes, so a text's n-grams are numbers of ``ORDER`` bytes and their kinds stay few against the text.
Documents are dealt into blocks. Each block asks once for each n-gram it holds and tells how often its trusted documents
have it; counts, contexts and probabilities are joined by n-gram, in shards; the answers go back to the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, joined_bytes, mix, packed, saved, slices, unpack, words

ORDER = 5
#: Bytes of text in a block, about.
BLOCK_BYTES = 32 << 20
FOLDS = 5
#: Bytes before a text's first.
START = 10
#: The share of a text's words, at least one, that its tail is made of; shorter words count as so many bytes.
TAIL, WORD = 0.01, 4


def text_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte of the texts; before a text there are START bytes."""
    out = data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    shifted = out.copy()
    for back in range(1, ORDER):
        shifted = np.concatenate([[START], shifted[:-1]]) if len(shifted) else shifted
        shifted[place < back] = START
        out |= shifted << (8 * back)
    return out


def _texts(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    column = table["packed"]
    for a in range(0, table.num_rows, 200):
        data, offsets = joined_bytes(unpack(column.slice(a, 200).to_pylist()))
        for x, y in slices(offsets):
            yield a + x, a + y, data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]


def _label_of(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's documents, which of them are trusted, and which of these set thresholds instead of being counted."""
    is_doc = np.asarray(table["is_doc"].combine_chunks())
    ids = table["doc_id"].combine_chunks()
    known = ids.filter(pa.array(~is_doc)).drop_null()
    docs = table.filter(pa.array(is_doc))
    own = np.asarray(docs["doc_id"].combine_chunks().fill_null(-(1 << 62)))
    trusted = np.isin(own, np.asarray(known))
    return docs, trusted, trusted & (mix(own.view(U64)) % U64(FOLDS) == 0)


def _ask(table: pa.Table) -> pa.Table:
    docs, trusted, held = _label_of(table)
    counted = trusted & ~held
    asked, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def merge() -> None:
        nonlocal asked, counts
        keys = np.concatenate([asked, *[k for k, _ in waiting]])
        values = np.concatenate([counts, *[c for _, c in waiting]])
        asked, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, values, len(asked)).astype(np.int64)
        waiting.clear()

    for a, b, data, offsets in _texts(docs):
        grams, flags = text_grams(data, offsets), np.repeat(counted[a:b], np.diff(offsets))
        for flag in (False, True):
            keys, times = np.unique(grams[flags == flag], return_counts=True)
            waiting.append((keys, times * flag))
        if len(waiting) >= 16:
            merge()
    merge()
    block = table["block"][0].as_py() if table.num_rows else 0
    return pa.table({"block": np.full(len(asked), block, np.int64), "gram": asked, "n": counts})


def tails(surprise: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text the mean surprise a byte of its most surprising words, TAIL of all; ``surprise`` is a running sum."""
    start, end, at, _ = words(data, offsets)
    each = (surprise[end] - surprise[start]) / np.maximum(end - start, WORD)
    out = np.zeros(len(offsets) - 1)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b > a:
            k = max(1, int((b - a) * TAIL))
            out[i] = np.partition(each[a:b], b - a - k)[b - a - k :].mean()
    return out


def _score(table: pa.Table, answers: pa.Table) -> pa.Table:
    docs, trusted, held = _label_of(table)
    grams, logs = np.asarray(answers["gram"].combine_chunks()), np.asarray(answers["logp"].combine_chunks())
    order = np.argsort(grams)
    grams, logs = grams[order], logs[order]
    sums, worst, sizes = np.zeros(docs.num_rows), np.zeros(docs.num_rows), np.zeros(docs.num_rows, np.int64)
    for a, b, data, offsets in _texts(docs):
        if len(data):
            own = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(grams, text_grams(data, offsets))])])
            sums[a:b] = own[offsets[1:]] - own[offsets[:-1]]
            worst[a:b] = tails(-own, data, offsets)
            sizes[a:b] = np.diff(offsets)
    return pa.table({"doc_id": docs["doc_id"], "lang": docs["lang"], "trusted": trusted, "held": held, "n_bytes": sizes, "perplexity": pa.array(np.exp(-sums / np.maximum(sizes, 1)), mask=sizes == 0), "tail": pa.array(np.exp(worst), mask=sizes == 0)})


def _discounts(counts: DataFrame, name: str) -> list[float]:
    """The three discounts of modified Kneser-Ney, from the numbers of n-grams that occur once to four times."""
    got = counts.select(*[F.coalesce(F.sum((F.col(name) == k).cast("long")), F.lit(0)) for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (max(1, x) for x in got)
    y = n1 / (n1 + 2 * n2)
    raw = [k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.1), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]


def log_probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, logp) of each asked n-gram, from the trusted counts (gram, n), both with one row for each n-gram.

    The highest order discounts counts, the lower ones the number of different bytes before an n-gram; what is taken
    off goes to the next lower order, the lowest of which is interpolated with an even share of all bytes.
    """
    level = counts.where("n > 0").select(F.col("gram").alias("key"), F.col("n"))
    levels = [level := saved(level)]
    for order in range(ORDER - 1, 0, -1):
        level = saved(level.select(F.col("key").bitwiseAND((1 << (8 * order)) - 1).alias("key")).groupBy("key").agg(F.count("*").alias("n")))
        levels.append(level)
    below = None
    for order in range(1, ORDER + 1):
        level = levels[ORDER - order]
        d = _discounts(level, "n")
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = lambda c: F.shiftright(c, 8)
        around = level.groupBy(context("key").alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("freed"))
        wanted = asked.select(F.col("gram").bitwiseAND((1 << (8 * order)) - 1).alias("key")).distinct().withColumn("context", context("key"))
        wanted = wanted.join(level.select("key", (F.col("n") - off).alias("kept")), "key", "left").join(around, "context", "left")
        lower: Column = F.lit(1.0 / 256)
        if below is not None:
            wanted = wanted.withColumn("shorter", F.col("key").bitwiseAND((1 << (8 * (order - 1))) - 1)).join(below, "shorter")
            lower = F.col("lower")
        p = F.when(F.col("total").isNull(), lower).otherwise((F.coalesce("kept", F.lit(0.0)) + F.col("freed") * lower) / F.col("total"))
        below = saved(wanted.select(F.col("key").alias("shorter"), p.alias("lower")))
    return below.select(F.col("shorter").alias("gram"), F.log("lower").alias("logp"))


def score_documents(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, trusted, held, n_bytes, perplexity, tail) of each row of docs (doc_id, text, lang); ``trusted`` has doc_ids.

    Perplexity is for each byte of the whole text; ``tail`` is that of its most surprising words. One in FOLDS trusted documents (by a hash) is held back from the
    model, so that thresholds can be set on text that it doesn't know. Null and empty texts have none; a null doc_id is never trusted;
    repeated rows each get theirs, and are counted each if trusted; without trusted text all bytes are alike (256).
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(4, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).alias("block")
    texts = packed(docs, "lang").select(block, "doc_id", "lang", "packed", F.lit(True).alias("is_doc"))
    marks = trusted.where("doc_id IS NOT NULL").select("doc_id").distinct()
    marks = marks.select(block, "doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("packed"), F.lit(False).alias("is_doc"))
    dealt = texts.unionByName(marks).repartition("block")
    asked = saved(dealt.groupBy("block").applyInArrow(_ask, "block long, gram long, n long"))
    counts = saved(asked.groupBy("gram").agg(F.sum("n").alias("n")))
    answers = asked.select(F.col("block").alias("place"), "gram").join(log_probabilities(counts, counts), "gram")
    schema = "doc_id long, lang string, trusted boolean, held boolean, n_bytes long, perplexity double, tail double"
    return dealt.groupBy("block").cogroup(answers.groupBy("place")).applyInArrow(_score, schema)


def judge_quality(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, slack: float = 1.1, least_trusted: int = 30) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, tail, tail_threshold, keep) of each row.

    A document is kept up to the perplexity that ``quantile`` of the held-back trusted documents of its language stay
    below, times ``slack``, if that of its most surprising words (``tail``), with a threshold made alike, is not too high
    either: a few words that trusted text doesn't have hardly change the mean. Languages with fewer than ``least_trusted``
    held-back documents, and rows without a language, go by those of all languages. Without any, all texts are kept;
    null and empty texts never are. Very long texts are scored whole; ties and repeated rows each get their result; other
    columns are not looked at; an empty table gives an empty one.
    """
    scored = saved(score_documents(docs, trusted))
    good = scored.where("held AND perplexity IS NOT NULL")
    at = lambda c: F.percentile_approx(c, quantile, 100_000) * slack
    by_language = good.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), at("perplexity").alias("own"), at("tail").alias("own_tail")).where(F.col("n") >= least_trusted).drop("n")
    everything = good.agg(at("perplexity").alias("any"), at("tail").alias("any_tail"))
    limit, limit_tail = F.coalesce("own", "any"), F.coalesce("own_tail", "any_tail")
    joined = scored.join(by_language, "lang", "left").join(F.broadcast(everything))  # one row
    keep = F.coalesce((F.col("perplexity") <= limit) & (F.col("tail") <= limit_tail), F.col("perplexity").isNotNull())
    return joined.select("doc_id", "lang", "n_bytes", "perplexity", limit.alias("threshold"), "tail", limit_tail.alias("tail_threshold"), keep.alias("keep"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    out = judge_quality(docs, trusted)
    return out.select("doc_id", "lang", "n_bytes", *[F.round(c, 6).alias(c) for c in ("perplexity", "threshold", "tail", "tail_threshold")], "keep")
