"""Source divergence audit: how far the words of each source of a language stray from those of its others.

Counting is one pass over the texts with partial counts in each task. The comparison of all sources of a language with each
other is a cube (block of sources, block of sources, block of terms): a task owns one cell, gets the two slices of counts
that meet there, returns partial sums for its pairs of sources, and these are added up along the axis of terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, saved

#: The scale of probabilities.
SCALE = 1_000_000_000
#: Sources of a block and terms of a block: a cell holds at most 2 * 32 * 8192 counts.
GROUPS, TERMS = 32, 8192
#: Distinct terms that a task gathers before it sends them on.
HELD = 800_000
#: Groups (lang, source) up to which their sums are broadcast.
FEW_GROUPS = 50_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and the documents that hold it.

    Terms are runs of ASCII letters and anything beyond ASCII, A-Z lower-cased. A task adds up what it meets and sends
    partial counts on whenever it holds ``HELD`` terms, so a frequent term or source is sent a few times by each task.
    """
    schema = "lang string, source string, term string, n long, docs long"
    target = arrow_schema(docs.sparkSession, schema)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def sent(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, found) in held.items():
            terms = pa.array(n.keys(), pa.binary(), size=len(n)).cast(pa.string())
            counts, docs_ = np.fromiter(n.values(), np.int64, len(n)), np.fromiter(map(found.__getitem__, n), np.int64, len(n))
            for a in range(0, len(n), 50_000):
                part = terms.slice(a, 50_000)
                yield as_batch({"lang": pa.array([lang] * len(part), pa.string()), "source": pa.array([source] * len(part), pa.string()), "term": part, "n": counts[a : a + 50_000], "docs": docs_[a : a + 50_000]}, target)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.large_binary())
            for lang, source, text in zip(langs, sources, texts, strict=True):
                n, found = held.setdefault((lang, source), (Counter(), Counter()))
                terms = _TERM.findall(text.as_py().lower())
                size -= len(n)
                n.update(terms)
                found.update(set(terms))
                size += len(n)
                if size > HELD:
                    yield from sent(held)
                    held, size = {}, 0
        yield from sent(held)

    parts = docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(count, schema)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * n / total) for 0 <= n <= total: three digits at a time, in whole numbers of 64 bits."""
    whole, rest = F.call_function("div", n, total), n % total
    for _ in range(3):
        whole, rest = whole * 1000 + F.call_function("div", rest * 1000, total), rest * 1000 % total
    return (whole + 1).cast("long")


def _scaled(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    whole, rest = n // total, n % total
    for _ in range(3):
        whole, rest = whole * 1000 + rest * 1000 // total, rest * 1000 % total
    return whole + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def partial_divergences(counts: np.ndarray, totals: np.ndarray, n_kept: int, n_here: int, rows: range, columns: range) -> np.ndarray:
    """Of the groups ``rows`` against the groups ``columns`` the sum of floor((p - q)^2 / q) over the terms of one block.

    ``counts`` (group, term) has the terms that some group of the cell holds; the others of the block's ``n_here`` terms
    occur in none of them, so each adds the same.
    """
    whole = np.maximum(totals + n_kept, 1)
    p, empty = _scaled(counts + 1, whole[:, None]), _scaled(np.ones_like(whole), whole)
    q, q0 = p[columns.start : columns.stop], empty[columns.start : columns.stop]
    out = np.empty((len(rows), len(columns)), np.int64)
    for i, g in enumerate(rows):
        d = p[g] - q
        d0 = empty[g] - q0
        out[i] = (d * d // q).sum(1) + d0 * d0 // q0 * (n_here - counts.shape[1])
    return out


def _cell(slices: pa.Table, cells: pa.Table) -> pa.Table:
    """(lang, g, h, value) of all ordered pairs of different groups of one cell (block bi, block bj, term block)."""
    cell = {c: cells[c][0].as_py() for c in ("lang", "bi", "bj", "n_kept", "n_here", "left", "right")}
    blocks = [cell["left"]] if cell["bi"] == cell["bj"] else [cell["left"], cell["right"]]
    groups = np.array([x["g"] for b in blocks for x in b], np.int64)
    totals = np.array([x["total"] for b in blocks for x in b], np.int64)
    terms = slices["term"].combine_chunks().dictionary_encode() if slices.num_rows else None
    counts = np.zeros((len(groups), len(terms.dictionary) if terms else 0), np.int64)
    if terms:
        counts[np.searchsorted(groups, np.asarray(slices["g"].combine_chunks())), np.asarray(terms.indices)] = np.asarray(slices["n"].combine_chunks())
    cut = len(cell["left"])
    parts = [range(cut), range(cut)] if len(blocks) == 1 else [range(cut), range(cut, len(groups))]
    out = []
    for rows, columns in [(parts[0], parts[1]), (parts[1], parts[0])][: len(blocks)]:
        value = partial_divergences(counts, totals, cell["n_kept"], cell["n_here"], rows, columns)
        g, h = np.repeat(groups[rows.start : rows.stop], len(columns)), np.tile(groups[columns.start : columns.stop], len(rows))
        out.append((g, h, value.ravel()))
    g, h, value = (np.concatenate(x) for x in zip(*out, strict=True))
    other = g != h
    return pa.table({"lang": pa.array([cell["lang"]] * int(other.sum()), pa.string()), "g": g[other], "h": h[other], "value": value[other]})


def pair_divergences(kept: DataFrame, groups: DataFrame, langs: DataFrame, small: Callable[[DataFrame], DataFrame] = lambda x: x, block: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """(lang, g, h, value) of all ordered pairs of groups of a language, through the cube.

    A count is sent to one cell for each block of sources of its language; a cell's rows number at most 2 * ``block`` times
    about ``terms``, whatever the size of a source or language. Blocks of terms have about ``terms`` terms by a hash.
    ``small`` marks tables of at most a row for each group, for broadcast where these are counted to be few.
    """
    blocks = groups.groupBy("lang", F.floor(F.col("g") / block).alias("b")).agg(F.sort_array(F.collect_list(F.struct("g", "total"))).alias("own"))
    numbered = langs.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n_kept") / terms)))
    tb = F.pmod(F.xxhash64("term"), F.col("n_blocks"))
    placed = kept.join(small(numbered), "lang").withColumn("tb", tb)
    sizes = placed.where("first").groupBy("lang", "tb").agg(F.count("*").alias("n_here"))
    left = blocks.select("lang", F.col("b").alias("bi"), F.col("own").alias("left"))
    right = blocks.select("lang", F.col("b").alias("bj"), F.col("own").alias("right"))
    cells = left.join(right, "lang").where("bi <= bj").join(small(numbered), "lang")
    cells = cells.withColumn("tb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    cells = cells.join(sizes, ["lang", "tb"], "left").withColumn("n_here", F.coalesce("n_here", F.lit(0).cast("long")))
    few = groups.groupBy("lang").agg(F.floor(F.max("g") / block).alias("last"))
    sent = placed.join(small(few), "lang").withColumn("own", F.floor(F.col("g") / block))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    sent = sent.select("lang", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "tb", "g", "term", "n")
    keys = ["lang", "bi", "bj", "tb"]
    parts = sent.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(_cell, "lang string, g long, h long, value long")
    return parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def source_divergences(docs: DataFrame, min_docs: int = 3, top: int = 200, block: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each source of a language apart from the others, and in which terms.

    A language keeps the V terms that at least ``min_docs`` of its documents (rows) hold. A group is a language and a
    source, and its p of a kept term is 1 + floor(SCALE * (n + 1) / (N + V)), N being all its occurrences of kept terms; that
    of the whole language likewise. Part ``pair``: item is each other source of the language, value the sum over all kept
    terms of floor((p - q)^2 / q), with the other's q (0 without kept terms). Part ``term``: item is each kept term that
    the group holds with a p above the language's q, value floor((p - q)^2 / q), of which the first ``top`` are given.
    Ranks begin at 1, by falling value and rising item (as UTF-8). All numbers are whole and exact, to 9e15 occurrences
    of a language and 2e9 kept terms.

    Null text, lang and source are ''; empty and null texts have no terms but their group is told; repeated rows are
    documents each; texts of any length are counted whole; an empty table gives an empty one. Other columns are not read.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    groups = saved(groups)
    own = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("_docs", F.sum("docs").over(own)).where(F.col("_docs") >= min_docs)
    counts = counts.withColumn("lang_n", F.sum("n").over(own)).withColumn("first", F.row_number().over(own.orderBy("source")) == 1)
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    kept = saved(counts.join(small(groups), ["lang", "source"]).select("lang", "g", "term", "n", "lang_n", "first"))

    totals = kept.groupBy("lang", "g").agg(F.sum("n").alias("total"))
    groups = saved(groups.join(totals, ["lang", "g"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long"))))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("n_kept"), F.sum("n").alias("lang_total"))
    langs = groups.select("lang").distinct().join(langs, "lang", "left").fillna(0, ["n_kept", "lang_total"])
    langs = saved(langs)

    pairs = pair_divergences(kept, groups, langs, small, block, terms)
    name = lambda g, as_: groups.select("lang", F.col("g").alias(g), F.col("source").alias(as_))
    pairs = pairs.join(small(name("g", "source")), ["lang", "g"]).join(small(name("h", "item")), ["lang", "h"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    found = kept.join(small(groups.select("lang", "g", "source", "total")), ["lang", "g"]).join(small(langs), "lang")
    found = found.withColumn("p", scaled(F.col("n") + 1, F.col("total") + F.col("n_kept"))).withColumn("q", scaled(F.col("lang_n") + 1, F.col("lang_total") + F.col("n_kept")))
    found = found.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(found.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


def divergence_sql(documents: str = "documents") -> str:
    """DuckDB SQL of the query."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    p = lambda n, total: f"(1 + 1000000000::hugeint * ({n} + 1) // ({total} + v))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {letters}) AS text FROM {documents}),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "coalesce(n.total, 0)")} AS p, {p("k.ln", "l.lt")} AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::bigint AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
e AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::bigint AS value FROM a WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM (SELECT * FROM b UNION ALL SELECT * FROM e))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""
