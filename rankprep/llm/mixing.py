"""Mixing sources to target weights by capped water-filling; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import with_group_places
from .common import FEW_IDS, free_name, saved

#: Up to so many sources, which are counted, are broadcast.
FEW_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def uniform(seed: int, stage: str, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed, the stage and the keys only: reruns and other partitionings agree."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit(stage), *keys))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The sources, by code point with null last, get the weights in turn. Together they get ``share`` of all sizes, by
    weight; a source that would get more than ``max_epochs`` times its size is clamped there, and the excess goes to
    the others by weight, until none is above. Sorted by limit over weight, the clamped sources are a leading run: the
    level of the rest is found with two running sums over one row per source. If all are clamped, the total is what
    the limits allow.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    given = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(given, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    line = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    onward = line.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with what the mix takes of each document.

    Adds mix_size (words), mix_source_size, mix_target (of the source), mix_whole (whole repetitions), mix_part (words
    of one more, fractional repetition), mix_part_from (0-based word where that begins, wrapping around) and mix_taken
    (all words taken). A source's documents all repeat target / source_size times; the fractional repetition is a
    seeded slice of the document, its length rounded up or down by a seeded draw, so a source's words come within
    rounding of its target. Draws are by doc_id, text and, where rows of a source have both alike, by their number among these, so
    rows without a doc_id and repeated ones are rounded each by itself.

    Null text has size 0; null is a source of its own; an empty table gives an empty table; repeated rows count each;
    very long texts count whole; documents without words take none. The row count never changes. Other columns pass
    through; those of the names above are replaced.
    """
    id_, text, nth = (free_name(docs.columns, f"_mix_{x}") for x in ("id", "text", "nth"))
    sized = _numbered(docs.withColumn("mix_size", n_words("text")), id_, text, nth)
    targets = saved(source_targets(sized.select("source", F.col("mix_size").alias("size")), weights, share, max_epochs))
    t = targets.select(F.col("source").alias("mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    t = F.broadcast(t) if targets.count() <= FEW_SOURCES else t
    sized = sized.drop("mix_source_size", "mix_target")
    out = sized.join(t, sized["source"].eqNullSafe(t["mix_key"]), "left").drop(t["mix_key"])
    ratio = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    size = F.col("mix_size")
    part = F.floor(size * (ratio - F.floor(ratio)) + uniform(seed, "part", id_, text, nth))
    out = out.withColumn("mix_whole", F.floor(ratio)).withColumn("mix_part", F.least(size, part))
    out = out.withColumn("mix_part_from", F.floor(size * uniform(seed, "from", id_, text, nth)))
    return out.withColumn("mix_taken", F.col("mix_whole") * size + F.col("mix_part")).drop(id_, text, nth)


def _numbered(docs: DataFrame, id_: str, text: str, nth: str) -> DataFrame:
    """``docs`` with doc_id and the md5 of the text as text, null as '', and a number from 0 among rows that agree in both and
    in the source.

    Which of these rows gets which number makes no difference. Agreeing rows, if there are any, are found by narrow counts
    and numbered apart; a group of any size is spread over tasks.
    """
    docs = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn(text, F.md5(F.coalesce("text", F.lit(""))))
    own = docs.select(F.col(id_).alias("i"), F.col(text).alias("t"), F.col("source").alias("s")).groupBy("i", "t", "s").agg(F.count("*").alias("n"))
    again = saved(own.where("n > 1").select("i", "t", "s"))
    found = again.limit(FEW_IDS + 1).count()
    if not found:
        return docs.withColumn(nth, F.lit(0).cast("long"))
    again = F.broadcast(again) if found <= FEW_IDS else again
    left = docs.alias("d")
    same = (F.col(f"d.{id_}") == F.col("i")) & (F.col(f"d.{text}") == F.col("t")) & F.col("d.source").eqNullSafe(F.col("s"))
    many = with_group_places(left.join(again, same, "left_semi"), [id_, text, "source"], []).drop("_size").withColumnRenamed("_place", nth)
    return left.join(again, same, "left_anti").withColumn(nth, F.lit(0).cast("long")).unionByName(many)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


def mix_sql(documents: str = "documents", columns: str = "") -> str:
    """DuckDB SQL of the mix over a table or subquery; ``columns`` are further expressions over d (documents)."""
    u = lambda stage: f"(('0x' || substr(md5(concat_ws('|', '42', '{stage}', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')), nth::varchar)), 1, 13))::bigint / 4503599627370496.0::double)"
    return f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, '')), source) - 1 AS nth, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size FROM {documents}),
per AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::int]::double AS weight,
  source_size * 2.0::double AS cap, (sum(source_size) OVER ())::double * 1.5::double AS total FROM per),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double))
  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
  WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
found AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE level <= cap / weight),
t AS (SELECT l.source, l.source_size, CASE WHEN f.level IS NULL THEN l.cap ELSE least(l.cap, f.level * l.weight) END AS target
  FROM levels l CROSS JOIN found f),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::double END AS ratio
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, {columns} size, source_size, target,
  floor(ratio)::bigint * size + least(size, floor(size * (ratio - floor(ratio)) + {u("part")})::bigint) AS taken FROM j"""
