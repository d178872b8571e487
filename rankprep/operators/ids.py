"""Contiguous ids, prefix sums and dictionaries. Id 0 is padding everywhere; ids begin at 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved

_LOCAL = (1 << 33) - 1
PAD = "[PAD]"


def sorted_parts(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` in a total order over range partitions, with _part and _at, the place within the part."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(ranged.withColumn("_id", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit(_LOCAL))).drop("_id")


def with_row_number(df: DataFrame, order: list[Column | str], name: str = "row") -> DataFrame:
    """``df`` with its 0-based place in a total order, without gathering the rows in one task.

    Rows are range-partitioned and sorted; a second pass adds up the sizes of the parts, one row for each.
    """
    parts = sorted_parts(df, order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    return parts.join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_part", "_at", "_start")


def with_prefix_sum(df: DataFrame, value: str, order: list[Column | str], name: str = "total") -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row in a total order, in two passes like the above."""
    parts = sorted_parts(df, order)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = sums.select("_part", before.alias("_start"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(starts, "_part").withColumn(name, F.col("_start") + within).drop("_part", "_at", "_start")


def with_group_places(df: DataFrame, keys: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """``df`` with _place, the 0-based place within its group of equal ``keys``, and _size, the group's rows; with
    ``value`` also _run, its sum up to and including the row, and _total, that of the group.

    As above, so that a group of any size is spread over tasks: each part of it is numbered by itself, and the parts'
    sizes, one row for each part and group, are added up.
    """
    v = F.col(value) if value else F.lit(0.0)
    parts = sorted_parts(df, [*keys, *order])
    sums = parts.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.sum(v).alias("_s"))
    group = Window.partitionBy(*keys)
    past = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *keys, *[F.coalesce(F.sum(c).over(past), F.lit(zero)).alias(f"{c}0") for c, zero in (("_n", 0), ("_s", 0.0))], F.sum("_n").over(group).alias("_size"), F.sum("_s").over(group).alias("_total"))
    own = Window.partitionBy("_part", *keys).orderBy("_at")
    out = parts.withColumn("_place", F.row_number().over(own) - 1).withColumn("_run", F.sum(v).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    mine = sums.select(F.col("_part").alias("_part0"), *[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], "_n0", "_s0", "_size", "_total")
    same = F.col("_part") == F.col("_part0")
    for i, c in enumerate(keys):  # null is a group like others
        same &= F.col(c).eqNullSafe(F.col(f"_key{i}"))
    out = out.join(mine, same).withColumn("_place", F.col("_n0") + F.col("_place")).withColumn("_run", F.col("_s0") + F.col("_run"))
    return out.drop("_part", "_at", "_part0", "_n0", "_s0", *[f"_key{i}" for i in range(len(keys))], *([] if value else ["_run", "_total"]))


#: Rows from which a group is spread over tasks.
HOT = 1_000_000


def hot_groups(df: DataFrame, key: str, more_than: int | None = None) -> DataFrame:
    """(key) of the groups of more than HOT rows, saved: at most one for each HOT rows of the table."""
    counted = df.groupBy(key).agg(F.count("*").alias("_n"))
    return saved(counted.where(F.col("_n") > (HOT if more_than is None else more_than)).select(key))


def without_and_with(df: DataFrame, hot: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of other groups, and those of the hot ones."""
    own = F.broadcast(hot.select(F.col(key).alias("_hot")))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(own, same, "left_anti"), df.join(own, same, "left_semi")


def with_places(df: DataFrame, key: str, order: list[Column | str], hot: DataFrame | None = None) -> DataFrame:
    """``df`` with _place, the 0-based place within its group, and _size, the group's rows.

    Groups are windows of one task each, but for the hot ones (``hot_groups``, worked out here unless they are given),
    whose parts are numbered apart, so that no task has more rows of one group than of others.
    """
    hot = hot_groups(df, key) if hot is None else hot
    few, many = (df, None) if not hot.limit(1).count() else without_and_with(df, hot, key)
    own = Window.partitionBy(key)
    out = few.withColumn("_place", (F.row_number().over(own.orderBy(*order)) - 1).cast("long")).withColumn("_size", F.count("*").over(own))
    return out if many is None else out.unionByName(with_group_places(many, [key], order))


#: Values that a cut sorts in the end.
FEW_VALUES = 10_000
_BITS, _STEP = 52, 16


def cuts(df: DataFrame, u: Column, keys: list[str], ranks: Callable[[int], list[int]]) -> tuple[int, list[Column]]:
    """The number of rows n, and for each of ``ranks(n)`` a condition that holds for just so many rows: the first in the
    order of ``u``, in [0, 1) with 52 bits, and ``keys``.

    Rows are neither sorted nor moved. Their draws are counted by their first bits, then, for the counts that the ranks fall
    into, by further bits, until few are left, which tell the row at the rank; rows are then compared with it.
    """
    bits = (u * F.lit(float(1 << _BITS))).cast("long")
    rows = df.select(bits.alias("_b"), *keys)
    at = lambda shift: F.shiftright("_b", shift)
    count = lambda part, shift: {r["k"]: r["n"] for r in part.groupBy(at(shift).alias("k")).agg(F.count("*").alias("n")).collect()}  # noqa: E731  # 65,536 at most
    first = _BITS - _STEP
    top = count(rows, first)
    n = sum(top.values())
    out = []
    for rank in ranks(n):
        if rank <= 0 or rank >= n:
            out.append(F.lit(rank > 0))
            continue
        shift, found, part, rest = first, top, rows, rank
        while True:
            for k in sorted(found):  # the bits of the row at the rank
                if rest < found[k]:
                    break
                rest -= found[k]
            part = rows.where(at(shift) == k)
            if found[k] <= FEW_VALUES or shift == 0:
                break
            shift = max(0, shift - _STEP)
            found = count(part, shift)
        bound = part.orderBy("_b", *keys).limit(rest + 1).collect()[rest]
        before = F.lit(False)
        for c in reversed(keys):
            same, mine = F.lit(bound[c]), F.col(c)
            less = F.lit(False) if bound[c] is None else F.coalesce(mine < same, mine.isNull())  # nulls come first
            before = less | (mine.eqNullSafe(same) & before)
        out.append((bits < bound["_b"]) | ((bits == bound["_b"]) & before))
    return n, out


def token_stream(texts: DataFrame, order: list[str], col: str = "text", sep: str = " ", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, pos, token): all tokens of the texts in ``order``, split at ``sep``, with their 0-based place in the stream.

    Texts are put in order and their numbers of tokens added up; the tokens themselves are neither sorted nor shuffled.
    """
    quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in sep)
    parts = F.split(F.col(col), quoted, -1)
    counted = texts.where(F.col(col).isNotNull()).withColumn("_tokens", F.size(parts).cast("long"))
    placed = with_prefix_sum(counted, "_tokens", order, "_end").withColumn("_start", F.col("_end").cast("long") - F.col("_tokens"))
    return placed.select(*keep, "_start", F.posexplode(parts).alias("_at", "token")).select(*keep, (F.col("_start") + F.col("_at")).alias("pos"), "token")


def build_dictionary(df: DataFrame, cols: list[str], order: list[str], pad: str = PAD) -> DataFrame:
    """(token, id): ids from 1 by first appearance of the tokens of ``cols``, which share one id space; the pad has 0.

    In a row, columns count in the order given. Nulls and the pad token itself get no new id.
    """
    key = F.struct(*order)
    rows = df.select(key.alias("key"), F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("place", "token"))
    first = rows.where(F.col("token").isNotNull() & (F.col("token") != pad)).groupBy("token").agg(F.min(F.struct("key", "place")).alias("first"))
    ids = with_row_number(first, ["first"], "id").select("token", (F.col("id") + 1).alias("id"))
    return ids.unionByName(df.sparkSession.createDataFrame([(pad, 0)], "token string, id long"))


def frequency_vocab(tokens: DataFrame, order: list[str]) -> DataFrame:
    """(token, id, freq): ids from 1 by falling count, ties by first appearance in ``order``."""
    counted = tokens.groupBy("token").agg(F.count("*").alias("freq"), F.min(F.struct(*order)).alias("first"))
    ids = with_row_number(counted, [F.desc("freq"), F.asc("first")], "id")
    return ids.select("token", (F.col("id") + 1).alias("id"), "freq")


#: A token with more than this share of all is joined apart: there are at most 10,000 such tokens, which are broadcast.
HEAVY = 1 / 10_000


def _heavy(tokens: DataFrame, vocab: DataFrame) -> DataFrame | None:
    """(_token, _id) of the tokens that are more than HEAVY of all occurrences, by the vocabulary's freq or by counting;
    none where there are no more than HOT."""
    counts = vocab.select("token", "freq") if "freq" in vocab.columns else saved(tokens.groupBy(F.col("_token").alias("token")).agg(F.count("*").alias("freq")))
    total = counts.agg(F.sum("freq")).first()[0] or 0
    if total <= HOT:
        return None
    often = counts.where(F.col("freq") > F.lit(total * HEAVY)).select("token")
    return vocab.join(F.broadcast(often), "token").select(F.col("token").alias("_token"), F.col("id").alias("_hot"))


def _with_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``tokens`` (_token, ...) with _id, null for unknown ones. Rows of heavy tokens get it by broadcast and then are dealt
    out evenly, so a token of any frequency is no hot key."""
    v = vocab.select(F.col("token").alias("_known"), F.col("id").alias("_id"))
    heavy = _heavy(tokens, vocab)
    if heavy is None:
        return tokens.join(v, F.col("_token") == F.col("_known"), "left").drop("_known")
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*tokens.columns), F.lit(100_000)).cast("string"), F.lit("\x00"))
    met = tokens.join(F.broadcast(heavy), "_token", "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_token")).otherwise(spread))
    found = met.join(v, F.col("_key") == F.col("_known"), "left")
    return found.withColumn("_id", F.coalesce("_hot", "_id")).select(*tokens.columns, "_id")


def encode_tokens(df: DataFrame, vocab: DataFrame, cols: list[str], key: list[str] | None = None) -> DataFrame:
    """``df`` with the tokens of ``cols`` replaced by their ids; tokens that aren't known, and nulls, become 0.

    Array columns keep their order; ``key`` names columns that tell rows apart, which they need. Frequent tokens are met
    by broadcast, the others by a shuffle.
    """
    for c in cols:
        if dict(df.dtypes)[c].startswith("array"):
            own = _with_ids(df.select(*key, F.posexplode(F.col(c).cast("array<string>")).alias("_p", "_token")), vocab)
            ids = own.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_p", F.coalesce("_id", F.lit(0)).alias("_id"))))["_id"].alias("_ids"))
            df = df.join(ids, key, "left").withColumn(c, F.coalesce("_ids", F.array().cast("array<bigint>"))).drop("_ids")
        else:
            order = df.columns
            df = _with_ids(df.withColumn("_token", F.col(c).cast("string")), vocab).withColumn(c, F.coalesce("_id", F.lit(0).cast("long"))).select(*order)
    return df


def decode_ids(df: DataFrame, vocab: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with the ids of ``cols`` replaced by their tokens; unknown ids become null."""
    for c in cols:
        v = vocab.select(F.col("id").alias("_id"), F.col("token").alias("_token"))
        df = df.withColumn("_id", F.col(c)).join(v, "_id", "left").withColumn(c, F.col("_token")).drop("_token", "_id")
    return df
