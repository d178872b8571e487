"""Splits, shuffles and batches, all from hashes of a seed and keys: reruns and other partitionings agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform
from .ids import cuts, with_places, with_row_number

PARTS = ("train", "valid", "test")
DEFAULT_RATIO = (0.8, 0.1, 0.1)


def _cut(count: Column, ratio: tuple[float, ...]) -> tuple[Column, Column]:
    """Sizes of train and valid: valid and test get their floors; then test, then valid, get one from train if empty."""
    valid, test = F.floor(count * F.lit(ratio[1])), F.floor(count * F.lit(ratio[2]))
    train = count - valid - test
    need_test = (test == 0) & (train > 1)
    train = train - need_test.cast("int")
    need_valid = (valid == 0) & (train > 1)
    return train - need_valid.cast("int"), valid + need_valid.cast("int")


def _part(place: Column, train: Column, valid: Column) -> Column:
    return F.when(place < train, PARTS[0]).when(place < train + valid, PARTS[1]).otherwise(PARTS[2])


def shuffle_within_user(df: DataFrame, keys: list[str], seed: int = 42, name: str = "place", hot: DataFrame | None = None) -> DataFrame:
    """The 0-based place of each row in a random order of its user's rows; ``keys`` tell rows apart."""
    order = [uniform(seed, "within", "user_id", *keys), *keys]
    return with_places(df, "user_id", order, hot).drop("_size").withColumnRenamed("_place", name)


def split_by_ratio(df: DataFrame, keys: list[str], ratio: tuple[float, ...] = DEFAULT_RATIO, mode: str = "user_entry", seed: int = 42, hot: DataFrame | None = None) -> DataFrame:
    """``df`` with its part in ``split``.

    ``user_entry`` cuts each user's shuffled rows, ``entry`` the shuffled rows of all, ``user`` the shuffled users. Users of
    very many rows (``hot``, worked out unless given) are spread over tasks; cuts through all rows need no sort.
    """
    if mode == "user_entry":
        order = [uniform(seed, "within", "user_id", *keys), *keys]
        placed = with_places(df, "user_id", order, hot)
        return placed.withColumn("split", _part(F.col("_place"), *_cut(F.col("_size"), ratio))).drop("_size", "_place")
    if mode == "entry":
        return df.withColumn("split", _cut_rows(df, uniform(seed, "entry", *keys), keys, lambda n: _whole_cut(n, ratio)))
    if mode == "user":

        def floors(m: int) -> tuple[int, int]:
            valid, test = int(m * ratio[1]), int(m * ratio[2])
            return m - valid - test, m - test

        users = df.select("user_id").distinct()
        parts = users.withColumn("split", _cut_rows(users, uniform(seed, "user", "user_id"), ["user_id"], floors))
        return df.join(parts, "user_id")
    raise ValueError(f"unknown mode {mode!r}")


def _whole_cut(n: int, ratio: tuple[float, ...]) -> tuple[int, int]:
    """Ends of train and valid among n rows, by the rule of ``_cut``."""
    valid, test = int(n * ratio[1]), int(n * ratio[2])
    train = n - valid - test
    if test == 0 and train > 1:
        train -= 1
    if valid == 0 and train > 1:
        train, valid = train - 1, 1
    return train, train + valid


def _cut_rows(df: DataFrame, u: Column, keys: list[str], ends: Callable[[int], tuple[int, int]]) -> Column:
    """The part of each row, in the order of its draw and keys."""
    _, (train, valid) = cuts(df, u, keys, lambda n: list(ends(n)))
    return F.when(train, PARTS[0]).when(valid, PARTS[1]).otherwise(PARTS[2])


def leave_n_out(df: DataFrame, order: list[str], n: int = 2, hot: DataFrame | None = None) -> DataFrame:
    """``df`` with ``part``: the last n rows of a user go to parts 1..n in turn, the rest to 0.

    A user's first row stays in part 0 as long as there is another; so short users give up the earlier parts first.
    Users of very many rows (``hot``, worked out unless given) are spread over tasks.
    """
    left = F.col("_size") - 1 - F.col("_place")
    part = F.when((F.col("_place") == 0) & (F.col("_size") > 1), 0).when(left < n, (F.lit(n) - left).cast("int")).otherwise(0)
    return with_places(df, "user_id", order, hot).withColumn("part", part).drop("_place", "_size")


def leave_last_distinct(df: DataFrame, order: list[str], n: int = 2) -> DataFrame:
    """``leave_n_out`` over the first occurrences of each user's items; repeats are dropped."""
    from .interact import drop_duplicate_pairs

    return leave_n_out(drop_duplicate_pairs(df, order), order, n)


def valid_ratio(ratio: object) -> tuple[float, ...]:
    """The ratio itself if it is three shares that add up to 1, else the default."""
    ok = isinstance(ratio, (list, tuple)) and len(ratio) == 3 and abs(sum(ratio) - 1) < 1e-6
    return tuple(ratio) if ok else DEFAULT_RATIO  # type: ignore[arg-type]


def random_split(df: DataFrame, keys: list[str], ratio: object = DEFAULT_RATIO, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the shuffled rows cut at the floors of n r0 and n (r0 + r1)."""
    r = valid_ratio(ratio)
    return df.withColumn("split", _cut_rows(df, uniform(seed, "random", *keys), keys, lambda n: (int(n * r[0]), int(n * (r[0] + r[1])))))


def holdout_split(train: DataFrame, test: DataFrame, keys: list[str], ratio: object = 0.8, seed: int = 42) -> DataFrame:
    """A given test table; the train table is shuffled and cut into train and valid at a share in (0, 1), else at 0.8."""
    share = ratio if isinstance(ratio, float) and 0 < ratio < 1 else 0.8
    parts = train.withColumn("split", _cut_rows(train, uniform(seed, "holdout", *keys), keys, lambda n: (int(n * share), n)))
    return parts.unionByName(test.withColumn("split", F.lit("test")))


def _batches(rows: DataFrame, count: int, size: int, drop_last: bool) -> DataFrame:
    out = rows.withColumn("batch", F.floor(F.col("_row") / size)).withColumn("place", (F.col("_row") % size).cast("int"))
    return out.where(F.col("batch") < count // size) if drop_last else out


def assign_batches(df: DataFrame, size: int, keys: list[str], shuffle: bool = False, drop_last: bool = False, seed: int = 42) -> DataFrame:
    """``df`` with ``batch`` and ``place``: in the order of the keys, or shuffled; a short last batch may be dropped."""
    order = [uniform(seed, "batch", *keys), *keys] if shuffle else keys
    return _batches(with_row_number(df, order, "_row"), df.count(), size, drop_last).drop("_row")


def assign_length_buckets(df: DataFrame, size: int, length: str, keys: list[str], shuffle: bool = False, drop_last: bool = False, seed: int = 42) -> DataFrame:
    """Batches of rows of about one length: in order of length, if shuffled within random groups of 10 batches each."""
    if shuffle:  # a group has 10 batches, so its order is a window
        ranked = with_row_number(df, [uniform(seed, "bucket", *keys), *keys], "_rank").withColumn("_group", F.floor(F.col("_rank") / (10 * size)))
        place = F.row_number().over(Window.partitionBy("_group").orderBy(length, *keys)) - 1
        rows = ranked.withColumn("_row", F.col("_group") * 10 * size + place).drop("_rank", "_group")
    else:
        rows = with_row_number(df, [length, *keys], "_row")
    return _batches(rows, df.count(), size, drop_last).drop("_row")


def alternate_batches(tail: DataFrame, head: DataFrame) -> DataFrame:
    """Batches of both directions in turn: even steps from ``tail``, odd ones from ``head``."""
    a = tail.withColumn("step", F.col("batch") * 2).withColumn("mode", F.lit("tail"))
    return a.unionByName(head.withColumn("step", F.col("batch") * 2 + 1).withColumn("mode", F.lit("head")))
