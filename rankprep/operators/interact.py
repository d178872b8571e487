"""Interaction tables (user_id, item_id, rating, ts, ...): ratings, repeats, k-core, statistics, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..tables import release, saved


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def implicit_rating(df: DataFrame) -> DataFrame:
    """A constant rating of 1 where the table has none."""
    return df if "rating" in df.columns else df.withColumn("rating", F.lit(1.0))


def threshold_ratings(df: DataFrame, threshold: float | None, drop_low: bool | None = False) -> DataFrame:
    """Ratings as 0 or 1 by the threshold; with ``drop_low`` the lower ones go and the rest become 1."""
    if threshold is None:
        return df
    high = F.col("rating") >= threshold
    if drop_low:
        return df.where(high).withColumn("rating", F.lit(1.0))
    return df.withColumn("rating", F.when(high, 1.0).otherwise(0.0))


def split_sequence(df: DataFrame, col: str, sep: str, cast: str = "string") -> DataFrame:
    """A delimited text column as an array; null is empty, empty pieces are dropped."""
    quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in sep)
    pieces = F.filter(F.split(F.coalesce(F.col(col), F.lit("")), quoted), lambda x: x != "")
    return df.withColumn(col, pieces.cast(f"array<{cast}>"))


def max_length(df: DataFrame, col: str) -> int:
    return df.agg(F.coalesce(F.max(F.size(col)), F.lit(0))).first()[0]


def pad_sequence(df: DataFrame, col: str, max_len: int, pad: float = 0) -> DataFrame:
    """The first ``max_len`` elements, filled up on the right."""
    kind = dict(df.dtypes)[col]
    cut = F.slice(col, 1, max_len)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(max_len) - F.size(cut), F.lit(0))).cast(kind)
    return df.withColumn(col, F.concat(cut, fill))


def parse_time(df: DataFrame, col: str = "ts", fmt: str | None = None) -> DataFrame:
    """Numbers stay; strings need a format and become timestamps; nothing else is a time."""
    kind = df.schema[col].dataType
    if isinstance(kind, NumericType):
        return df
    if isinstance(kind, StringType):
        if not fmt:
            raise ValueError(f"{col} holds strings: a time format is needed")
        return df.withColumn(col, F.to_timestamp(col, fmt))
    raise TypeError(f"{col} is {kind.simpleString()}, not a number or string")


def first_occurrence(df: DataFrame, order: list[str], name: str = "first") -> DataFrame:
    """Flags each row that is the first of its user and item."""
    w = Window.partitionBy("user_id", "item_id").orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) == 1)


def drop_duplicate_pairs(df: DataFrame, order: list[str]) -> DataFrame:
    return first_occurrence(df, order, "_first").where("_first").drop("_first")


def keep_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """The listed columns, and the rating always."""
    return df.select(*[c for c in df.columns if c in fields or c == "rating"])


def fill_missing(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Nulls by type: float becomes the column's mean, token the pad 0, sequences an empty array."""
    floats = [c for c, t in types.items() if t == "float"]
    if floats:
        means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in floats])
        df = df.join(F.broadcast(means))  # one row
    for c, t in types.items():
        if t == "float":
            df = df.withColumn(c, F.coalesce(F.col(c), F.col(f"_mean_{c}"))).drop(f"_mean_{c}")
        elif t == "token":
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)))
        else:
            df = df.withColumn(c, F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)))
    return df


def reindex_catalogue(attributes: DataFrame, dim: DataFrame, types: dict[str, str]) -> DataFrame:
    """One attribute row for each id of ``dim``; ids without attributes get the fill of their types."""
    return fill_missing(dim.select("id").join(attributes, "id", "left"), types)


def attach_features(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Left joins of user attributes (by user_id) and item attributes (by item_id)."""
    return df.join(users, "user_id", "left").join(items, "item_id", "left")


def order_interactions(df: DataFrame, order: list[str]) -> DataFrame:
    """Users together, their rows in order."""
    return df.repartition("user_id").sortWithinPartitions("user_id", *order)


#: Up to so many ids (8 MB) are broadcast, once they are counted.
FEW = 1_000_000


def _few(table: DataFrame, count: int) -> DataFrame:
    return F.broadcast(table) if count <= FEW else table


def kcore(df: DataFrame, min_user: int, min_item: int) -> DataFrame:
    """Drops users and items with too few interactions until none are left with too few; what is left doesn't depend on
    the order of dropping. If nothing qualifies the result is empty.

    Users and items keep their number of interactions. A round takes off what they had with those dropped in the round
    before, so only neighbours of these are counted; the pairs, one narrow row each, are written anew without dropped ones
    whenever these have become many. The table itself is met once, at the end.
    """
    least = F.when(F.col("_side") == 0, min_user).otherwise(min_item)
    kinds = dict(df.dtypes)
    kind = kinds["user_id"] if kinds["user_id"] == kinds["item_id"] else "string"  # both are ids of one table of nodes
    pairs = saved(df.groupBy(F.col("user_id").cast(kind).alias("_u"), F.col("item_id").cast(kind).alias("_i")).agg(F.count("*").alias("_n")))
    sides = F.array(F.struct(F.lit(0).alias("_side"), F.col("_u").alias("_id"), F.col("_i").alias("_other")), F.struct(F.lit(1).alias("_side"), F.col("_i").alias("_id"), F.col("_u").alias("_other")))
    ends = lambda rows: rows.select(F.explode(sides).alias("x"), "_n").select("x.*", "_n")

    def counted(table: DataFrame) -> tuple[DataFrame, int, int]:
        """The saved nodes with _low, whether they have too few, how many there are, and how many of these have too few."""
        seen = Observation()
        out = saved(table.withColumn("_low", F.col("_deg") < least).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("_low").alias("low")))
        return out, seen.get["n"], seen.get["low"]

    nodes, count, low = counted(ends(pairs).groupBy("_side", "_id").agg(F.sum("_n").alias("_deg")))
    gone = 0
    while low:
        dropped = nodes.where("_low").select(F.col("_side").alias("_s"), F.col("_id").alias("_d"))
        hit = ends(pairs).join(_few(dropped, low), (F.col("_side") == F.col("_s")) & F.col("_id").eqNullSafe(F.col("_d")))
        lost = hit.groupBy((1 - F.col("_side")).alias("_s"), F.col("_other").alias("_d")).agg(F.sum("_n").alias("_lost"))
        rest = nodes.where("NOT _low").join(lost, (F.col("_side") == F.col("_s")) & F.col("_id").eqNullSafe(F.col("_d")), "left")
        gone += low
        after, count, low = counted(rest.select("_side", "_id", (F.col("_deg") - F.coalesce("_lost", F.lit(0))).alias("_deg")))
        release(nodes)
        nodes = after
        if low and gone > count // 4:
            left = saved(_between(pairs, nodes, count, "_u", "_i"))
            release(pairs)
            pairs, gone = left, 0
    release(pairs)
    return _between(df, nodes, count, "user_id", "item_id")


def _between(rows: DataFrame, nodes: DataFrame, count: int, user: str, item: str) -> DataFrame:
    """The rows whose user and item both are among the nodes."""
    for side, col in ((1, item), (0, user)):
        own = nodes.where(F.col("_side") == side).select(F.col("_id").alias("_kept"))
        rows = rows.join(_few(own, count), F.col(col).cast(own.schema["_kept"].dataType).eqNullSafe(F.col("_kept")), "left_semi")
    return rows


def dataset_stats(df: DataFrame) -> DataFrame:
    """One row: users and items (pad included) and interactions."""
    return df.agg((F.countDistinct("user_id") + 1).alias("n_users"), (F.countDistinct("item_id") + 1).alias("n_items"), F.count("*").alias("n_interactions"))


def history(df: DataFrame, order: list[str], by: str = "user_id", of: str = "item_id", dim: DataFrame | None = None) -> DataFrame:
    """(id, items, n): the list of each id in order; with ``dim`` (id) absent ids have an empty list."""
    lists = df.groupBy(F.col(by).alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(of).alias("_of")))), lambda x: x["_of"]).alias("items"))
    if dim is not None:
        kind = lists.schema["items"].dataType
        lists = dim.select("id").join(lists, "id", "left").withColumn("items", F.coalesce("items", F.array().cast(kind)))
    return lists.withColumn("n", F.size("items"))


def merge_history(train: DataFrame, valid: DataFrame) -> DataFrame:
    """(id, items, n) of train and valid together, as a bag, in falling order of the items."""
    return train.unionByName(valid).groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list("item_id"), asc=False).alias("items"), F.count("*").cast("int").alias("n"))


def item_freq(targets: DataFrame, dim: DataFrame) -> DataFrame:
    """(id, freq): how often each item of ``dim`` is a train target, 0 for unseen ones."""
    counts = targets.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("freq"))
    return dim.select("id").join(counts, "id", "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))


def eval_groups(df: DataFrame, order: list[str], by_row: bool = False) -> DataFrame:
    """(user_id, items, ratings): evaluation rows as one record for each user that has any; ``by_row``, each by itself."""
    if by_row:
        return df.select("user_id", F.array("item_id").alias("items"), F.array("rating").alias("ratings"))
    rows = F.sort_array(F.collect_list(F.struct(*order, "item_id", "rating")))
    return df.groupBy("user_id").agg(rows.alias("_rows")).select("user_id", F.col("_rows.item_id").alias("items"), F.col("_rows.rating").alias("ratings"))
