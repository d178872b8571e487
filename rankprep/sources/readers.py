"""Delimited interactions, triples, token corpora, sparse multi-label rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..operators.interact import split_sequence
from ..tables import saved

ROLES = ("train", "valid", "test")
#: Parts of files up to which their places are broadcast.
FEW_PARTS = 100_000
_TYPES = {"token": StringType(), "float": DoubleType(), "token_seq": ArrayType(StringType()), "float_seq": ArrayType(DoubleType())}


def field_schema(specs: list[str]) -> tuple[StructType, dict[str, str]]:
    """Fields from specs ``name:type`` or ``name:type:"separator"``; and the separators of the sequences."""
    fields, separators = [], {}
    for spec in specs:
        m = re.fullmatch(r"([^:]+):(token|float|token_seq|float_seq)(?::\"(.*)\")?", spec.strip())
        if not m:
            raise ValueError(f"not a field: {spec!r}")
        name, kind, sep = m.groups()
        if kind.endswith("_seq") != (sep is not None):
            raise ValueError(f"sequences, and only they, have a separator: {spec!r}")
        fields.append(StructField(name, _TYPES[kind]))
        if sep is not None:
            separators[name] = sep
    return StructType(fields), separators


def read_interactions(
    spark: SparkSession, path: str, specs: list[str], sep: str = "\t", header: bool = True, encoding: str = "UTF-8", columns: list[str] | None = None, null_value: str = ""
) -> DataFrame:
    """The declared columns of a delimited file. ``columns`` gives the file's order if it has more than the declared."""
    schema, separators = field_schema(specs)
    of = {f.name: f for f in schema}
    flat = [StructField(n, of[n].dataType if n in of and n not in separators else StringType()) for n in columns or schema.names]
    df = spark.read.csv(path, schema=StructType(flat), sep=sep, header=header, encoding=encoding, nullValue=null_value).select(*schema.names)
    for name, own in separators.items():
        df = split_sequence(df, name, own, of[name].dataType.elementType.simpleString())
    return df


def role_of(name: str) -> str | None:
    """The first of train, valid and test that a file's name holds."""
    return next((role for role in ROLES if role in name), None)


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the files of a folder but hidden ones, in order; tables in folders of their own count as files."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        raise FileNotFoundError(path)
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(folder)) if n[0] not in "._")


def _by_role(spark: SparkSession, path: str, read) -> DataFrame:
    """The union of what is read of the files of each role. A file has one role, and one without is left out; so are roles
    without a file."""
    files: dict[str, list[str]] = {}
    for name in _listed(spark, path):
        files.setdefault(role_of(name) or "", []).append(f"{path.rstrip('/')}/{name}")
    out = None
    for role in ROLES:
        if role in files:
            part = read(files[role]).withColumn("split", F.lit(role))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no train, valid or test file in {path}")
    return out


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(head, relation, tail, split) from tab-separated files without header, the split by the file's name."""
    return _by_role(spark, path, lambda p: spark.read.csv(p, sep="\t", schema="head string, relation string, tail string"))


def read_corpus(spark: SparkSession, path: str, skip_first_char: bool = True) -> DataFrame:
    """(split, pos, token) from text files, split at single spaces; empty tokens and line ends stay. pos is the place in
    the file.

    Spaces are read as the ends of lines, so large files are split over tasks. The tokens of each part of a file are counted,
    and the parts before it give each its first place: tokens are neither sorted nor shuffled. A file without a byte has
    no token.
    """

    def read(files: list[str]) -> DataFrame:
        raw = spark.read.option("lineSep", " ").text(files).select(F.col("value").alias("token"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"))
        rows = raw.withColumn("_id", F.monotonically_increasing_id())  # a part of a file is read in order by one task
        blocks = rows.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.sum(F.octet_length("token") + 1).alias("_used"), F.max("size").alias("size"), F.min_by("token", "_id").alias("_token"))
        own = Window.partitionBy("file")
        before = F.coalesce(F.sum("_n").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # where a file's first character is a space, nothing stands before it once it is dropped
        blank = (F.min_by("_token", "block").over(own) == "").cast("int") if skip_first_char else F.lit(0)
        blocks = saved(blocks.select("file", "block", "_first", before.alias("_start"), blank.alias("_base"), "_n", "_used", "size"))
        few = F.broadcast if blocks.count() <= FEW_PARTS else lambda x: x
        placed = rows.join(few(blocks.select("file", "block", "_first", "_start", "_base")), ["file", "block"]).withColumn("_row", F.col("_start") + F.col("_id") - F.col("_first"))
        token = F.when(F.col("_row") == 0, F.substring("token", 2, 2**31 - 1)).otherwise(F.col("token")) if skip_first_char else F.col("token")
        placed = placed.where("_row >= _base").select((F.col("_row") - F.col("_base")).alias("pos"), token.alias("token"))
        files_ = blocks.groupBy("file").agg(F.sum("_n").alias("n"), F.sum("_used").alias("used"), F.max("size").alias("size"), F.max("_base").alias("base"))
        return placed.unionByName(files_.where("used = size").select((F.col("n") - F.col("base")).alias("pos"), F.lit("").alias("token")))

    return _by_role(spark, path, read).select("split", F.col("pos").cast("long").alias("pos"), "token")


def read_sparse_multilabel(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (row, labels, features) of ``l1,l2 f:v f:v`` lines, zero-based, and the header (samples, features, labels).

    A line that begins with a space has no label, and one of a space alone no feature either; an empty line is no row. ``row``
    is the 0-based number of the row, in the order of files and lines.
    """
    is_header = F.col("value").rlike(r"^\s*\d+\s+\d+\s+\d+\s*$")
    text = spark.read.text(path)
    lines = text.where(~is_header & (F.col("value") != "")).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("_id", F.monotonically_increasing_id())  # in order within a part of a file
    counted = lines.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each part
    starts = saved(counted.select("file", "block", "_first", start.alias("_start")))
    few = F.broadcast if starts.count() <= FEW_PARTS else lambda x: x
    lines = lines.join(few(starts), ["file", "block"]).withColumn("row", F.col("_start") + F.col("_id") - F.col("_first"))
    parts = F.split("value", " ", -1)
    pairs = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x != "")
    feature = lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("idx"), F.split(x, ":")[1].cast("double").alias("val"))
    labels = F.filter(F.split(parts[0], ","), lambda x: x != "").cast("array<int>")
    rows = lines.select("row", labels.alias("labels"), F.transform(pairs, feature).alias("features"))
    numbers = F.split(F.trim("value"), r"\s+").cast("array<long>")
    header = text.where(is_header).select(numbers[0].alias("n_samples"), numbers[1].alias("n_features"), numbers[2].alias("n_labels"))
    return rows, header


def check_header(rows: DataFrame, n_rows: int, n_features: int, n_labels: int) -> int:
    """Raises where rows or indices exceed what is declared; returns how many declared rows are missing."""
    got = rows.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.max(F.array_max(F.col("features.idx"))), F.lit(-1)).alias("feature"),
        F.coalesce(F.max(F.array_max("labels")), F.lit(-1)).alias("label"),
    ).first()
    for what, found, most in (("rows", got["rows"], n_rows), ("features", got["feature"] + 1, n_features), ("labels", got["label"] + 1, n_labels)):
        if found > most:
            raise ValueError(f"{found} {what}, but {most} are declared")
    return n_rows - got["rows"]


def check_agreement(train: Row, test: Row) -> None:
    """Raises where the headers of a train and a test file declare other numbers of features or labels."""
    for what in ("n_features", "n_labels"):
        if train[what] != test[what]:
            raise ValueError(f"{what}: {train[what]} in the train file, {test[what]} in the test file")


def read_sparse_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Row]]:
    """Rows (split, row, labels, features) and the headers by split, of a folder of sparse multi-label files.

    A single file is a whole data set, with a null split, to be split (``random_split``). Of several, those are read whose
    names hold train or else test; their headers must agree (``check_agreement``), and ``holdout_split`` goes on from there.
    Rows must not exceed what is declared (``check_header``).
    """
    names = _listed(spark, path)
    roles = {None: names} if len(names) == 1 else {r: [n for n in names if (r in n and (r == "train" or "train" not in n))] for r in ("train", "test")}
    if not names or not all(roles.values()):
        raise FileNotFoundError(f"neither a single file nor train and test files in {path}")
    out, headers = None, {}
    for role, files in roles.items():
        rows, header = read_sparse_multilabel(spark, [f"{path.rstrip('/')}/{n}" for n in files])
        headers[role or "all"] = header.first()
        if headers[role or "all"] is None:
            raise ValueError(f"no header in {files}")
        check_header(rows, *headers[role or "all"])
        rows = rows.select(F.lit(role).cast("string").alias("split"), "row", "labels", "features")
        out = rows if out is None else out.unionByName(rows)
    if "train" in headers:
        check_agreement(headers["train"], headers["test"])
    return out, headers


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
