"""Tables that cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, on one machine only, a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-rankprep-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rankprep-{uuid.uuid4().hex}"


#: What has been saved within each open ``scratch``.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, all tables saved within it that are not released yet. What is wanted of a query must be written
    or collected by then, as results are read from saved tables."""
    own: list[DataFrame] = []
    _OPEN.append(own)
    try:
        yield
    finally:
        _OPEN.remove(own)
        release(*own)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later steps don't depend on lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more: what was made of them has been saved itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
