"""Tables in the folder that all executors share, and exact numbering by way of them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

class _Written(threading.local):
    """Folders of the tables that this thread wrote so far, in order: queries of other threads keep theirs."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_WRITTEN = _Written()


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Where it is unset, a session on one machine gets a folder of its own; a cluster is refused, for each executor would
    write to its own disk and a later read miss the others' files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, *, rows_a_file: int = 0) -> DataFrame:
    """The rows after a round trip through Parquet in the shared folder; `rows_a_file`: at most so many in a file (0: any number).

    This cuts the lineage, and losing an executor afterwards costs nothing: the files stay until `dropped`.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    _WRITTEN.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables this thread has written, for `dropped`."""
    return len(_WRITTEN.paths)


def dropped(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables that this thread wrote after a mark, but for the last `keep`. Call it once nothing reads them any more."""
    paths = _WRITTEN.paths
    gone = paths[since : len(paths) - keep]
    del paths[since : len(paths) - keep]
    for path in gone:
        removed(spark, path)


def numbered(rows: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), *, counts: Column | None = None, name: str = "number") -> DataFrame:
    """Rows with their number (from 1) in the order, within each group of `by`; `counts` says which rows are counted.

    The rows are dealt to ranges of (by, order) and written with the range that they fell into. Numbers within ranges
    and the ranges' counts both come from what was written, so they agree, and a group with most of the rows is many
    ranges. Rows that are equal in the order are numbered as they come: name a column that tells them apart.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    one = F.lit(1) if counts is None else counts.cast("int")
    parts = written(rows.repartitionByRange(*[F.col(k) for k in by], *keys).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*by, "_part").agg(F.sum(one).alias("_n"))
    start = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    before = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in by], F.col("_part").alias("_range"), start.alias("_before"))
    if not by:
        before = F.broadcast(before)  # one row a range
    within = Window.partitionBy(*by, "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("_place", F.sum(one).over(within))
    # a group's key may be null: it is a group as well
    same = F.col("_part") == F.col("_range")
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return placed.join(before, same).select(*rows.columns, (F.col("_before") + F.col("_place")).cast("long").alias(name))
