"""Session helpers shared by all operators: builder, shared folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its optimised plan, or its counted rows, are below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusmill") -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the setting is absent (tests, local mode) a temporary folder is made, and the session is told of it.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        have = spark.sparkContext.getCheckpointDir()
        if have:
            return have
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="corpusmill-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def drop_folders(spark: SparkSession, *paths: str) -> None:
    """Remove folders that this engine wrote and nothing reads any more."""
    for p in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the execution that wrote them ends, instead of when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def through_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder (below a fresh path if none is given) and read again: a stage boundary that keeps columns in Parquet."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES, rows: int | None = None) -> DataFrame:
    """Broadcast hint only if the frame stays under the limit: counted rows times a row's upper size, or, for rows that hold arrays, the sum of a column of sizes.

    The frame should be a table already written or a small aggregate, as it's counted once, unless its rows are known. Beyond the limit
    the frame comes back without a hint, so that the join shuffles and adaptive execution splits skewed keys.
    """
    if isinstance(row_bytes, Column):
        return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= limit else df
    most = limit // max(1, row_bytes)
    if rows is not None:
        return F.broadcast(df) if rows <= most else df
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def few_partitions(scan: DataFrame) -> bool:
    """Whether a scan has fewer than half as many partitions as there are cores. For frames without a shuffle only: adaptive plans run to answer this."""
    return scan.rdd.getNumPartitions() * 2 <= scan.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """The frame over all cores if its scan has fewer than half as many partitions: a small input (one file, one row group) before costly work.

    A large input has more partitions than that and is returned as it is, without a shuffle. `scan` is what to ask for frames that shuffle."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if few_partitions(df if scan is None else scan) else df
