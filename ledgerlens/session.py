"""Session settings sized from the data to be read."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_TARGET_PARTITION_BYTES = 128 * 1024**2


def session_conf(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job that shuffles about ``shuffle_bytes`` on ``cores`` task slots.

    Shuffles start with partitions of about 128 MB and at least one per slot; adaptive
    execution then merges small ones and splits skewed ones. Recording the Python line of
    every expression is off: it costs more round trips than building the expression.
    """
    partitions = max(cores, -(-shuffle_bytes // _TARGET_PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(_TARGET_PARTITION_BYTES),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(_TARGET_PARTITION_BYTES),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.exchange.reuse": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }


def configure(spark: SparkSession, shuffle_bytes: int) -> SparkSession:
    """Apply those of :func:`session_conf` that can change in a running session."""
    cores = spark.sparkContext.defaultParallelism
    for key, value in session_conf(shuffle_bytes, cores).items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Where work files go: the folder that ``spark.checkpoint.dir`` names.

    Driver and executors have to share it. Only a local session, whose executors run in the
    driver's own process, may leave it out; its files then go below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    raise ValueError(
        "spark.checkpoint.dir is not set: name a folder that the driver and all executors share"
    )


#: Paths made inside each open :func:`work_tables`.
_OPEN: list[list[str]] = []


@contextlib.contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch paths made inside when it ends; what is to stay is written elsewhere."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in :func:`scratch_dir`; pass it to :func:`remove_at_exit` once written."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    files, location = _file_system(spark, path)
    return files.exists(location)


def files_bytes(spark: SparkSession, paths: Iterable[str]) -> int:
    """Total length of files, as ``DataFrame.inputFiles`` names them: URIs, with %20 for a space."""
    uri = spark._jvm.java.net.URI.create
    found = (_file_system(spark, uri(path)) for path in paths)
    return sum(files.getFileStatus(location).getLen() for files, location in found)


def fits_broadcast(spark: SparkSession, path: str) -> bool:
    """Whether the files below ``path`` are within the session's broadcast threshold."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if threshold.startswith("-"):  # no broadcasts
        return False
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(threshold)
    files, location = _file_system(spark, path)
    return files.getContentSummary(location).getLength() <= limit


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the written ``path`` removed when the session's JVM ends."""
    files, location = _file_system(spark, path)
    files.deleteOnExit(location)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that nothing reads any more."""
    files, location = _file_system(spark, path)
    files.delete(location, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` computed once into a scratch table, and that table's path.

    Reading it again needs nothing of what made it, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path
