"""Tables written once and read back, in the folder of spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"
#: Paths written since the beginning of each open `temporary` block, the innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder is set: a temporary one if all of Spark
    runs on this machine, else one in the warehouse, which executors share."""
    found = spark.sparkContext.getConf().get(FOLDER) or spark.conf.get(FOLDER, None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] == "local":
            own = tempfile.mkdtemp(prefix="subspark-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            found = "file://" + own
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/subspark-work"
        spark.conf.set(FOLDER, found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/subspark-{name}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside the block are deleted at its end: results read from them lazily, so write or collect
    results inside it."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN[:] = [each for each in _OPEN if each is not paths]
        for path in paths:
            delete(spark, path)


def drop(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        delete(df.sparkSession, files[0].rpartition("/")[0])


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of one's own, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
