"""Written tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, job: str) -> str:
    """A new folder below the session's spark.checkpoint.dir; below one of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/gleaner-{job}-{uuid.uuid4().hex}"


#: Paths of the tables that this process has written and not dropped.
_written: list[str] = []


def drop_written(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables of ``written`` (all, or those after the first ``since``); no DataFrame may read them any more."""
    jvm = spark.sparkContext._jvm
    while len(_written) > since:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def move_files(spark: SparkSession, folder: str, to: str) -> None:
    """Move the data files of ``folder``, if it is there, into ``to``, which is made. Their names begin with the
    folder's there, as one write gives its folders files of the same names."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = fs.Path(folder), fs.Path(to)
    storage = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    storage.mkdirs(target)
    for found in storage.listStatus(source) if storage.exists(source) else ():
        name = found.getPath().getName()
        if not name.startswith(("_", ".")) and not storage.rename(found.getPath(), fs.Path(target, f"{source.getName().replace('=', '-')}-{name}")):
            raise OSError(f"can't move {found.getPath()} into {to}")


def count_written() -> int:
    return len(_written)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as tasks can run, where its files give fewer. A table of many files is left as
    it is, and its rows go through no shuffle."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * width else df.repartition(width)


def written(df: DataFrame, job: str) -> DataFrame:
    """``df`` as a Parquet table: computed once however often it is read, and read again rather than
    computed again when an executor is lost."""
    path = shared_folder(df.sparkSession, job)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
