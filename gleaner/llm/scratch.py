"""Tables between the steps of a job, in the folder that driver and executors share.

A written table cuts the lineage: when an executor is lost, what it had computed is read
again from the shared folder rather than recomputed from the start.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="gleaner-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: where the session leaves the size of Arrow batches at Spark's default of 10,000
    rows, it is set to ``rows``, as tasks hold several batches outside the heap."""
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, str(rows))


class Scratch:
    """One job's folder of intermediate tables. ``drop`` removes those no longer needed.

    Tables that a returned DataFrame still reads stay until ``drop`` or ``drop_all``.
    """

    def __init__(self, spark: SparkSession, job: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gleaner-{job}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, compression: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        df.write.parquet(self.path(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def drop_all(self) -> None:
        self._delete(self.root)
