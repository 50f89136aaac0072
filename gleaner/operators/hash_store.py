"""Hash lists too long to broadcast: saved once, bucketed and sorted by hash, and joined where they lie."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.tables import shared_folder


def save_hash_store(hashes: DataFrame, buckets: int, table: str | None = None, path: str | None = None) -> str:
    """Save the distinct hashes of ``hashes`` as a table of ``buckets`` buckets sorted by md5; returns its name. Take
    as many buckets as joins with it have shuffle partitions, or more; null hashes are left out."""
    spark = hashes.sparkSession
    name = table or f"gleaner_hashes_{uuid.uuid4().hex}"
    rows = hashes.select("md5").where("md5 is not null").distinct().repartition(buckets, "md5")
    rows.write.format("parquet").mode("overwrite").bucketBy(buckets, "md5").sortBy("md5").option("path", path or shared_folder(spark, "hash-store")).saveAsTable(name)
    return name


def listed(files: DataFrame, store: str) -> DataFrame:
    """Distinct hashes of the files that are in the store. Files are brought down to distinct hashes before the
    shuffle, so a hash of very many files is one row of each task; the store is read where it lies."""
    return files.select("md5").distinct().join(files.sparkSession.table(store).hint("merge"), "md5", "left_semi")


def drop_listed(files: DataFrame, store: str) -> DataFrame:
    """Files whose hash is not in the store; a file without a hash stays. ``files`` is read twice, so it should be a
    table without content."""
    return files.join(listed(files, store), "md5", "left_anti")


def flag_listed(files: DataFrame, store: str, flag: str = "is_blacklisted") -> DataFrame:
    """Adds whether the hash is in the store, in the same way."""
    known = listed(files, store).withColumn("_known", F.lit(True))
    return files.join(known, "md5", "left").withColumn(flag, F.coalesce("_known", F.lit(False))).drop("_known")
