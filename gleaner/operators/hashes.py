"""Hash lists, known files and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import extension


def build_hash_list(files: DataFrame) -> DataFrame:
    """Hash of every file whose extension is exactly php."""
    return files.where(extension(F.col("path")) == "php").select("path", F.md5(F.col("content").cast("binary")).alias("md5"))


def drop_whitelisted(files: DataFrame, hashes: DataFrame) -> DataFrame:
    return files.join(hashes.select("md5"), "md5", "left_anti")


def flag_blacklisted(files: DataFrame, hashes: DataFrame, drop: bool = False) -> DataFrame:
    """Adds is_blacklisted, or removes what is on the list."""
    if drop:
        return files.join(hashes.select("md5"), "md5", "left_anti").withColumn("is_blacklisted", F.lit(False))
    known = hashes.select("md5", F.lit(True).alias("_known")).distinct()
    return files.join(known, "md5", "left").withColumn("is_blacklisted", F.coalesce("_known", F.lit(False))).drop("_known")


def hash_conflicts(white: DataFrame, black: DataFrame) -> DataFrame:
    return white.select("md5").intersect(black.select("md5"))


def dedupe_hashes(lines: DataFrame) -> DataFrame:
    """(line_no, md5) of the first line of each hash."""
    return lines.groupBy("md5").agg(F.min("line_no").alias("line_no"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """For each hash of several files: how many, and the first by time (newest) and path."""
    first = F.min(F.struct((-F.coalesce("mtime", F.lit(0))).alias("age"), "path"))
    return files.groupBy("md5").agg(F.count("*").alias("copies"), first["path"].alias("first_path")).where("copies > 1")


def mark_duplicates(files: DataFrame) -> DataFrame:
    """Adds duplicate_of: the first file of the same hash; null for that file itself.

    Aggregated before the join, so a hash that owns many rows meets one row, and only hashes of
    several files take part.
    """
    first = duplicate_groups(files).select("md5", "first_path")
    same = (F.col("first_path").isNotNull()) & (F.col("first_path") != F.col("path"))
    return files.join(first, "md5", "left").withColumn("duplicate_of", F.when(same, F.col("first_path"))).drop("first_path")


def mark_duplicates_by_window(files: DataFrame) -> DataFrame:
    """The same by a window, for checks; one task holds all files of a hash."""
    first = F.first("path").over(Window.partitionBy("md5").orderBy(F.coalesce("mtime", F.lit(0)).desc(), "path"))
    return files.withColumn("duplicate_of", F.when(first != F.col("path"), first))
