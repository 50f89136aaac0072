"""The chunked scan as a stream: features per chunk, copies found across chunks, rolling analysis.

Each chunk leaves one row of moments. A re-analysis merges those rows into the statistics so far and reads no
features; rows are scored with them when they are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gleaner.operators.analysis import FEATURES, analyse, features
from gleaner.operators.hashes import mark_duplicates
from gleaner.operators.moments import merged, moments, stats
from gleaner.sources.files import file_rows
from gleaner.sources.tables import count_written, drop_written

SEEN = "md5 string, path string, level int, start int, prefix string"
#: So many neighbouring parts of the seen hashes become one.
SPAN = 16
BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def read_chunks(spark: SparkSession, folder: str, schema: object, files_per_chunk: int | None = None, newest_first: bool = False) -> DataFrame:
    """A stream of Parquet files of file rows: so many files per chunk, or all that are new."""
    source = spark.readStream.schema(schema).option("latestFirst", newest_first)
    return (source.option("maxFilesPerTrigger", files_per_chunk) if files_per_chunk else source).parquet(folder)


def read_file_chunks(spark: SparkSession, folder: str, files_per_chunk: int = 500, newest_first: bool = True) -> DataFrame:
    """A stream of the files below ``folder`` themselves, so many per chunk, newest first as the listing is; names
    that begin with a dot or an underscore are hidden from it."""
    source = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("recursiveFileLookup", True)
    return file_rows(source.option("latestFirst", newest_first).option("maxFilesPerTrigger", files_per_chunk).load(folder))


def spans(chunks: int) -> list[tuple[int, int]]:
    """(level, first chunk) of the parts that hold the first ``chunks`` chunks: a part of a level holds SPAN parts of
    the level below, so they are few however many chunks there were."""
    out, start = [], 0
    while start < chunks:
        level = 0
        while start % SPAN ** (level + 1) == 0 and start + SPAN ** (level + 1) <= chunks:
            level += 1
        out.append((level, start))
        start += SPAN**level
    return out


def seen_before(spark: SparkSession, out: str, parts: list[tuple[int, int]]) -> DataFrame:
    paths = [f"{out}/seen/level={level}/start={start}" for level, start in parts]
    return spark.read.schema(SEEN).option("basePath", f"{out}/seen").parquet(*paths)


def merge_seen(spark: SparkSession, out: str, chunks: int) -> None:
    """Put together the parts that are complete after ``chunks`` chunks; done again, it gives the same."""
    level = 1
    while chunks % SPAN**level == 0:
        size = SPAN ** (level - 1)
        start = chunks - SPAN**level
        below = seen_before(spark, out, [(level - 1, start + k * size) for k in range(SPAN)])
        below.select("md5", "path", "prefix").repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{out}/seen/level={level}/start={start}")
        level += 1


def stream_features(files: DataFrame, white: DataFrame, black: DataFrame, out: str, checkpoint: str, every: int = 3, **how: object) -> StreamingQuery:
    """Start the scan. Features are appended to ``out``/features by chunk; a chunk that runs again
    replaces its own rows. A file's copies in earlier chunks are found in ``out``/seen, which holds the
    first file of each hash by chunks and by the first two signs of the hash; a chunk reads the folders that
    its own hashes need, of parts that are put together as chunks grow many. ``out``/moments gets a row for each chunk; after every ``every`` chunks they are merged to
    a row of ``out``/stats, with which ``scored_so_far`` reads the features.
    """

    def chunk(rows: DataFrame, number: int) -> None:
        spark, before = rows.sparkSession, count_written()
        own = features(rows, white, black, mark=False, **how)
        readable = mark_duplicates(own.where("not is_unreadable").drop("duplicate_of")).withColumn("prefix", F.substring("md5", 1, 2))
        if number:
            asked = [r["prefix"] for r in readable.select("prefix").distinct().collect()]  # 256 at the most
            seen = seen_before(spark, out, spans(number)).where(F.col("prefix").isin(asked)).select("md5", F.col("path").alias("_seen"))
            readable = readable.join(seen, "md5", "left").withColumn("duplicate_of", F.coalesce("_seen", "duplicate_of")).drop("_seen")
        every_row = readable.select(*FEATURES).unionByName(own.where("is_unreadable").select(*FEATURES))
        every_row.write.mode("overwrite").parquet(f"{out}/features/chunk={number}")
        done = spark.read.parquet(f"{out}/features/chunk={number}")
        first = done.where(F.col("duplicate_of").isNull() & ~F.col("is_unreadable")).select("md5", "path", F.substring("md5", 1, 2).alias("prefix"))
        first.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{out}/seen/level=0/start={number}")
        merge_seen(spark, out, number + 1)
        moments(done).coalesce(1).write.mode("overwrite").parquet(f"{out}/moments/chunk={number}")
        if number % every == every - 1:
            stats_so_far(spark, out, number).coalesce(1).write.mode("overwrite").parquet(f"{out}/stats/chunk={number}")
        drop_written(spark, before)

    return files.writeStream.foreachBatch(chunk).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stats_so_far(spark: SparkSession, out: str, chunk: int | None = None) -> DataFrame:
    """The statistics of all rows up to a chunk, from one row a chunk."""
    kept = spark.read.parquet(f"{out}/moments")
    return stats(merged(kept if chunk is None else kept.where(F.col("chunk") <= chunk)))


def scored_so_far(spark: SparkSession, out: str, chunk: int) -> DataFrame:
    """The analysis that was made after ``chunk``: the rows up to it, with the statistics of then."""
    told = spark.read.parquet(f"{out}/stats").where(F.col("chunk") == chunk).drop("chunk")
    return analyse(spark.read.parquet(f"{out}/features").where(F.col("chunk") <= chunk).drop("chunk"), stats=told)


def scan_in_chunks(spark: SparkSession, files: DataFrame, white: DataFrame, black: DataFrame, out: str, checkpoint: str, **how: object) -> DataFrame:
    """Run the stream over all that is there and analyse all chunks so far."""
    query = stream_features(files, white, black, out, checkpoint, **how)
    query.awaitTermination()
    return analyse(spark.read.parquet(f"{out}/features").drop("chunk"), stats=stats_so_far(spark, out))
