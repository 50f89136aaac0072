"""Sources: file trees, manifests, hash lists and needle tables."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import needles as N
from gleaner.functions.text import LOWER, UPPER
from gleaner.sources.tree import located

FILES = "path string, mtime long, size long, content binary, is_readable boolean"
MANIFEST_BATCH = 32 << 20
NEEDLES = "pos int, token string, weight decimal(18,8), is_critical boolean, is_obfuscation boolean, is_upload boolean"


def file_rows(raw: DataFrame) -> DataFrame:
    """Rows of Spark's binary files, batch or stream, as file rows."""
    path = F.regexp_replace("path", "^file:/+", "/")
    return raw.select(path.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), "content", F.lit(True).alias("is_readable"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path``. Spark's reader hides names that begin with a dot or an underscore;
    such files come through ``tree.read_tree``."""
    return file_rows(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def read_manifest(manifest: DataFrame, partitions: int | None = None, max_bytes: int = 256 << 20) -> DataFrame:
    """Files named by ``manifest(path, mtime)``, opened on the executors on any storage that ``pyarrow.fs`` opens;
    paths without a scheme are local. One that can't be opened, or has more than ``max_bytes``, has null size and
    content and is_readable false. Whole files of a batch are held up to that size, so batches end there."""

    def opened(path: str) -> bytes | None:
        try:
            system, name = located(path)
            with system.open_input_file(name) as f:
                return None if f.size() > max_bytes else f.read()
        except (OSError, ValueError):
            return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "mtime", "size", "content", "is_readable"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for path, mtime in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = None if path is None else opened(path)
                held.append((path, mtime, None if content is None else len(content), content, content is not None))
                size += len(content or b"")
                if size > MANIFEST_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    rows = manifest.select("path", F.coalesce(F.col("mtime"), F.lit(0)).cast("long").alias("mtime"))
    return rows.repartition(partitions or manifest.sparkSession.sparkContext.defaultParallelism).mapInArrow(read, FILES)


def load_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct hashes of a text file with one per line; blanks around them and letter case don't count."""
    return spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "\r", ""))).alias("md5")).where("md5 <> ''").distinct()


def needle_lists(table: DataFrame) -> tuple[list[tuple[str, float | None]], N.Categories]:
    """A needle table of the user's, in its order, as what ``features`` and ``analyse`` take. Such a table
    is a list of words that a person keeps; longer ones go through ``match_needles_by_join``."""
    rows = sorted(table.collect(), key=lambda r: r["pos"])
    pick = lambda flag: [r["token"].translate(str.maketrans(UPPER, LOWER)) for r in rows if r[flag]]
    weights = [(r["token"], None if r["weight"] is None else float(r["weight"])) for r in rows]
    return weights, (pick("is_critical"), pick("is_obfuscation"), pick("is_upload"))


def needle_table(spark: SparkSession, profile: str = "web") -> DataFrame:
    rows = N.WEB if profile == "web" else N.CLI
    made = [(i, t, None if w is None else Decimal(str(w)), t in N.CRITICAL, t in N.OBFUSCATION, t in N.UPLOAD) for i, (t, w) in enumerate(rows)]
    return spark.createDataFrame(made, NEEDLES)
