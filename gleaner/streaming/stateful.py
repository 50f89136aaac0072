"""The scan as one stateful stream: the first file of each hash is a value of the state store, keyed by the hash."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from gleaner.operators.analysis import FEATURES, readable, token_features, unreadable_features
from gleaner.operators.hashes import drop_whitelisted, flag_blacklisted
from gleaner.operators.selection import filter_patterns, is_htaccess

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKED = "md5 string, path string, duplicate_of string, packed string"
PACKED = "size long, mtime long, total_tokens long, matched_tokens array<string>, is_blacklisted boolean, entropy double"


class FirstSeen(StatefulProcessor):
    """Adds duplicate_of. Within a chunk the newest file of a hash comes first, then by path; over chunks the one
    that was seen first. A chunk's rows of one hash are held, without content, as many as the chunk has at most. Most
    hashes have one row, so rows come as they are, not as frames, and the state is asked once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "path string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        first = None
        if key[0] is not None:  # files without a hash are nobody's copies
            seen = self.first.get()
            if seen is not None:
                first = seen[0]
            else:
                rows = list(rows)
                first = min((age, path is None, path) for _, path, age, _ in rows)[2]
                self.first.update((first,))
        for md5, path, _, packed in rows:
            yield Row(md5=md5, path=path, duplicate_of=None if first is None or path == first else first, packed=packed)

    def close(self) -> None:
        pass


def stream_marked(files: DataFrame, white: DataFrame, black: DataFrame, out: str, checkpoint: str, **how: object) -> StreamingQuery:
    """Start the scan of a stream of file rows: feature rows are appended to the Parquet table ``out``, each with the
    first file of its hash over all chunks. The state holds one path for each distinct hash, in RocksDB, and is kept
    in ``checkpoint``, so that a new start goes on where the last one ended. Content stays where it is read: the
    shuffle by hash carries feature rows.

    The session's state store provider is set to RocksDB, which this operator needs.
    """
    files.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    kept = filter_patterns(files)
    rows = flag_blacklisted(drop_whitelisted(token_features(kept.where(readable()), **how), white), black)
    names = [f.split()[0] for f in PACKED.split(", ")]
    age = (-F.coalesce("mtime", F.lit(0))).cast("long").alias("age")
    slim = rows.select("md5", "path", age, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("packed"))
    marked = slim.groupBy("md5").transformWithState(FirstSeen(), MARKED, "Append", "None")
    full = marked.withColumn("p", F.from_json("packed", PACKED)).select("md5", "path", "duplicate_of", "p.*")
    full = full.withColumns({"is_htaccess": is_htaccess(F.col("path")), "error": F.lit(None).cast("string"), "is_unreadable": F.lit(False)}).select(*FEATURES)
    every_row = full.unionByName(unreadable_features(kept))
    return every_row.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
