"""Packing by power-of-two decomposition.

A document of n tokens is cut into as many pieces of the longest length as fit and then into one
piece for each one-bit of what remains. Pieces of equal length share a bucket and each piece is a
sequence of its own, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch
from gleaner.llm.tokens import chunked, encoder


def cut_lengths(n: int, longest: int) -> list[int]:
    """Lengths, all powers of two and falling, that add up to ``n``."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_power_of_two(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    longest: int = 2048,
    with_ids: bool = True,
    cache_bytes: int = 64_000_000,
) -> DataFrame:
    """One row per piece, which is also a sequence.

    Columns: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0), and
    ids (array<int>) if ``with_ids``. Sequences are numbered without gaps, bucket by bucket with
    the longest first, then by document and start.

    Each worker keeps ``cache_bytes`` of words and their ids, which bounds its memory only.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur, a
    null id like any other. Other columns are ignored; no rows give no rows.
    """
    if longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    # the path names a file that every executor has, not one of the driver's alone
    key = docs.schema[id_col]
    fields = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long")] + [("ids", "array<int>")] * with_ids
    out_schema = f"`{id_col}` {key.dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, cache_bytes)
        for batch in batches:
            for first, ids, counts in chunked(words, batch.column(1)):
                raw, begin = ids.tobytes(), 0
                rows, cols = [], ([], [], [], [])
                pieces = []
                for i, count in enumerate(counts.tolist(), first):
                    own = raw[4 * begin : 4 * (begin + count)] + end
                    n, at, begin = count + 1, 0, begin + count
                    for length in cut_lengths(n, longest):
                        piece = own[4 * at : 4 * (at + length)]
                        rows.append(i)
                        for col, value in zip(cols, (at, length, zlib.crc32(piece), n), strict=True):
                            col.append(value)
                        if with_ids:
                            pieces.append(np.frombuffer(piece, "<i4"))
                        at += length
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
                if with_ids:
                    arrays.append(pa.array(pieces, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [id_col, *(n for n, _ in fields)])

    work = Scratch(spark, "packing")
    pieces = work.table("pieces", docs.select(id_col, text_col).mapInArrow(cut, out_schema))
    # low 33 bits: place in the partition; the rest: the partition, in range order
    dealt = pieces.repartitionByRange(F.col("length").desc(), F.col(id_col), F.col("start"), F.col("ids_crc32")).sortWithinPartitions(
        F.col("length").desc(), F.col(id_col), F.col("start"), F.col("ids_crc32")
    )
    place = F.monotonically_increasing_id()
    numbered = work.table("numbered", dealt.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    work.drop("pieces")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return numbered.join(F.broadcast(before), "part").select(
        id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids
    )
