"""Token ids in files of independent zstandard frames with a trailing seek table.

The layout is the public seekable format: frames one after another, then a skippable frame whose
entries hold each frame's compressed size, decompressed size and checksum (the low half of
xxh64), and a footer. A reader finds the frames that hold a document's ids and decompresses only
those. A Parquet index beside the files says where each document begins.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.scratch import bounded_batches
from gleaner.llm.tokens import chunked, encoder

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80


class FrameWriter:
    """Collects bytes into frames of ``frame_bytes`` (the last may be shorter) and writes them."""

    def __init__(self, out, frame_bytes: int, level: int = 1):
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[bytes] = []
        self.held, self.size = [], 0

    def write(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            whole = b"".join(self.held)
            end = len(whole) - len(whole) % self.frame_bytes
            for at in range(0, end, self.frame_bytes):
                self._frame(whole[at : at + self.frame_bytes])
            self.held, self.size = [whole[end:]], len(whole) - end

    def _frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.entries.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.held))
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class FrameReader:
    """Random access to the bytes of one file; decompresses and checks only the frames asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or not descriptor & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n)
        rows = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = [0, *np.cumsum(rows[:, 0]).tolist()]
        self.begin = [0, *np.cumsum(rows[:, 1]).tolist()]
        self.checks = rows[:, 2].tolist()
        self.unpack = zstandard.ZstdDecompressor()
        self.kept: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            self.source.seek(self.at[k])
            data = self.unpack.decompress(self.source.read(self.at[k + 1] - self.at[k]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[k]:
                raise ValueError(f"frame {k}: its checksum differs")
            self.kept = (k, data)
        return self.kept[1]

    def read(self, start: int, length: int) -> bytes:
        k, parts, end = bisect_right(self.begin, start) - 1, [], start + length
        while start < end:
            data, base = self.frame(k), self.begin[k]
            parts.append(data[start - base : end - base])
            start, k = self.begin[k + 1], k + 1
        return b"".join(parts)


def write_tokens(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    file_chars: int = 24_000_000,
    frame_tokens: int = 65_536,
) -> DataFrame:
    """Write the ids of all documents, in ascending id order, to files below ``folder``; return the index.

    Index columns: ``id_col``, file, file_no, first (ids before it in the file), start (ids before
    it in all files), n_tokens (with the end id). Files are named by the attempt that wrote them
    and count only once the index names them, so a task that runs twice does no harm.

    A null or empty text is the end id alone; a null id comes first; rows that repeat an id, or have none, follow
    each other, ordered by text, so that they may lie in several files. Other columns are ignored; no rows give an empty index.
    """
    bounded_batches(spark)
    docs = docs.select(id_col, text_col)
    chars = docs.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    files = max(spark.sparkContext.defaultParallelism, -(-chars // file_chars))
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.zst"
        out, first = None, 0
        for batch in batches:
            for lo, ids, own in chunked(words, batch.column(1)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = FrameWriter(fs.open_output_stream(f"{root}/{name}", compression=None), 4 * frame_tokens)
                n, raw, begin = len(own), ids.tobytes(), 0
                for count in own.tolist():
                    out.write(raw[4 * begin : 4 * (begin + count)] + end)
                    begin += count
                firsts = first + np.concatenate([[0], np.cumsum(own + 1)])
                first = int(firsts[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array([name] * n), pa.array([part] * n, pa.int64()), pa.array(firsts[:-1], pa.int64()), pa.array(own + 1, pa.int64())],
                    [id_col, "file", "file_no", "first", "n_tokens"],
                )
        if out is not None:
            out.close()

    # texts sort as their beginnings do, which are all that the ranges need
    dealt = docs.repartitionByRange(files, F.col(id_col), F.substring(text_col, 1, 128)).sortWithinPartitions(id_col, text_col)
    index_path = f"{folder}/index"
    dealt.mapInArrow(write, f"`{id_col}` {kind}, file string, file_no long, first long, n_tokens long").write.parquet(index_path)
    index = spark.read.parquet(index_path)
    sizes = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = sizes.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("before"))
    return index.join(F.broadcast(before), "file_no").select(id_col, "file", "file_no", "first", (F.col("before") + F.col("first")).alias("start"), "n_tokens")


def read_tokens(index: DataFrame, folder: str, id_col: str = "doc_id", with_ids: bool = True, run_tokens: int = 4_000_000) -> DataFrame:
    """The ids of the documents that ``index`` lists (all of it, or any selection of its rows).

    Columns: ``id_col``, start, n_tokens, ids_crc32, and ids (array<int>) if ``with_ids``. Rows of
    one stretch of a file go to one task, in file order, so each frame is decompressed once there. Rows of the
    index that repeat are read again; other columns of it are ignored; an empty index gives no rows.
    """
    kind = index.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        held: tuple[str, FrameReader | None] = ("", None)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                crcs, ids = [], []
                for file, first, n in zip(*(rows.column(c).to_pylist() for c in (1, 2, 4)), strict=True):
                    if held[0] != file:
                        if held[1]:
                            held[1].source.close()
                        held = (file, FrameReader(fs.open_input_file(f"{root}/{file}")))
                    data = held[1].read(4 * first, 4 * n)
                    crcs.append(zlib.crc32(data))
                    if with_ids:
                        ids.append(np.frombuffer(data, "<i4"))
                arrays = [rows.column(0), rows.column(3), rows.column(4), pa.array(crcs, pa.int64())]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
        if held[1]:
            held[1].source.close()

    stretch = F.floor(F.col("first") / run_tokens)
    dealt = index.repartition("file", stretch).sortWithinPartitions("file", "first").select(id_col, "file", "first", "start", "n_tokens")
    return dealt.mapInArrow(read, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
