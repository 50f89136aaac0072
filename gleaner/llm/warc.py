"""WARC archives, index first.

Writing gives one index row per record (file, offset, length, url, digest, ...). Reading takes any
selection of index rows, sorts it by file and offset, joins ranges that lie close together into
one read, and parses the records out of what was read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch, bounded_batches

# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
RECORD_DATE = "2000-01-01T00:00:00Z"  # the pages carry no time of capture
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX_FIELDS = "file string, offset long, length long, url string, digest string, record_type string"


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def build_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object | None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header, with the full payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}"]
    head += [f"WARC-Date: {RECORD_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(
    spark: SparkSession,
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 100,
    file_bytes: int = 1 << 30,
    broadcast_rows: int = 250_000,
) -> DataFrame:
    """Write a record per row of ``pages`` to files below ``folder`` and return the index.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least
    ``least_bytes`` the one with the smallest id is a response and the others revisit it; smaller
    payloads are always responses. Rows with a null id are responses and are never revisited. Rows
    that repeat an id and payload are treated alike. The payloads are written where they lie, without
    a shuffle, as long as there are no more than ``broadcast_rows`` revisits to know of. Other columns are ignored; no rows, no index
    rows. Files are named by the attempt that wrote them and count only once the index names them.
    """
    bounded_batches(spark)
    payload = F.coalesce(F.col(html_col), F.lit(""))
    digest = F.sha2(payload.cast("binary"), 256)
    light = pages.select(F.col(id_col).alias("at"), digest.alias("sha"), F.octet_length(payload).alias("bytes")).where(F.col("at").isNotNull() & (F.col("bytes") >= least_bytes))
    first = light.groupBy("sha").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    # only pages that revisit another get a row here
    revisits = Scratch(spark, "warc-revisits").table("0", light.join(first, "sha").where("at <> first").select("at", "sha", "first").distinct())
    held = F.broadcast(revisits) if revisits.count() <= broadcast_rows else revisits.hint("shuffle_hash")
    full = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("html"), digest.alias("digest"))
    dealt = full.join(held, (F.col("id") == F.col("at")) & (F.col("digest") == F.col("sha")), "left").select("id", "url", "html", "digest", "first")
    kind = pages.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        part, out, name, offset = TaskContext.get().partitionId(), None, "", 0
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for page_id, url, html, sha, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None or offset > file_bytes:
                    if out is not None:
                        out.close()
                    fs.create_dir(root, recursive=True)
                    name, offset = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = build_record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), sha.as_py(), refers_to.as_py())
                out.write(data)
                for col, value in zip(rows, (name, offset, len(data), "response" if not refers_to.is_valid else "revisit"), strict=True):
                    col.append(value)
                offset += len(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), batch.column(1), batch.column(3), pa.array(rows[3], pa.string())],
                [id_col, "file", "offset", "length", "url", "digest", "record_type"],
            )
        if out is not None:
            out.close()

    dealt.mapInArrow(write, f"`{id_col}` {kind}, {INDEX_FIELDS}").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int]]:
    """(begin, end, how many ranges) of sorted (offset, length) ranges, joined over gaps of up to ``gap`` bytes."""
    out: list[list[int]] = []
    for offset, length in ranges:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1][1], out[-1][2] = max(out[-1][1], offset + length), out[-1][2] + 1
        else:
            out.append([offset, offset + length, 1])
    return [tuple(x) for x in out]


def read_archives(index: DataFrame, folder: str, id_col: str = "page_id", with_payload: bool = True, gap: int = 65_536, most: int = 8 << 20) -> DataFrame:
    """The records of the index rows given: ``id_col``, url, payload_bytes, payload_digest,
    record_type, refers_to, and payload (null for revisits) if ``with_payload``.

    A response's digest and length are computed from the payload read and checked against the
    record's own; a revisit states those of the payload it refers to.
    """
    whole = index.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    kind = "long" if whole else "string"

    def parse(members: list[bytes]) -> Iterator[tuple]:
        to_id = int if whole else str
        for member in members:
            fields, http, payload = parse_record(member)
            digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
            if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
            size = int(http["Content-Length"]) if revisit else len(payload)
            ids = [None if n not in fields else to_id(fields[n]) for n in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")]
            yield ids[0], fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], ids[1], None if revisit else payload

    id_type = pa.int64() if whole else pa.string()
    types = [id_type, pa.string(), pa.int64(), pa.string(), pa.string(), id_type, pa.binary()]
    names = [id_col, "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    n = 7 if with_payload else 6

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                by_file.setdefault(file, []).append((offset, length))
            for file, ranges in by_file.items():
                ranges.sort()
                with fs.open_input_file(f"{root}/{file}") as source:
                    at = 0
                    for begin, end, count in coalesced(ranges, gap, most):
                        source.seek(begin)
                        data = source.read(end - begin)
                        rows = list(parse([data[o - begin : o - begin + size] for o, size in ranges[at : at + count]]))
                        at += count
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(n)], names[:n])

    dealt = index.repartition("file", F.floor(F.col("offset") / most)).sortWithinPartitions("file", "offset").select("file", "offset", "length")
    schema = f"`{id_col}` {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}" + ", payload binary" * with_payload
    return dealt.mapInArrow(read, schema)
