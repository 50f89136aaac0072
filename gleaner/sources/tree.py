"""File trees as a data source: names that begin with a dot included, on any storage that ``pyarrow.fs`` opens.

``read_tree(spark, uri)`` gives one row per file. Filters on path, extension, is_script, mtime and size reach the
listing, so that only files that fulfil them are opened. Directories are listed on the driver up to a bound, files
are dealt over partitions by size, and what lies below the bound is listed by the tasks themselves.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs as storage
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from gleaner.functions import needles as N

SCHEMA = "path string, extension string, is_script boolean, mtime long, size long, content binary, is_readable boolean, error string"
TOO_LARGE = "too large"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: What a filter says of a value of the listing, which is never null.
TESTS: dict[type, Callable[[object, object], bool]] = {
    ds.EqualTo: lambda v, x: v == x,
    ds.EqualNullSafe: lambda v, x: v == x,
    ds.GreaterThan: lambda v, x: v > x,
    ds.GreaterThanOrEqual: lambda v, x: v >= x,
    ds.LessThan: lambda v, x: v < x,
    ds.LessThanOrEqual: lambda v, x: v <= x,
    ds.In: lambda v, x: v in x,
    ds.StringStartsWith: lambda v, x: v.startswith(x),
    ds.StringEndsWith: lambda v, x: v.endswith(x),
    ds.StringContains: lambda v, x: x in v,
    ds.IsNull: lambda v, x: False,
    ds.IsNotNull: lambda v, x: True,
}
LISTED = {"path", "extension", "is_script", "mtime", "size"}
Entry = tuple[str, int, int]  # path, mtime, size
#: So many directories are listed between two looks at the bound.
AT_ONCE = 64
#: So many directories a writing task remembers as made.
MADE = 10_000


def holds(f: ds.Filter, row: dict[str, object]) -> bool:
    if isinstance(f, ds.Not):
        return not holds(f.child, row)
    return TESTS[type(f)](row[f.attribute[0]], getattr(f, "value", None))


def known(f: ds.Filter) -> bool:
    """Whether the listing alone decides the filter. One that compares with null is left to Spark."""
    if isinstance(f, ds.Not):
        return known(f.child)
    value = getattr(f, "value", 0)
    nulls = value is None or isinstance(value, (list, tuple)) and None in value
    return type(f) in TESTS and not nulls and len(f.attribute) == 1 and f.attribute[0] in LISTED


def located(uri: str) -> tuple[storage.FileSystem, str]:
    """The storage of a URI and the path in it; without a scheme the path is local, and taken as it is."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return storage.FileSystem.from_uri(uri)
    return storage.LocalFileSystem(), os.path.abspath(uri)


class Part(ds.InputPartition):
    """Files to read, and directories to list and read."""

    def __init__(self, files: list[Entry], folders: list[str]):
        super().__init__(None)
        self.files, self.folders = files, folders


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        if "path" not in options:
            raise ValueError("the path of a tree is missing")
        self.uri = options["path"]
        self.script = re.compile("(?:" + options.get("patterns", "|".join(N.PATTERNS)) + ")", re.I)
        self.part_bytes = int(options.get("partitionbytes", 128 << 20))
        self.open_bytes = int(options.get("openbytes", 256 << 10))
        self.planned = int(options.get("plannedfiles", 200_000))
        self.folder_parts = int(options.get("folderpartitions", 256))
        self.largest = int(options.get("maxfilebytes", 256 << 20))
        self.batch_bytes = int(options.get("batchbytes", 32 << 20))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        self.filters = [f for f in filters if known(f)]
        return [f for f in filters if not known(f)]

    def storage(self) -> tuple[storage.FileSystem, str]:
        system, root = located(self.uri)
        return system, root.rstrip("/") or "/"

    def listed(self, system: storage.FileSystem, folder: str) -> tuple[list[Entry], list[str]]:
        """Files of a directory that fulfil the filters, and its directories. Local links are left out; a directory
        that can't be listed, or is gone, holds nothing."""
        try:
            found = system.get_file_info(storage.FileSelector(folder, allow_not_found=True))
        except OSError:
            return [], []
        local = isinstance(system, storage.LocalFileSystem)
        found = [i for i in found if not (local and os.path.islink(i.path))]
        files = [(i.path, int((i.mtime_ns or 0) // 10**9), int(i.size or 0)) for i in found if i.type == storage.FileType.File]
        return [e for e in files if self.wanted(e)], sorted(i.path for i in found if i.type == storage.FileType.Directory)

    def facts(self, entry: Entry) -> dict[str, object]:
        path, mtime, size = entry
        dot = re.search(r"\.([^./]*)$", path)
        extension = dot[1] if dot else ""
        return {"path": path, "extension": extension, "is_script": bool(self.script.fullmatch(extension)), "mtime": mtime, "size": size}

    def wanted(self, entry: Entry) -> bool:
        row = self.facts(entry)
        return all(holds(f, row) for f in self.filters)

    def partitions(self) -> list[Part]:
        """Level by level, some directories at a time, until the bound; then files by size, the largest first, and the
        directories that are left, dealt over a bounded number of partitions."""
        system, root = self.storage()
        top = system.get_file_info(root)
        if top.type == storage.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        single = (root, int((top.mtime_ns or 0) // 10**9), int(top.size or 0))
        files, level = ([single] if self.wanted(single) else [], []) if top.type == storage.FileType.File else ([], [root])
        with ThreadPoolExecutor(16) as pool:
            below: list[str] = []
            while (level or below) and len(files) + len(level) + len(below) < self.planned:
                level, below = level or below, below if level else []
                some, level = level[:AT_ONCE], level[AT_ONCE:]
                for own, folders in pool.map(lambda folder: self.listed(system, folder), some):
                    files += own
                    below += folders
            level += below
        parts, held, size = [], [], 0
        for e in sorted(files, key=lambda e: (-e[2], e[0])):
            if held and size + e[2] + self.open_bytes > self.part_bytes:
                parts.append(Part(held, []))
                held, size = [], 0
            held.append(e)
            size += e[2] + self.open_bytes
        dealt = min(len(level), self.folder_parts)
        parts += [Part(held, [])] * bool(held) + [Part([], level[k::dealt]) for k in range(dealt)]
        return parts or [Part([], [])]

    def entries(self, system: storage.FileSystem, part: Part) -> Iterator[Entry]:
        yield from part.files
        level = list(part.folders)
        while level:
            files, below = self.listed(system, level.pop())
            yield from files
            level += below

    def opened(self, system: storage.FileSystem, path: str) -> bytes:
        with system.open_input_stream(path) as stream:
            return stream.read()

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = self.storage()
        held: list[tuple] = []
        size = 0
        for e in self.entries(system, partition):
            content = error = None
            if e[2] > self.largest:
                error = TOO_LARGE
            else:
                try:
                    content = self.opened(system, e[0])
                except OSError as problem:
                    error = str(problem)
            held.append((*self.facts(e).values(), content, content is not None, error))
            size += len(content or b"") + 200
            if size > self.batch_bytes:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


class TreeSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, uri: str, **options: object) -> DataFrame:
    """(path, extension, is_script, mtime, size, content, is_readable, error): a row for each file below ``uri``.

    path is the storage's own (no scheme); extension what follows the last dot of the name, empty without one;
    is_script whether it matches ``patterns`` (regular expressions joined by |) as a whole, letter case aside. A
    file that can't be opened, or is over ``maxFileBytes``, has null content, is_readable false and a reason in
    error. Links of a local storage are not followed. ``partitionBytes`` and ``openBytes`` (a file's own cost) size
    the partitions, ``plannedFiles`` bounds what the driver lists, and the directories that it leaves are dealt over
    ``folderPartitions`` at most. An empty tree gives no rows, a missing one an error.

    Filters reach the listing through ``spark.sql.python.filterPushdown.enabled``, which is switched on here.
    """
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(TreeSource)
    reader = spark.read.format(TreeSource.name())
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(uri)


def write_tree(files: DataFrame, uri: str) -> None:
    """Write ``files`` (path below ``uri``, content) as files of their own; null content as an empty file. A path
    that recurs is written again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(uri)
        done, made = 0, set()
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                target = f"{root}/{path.as_py().lstrip('/')}"
                folder = os.path.dirname(target)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    if len(made) == MADE:
                        made.clear()
                    made.add(folder)
                with system.open_output_stream(target) as stream:
                    stream.write(content.as_py() or b"")
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    rows = files.select("path", files["content"].cast("binary").alias("content"))
    rows.mapInArrow(write, "files long").agg({"files": "sum"}).collect()
