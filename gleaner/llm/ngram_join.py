"""Exact n-gram Jaccard join over a token-group matrix.

1. Texts with equal shingle sets form a class; one document stands for it.
2. Shingles get one global order, rare before frequent (counts in a table of fixed size). Two sets
   that overlap enough share a certain number of shingles among the first of each in that order
   (a tenth of the smaller set, beside the one that is shared in any case), so a class that shares
   fewer leading shingles with all others drops out here, as most do.
3. The remaining classes are partitioned into groups of similar sets of bounded size, keyed by the
   smallest hash among their shared leading shingles. A group stores its members' sets and their union.
4. Groups that share enough leading shingles meet once, whatever the number of shingles and members
   they share. For each member of one the overlap with the other's union bounds the overlap with
   every member; only members that can still reach the threshold open the group.
5. Of the links found in a meeting a spanning forest leaves the task, with each class's number of
   linked documents; components follow from the forest.
"""

from __future__ import annotations

import hashlib
import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.bytewords import shingle_sets
from gleaner.llm.components import connected_components
from gleaner.llm.scratch import Scratch
from gleaner.llm.tokens import release

COUNT_BLOCK = 8192


def _text_batches(batches: Iterator[pa.RecordBatch], column: int, seed: int, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    release()
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield part, list(shingle_sets(part.column(column).to_pylist(), seed=seed))


def frequency_ranks(texts: DataFrame, buckets: int, seed: int = 0) -> np.ndarray:
    """A rank from 0 to 255 for each bucket of shingle hashes: eight times the logarithm of how
    many sets hold a shingle of the bucket. Fixed in size, whatever the corpus holds; the tasks'
    counts are added block by block as a stream, so no task holds those of several tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_set = np.zeros(buckets, np.uint32), False
        for _, sets in _text_batches(batches, 0, seed):
            for s in sets:
                np.add.at(total, (s & np.uint64(buckets - 1)).astype(np.int64), np.uint32(1))
                any_set |= len(s) > 0
        if any_set:
            for b, part in enumerate(total.reshape(-1, min(COUNT_BLOCK, buckets))):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "counts"])

    def add(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(min(COUNT_BLOCK, buckets), np.uint64)
        for batch in rows:
            for packed in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
        rank = np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([rank.tobytes()], pa.binary())], ["block", "ranks"])

    parts = texts.mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, ranks binary")
    ranks = np.zeros(buckets, np.uint8)
    for row in parts.collect():  # at most buckets / COUNT_BLOCK rows
        ranks[row["block"] * COUNT_BLOCK : row["block"] * COUNT_BLOCK + len(row["ranks"])] = np.frombuffer(row["ranks"], np.uint8)
    return ranks


def leading(shingles: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the global order: so many that a match shares at least
    ``least_shared`` of the smaller set's size of them."""
    n = len(shingles)
    bucket = (shingles & np.uint64(len(ranks) - 1)).astype(np.int64)
    order = np.argsort((ranks[bucket].astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8)), kind="stable")
    return shingles[order[: n - (percent * n + 99) // 100 + 1 + n // 10]]


Member = tuple[tuple[int, int], int, np.ndarray]


def meet(a: list[Member], b: list[Member], percent: int, same: bool) -> list[tuple[tuple[int, int], tuple[int, int], int]]:
    """Links between the members (name, copies, sorted set) of two groups, or within one.

    Returns (name, the name that stands for those it is connected with here, linked documents).
    """
    ids = [m[0] for m in a] + ([] if same else [m[0] for m in b])
    union = np.unique(np.concatenate([m[2] for m in b]))
    # the bound: no member of b shares more with this set than b's union does
    open_rows = [i for i, m in enumerate(a) if 100 * np.isin(m[2], union, assume_unique=True).sum() >= percent * len(m[2])]
    if not open_rows:
        return []
    common = np.intersect1d(np.unique(np.concatenate([a[i][2] for i in open_rows])), union, assume_unique=True)
    shared = np.zeros((len(open_rows), len(b)), np.float32)
    for lo in range(0, len(common), 8192):
        part = common[lo : lo + 8192]
        left, right = (np.zeros((len(ms), len(part)), np.float32) for ms in (open_rows, b))
        for matrix, sets in ((left, [a[i][2] for i in open_rows]), (right, [m[2] for m in b])):
            for k, s in enumerate(sets):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                at = np.searchsorted(part, s)
                matrix[k, at[part[at] == s]] = 1
        shared += left @ right.T
    size_a = np.array([len(a[i][2]) for i in open_rows], np.float64)[:, None]
    size_b = np.array([len(m[2]) for m in b], np.float64)[None, :]
    linked = 100 * shared >= percent * (size_a + size_b - shared)
    copies_a, copies_b = np.array([a[i][1] for i in open_rows]), np.array([m[1] for m in b])
    root = list(range(len(ids)))
    counts = [0] * len(ids)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if same:
        linked[np.arange(len(open_rows)), open_rows] = False
    for i, row in enumerate(open_rows):
        partners = np.flatnonzero(linked[i])
        counts[row] += int(copies_b[partners].sum())
        for j in partners.tolist():
            x, y = top(row), top(j if same else len(a) + j)
            if x != y:
                root[max(x, y)] = min(x, y)
    if not same:
        for j in range(len(b)):
            counts[len(a) + j] += int(copies_a[linked[:, j]].sum())
    return [(ids[k], ids[top(k)], counts[k]) for k in range(len(ids)) if counts[k]]


def jaccard_components(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    group_size: int = 128,
    group_shingles: int = 500_000,
    buckets: int = 1 << 23,
    broadcast_rows: int = 500_000,
    hot_sets: int = 1 << 16,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id, n_links.

    Shingles are five consecutive words (A-Z lower-cased, cut at blanks, tabs and line ends); a
    shorter text has its whole word sequence as one. Two documents link when their sets' Jaccard
    similarity reaches ``percent``. component_id is the smallest id reachable, n_links the number
    of other documents that the row's text links with.

    A null text or one without words has an empty set and links with nothing: it is its own
    component. Rows that repeat an id count as one document that has each of their texts, and have
    one component. A row with a null id has no component. Other columns are ignored; no rows give no
    rows. Ids are longs. Shingles are compared by 64-bit hashes from a seed drawn for each run, and equal
    sets found by 128-bit ones; words themselves are not compared again. Two sets of n and m shingles have
    two of them in common by chance with a probability of n * m / 2**64.

    Groups hold ``group_size`` sets or ``group_shingles`` shingles, about. As ``n_links`` counts every
    link, the groups of one cluster of n near copies all meet: (n / group_size)**2 / 2 meetings. Leading shingles
    in whose bucket of counts ``hot_sets`` sets or more fall are taken for shared without being brought together.
    """
    work = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seed, hot_rank = secrets.randbits(63), 8 * (hot_sets.bit_length() - 1)
    ranks = spark.sparkContext.broadcast(frequency_ranks(docs.select("text"), buckets, seed))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = ranks.value, set()
        for rows, sets in _text_batches(batches, 1, seed):
            keys, leads, hot = [], [], []
            for s in sets:
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                keys.append(key)
                # copies within the task lead with the same shingles
                first = leading(s, order, percent) if key and key not in seen else np.zeros(0, np.uint64)
                common = order[(first & np.uint64(buckets - 1)).astype(np.int64)] >= hot_rank
                leads.append(first[~common].view(np.int64))
                hot.append(first[common].view(np.int64))
                seen.add(key)
            lists, others = (pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), pa.int64())) for x in (leads, hot))
            short = pa.array([None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), short, lists, others], ["id", "n", "key", "class", "leads", "hot"])

    signed = work.table("signed", docs.mapInArrow(sign, "id long, n long, key binary, class long, leads array<long>, hot array<long>"))
    held = signed.where("id is not null and n > 0").groupBy("key", "class", "id").agg(F.max("n").alias("n"))
    classes = work.table("classes", held.groupBy("key", "class").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n")))

    # shingles that lead at least two classes
    leads = signed.where("id is not null and n > 0").select(F.explode("leads").alias("shingle"), "class")
    same = Window.partitionBy("shingle")  # those of a shingle that fewer than ``hot_sets`` sets hold
    spread = leads.withColumn("low", F.min("class").over(same)).withColumn("high", F.max("class").over(same)).where("low <> high")
    hot = signed.where("id is not null and n > 0").select(F.explode("hot").alias("shingle"), "class")
    shared = work.table("shared", spread.select("shingle", "class").unionByName(hot).distinct())

    # a match is at least this large, and shares as many leading shingles as the smaller set must
    smallest = F.floor((percent * F.col("n") + 99) / 100)
    keyed = shared.groupBy("class").agg(F.count("*").alias("found"), F.min(F.xxhash64("shingle")).alias("gkey"))
    keyed = classes.join(keyed, "class").where(F.col("found") >= 1 + F.floor(smallest / 10))
    keyed = work.table("keyed", keyed.select("rep", "class", "copies", "gkey", "n", (1 + F.floor(F.col("n") / 10)).alias("least")))
    sizes = keyed.groupBy("gkey").agg(F.greatest(F.ceil(F.count("*") / group_size), F.ceil(F.sum("n") / group_shingles)).alias("parts"))
    members = work.table("members", keyed.join(sizes, "gkey").select("rep", "class", "copies", "least", F.xxhash64("gkey", F.pmod(F.xxhash64("class"), F.col("parts"))).alias("grp")))

    wanted = members.select(F.col("rep").alias("id"), "class", "copies", "grp")
    if wanted.count() <= broadcast_rows:  # 32 bytes each
        wanted = F.broadcast(wanted)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _text_batches(batches, 0, seed):
            keys = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8 * 2).digest()[:8], "little", signed=True) if len(s) else None for s in sets]
            fits = [i for i, (k, c) in enumerate(zip(keys, rows.column(2).to_pylist(), strict=True)) if k == c]
            at = pa.array(fits, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(1).take(at), rows.column(3).take(at), rows.column(4).take(at), rows.column(2).take(at), pa.array([sets[i].tobytes() for i in fits], pa.binary())], ["rep", "copies", "grp", "class", "tokens"])

    sets = docs.join(wanted, "id").select("text", F.col("id").alias("rep"), "class", "copies", "grp").mapInArrow(pack, "rep long, copies long, grp long, class long, tokens binary")
    member = F.struct("rep", "class", "copies", "tokens")
    groups = work.table("groups", sets.dropDuplicates(["rep", "class"]).groupBy("grp").agg(F.collect_list(member).alias("members")))

    # groups that share enough leading shingles meet
    least = members.groupBy("grp").agg(F.min("least").alias("least"))
    led = shared.join(members.select("class", "grp"), "class").select("shingle", "grp").distinct().join(least, "grp")
    pairs = led.alias("x").join(led.alias("y"), "shingle").where("x.grp < y.grp").groupBy(F.col("x.grp").alias("g"), F.col("y.grp").alias("h"))
    pairs = pairs.agg(F.count("*").alias("found"), F.first(F.least("x.least", "y.least")).alias("least")).where("found >= least").select("g", "h")
    alone = groups.where(F.size("members") > 1).select(F.col("grp").alias("g"), F.col("grp").alias("h"))
    left, right = (groups.select(F.col("grp").alias(k), F.col("members").alias(m)) for k, m in (("g", "left"), ("h", "right")))
    met = pairs.union(alone).join(left, "g").join(right, "h").select("g", "h", "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[tuple[int, int], tuple[int, int], int]] = []
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("g", "h", "left", "right")}
                a, b = ([((m["rep"], m["class"]), m["copies"], np.frombuffer(m["tokens"], np.uint64)) for m in row[side]] for side in ("left", "right"))
                out += meet(a, b, percent, row["g"] == row["h"])
            columns = [x[0][0] for x in out], [x[1][0] for x in out], [x[0][1] for x in out], [x[2] for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["src", "dst", "class", "links"])

    links = work.table("links", met.mapInArrow(compare, "src long, dst long, class long, links long"))
    # an id with several texts ties their classes together
    several = held.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").select("id")
    tied = work.table("tied", held.join(several, "id", "left_semi").join(classes.select("key", "rep"), "key").select(F.col("id").alias("src"), F.col("rep").alias("dst")))
    labels = connected_components(links.select("src", "dst").unionByName(tied), work)
    degree = links.groupBy("class").agg(F.sum("links").alias("links"))
    found = classes.join(labels, F.col("rep") == F.col("node"), "left").join(degree, "class", "left")
    found = work.table("found", found.select("key", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    work.drop("shared", "keyed", "members", "groups", "cc-links", "links", "tied", "classes")
    linkable = F.col("id").isNotNull() & (F.col("n") > 0)
    rows = signed.where(linkable).select("id", "n", "key").join(found, "key").select("id", "n", "component", "links")
    # a row without words takes the component that its id has from other rows
    bare = signed.where(~linkable).select("id", "n")
    named = held.join(bare.select("id").where("id is not null"), "id", "left_semi").join(found, "key").groupBy("id").agg(F.min("component").alias("component"))
    bare = bare.join(named, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"), F.lit(0).alias("links"))
    return rows.unionByName(bare).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").cast("long").alias("n_links"))
