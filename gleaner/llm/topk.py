"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks; a block of queries meets every block of candidates
in a shard. Each round scores everything and counts, for every query, the scores in 128 equal bins
of the interval that still holds its kth score; the counts are summed over all shards and the bin
of the kth score becomes the next interval, until a bin is one score wide. A last pass keeps the
scores above the kth, and of those equal to it as many as are still needed, smallest id first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch

BINS = 128
BLOCK = "ids binary, width int, kind string, data binary"
HELD_PARTS = 16  # blocks of queries whose counts a task holds
LIMIT = 1 << 61  # so that differences of scores fit a long


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec array<long>): floor(scale * x) of each component; vectors that are null or hold a
    null or non-finite component, and null ids, are left out. Components stop at +-2**61. Of rows
    equal in both one stays."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long"))
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    return kept.select(F.col(id_col).cast("long").alias("id"), whole.alias("vec")).distinct()


def packed(vectors: list[list[int]]) -> tuple[str, bytes]:
    """A matrix of whole numbers in the narrowest type that holds them."""
    rows = np.array(vectors, np.int64)
    most = int(np.abs(rows).max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    return kind, rows.astype(kind).tobytes()


def scores_of(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point only where every partial sum is a whole number it holds."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(candidates)), np.int64)
    most = math.prod(float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (queries, candidates)) * queries.shape[1]
    if most < 1 << 24:
        return (queries.astype(np.float32) @ candidates.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    if most < LIMIT:
        return queries @ candidates.T
    exact = queries.astype(object) @ candidates.astype(object).T
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def exact_top_k(
    spark: SparkSession,
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 64,
    block_rows: int = 1024,
) -> DataFrame:
    """(query_id, rank from 1, the candidate's id as ``id_col``, score): each query's ``k`` highest
    integer inner products among candidates of another id, ties to the smaller id; all, if fewer.

    Vectors null or with null or non-finite components, and null ids, take no part; of rows
    equal in id and integer vector one takes part. An id with several vectors is a candidate with each of
    them; as a query it ranks what all of them find. Vectors meet those of their own
    length only. Scores are exact and stop at +-2**61. Other columns are ignored; without queries
    or candidates there are no rows.
    """
    work = Scratch(spark, "topk")
    cand = work.table("candidates", integer_vectors(candidates, id_col, vec_col, scale))
    # written, so that the keys stay the same
    asked = work.table("queries", integer_vectors(queries, id_col, vec_col, scale).withColumn("key", F.monotonically_increasing_id()))
    squared = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    facts = cand.agg(F.count("*").alias("n"), F.max(squared("vec")).alias("sq")).crossJoin(asked.agg(F.count("*").alias("m"), F.max(squared("vec")).alias("qsq"))).first()
    shards = max(spark.sparkContext.defaultParallelism * 2, -(-facts["n"] // 200_000))
    longest = math.sqrt(facts["sq"] or 0.0)
    bound = F.least(F.sqrt(squared("vec")) * F.lit(longest * 1.000001) + 2, F.lit(float(LIMIT)))
    parts = max(1, -(-facts["m"] // block_rows))
    state = asked.select(
        "key", F.size("vec").alias("width"), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"),
        (-bound).cast("long").alias("low"), bound.cast("long").alias("high"), F.lit(k).cast("long").alias("need"),
    )
    state = work.table("state", state)

    def block_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_width: dict[int, list[tuple[int, list[int]]]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_width.setdefault(len(v), []).append((i, v))
            for width, rows in by_width.items():
                for lo in range(0, len(rows), block_rows):
                    some = rows[lo : lo + block_rows]
                    kind, data = packed([v for _, v in some])
                    ids = np.array([i for i, _ in some], np.int64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([width], pa.int32()), pa.array([kind]), pa.array([data], pa.binary())], ["ids", "width", "kind", "data"])

    def query_block(rows: pa.Table) -> pa.Table:
        kind, data = packed(rows.column("vec").to_pylist())
        keys, ids = (rows.column(c).to_numpy().astype("<i8").tobytes() for c in ("key", "id"))
        cols = [rows.column("part")[:1], rows.column("width")[:1], pa.array([keys], pa.binary()), pa.array([ids], pa.binary()), pa.array([kind]), pa.array([data], pa.binary())]
        return pa.Table.from_arrays([pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in cols], ["part", "width", "keys", "own", "qkind", "qdata"])

    blocks = cand.select("id", "vec").mapInArrow(block_up, BLOCK)
    blocks = work.table("blocks", blocks.select(F.pmod(F.xxhash64("ids"), F.lit(shards)).alias("shard"), "*"))
    members = asked.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), F.size("vec").alias("width"), "key", "id", "vec")
    questions = work.table("questions", members.groupBy("part", "width").applyInArrow(query_block, "part long, width int, keys binary, own binary, qkind string, qdata binary"))

    def met(now: DataFrame) -> DataFrame:
        """Every block of queries, with the interval of each, beside every block of candidates."""
        limits = now.groupBy("part", "width").agg(F.collect_list(F.struct("key", "low", "high", "need")).alias("limits"))  # block_rows of them, about
        asking = questions.join(limits, ["part", "width"]).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        return asking.join(blocks, ["shard", "width"]).select("part", "keys", "own", "qkind", "qdata", "limits", "ids", "kind", "data")

    Met = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[Met]:
        """(part, keys, ids of the queries, [low, high, need], candidates' ids, scores, which are another's)."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, keys, own, qkind, qdata, ids, kind, data = (row.column(c)[0].as_py() for c in ("part", "keys", "own", "qkind", "qdata", "ids", "kind", "data"))
                limits = row.column("limits").flatten()
                order = np.argsort(limits.field("key").to_numpy())
                bounds = np.stack([limits.field(c).to_numpy()[order] for c in ("low", "high", "need")])
                keys, own, ids = (np.frombuffer(x, "<i8") for x in (keys, own, ids))
                by_key = np.argsort(keys)
                asked_for = np.frombuffer(qdata, qkind).reshape(len(keys), -1).astype(np.int64)[by_key]
                found = scores_of(asked_for, np.frombuffer(data, kind).reshape(len(ids), -1).astype(np.int64))
                yield part, keys[by_key], own[by_key], bounds, ids, found, own[by_key][:, None] != ids[None, :]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts are added up over the blocks of candidates that a task sees. A bin below the one that
        holds the task's own kth score can't hold that of all, so it is left out."""
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def rows(part: int) -> pa.RecordBatch:
            keys, need, counts = held.pop(part)
            above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < need[:, None]))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys[q], b, counts[q, b])], ["key", "bin", "n"])

        for part, keys, _, (low, high, need), _, found, other in unpack(batches):
            step = ((high - low) // BINS + 1)[:, None]
            ok = other & (found >= low[:, None]) & (found <= high[:, None])
            slot = np.where(ok, (found - low[:, None]) // step, BINS) + np.arange(len(keys))[:, None] * (BINS + 1)
            counts = np.bincount(slot.ravel(), minlength=len(keys) * (BINS + 1)).reshape(len(keys), -1)[:, :BINS]
            if part in held:
                counts = held[part][2] + counts
            held[part] = keys, need, counts
            if len(held) > HELD_PARTS:
                yield rows(next(iter(held)))
        for part in list(held):
            yield rows(part)

    rounds, span = 0, 2 * min(longest * 1.000001 * math.sqrt(facts["qsq"] or 0.0) + 2, LIMIT) + 1
    while span > 1:
        span, rounds = span // BINS + 1 if span > BINS else 1, rounds + 1
    for r in range(rounds + 1):
        counts = met(state).mapInArrow(histogram, "key long, bin long, n long").groupBy("key", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("key").orderBy(F.col("bin").desc())  # BINS rows
        reached = counts.withColumn("upto", F.sum("n").over(from_top)).join(state.select("key", "low", "high", "need"), "key")
        kth = reached.where("upto >= need").groupBy("key").agg(F.max(F.struct("bin", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))).alias("kth"))
        step = F.expr(f"(high - low) div {BINS} + 1")
        joined = state.join(kth, "key", "left")
        low = F.when(F.col("kth").isNull(), F.col("low")).otherwise(F.col("low") + F.col("kth.bin") * step)
        high = F.when(F.col("kth").isNull(), F.col("low")).otherwise(F.least("high", F.col("low") + (F.col("kth.bin") + 1) * step - 1))
        # fewer scores than asked for: everything from the lower end on is wanted
        need = F.when(F.col("kth").isNull(), F.lit(k)).otherwise(F.col("kth.need")).cast("long")
        state = work.table(f"state-{r}", joined.select("key", "width", "part", low.alias("low"), high.alias("high"), need.alias("need")))
        if r:
            work.drop(f"state-{r - 1}")
        if not state.where("low < high").limit(1).count():
            break

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, own, (low, _, need), ids, found, other in unpack(batches):
            order = np.argsort(ids, kind="stable")
            ids, found, other = ids[order], found[:, order], other[:, order]
            equal = other & (found == low[:, None])
            keep = other & (found > low[:, None]) | equal & (np.cumsum(equal, 1) <= need[:, None])
            q, c = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (own[q], ids[c], found[q, c])], ["query_id", "id", "score"])

    best = met(state).mapInArrow(select, "query_id long, id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
