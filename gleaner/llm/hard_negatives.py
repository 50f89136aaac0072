"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm, highest first, and cut into buckets; a bucket keeps its highest norm. By
Cauchy-Schwarz no row of a bucket scores more with an anchor than the product of the two norms, so a bucket is left
out where that is below the lower limit of a window and below the window's running kth score. Rounds go down the
norms, each over eight times as many buckets as the one before, and what they found raises the limits of the next.
The same search runs twice: for the positives of each anchor (one window without limits, same label), and for the
negatives of each anchor and positive (a window of scores, other labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch
from gleaner.llm.topk import LIMIT, packed, scores_of

FIRST_BUCKETS, GROWTH = 64, 8
HELD_PARTS = 16  # blocks of anchors whose best rows a task holds
NOT_YET = -(1 << 62)
BUCKET = "width int, norm double, kind string, ids binary, labels binary, data binary"
FOUND = "key long, slot int, id long, score long"


def labelled_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vec array<long>, square, width): floor(scale * x) of each component, and the sum of their squares.
    Rows with a null id or label, a null vector, or a null or non-finite component are left out; components stop at
    +-2**61. Of rows equal in all one stays."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long"))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    kept = kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("vec")).where("label is not null").distinct()
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return kept.withColumn("square", square).withColumn("width", F.size("vec"))


def by_norm(work: Scratch, rows: DataFrame, bucket_rows: int) -> DataFrame:
    """A written table of buckets of about ``bucket_rows`` vectors, numbered in ``place`` from the highest norm down."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, list[int], float]]] = {}

        def bucket(width: int) -> pa.RecordBatch:
            some = held.pop(width)
            kind, data = packed([v for _, _, v, _ in some])
            ids, labels = (np.array([r[k] for r in some], "<i8").tobytes() for k in (0, 1))
            norm = math.sqrt(max(r[3] for r in some)) * (1 + 1e-9) + 1e-9
            cols = [pa.array([width], pa.int32()), pa.array([norm]), pa.array([kind]), *(pa.array([x], pa.binary()) for x in (ids, labels, data))]
            return pa.RecordBatch.from_arrays(cols, ["width", "norm", "kind", "ids", "labels", "data"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "vec", "square")), strict=True):
                held.setdefault(len(row[2]), []).append(row)
                if len(held[len(row[2])]) >= bucket_rows:
                    yield bucket(len(row[2]))
        for width in list(held):
            yield bucket(width)

    high_first = [F.col("square").desc(), F.col("id")]
    dealt = rows.repartitionByRange(*high_first).sortWithinPartitions(*high_first)
    # the number rises with the partition and within it, so as norms fall; then it is made dense
    number = F.monotonically_increasing_id()
    packs = dealt.select("id", "label", "vec", "square").mapInArrow(pack, BUCKET)
    kept = work.table("packs", packs.select(F.shiftright(number, 33).alias("_part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"), "*"))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return kept.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """(part, width, kind, keys, ids, labels, norms, data) of anchors (key, part, id, label, vec, square, width)."""

    def pack(rows: pa.Table) -> pa.Table:
        kind, data = packed(rows.column("vec").to_pylist())
        binaries = [rows.column(c).to_numpy().astype("<i8").tobytes() for c in ("key", "id", "label")]
        binaries += [(np.sqrt(rows.column("square").to_numpy()) * (1 + 1e-9) + 1e-9).astype("<f8").tobytes(), data]
        part, width = (rows.column(c)[0].as_py() for c in ("part", "width"))
        cols = [pa.array([part], pa.int64()), pa.array([width], pa.int32()), pa.array([kind]), *(pa.array([x], pa.binary()) for x in binaries)]
        return pa.table(cols, ["part", "width", "kind", "keys", "ids", "labels", "norms", "data"])

    return anchors.groupBy("part", "width").applyInArrow(pack, "part long, width int, kind string, keys binary, ids binary, labels binary, norms binary, data binary")


class Best:
    """The ``k`` best (score, id) of each anchor of a block and slot, as far as a task has seen."""

    def __init__(self, keys: np.ndarray, slots: int, k: int):
        self.keys, self.k = keys, k
        self.scores = np.full((len(keys), slots, k), NOT_YET, np.int64)
        self.ids = np.full((len(keys), slots, k), -1, np.int64)

    def take(self, rows: np.ndarray, slot: int, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Candidates ``ids`` with ``scores`` for anchors ``rows``; ties to the smaller id."""
        k = self.k
        scores = np.where(allowed, scores, NOT_YET)
        if scores.shape[1] > k:
            kth = np.partition(scores, -k, axis=1)[:, -k]
            allowed &= scores >= np.maximum(kth, self.scores[rows, slot, -1])[:, None]
        r, c = np.nonzero(allowed)
        if not len(r):
            return
        touched = np.unique(r)
        old = self.scores[rows[touched], slot]
        row = np.concatenate([r, np.repeat(touched, k)])
        score = np.concatenate([scores[r, c], old.ravel()])
        doc = np.concatenate([ids[c], self.ids[rows[touched], slot].ravel()])
        order = np.lexsort((doc, -score, row))
        row, score, doc = row[order], score[order], doc[order]
        begin = np.searchsorted(row, touched)
        keep = begin[:, None] + np.arange(k)
        self.scores[rows[touched], slot], self.ids[rows[touched], slot] = score[keep], doc[keep]

    def rows(self) -> pa.RecordBatch:
        q, slot, n = np.nonzero(self.scores > NOT_YET)
        cols = [pa.array(self.keys[q], pa.int64()), pa.array(slot, pa.int32()), pa.array(self.ids[q, slot, n], pa.int64()), pa.array(self.scores[q, slot, n], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["key", "slot", "id", "score"])


def compare(k: int, same_label: bool):  # noqa: ANN201
    """A task's rows: blocks of anchors beside buckets; its best rows for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n != "limits"}
                keys, own, labels = (np.frombuffer(row[n], "<i8") for n in ("keys", "ids", "labels"))
                norms, asked = np.frombuffer(row["norms"], "<f8"), np.frombuffer(row["data"], row["kind"]).reshape(len(keys), -1)
                ids, others = np.frombuffer(row["cids"], "<i8"), np.frombuffer(row["clabels"], "<i8")
                limits = batch.slice(i, 1).column("limits").flatten()
                key, slot, low, high, kth = (limits.field(n).to_numpy(zero_copy_only=False) for n in ("key", "slot", "low", "high", "kth"))
                by_key = np.argsort(keys)
                at = by_key[np.searchsorted(keys, key, sorter=by_key)]
                name = row["part"], row["width"]
                if name not in held:
                    held[name] = Best(keys, int(slot.max()) + 1, k)
                    if len(held) > HELD_PARTS:
                        yield held.pop(next(iter(held))).rows()
                best = held[name]
                floor = np.maximum(np.maximum(low, kth), best.scores[at, slot, -1])
                live = norms[at] * row["most"] >= floor
                if not live.any():
                    continue
                some = np.unique(at[live])
                found = scores_of(asked[some].astype(np.int64), np.frombuffer(row["cdata"], row["ckind"]).reshape(len(ids), -1).astype(np.int64))
                fits = (own[some][:, None] != ids[None, :]) & ((labels[some][:, None] == others[None, :]) == same_label)
                for s in np.unique(slot[live]).tolist():
                    here = np.flatnonzero(live & (slot == s))
                    r = np.searchsorted(some, at[here])
                    inside = fits[r] & (found[r] >= floor[here][:, None]) & (found[r] <= high[here][:, None])
                    best.take(at[here], s, found[r], ids, inside)
        for best in held.values():
            yield best.rows()

    return run


def with_reach(windows: DataFrame) -> DataFrame:
    """Adds the least norm of a row that can still enter the window."""
    floor = F.greatest("low", "kth").cast("double")
    return windows.withColumn("reach", F.when(floor <= 0, F.lit(0.0)).when(F.col("norm") > 0, floor / F.col("norm") * (1 - 1e-9)).otherwise(F.lit(float("inf"))))


def search(work: Scratch, name: str, blocks: DataFrame, buckets: DataFrame, windows: DataFrame, k: int, same_label: bool, shards: int) -> DataFrame:
    """(key, slot, id, score, rank): the ``k`` best rows of each window (key, part, width, norm, slot, low, high), of
    the anchor's label or of other labels, the anchor's own id aside."""
    order = Window.partitionBy("key", "slot").orderBy(F.col("score").desc(), "id")
    none = F.lit(NOT_YET).cast("long")
    state, best = with_reach(windows.withColumn("kth", none)), work.spark.createDataFrame([], f"{FOUND}, rank int")
    held = buckets.select("width", "place", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.col("norm").alias("most"), F.col("kind").alias("ckind"), F.col("ids").alias("cids"), F.col("labels").alias("clabels"), F.col("data").alias("cdata"))
    total, done, size, turn = buckets.count(), 0, FIRST_BUCKETS, 0
    while done < total:
        limits = state.groupBy("part", "width").agg(F.collect_list(F.struct("key", "slot", "low", "high", "kth")).alias("limits"), F.min("reach").alias("least"))
        asking = blocks.join(limits, ["part", "width"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        now = held.where((F.col("place") >= done) & (F.col("place") < done + size)).drop("place")
        found = asking.join(now, ["shard", "width"]).where("most >= least").drop("shard", "least").mapInArrow(compare(k, same_label), FOUND)
        ranked = found.unionByName(best.drop("rank")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = work.table(f"{name}-{turn}", ranked)
        if turn:
            work.drop(f"{name}-{turn - 1}")
        done, size, turn = done + size, size * GROWTH, turn + 1
        if done < total:
            kth = best.where(F.col("rank") == k).select("key", "slot", F.col("score").alias("kth"))
            state = with_reach(windows.join(kth, ["key", "slot"], "left").withColumn("kth", F.coalesce("kth", none)))
    return best


def mine_hard_negatives(
    spark: SparkSession,
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: str = "0.50",
    high: str = "0.95",
    scale: int = 256,
    bucket_rows: int = 1024,
    block_rows: int = 512,
) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score): for each row that fulfils
    ``anchors`` its ``positives`` best other rows of the same label, and for each of these the ``negatives`` best rows
    of other labels that score from ``low`` to ``high`` times as much as the positive, both ends in; all, if fewer.

    Scores are exact integer inner products of floor(scale * x), higher first, ties to the smaller id. Rows with a null
    id, label or vector, or a null or non-finite component, take no part; ids and labels are longs. Of rows equal in
    all three one takes part; an id with several vectors or labels is a candidate, and an anchor, with each. Vectors
    meet those of their own length only. Other columns are ignored; no rows or anchors, no result.
    """
    work = Scratch(spark, "hard-negatives")
    cand = work.table("rows", labelled_vectors(rows, id_col, vec_col, label_col, scale))
    # written, so that the keys stay the same
    asked = work.table("asked", labelled_vectors(rows.where(anchors), id_col, vec_col, label_col, scale).withColumn("key", F.monotonically_increasing_id()))
    n, m = cand.count(), asked.count()
    shards = max(spark.sparkContext.defaultParallelism * 2, -(-n // 200_000))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-m // block_rows)))))
    blocks, buckets = work.table("blocks", anchor_blocks(asked)), work.table("buckets", by_norm(work, cand, bucket_rows))
    every = asked.select("key", "part", "width", (F.sqrt("square") * (1 + 1e-9) + 1e-9).alias("norm"), F.lit(0).alias("slot"), F.lit(NOT_YET).alias("low"), F.lit(-NOT_YET).alias("high"))
    alike = search(work, "positives", blocks, buckets, every, positives, True, shards).select("key", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    exact = F.col("positive_score").cast("decimal(20,0)")
    windows = alike.join(every.select("key", "part", "width", "norm"), "key").withColumn("low", F.ceil(exact * F.lit(Decimal(low))).cast("long")).withColumn("high", F.floor(exact * F.lit(Decimal(high))).cast("long"))
    windows = work.table("windows", windows.where("low <= high"))
    found = search(work, "negatives", blocks, buckets, windows.select("key", "part", "width", "norm", "slot", "low", "high"), negatives, False, shards)
    told = found.join(windows.select("key", "slot", "positive_id", "positive_score"), ["key", "slot"]).join(asked.select("key", F.col("id").alias("anchor_id")), "key")
    return told.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
