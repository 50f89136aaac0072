"""Language-model scores by deleted interpolation.

1. Documents are tokenised once into blocks of bounded size, written in the shared folder. A tenth of the
   training documents is deleted from the counts and goes into blocks of its own.
2. Every block lists its distinct n-grams of each order with its own counts, dealt over parts by their keys.
   A part adds up the counts of all blocks and answers each block, gram by gram.
3. Maximum-likelihood estimates of each order are mixed with the order below by weights that depend on how
   often the context occurs (a bucket each half octave). Expectation-maximisation learns the weights on the
   deleted documents, with counts of the others, from the lowest order up; it runs on sums by bucket and by
   ratio of the two estimates, a table of fixed size.
4. Every block is scored with the counts of all training documents and these weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bytewords import mix
from gleaner.llm.scratch import Scratch
from gleaner.llm.tokens import release

TEST, MAIN, DELETED = 0, 1, 2
START, END, BETWEEN = b"\t", b" ", b"\n"  # no word holds white space
BUCKETS = 64  # of context frequencies: none, then half octaves
RATIOS, PER_OCTAVE, OCTAVES = 1 + 2 * 40 * 16, 16, 40  # bins of ratios of two estimates: 0, then sixteenths of octaves
BLOCKS = "block long, deleted boolean, ids array<long>, kinds binary, lengths binary, stream binary, words binary"
ANSWERS = "block long, part int, level int, main binary, deleted_counts binary, sums array<long>"
SCORES = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tight(data: bytes) -> bytes:
    """What travels or is kept of a block: word numbers and counts are far from evenly spread, which Spark's own
    codecs don't make use of."""
    return zstandard.ZstdCompressor(level=1).compress(data)


def loose(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class _Block:
    """Documents of a task as word numbers."""

    def __init__(self) -> None:
        self.numbers = _Numbers({START: 0, END: 1})
        self.ids: list[int | None] = []
        self.kinds, self.lengths = bytearray(), []
        self.streams: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, kind: int, text: bytes) -> None:
        words = text.lower().split()  # of bytes: A-Z only, and blanks, tabs and line ends only
        self.ids.append(doc)
        self.kinds.append(kind)
        self.lengths.append(len(words))
        self.streams.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.size += len(words) + 1

    def row(self, block: int, deleted: bool) -> pa.RecordBatch:
        stream = np.concatenate(self.streams).astype("<u4")
        planes = stream.view(np.uint8).reshape(-1, 4).T.tobytes()  # bytes of equal weight together, which packs better
        lengths = np.array(self.lengths, "<u4").tobytes()
        cols = [pa.array([block], pa.int64()), pa.array([deleted]), pa.array([self.ids], pa.list_(pa.int64()))]
        cols += [pa.array([x], pa.binary()) for x in (bytes(self.kinds), tight(lengths), tight(planes), tight(BETWEEN.join(self.numbers)))]
        return pa.RecordBatch.from_arrays(cols, ["block", "deleted", "ids", "kinds", "lengths", "stream", "words"])


def block_documents(docs: DataFrame, block_tokens: int) -> DataFrame:
    """(id long, text binary, kind int) as blocks of about ``block_tokens`` tokens; a longer text stands alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        name, held = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            for doc, text, kind in zip(*(batch.column(c) for c in range(3)), strict=True):
                deleted = kind.as_py() == DELETED
                block = held.setdefault(deleted, _Block())
                block.add(doc.as_py(), kind.as_py(), text.as_py() or b"")
                if block.size >= block_tokens:
                    yield held.pop(deleted).row(name, deleted)
                    name += 1
        for deleted, block in held.items():
            yield block.row(name, deleted)
            name += 1

    return docs.mapInArrow(run, BLOCKS)


def packed_keys(keys: np.ndarray) -> bytes:
    """Rising keys by their gaps, bytes of equal weight together: the upper ones are 0 and pack away."""
    return tight(np.diff(keys.astype("<u8"), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(loose(data), np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


class Grams:
    """All n-grams of a block: for each order, which distinct gram ends at each place.

    Documents are padded with start marks, so that a place and the place before it give every context.
    """

    def __init__(self, row: dict, order: int):
        self.words = loose(row["words"]).split(BETWEEN)
        kinds, lengths = np.frombuffer(row["kinds"], np.uint8), np.frombuffer(loose(row["lengths"]), "<u4").astype(np.int64)
        stream = np.ascontiguousarray(np.frombuffer(loose(row["stream"]), np.uint8).reshape(4, -1).T).view("<u4").ravel()
        pad = order - 1
        full = lengths + pad + 1
        first = np.cumsum(full) - full
        self.seq = np.zeros(int(full.sum()), np.int64)
        inside = np.arange(len(stream)) + np.repeat(first + pad - (np.cumsum(lengths) - lengths), lengths)
        self.seq[inside], self.seq[first + pad + lengths] = stream, 1
        self.before = np.arange(len(self.seq)) - 1
        self.before[first] = first
        self.doc_of = np.repeat(np.arange(len(full)), full)
        self.scored = np.ones(len(self.seq), bool)  # places of words and ends
        counted = kinds[self.doc_of] != TEST
        for k in range(pad):
            self.scored[first + k] = False
            counted[first + k] &= k == pad - 1  # the last start mark is the context of a word, those before it are not
        self.counted = counted
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.at, self.keys, self.sizes = [self.seq], [hashes], [len(hashes)]
        for level in range(2, order + 1):
            code = self.at[-1][self.before] * np.int64(len(hashes)) + self.seq
            _, example, at = np.unique(code, return_index=True, return_inverse=True)
            context = self.keys[-1][self.at[-1][self.before[example]]]
            self.keys.append(mix(context * np.uint64(0x9E3779B97F4A7C15) + hashes[self.seq[example]] + np.uint64(level)))
            self.at.append(at)
            self.sizes.append(len(example))

    def counts(self, level: int) -> np.ndarray:
        return np.bincount(self.at[level][self.counted], minlength=self.sizes[level])

    def dealt(self, level: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct grams ordered by key, and where each part, a range of keys, begins in that order."""
        order = np.argsort(self.keys[level], kind="stable")
        low = np.array([(p << 64) // parts for p in range(parts)], np.uint64)
        return order, np.append(np.searchsorted(self.keys[level][order], low), len(order))


def ask_counts(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """For each block, order and part: the distinct grams (words as they are, longer grams as 64-bit keys) with
    the block's own counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("block", "deleted", "kinds", "lengths", "stream", "words")}
                grams = Grams(row, order)
                for level in range(order):
                    by_part, begin = grams.dealt(level, parts)
                    counts = grams.counts(level).astype("<u4")[by_part]
                    keys = [grams.words[k] for k in by_part.tolist()] if level == 0 else grams.keys[level][by_part]
                    some = [p for p in range(parts) if begin[p] < begin[p + 1]]
                    cut = [slice(begin[p], begin[p + 1]) for p in some]
                    packed = [tight(BETWEEN.join(keys[s])) if level == 0 else packed_keys(keys[s]) for s in cut]
                    n = len(some)
                    cols = [pa.array(some, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array([level] * n, pa.int32()), pa.array([row["deleted"]] * n, pa.bool_())]
                    cols += [pa.array(packed, pa.binary()), pa.array([tight(counts[s].tobytes()) for s in cut], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["part", "block", "level", "deleted", "grams", "counts"])

    return blocks.select("block", "deleted", "kinds", "lengths", "stream", "words").mapInArrow(run, "part int, block long, level int, deleted boolean, grams binary, counts binary")


def answer_counts(asked: DataFrame) -> DataFrame:
    """To each row of ``ask_counts`` the counts of its grams in all blocks: in those that count, and in the deleted
    ones. A row with a null block holds a part's sums: tokens and distinct words counted, and with the deleted ones."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, levels = key[0].as_py(), {}
        for batch in batches:
            for block, level, deleted, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "level", "deleted", "grams", "counts")), strict=True):
                levels.setdefault(level, []).append((block, deleted, grams, np.frombuffer(loose(counts), "<u4")))
        for level, rows in levels.items():
            sizes = np.array([len(r[3]) for r in rows])
            if level == 0:
                numbers = _Numbers()
                at = np.fromiter((numbers[w] for r in rows for w in loose(r[2]).split(BETWEEN)), np.int64, int(sizes.sum()))
            else:
                keys, at = np.unique(np.concatenate([unpacked_keys(r[2]) for r in rows]), return_inverse=True)
            counts, gone = np.concatenate([r[3] for r in rows]), np.repeat([r[1] for r in rows], sizes)
            total = [np.bincount(at, counts * (gone == d)).astype(np.int64) for d in (False, True)]
            ends = np.cumsum(sizes)
            told = [[tight(t[at[e - n : e]].astype("<u4").tobytes()) for n, e in zip(sizes, ends, strict=True)] for t in total]
            n = len(rows)
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * n, pa.int32()), pa.array([level] * n, pa.int32()), *(pa.array(t, pa.binary()) for t in told), pa.array([None] * n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["block", "part", "level", "main", "deleted_counts", "sums"])
            if level == 0:
                kept = np.fromiter((w != START for w in numbers), bool, len(numbers))
                main, every = total[0][kept], (total[0] + total[1])[kept]
                sums = [int(x) for x in (main.sum(), (main > 0).sum(), every.sum(), (every > 0).sum())]
                cols = [pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([0], pa.int32()), *(pa.array([None], pa.binary()) for _ in range(2)), pa.array([sums], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["block", "part", "level", "main", "deleted_counts", "sums"])

    return asked.groupBy("part").applyInArrow(run, ANSWERS)


def met(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks and the answers to them in one table."""
    own = blocks.select("block", F.lit(-1).alias("part"), F.lit(-1).alias("level"), "ids", "kinds", "lengths", "stream", "words", *(F.lit(None).cast("binary").alias(c) for c in ("main", "deleted_counts")))
    return own.unionByName(answers.drop("sums"), allowMissingColumns=True)


def gathered(batches: Iterator[pa.RecordBatch], order: int, parts: int) -> tuple[dict, Grams, list[list[np.ndarray]]]:
    """A block, its grams, and for each order their counts in all blocks: counted ones and deleted ones."""
    release()
    row, told = {}, {}
    for batch in batches:
        for k in range(batch.num_rows):
            level = batch.column("level")[k].as_py()
            if level < 0:
                row = {n: batch.column(n)[k].as_py() for n in ("ids", "kinds", "lengths", "stream", "words")}
            else:
                told[level, batch.column("part")[k].as_py()] = [batch.column(n)[k].as_py() for n in ("main", "deleted_counts")]
    grams, counts = Grams(row, order), []
    for level in range(order):
        by_part, begin = grams.dealt(level, parts)
        both = [np.zeros(grams.sizes[level], np.int64) for _ in range(2)]
        for p in range(parts):
            if begin[p] < begin[p + 1]:
                for out, packed in zip(both, told[level, p], strict=True):
                    out[by_part[begin[p] : begin[p + 1]]] = np.frombuffer(loose(packed), "<u4")
        counts.append(both)
    return row, grams, counts


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0 for contexts that don't occur, then one for each half octave of their counts."""
    return np.where(counts > 0, np.minimum(BUCKETS - 1, 1 + np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.int64)), 0)


def estimates(places: list[np.ndarray], n: int, v: int, weights: list[np.ndarray]) -> np.ndarray:
    """The mixed probability at each place, of as many orders as have weights. ``places``: the counts of the
    word, of its context and the gram for order 2, of those for order 3, and so on."""
    p = np.full(len(places[0]), 1 / (v + 1))
    for level, weight in enumerate(weights):
        context = np.full(len(p), n) if level == 0 else places[2 * level - 1]
        share = weight[np.zeros(len(p), np.int64) if level == 0 else bucket_of(context)]
        share = np.where(context > 0, share, 0.0)
        p = share * places[2 * level] / np.maximum(context, 1) + (1 - share) * p
    return p


def learned_weights(sums: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Expectation-maximisation of the weight of each bucket, from how often each ratio of the higher to the
    lower estimate occurs in it. A bucket without any takes the weight of the nearest one that has some."""
    ratio = np.concatenate([[0.0], np.exp2((np.arange(RATIOS - 1) + 0.5) / PER_OCTAVE - OCTAVES)])
    total = sums.sum(1)
    some = np.flatnonzero(total)
    weight = np.full(len(sums), 0.5)
    for _ in range(rounds):
        w = weight[some][:, None]
        weight[some] = np.clip((sums[some] * (w * ratio / (w * ratio + 1 - w))).sum(1) / total[some], 1e-4, 1 - 1e-4)
    if len(some):
        weight = weight[some[np.abs(some[None, :] - np.arange(len(sums))[:, None]).argmin(1)]]
    return weight


def learn_weights(places: DataFrame, order: int, n: int, v: int) -> list[np.ndarray]:
    """Weights of each order from the deleted documents' places (columns c0, c1, ...), the lowest order first."""
    weights: list[np.ndarray] = []
    for level in range(order):

        def count(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(BUCKETS * RATIOS, np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    at = [np.frombuffer(loose(batch.column(c)[i].as_py()), "<u4").astype(np.int64) for c in range(batch.num_columns)]
                    context = np.full(len(at[0]), n) if level == 0 else at[2 * level - 1]
                    ratio = at[2 * level] / np.maximum(context, 1) / estimates(at, n, v, weights)
                    fine = np.floor((np.log2(np.maximum(ratio, 1e-300)) + OCTAVES) * PER_OCTAVE)
                    place = np.where(ratio > 0, 1 + np.clip(fine, 0, RATIOS - 2), 0).astype(np.int64)
                    bucket = np.zeros(len(place), np.int64) if level == 0 else bucket_of(context)
                    sums += np.bincount((bucket * RATIOS + place)[context > 0], minlength=len(sums))
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], ["cell", "n"])

        sums = np.zeros(BUCKETS * RATIOS)
        for row in places.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # BUCKETS * RATIOS rows at most
            sums[row["cell"]] = row["n"]
        weights.append(learned_weights(sums.reshape(BUCKETS, RATIOS)))
    return weights


def score_texts(
    spark: SparkSession,
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 3,
    deleted_part: int = 10,
    block_tokens: int = 3 << 18,
    part_bytes: int = 8_000_000,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_tokens, n_known, train_tokens, base_score, score.

    The rows for which ``train`` is true teach the model; of these one in ``deleted_part``, chosen by id, teaches
    the mixture weights, and counts again in the model that scores. Tokens are words (A-Z lower-cased, cut at
    blanks, tabs and line ends) and an end. base_score is the add-one unigram score, with one more word than was
    seen for all others; score the model's, both sums of log10 probabilities. n_known tokens occur in training.
    Words are compared as they are, longer grams by 64-bit hashes: two that share one would share a count, which
    moves a score a little and no other column.

    A null or empty text has only its end. Repeated rows teach and are scored each. Ids are longs and may be null.
    ``train`` null is false. Without training rows all words are new: both scores are 0. Other columns
    are ignored; no rows give no rows. A text of any length is scored as a whole, in one task.
    """
    work = Scratch(spark, "lm-score")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    kind = F.when(~F.coalesce(train, F.lit(False)), TEST).when(F.pmod(F.xxhash64(key), F.lit(deleted_part)) == 0, DELETED).otherwise(MAIN)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), kind.alias("kind"))
    blocks = work.table("blocks", block_documents(rows, block_tokens))
    size = blocks.agg(F.sum(F.octet_length("stream")).alias("n")).first()["n"] or 0
    parts = max(64, -(-size // part_bytes))  # what a part gathers grows with the packed streams of 8 MB
    answers = work.table("answers", answer_counts(ask_counts(blocks, order, parts)))
    sums = answers.where("sums is not null").agg(*(F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)).alias(c) for i, c in enumerate(("n_main", "v_main", "n", "v")))).first()
    answers = answers.where("block is not null")

    def deleted_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, grams, counts = gathered(batches, order, parts)
        at = np.flatnonzero(grams.scored)
        cols = []
        for level in range(order):
            if level:
                cols.append(counts[level - 1][0][grams.at[level - 1][grams.before[at]]])
            cols.append(counts[level][0][grams.at[level][at]])
        yield pa.RecordBatch.from_arrays([pa.array([tight(c.astype("<u4").tobytes())], pa.binary()) for c in cols], [f"c{i}" for i in range(len(cols))])

    gone = blocks.where("deleted")
    schema = ", ".join(f"c{i} binary" for i in range(2 * order - 1))
    own = answers.join(F.broadcast(gone.select("block")), "block", "left_semi") if gone.count() < 100_000 else answers.join(gone.select("block"), "block", "left_semi")
    places = work.table("places", met(gone, own).groupBy("block").applyInArrow(deleted_places, schema))
    weights = learn_weights(places, order, sums["n_main"], sums["v_main"])
    n, v = sums["n"], sums["v"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, grams, counts = gathered(batches, order, parts)
        every = [main + gone for main, gone in counts]
        at = np.flatnonzero(grams.scored)
        doc, docs_n = grams.doc_of[at], len(row["ids"])
        places = [every[0][grams.at[0][at]]]
        for level in range(1, order):
            places += [every[level - 1][grams.at[level - 1][grams.before[at]]], every[level][grams.at[level][at]]]
        tokens = np.bincount(doc, minlength=docs_n)
        known = np.bincount(doc, places[0] > 0, docs_n).astype(np.int64)
        base = np.bincount(doc, np.log10((places[0] + 1) / (n + v + 1)), docs_n)
        found = np.bincount(doc, np.log10(estimates(places, n, v, weights)), docs_n)
        cols = [pa.array(row["ids"], pa.int64()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array([n] * docs_n, pa.int64()), pa.array(base, pa.float64()), pa.array(found, pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCORES.split(", ")])

    scored = met(blocks, answers).groupBy("block").applyInArrow(score, SCORES)
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", "train_tokens", "base_score", "score")
