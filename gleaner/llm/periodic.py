"""Periodic runs of words by harmonic grid probing.

A run of period p that is at least four periods long holds four neighbouring points of the grid 0, p, 2p, ...,
whatever its start. So for each p only words on its grid are compared, n / p of them: n log n in all. Where three
neighbouring pairs (jp, (j+1)p) are equal, the stretch around them in which words p apart agree is followed to both
sides by comparing chunks of the array that double in size. Grid points inside a run found before, of the same
period or of a divisor of it, are skipped: a stretch of period p that holds such a run's whole period is that run.
Periods rise, so the smallest period of a stretch is the one that finds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.scratch import bounded_batches
from gleaner.llm.tokens import release

PERIODS, LEAST = 4, 6  # a run is at least so many periods, and so many words, long
FIRST_CHUNK, LAST_CHUNK = 32, 1 << 16
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def agree_up(words: np.ndarray, at: int, p: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``p`` after it."""
    end, size = len(words) - p, FIRST_CHUNK
    while at < end:
        stop = min(end, at + size)
        differ = words[at:stop] != words[at + p : stop + p]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, size = stop, min(2 * size, LAST_CHUNK)
    return end


def agree_down(words: np.ndarray, at: int, p: int) -> int:
    """The smallest place from which on, up to ``at``, words equal the ones ``p`` after them."""
    size = FIRST_CHUNK
    while at > 0:
        stop = max(0, at - size)
        differ = (words[stop:at] != words[stop + p : at + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at, size = stop, min(2 * size, LAST_CHUNK)
    return 0


class Found:
    """The runs found so far, by period."""

    def __init__(self) -> None:
        self.periods = np.zeros(0, np.int64)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, p: int, runs: list[tuple[int, int]]) -> None:
        if runs:
            self.periods = np.append(self.periods, p)
            self.runs[p] = tuple(np.array(x, np.int64) for x in zip(*runs, strict=True))

    def covers(self, low: np.ndarray, high: np.ndarray, p: int) -> np.ndarray:
        """Which pairs of places lie in one run whose period divides ``p``. Runs of one period overlap by less
        than it, so their starts and ends rise together and at most two of them hold a place."""
        inside = np.zeros(len(low), bool)
        for d in self.periods[p % self.periods == 0].tolist():
            starts, ends = self.runs[d]
            k = np.searchsorted(starts, low, "right") - 1
            for back in (0, 1):
                own = k - back
                inside |= (own >= 0) & (high < ends[np.maximum(own, 0)])
        return inside


def survivors(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(p, all j, rising, for which the words at jp, (j+1)p, (j+2)p and (j+3)p are equal), p rising.

    Small periods take their own grid; the others are probed together, j by j, as few grid points each remain.
    """
    n = len(words)
    top = n // PERIODS
    split = min(top, max(1, int(n**0.5)))
    for p in range(1, split + 1):
        grid = words[::p]
        same = grid[1:] == grid[:-1]
        j = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if len(j):
            yield p, j
    pairs = []
    for j in range(n // (split + 1) - 2):
        p = np.arange(split + 1, min(top, (n - 1) // (j + 3)) + 1)
        for k in range(3):
            p = p[words[(j + k) * p] == words[(j + k + 1) * p]]
        if len(p):
            pairs.append(np.stack([p, np.full(len(p), j)]))
    if pairs:
        ps, js = np.concatenate(pairs, 1)
        order = np.lexsort((js, ps))
        ps, js = ps[order], js[order]
        begin = np.flatnonzero(np.diff(ps, prepend=0))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(ps)], strict=True):
            yield int(ps[a]), js[a:b]


def periodic_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period.

    A run is a stretch with smallest period q, at least max(6, 4q) long, that no neighbouring word extends.
    """
    found, out = Found(), []
    if len(words) < LEAST:
        return out
    for p, j in survivors(words):
        j = j[~found.covers(j * p, (j + 1) * p, p)] if len(found.periods) else j
        runs, upto = [], 0
        for at in (j * p).tolist():
            if at + p >= upto:  # else inside the stretch before
                start, stop = agree_down(words, at, p), agree_up(words, at, p) + p
                upto = stop
                if stop - start >= max(LEAST, PERIODS * p):
                    runs.append((start, stop))
        found.add(p, runs)
        out += [(start, stop - start, p) for start, stop in runs]
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without what any run holds after its first period, words joined by blanks."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def find_runs(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, runs (array of start, length, period; by start, then
    period) and collapsed (the kept words, joined by blanks).

    Words are cut at blanks, tabs and line ends and compared as they are. A null or empty text has no words, no
    runs and an empty collapsed text. Repeated rows give repeated rows; null ids stay. Other columns are ignored;
    no rows give no rows. A text is searched as a whole, in n log n comparisons, where it lies: no shuffle.
    """
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sizes, runs, texts = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                got = periodic_runs(numbered(words))
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in got])
                texts.append(collapsed(words, got))
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_words", "runs", "_kept"])

    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    found = rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, _kept binary")
    return found.select(id_col, "n_words", "runs", F.col("_kept").cast("string").alias("collapsed"))
