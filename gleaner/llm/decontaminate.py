"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a bounded run of documents inside a task. Its words become symbols (the benchmark's own
words; any other word, and the border of a document, is symbol 0, which no phrase holds). The
index is a suffix array's Burrows-Wheeler transform in a wavelet matrix; all test phrases are
searched backward at once, and the places of those that occur come from sampled suffix positions.
Spans that overlap are merged document by document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bytewords import ALNUM, Words, chunks
from gleaner.llm.scratch import Scratch, bounded_batches
from gleaner.llm.tokens import release

SHARD_SYMBOLS = 400_000


class BitRank:
    """A bit vector that counts its ones before any place."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.ones = int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, low = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = list(range(max(1, int(top).bit_length()) - 1, -1, -1))
        self.levels: list[tuple[BitRank, int]] = []
        for b in self.bits:
            one = (symbols >> b) & 1 == 1
            level = BitRank(one)
            self.levels.append((level, level.n - level.ones))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place beside it."""
        low = np.zeros_like(i)
        for b, (level, zeros) in zip(self.bits, self.levels, strict=True):
            one = (symbol >> b) & 1 == 1
            ri, rl = level.rank(i), level.rank(low)
            i, low = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rl, low - rl)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its occurrences before that place."""
        symbol, low = np.zeros_like(i), np.zeros_like(i)
        for b, (level, zeros) in zip(self.bits, self.levels, strict=True):
            one, ri, rl = level.get(i), level.rank(i), level.rank(low)
            symbol |= one.astype(np.int64) << b
            i, low = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rl, low - rl)
        return symbol, i - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order, by prefix doubling; only suffixes not told apart are sorted again."""
    n = len(text)
    top = np.int64(text.max()) + 2
    # several symbols at once in the first key
    width = max(1, min(4, int(62 // max(1, int(top).bit_length()))))
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = key * top + padded[j : j + n]
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n + 1, np.int64)
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # rank: where the group begins
    rank[order], rank[n] = group, -1
    step = width
    while True:
        begins = np.flatnonzero(fresh)
        lengths = np.diff(begins, append=n)
        open_at = np.flatnonzero(np.repeat(lengths > 1, lengths))
        if not len(open_at):
            return order
        rows = order[open_at]
        nxt = rank[np.minimum(rows + step, n)]
        again = np.lexsort((nxt, group[open_at])) if n >= 1 << 31 else np.argsort(group[open_at] * np.int64(n + 1) + nxt + 1, kind="stable")
        rows, nxt, own = rows[again], nxt[again], group[open_at][again]
        order[open_at] = rows
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        fresh[open_at] = new
        group[open_at] = np.maximum.accumulate(np.where(new, open_at, 0))
        rank[rows] = group[open_at]
        step *= 2


class FMIndex:
    """Counts and places of phrases in a text of symbols 0..top."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 8):
        text, top = np.concatenate([text + 1, [0]]), top + 1  # the end needs a symbol of its own
        order = suffix_array(text)
        last = text[order - 1]
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.rows = WaveletMatrix(last.astype(np.int64), top)
        # a whole turn begins at place 0, which is always sampled
        kept = order % sample == 0
        self.kept, self.places = BitRank(kept), order[kept]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows, padded on the right) at once."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            now = alive[lengths[alive] > j]
            symbol = phrases[now, j] + 1
            lo[now] = self.first[symbol] + self.rows.rank(symbol, lo[now])
            hi[now] = self.first[symbol] + self.rows.rank(symbol, hi[now])
            alive = alive[lo[alive] < hi[alive]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: step back to the nearest sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.kept.get(at)
            out[left[done]] = self.places[self.kept.rank(at[done])] + steps[left[done]]
            left, at = left[~done], at[~done]
            symbol, before = self.rows.access(at)
            at = self.first[symbol] + before
            steps[left] += 1
        return out


class Phrases:
    """The distinct windows of a block of items, as symbols."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        numbers: dict[bytes, int] = {}  # distinct words, from 1
        texts: list[np.ndarray] = []
        for _, docs in chunks([t for _, t in items]):
            words = Words(docs, ALNUM)
            low = words.low.tobytes()
            found = [numbers.setdefault(low[a:b], len(numbers) + 1) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
            texts += np.split(np.array(found, np.int64), words.begin[1:-1])
        self.vocabulary(list(numbers))
        self.items = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.items)}
        joined = np.concatenate([*texts, np.zeros(0, np.int64)])
        counts = np.array([len(t) for t in texts], np.int64)
        # windows of each item, one at least if it has words; symbols from 1, 0 after the end of a shorter one
        windows = np.where(counts > 0, np.maximum(1, counts - width + 1), 0)
        owner = np.repeat(np.arange(len(counts)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start, length = (np.cumsum(counts) - counts)[owner] + nth, np.minimum(width, counts[owner])
        symbols = np.concatenate([joined, np.zeros(width, np.int64)]).astype(np.int32)
        table = np.zeros((len(owner), width), np.int32)
        for j in range(width):
            table[:, j] = np.where(j < length, symbols[start + j], 0)
        # equal windows get one number, symbol by symbol
        code = np.zeros(len(table), np.int64)
        for j in range(width):
            code = np.unique(code * np.int64(len(numbers) + 1) + table[:, j], return_inverse=True)[1]
        _, first = np.unique(code, return_index=True)
        self.table, self.lengths = table[first], length[first]
        names = np.array([number[i] for i, _ in items], np.int64)[owner] if len(owner) else owner
        pairs = np.unique(np.stack([code, names], 1), axis=0) if len(code) else np.zeros((0, 2), np.int64)
        self.owner_names, self.owner_begin = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.shortest = int(self.lengths.min()) if len(first) else width

    def owners(self, window: int) -> list[int]:
        """Numbers, in ``items``, of the items that have the window."""
        return self.owner_names[self.owner_begin[window] : self.owner_begin[window + 1]].tolist()

    def vocabulary(self, words: list[bytes]) -> None:
        """Keep distinct words, of which the kth has symbol k + 1, in the order of their hashes; the seed is the
        first with which no two of them have one hash."""
        self.size, self.seed, docs = len(words), 0, [b" ".join(words)]
        while True:
            own = Words(docs, ALNUM, self.seed)
            order = np.argsort(own.hashes)
            self.hashes = own.hashes[order]
            if (self.hashes[1:] != self.hashes[:-1]).all():
                break
            self.seed += 1
        self.symbol, self.low, self.starts, self.lengths_of = order + 1, own.low, own.starts[order], own.lengths[order]

    def symbols(self, words: Words) -> np.ndarray:
        """The symbol of each word, 0 for those that the items lack. Equal hashes are compared byte by byte."""
        if not self.size:
            return np.zeros(len(words.hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), self.size - 1)
        like = np.flatnonzero((self.hashes[at] == words.hashes) & (self.lengths_of[at] == words.lengths))
        sizes = words.lengths[like]
        begin = np.cumsum(sizes) - sizes
        step = np.arange(sizes.sum()) - np.repeat(begin, sizes)
        same = words.low[np.repeat(words.starts[like], sizes) + step] == self.low[np.repeat(self.starts[at[like]], sizes) + step]
        like = like[np.logical_and.reduceat(same, begin)] if len(like) else like
        out = np.zeros(len(words.hashes), np.int64)
        out[like] = self.symbol[at[like]]
        return out


def long_runs(inside: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a run of at least ``least`` true values."""
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = ends - starts >= least
    mark = np.zeros(len(inside) + 1, np.int64)
    mark[starts[keep]] += 1
    mark[ends[keep]] -= 1
    return np.cumsum(mark[:-1]) > 0


def search_shard(symbols: np.ndarray, doc_of: np.ndarray, phrases: Phrases, top: int) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which places of a shard are hit, and the items found in each document."""
    hit, items = np.zeros(len(symbols), bool), {}
    # words that no phrase can cover leave the index; one border symbol stands for each gap
    keep = long_runs(symbols > 0, phrases.shortest)
    border = np.concatenate([[False], keep[:-1] & ~keep[1:]]) if len(keep) else keep
    where = np.flatnonzero(keep | border)
    if not len(where) or not keep.any():
        return hit, items
    index = FMIndex(np.where(keep[where], symbols[where], 0), top)
    lo, hi = index.ranges(phrases.table, phrases.lengths)
    found = np.flatnonzero(lo < hi)
    counts = hi[found] - lo[found]
    rows = np.repeat(lo[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.repeat(found, counts)
    begin = where[index.locate(rows)]
    mark = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(mark, begin, 1)
    np.add.at(mark, begin + phrases.lengths[window], -1)
    hit = np.cumsum(mark[:-1]) > 0
    for doc, w in np.unique(np.stack([doc_of[begin], window], 1), axis=0).tolist():
        items.setdefault(doc, set()).update(phrases.owners(w))
    return hit, items


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


#: The phrases that this process has built last.
_built: list[tuple[str, Phrases]] = []


def _phrases(key: str, items: list[tuple[str, str]], width: int) -> Phrases:
    if not _built or _built[0][0] != key:
        _built[:] = [(key, Phrases(items, width))]
    return _built[0][1]


def _search(docs: DataFrame, items: list[tuple[str, str]], id_col: str, text_col: str, width: int, carry: tuple[str, ...], cleaned: bool = False) -> DataFrame:
    """One row per document for one block of items: n_words, spans and items, ``carry`` columns and the cleaned text."""
    taken = list(dict.fromkeys([id_col, text_col, *carry]))
    given = list(dict.fromkeys([id_col, *carry]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in given)
    block = hashlib.sha256(repr((items, width)).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        phrases = _phrases(block, items, width)
        top = phrases.size
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            held: list[np.ndarray] = []
            size = 0

            def flush() -> None:
                nonlocal held, size
                ends = np.cumsum([len(h) + 1 for h in held])
                stream = np.concatenate([x for h in held for x in (h, np.zeros(1, np.int64))]) if held else np.zeros(0, np.int64)
                doc_of = np.repeat(np.arange(len(held)), [len(h) + 1 for h in held])
                hit, found = search_shard(stream, doc_of, phrases, top)
                for k, symbols in enumerate(held):
                    out[0].append(len(symbols))
                    out[1].append(_runs(hit[ends[k] - 1 - len(symbols) : ends[k] - 1]) if k in found else [])
                    out[2].append([phrases.items[x] for x in sorted(found.get(k, ()))])
                held, size = [], 0

            for _, raw in chunks(batch.column(text_col).to_pylist()):
                words = Words(raw, ALNUM, phrases.seed)
                symbols = phrases.symbols(words)
                for a, b in zip(words.begin[:-1].tolist(), words.begin[1:].tolist(), strict=True):
                    if held and size + b - a > SHARD_SYMBOLS:
                        flush()
                    held.append(symbols[a:b])
                    size += b - a + 1
            flush()
            more = []
            if cleaned:
                marked = [i for i, spans in enumerate(out[1]) if spans]
                texts = batch.column(text_col)
                if marked:
                    new = [cut_words(texts[i].as_py(), out[1][i]) for i in marked]
                    mask = np.zeros(len(texts), bool)
                    mask[marked] = True
                    texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
                more = [texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), *more, pa.array(out[0], pa.int64()), pa.array(out[1], span), pa.array(out[2], pa.list_(pa.string()))], [*given, *["cleaned"] * cleaned, "n_words", "spans", "items"])

    return docs.select(*taken).mapInArrow(run, kinds + ", cleaned string" * cleaned + ", n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    block_chars: int = 8_000_000,
    carry: tuple[str, ...] = (),
    cleaned: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the columns of ``carry``, with ``cleaned`` the text without
    hit words and what stands between them, n_words, spans (of hit words, end exclusive, merged and in order), items (ids as strings, distinct and sorted; each whose window occurs).

    Words are runs of ASCII letters (A-Z lower-cased), digits and all non-ASCII characters. A window
    is ``width`` consecutive words of an item; an item with fewer is one window; one without words,
    or null, has none. An item id that recurs has the windows of all its texts. The documents are
    searched where they lie, without a shuffle. Words are found by hashes and compared byte by byte.

    Benchmark items reach the driver and the tasks in blocks of about ``block_chars`` characters, one
    block after another, each over all documents; the findings of all blocks are merged, so the
    rows are those of one block. A null text has no words. Repeated rows give repeated rows. Other
    columns are ignored; ``carry`` must not name n_words, spans, items or cleaned. No items, no spans.
    """
    bounded_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col("item").isNotNull() & (F.length("text") > 0))
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-chars // block_chars) or 1

    def block(b: int) -> list[tuple[str, str]]:
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        return sorted((r["item"], r["text"]) for r in part.distinct().collect())

    if blocks == 1:
        return _search(docs, block(0), id_col, text_col, width, carry, cleaned)
    work = Scratch(spark, "decontaminate")
    key = F.struct(F.col(id_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("sha"))
    keyed = docs.select(*dict.fromkeys([id_col, text_col, *carry]), key.alias("_key"))
    own = work.table("0", _search(keyed, block(0), id_col, text_col, width, (*carry, "_key", *[text_col] * (cleaned and text_col not in carry))))
    others = None
    for b in range(1, blocks):
        hits = work.table(str(b), _search(keyed.select("_key", text_col), block(b), "_key", text_col, width, ()).where(F.size("spans") > 0).drop("n_words"))
        others = hits if others is None else others.unionByName(hits)
    # rows equal in id and text have equal findings
    others = others.groupBy("_key").agg(F.flatten(F.collect_set("spans")).alias("_spans"), F.flatten(F.collect_set("items")).alias("_items"))

    def join_spans(acc: Column, s: Column) -> Column:
        touches = (F.size(acc) > 0) & (s["start"] <= F.get(acc, F.size(acc) - 1)["end"])
        longer = F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"))
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    met = own.join(others.withColumnRenamed("_key", "_other"), F.col("_key").eqNullSafe(F.col("_other")), "left")
    both = F.array_sort(F.concat("spans", F.coalesce("_spans", F.array().cast("array<struct<start:long,end:long>>"))))
    spans = F.aggregate(both, F.array().cast("array<struct<start:long,end:long>>"), join_spans)
    names = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))))
    met = met.withColumn("spans", spans).withColumn("items", names)
    return met.select(*dict.fromkeys([id_col, *carry]), *[without_words(F.col(text_col), F.col("spans")).alias("cleaned")] * cleaned, "n_words", "spans", "items")


#: The words that spans count: ASCII letters, digits and all non-ASCII characters.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut_words(text: str, marks: list[dict[str, int]]) -> str:
    """The text without the words of these spans and what stands between them."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in marks:
        out.append(text[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    return "".join([*out, text[at:]])


def without_words(text: Column, spans: Column) -> Column:
    """``cut_words`` of a column. Texts without spans are not sent to Python."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_words(t, m) for t, m in zip(texts, found, strict=True)], dtype=object)

    hit = F.size(spans) > 0
    return F.when(hit, cut(F.when(hit, text), spans)).otherwise(text)
