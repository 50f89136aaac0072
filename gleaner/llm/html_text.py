"""Main text of web pages with a suffix array per host.

A page is cut into blocks. The blocks of a host's distinct pages that the markup does not mark as
menu, header, footer, sidebar, notice, advert, form or comments are concatenated, those of article
containers too; a suffix array over them finds runs that a share of the pages has. These are
boilerplate and leave the text; all other unmarked blocks stay, in page order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.decontaminate import suffix_array
from gleaner.llm.scratch import Scratch

# Element and attribute names of HTML by what they mean here.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "title", "audio", "video", "select", "button"}
SIDE = {"nav", "aside", "footer", "form", "menu", "dialog", "fieldset", "datalist"}
CONTAINER = {"article", "main"}
BREAKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
SPACES = {"br", "td", "th", "option"}
NESTED = BREAKS - {"p", "hr", "html", "body", "head", "tbody", "tfoot", "thead"}
ITEMS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}}  # an item ends where the next one of its list begins
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
# Words of class and id names: what stands beside an article, and what says nothing by itself. A name counts
# as a mark if all its words are of these and one at least is of the first, as in ad-slot, but not in social-history.
SIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar related teaser cookie cookies consent notice banner popup modal newsletter subscribe signup share sharing social comment comments commentlist disqus reply replies respond footer masthead pagination pager widget widgets".split()
)
PLAIN_NAMES = set(
    "area bar block body bottom box btn button buttons card container content desktop entry fixed form group head header icon icons inner item items label large left line link links list main media message mobile module outer overlay page panel post posts primary right row secondary section side site slot small sticky text title top unit user wrap wrapper".split()
)
MAIN_NAMES = {"article", "post", "story", "entry"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """(marked as something beside the article, marked as the article)."""
    if not attributes:
        return tag in SIDE, tag in CONTAINER
    given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    found = {k: v.lower() for k, v in given.items()}
    names = [{w.lower() for w in _NAME.findall(n)} for n in f"{given.get('class', '')} {given.get('id', '')}".split()]
    marked = any(n & SIDE_NAMES and n <= SIDE_NAMES | PLAIN_NAMES for n in names) and tag not in ("main", "body")
    hidden = re.search(r"\shidden(?:[\s=/]|$)", attributes.lower()) or "display:none" in found.get("style", "").replace(" ", "") or found.get("aria-hidden") == "true"
    side = tag in SIDE or found.get("role") in SIDE_ROLES or found.get("itemprop") == "comment" or bool(hidden) or marked
    article = any(n & MAIN_NAMES and not n & SIDE_NAMES for n in names)
    return side, tag in CONTAINER or found.get("role") in ("main", "article") or (tag in ("div", "section") and article and not side)


def blocks_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, inside the article container, marked as something beside it), in page order.

    White space is one space, character references are decoded, blocks without text are left out.
    Elements left open end with the page; a closing tag without its opening one changes nothing.
    """
    page = page or ""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, side, container
    side = inside = 0
    p_side = False
    at = 0

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, inside > 0, side > 0 or p_side))

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if not attributes.endswith("/") else None
            if end is not None:
                at = end.end()
            elif tag in ("script", "style", "template", "textarea", "title"):
                at = len(page)
            parts.append(" ")
            continue
        if tag in SPACES:
            parts.append(" ")
            continue
        if tag not in BREAKS:
            continue
        close()
        p_side = False
        if tag not in NESTED:
            if not closing and attributes and tag not in ("html", "body", "head"):
                p_side = _marks(tag, attributes)[0]
            continue
        if tag in ITEMS:
            # an item ends at its closing tag or where the next one of its list begins
            same = {"dd", "dt"} if tag != "li" and tag != "tr" and not closing else {tag}
            deep = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in same | ITEMS[tag]), -1)
            if deep >= 0 and stack[deep][0] in same:
                for _, s, c in stack[deep:]:
                    side, inside = side - s, inside - c
                del stack[deep:]
        if closing:
            if tag not in ITEMS and any(t == tag for t, _, _ in stack):
                while stack:
                    t, s, c = stack.pop()
                    side, inside = side - s, inside - c
                    if t == tag:
                        break
        else:
            s, c = _marks(tag, attributes)
            if tag == "header":
                s = inside == 0
            stack.append((tag, s, c))
            side, inside = side + s, inside + c
    close()
    return out


def run_groups(codes: np.ndarray, lengths: np.ndarray, least: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of streams of these lengths, for each of its places the group of suffixes that agree in
    ``least`` tokens, and for each group how many owners have it (0 for runs that cross a border)."""
    _, codes = np.unique(codes, return_inverse=True)
    n_codes = int(codes.max(initial=0)) + 1
    # a border of its own after every stream, so that no run crosses streams
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    border = np.zeros(len(text), bool)
    border[ends] = True
    text[~border] = codes
    text[ends] = n_codes + np.arange(len(lengths))
    order = suffix_array(text)
    padded = np.concatenate([text, np.full(least, -1)])
    same = np.ones(len(order) - 1, bool)
    for j in range(least):
        same &= padded[order[:-1] + j] == padded[order[1:] + j]
    group = np.cumsum(np.concatenate([[True], ~same])) - 1
    left = np.repeat(ends, lengths + 1) - np.arange(len(text))  # tokens up to the border
    whole = left[order] >= least
    pairs = np.unique(group[whole] * np.int64(owner.max() + 1) + np.repeat(owner, lengths + 1)[order[whole]])
    return order, group, np.bincount(pairs // np.int64(owner.max() + 1), minlength=group[-1] + 1)


def block_codes(blocks: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all blocks as numbers that are the same in every process, and each block's length.
    A block of fewer than ``least`` tokens is filled up, so that it is one run as a whole."""
    streams = [b.split(" ") for b in blocks]
    tokens = [t for s in streams for t in (*s, *[""] * (least - len(s)))]
    codes = pd.util.hash_array(np.array(tokens, object)) if tokens else np.zeros(0, np.uint64)
    return codes, np.array([max(least, len(s)) for s in streams], np.int64)


def page_codes(pages: list[list[str]], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``block_codes`` of each of these pages, made at once."""
    codes, lengths = block_codes([b for blocks in pages for b in blocks], least)
    begin = np.concatenate([[0], np.cumsum([len(blocks) for blocks in pages])]).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])[begin]
    return [(codes[at[i] : at[i + 1]], lengths[begin[i] : begin[i + 1]]) for i in range(len(pages))]


def window_hashes(codes: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for the run of ``least`` tokens from each place on, and whether it lies within a block."""
    out = np.zeros(max(0, len(codes) - least + 1), np.uint64)
    for j in range(least):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(out)]
    return out.view(np.int64), np.arange(len(out)) + least <= np.repeat(np.cumsum(lengths), lengths)[: len(out)]


def common_runs(pages: list[tuple[np.ndarray, np.ndarray]], least: int, share: float, piece_tokens: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Runs within a block that ``share`` of these pages (codes, lengths) have: their hashes, and how
    many pages have each. The suffix arrays are built over pieces of about ``piece_tokens``; what a
    share of the pages has, a share of some piece's pages has, so pieces propose and all pages count."""
    proposed, counts, begin = [], [], 0
    sizes = np.cumsum([len(c) for c, _ in pages])
    while begin < len(pages):
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + piece_tokens, "right")))
        piece = pages[begin:end]
        codes, lengths = (np.concatenate([p[k] for p in piece]) for k in (0, 1))
        if len(codes):
            order, group, count = run_groups(codes, lengths, least, np.repeat(np.arange(len(piece)), [len(n) for _, n in piece]))
            chosen = np.flatnonzero((count >= share * len(piece)) & (count > 0))
            starts = order[np.flatnonzero(np.diff(group, prepend=-1))[chosen]]
            # the suffix array's text has a border after each block
            block = np.searchsorted(np.cumsum(lengths + 1), starts, "right")
            proposed.append(window_hashes(codes, lengths, least)[0][starts - block])
            counts.append(count[chosen])
        begin = end
    if len(proposed) < 2:
        return (proposed or [np.zeros(0, np.int64)])[0], (counts or [np.zeros(0, np.int64)])[0]
    runs = np.unique(np.concatenate(proposed))
    total = np.zeros(len(runs), np.int64)
    for codes, lengths in pages:
        hashes, within = window_hashes(codes, lengths, least)
        total += np.isin(runs, hashes[within])
    enough = total >= share * len(pages)
    return runs[enough], total[enough]


def kept_text(texts: list[str], inside: list[bool], common: np.ndarray, firm: np.ndarray, least: int) -> str:
    """The unmarked blocks (``inside`` tells which stand in an article container) without the ``common`` runs, or inside an article container the ``firm`` ones. A block of
    which these are less than half stays whole, and is the page's own. A page that has no block of its own is one
    of many near copies rather than an article among menus, and stays whole."""
    if not texts or not len(common):
        return "\n\n".join(texts)
    codes, lengths = block_codes(texts, least)
    hashes, within = window_hashes(codes, lengths, least)
    held = np.repeat(inside, lengths)[: len(hashes)]
    covered = np.convolve(within & np.where(held, np.isin(hashes, firm), np.isin(hashes, common)), np.ones(least, int)) > 0
    kept, own_blocks, begin = [], 0, 0
    for text, end in zip(texts, np.cumsum(lengths).tolist(), strict=True):
        tokens = text.split(" ")
        own = covered[begin : begin + len(tokens)]
        hit, begin = int(own.sum()), end
        if 2 * hit < len(tokens):
            own_blocks += 1
            kept.append(text)
        else:
            kept.append(" ".join(t for t, c in zip(tokens, own.tolist(), strict=True) if not c))
    return "\n\n".join(t for t in (kept if own_blocks else texts) if t)


class HostRuns:
    """Lists of runs by host, for tasks that go through pages. Up to ``most`` runs in all they are broadcast, once
    per worker; beyond that they are joined to the pages, by the host."""

    def __init__(self, table: DataFrame, names: tuple[str, ...], most: int):
        self.names, self.table, self.held = names, table, None
        n_runs = table.agg(F.sum(sum(F.size(n) for n in names))).first()[0] or 0
        if n_runs <= most:
            found = table.toArrow()
            lists = [[np.array(x.as_py(), np.int64) for x in found.column(n)] for n in names]
            self.held = table.sparkSession.sparkContext.broadcast(dict(zip(found.column("host").to_pylist(), zip(*lists, strict=True), strict=True)))

    def __getstate__(self) -> dict:
        return {"names": self.names, "held": self.held}

    def beside(self, pages: DataFrame) -> DataFrame:
        return pages.join(self.table.select("host", *self.names), "host", "left") if self.held is None else pages

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """The lists of each row's host, empty where it has none."""
        if self.held is None:
            for row in zip(*(batch.column(n) for n in self.names), strict=True):
                yield tuple(np.array(x.as_py() or [], np.int64) for x in row)
            return
        none = (np.zeros(0, np.int64),) * len(self.names)
        for host in batch.column("host").to_pylist():
            yield self.held.value.get(host, none)


def host_of(url: str) -> F.Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extract_text(
    spark: SparkSession,
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_tokens: int = 8,
    shard_chars: int = 2_000_000,
    broadcast_rows: int = 100_000,
    least_pages: int = 3,
    share: float = 0.25,
    firm_share: float = 0.5,
) -> DataFrame:
    """One row per row of ``pages``: ``id_col``, ``url_col``, text (blocks joined by two line ends; empty if none).

    A run of ``least_tokens`` tokens within a block, or a whole shorter block, is boilerplate if at
    least ``least_pages`` of the host's distinct pages and a ``share`` of them have it, or ``firm_share``
    where it stands inside an article container. ``kept_text`` says what of it leaves a page. Blocks that the markup
    marks as something beside the article go; all others stay, also outside the container.

    A host whose pages hold more than ``shard_chars`` characters of html is dealt over shards of
    about that size by the hash of the page, each with a suffix array of its own. What a share of
    all pages has, a share of some shard's pages has: the shards propose runs, which are then
    counted on all pages of the host, so the shards do not change the result. Pages without a host
    share the empty one. A null html is empty. Repeated rows give repeated rows, and count as one
    page, as do pages of a host with equal html. Other columns are ignored; no rows give no rows.
    The runs of all hosts are broadcast up to ten times ``broadcast_rows``, and joined beyond that.
    """
    work = Scratch(spark, "html-text")
    kind = pages.schema[id_col].dataType.simpleString()
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    read = read.withColumn("page", F.unhex(F.md5(F.col("html").cast("binary"))))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            fresh = []
            for key in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                fresh.append(key[1] is not None and key not in seen)  # copies within the task
                seen.add(key)
            found = [[(t, c) for t, c, side in blocks_of(p.as_py()) if not side] for p in batch.column(2)]
            texts, inside = pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())), pa.array([[c for _, c in f] for f in found], pa.list_(pa.bool_()))
            chars = pc.utf8_length(batch.column(2)).cast(pa.int64())
            arrays = [*(batch.column(i) for i in (0, 1, 3, 4)), chars, pa.array(fresh, pa.bool_()), texts, inside]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "url", "host", "page", "chars", "fresh", "blocks", "inside"])

    # the html is read and parsed once; all that follows reads the unmarked blocks
    schema = f"id {kind}, url string, host string, page binary, chars long, fresh boolean, blocks array<string>, inside array<boolean>"
    parsed = work.table("blocks", read.mapInArrow(parse, schema), compression="zstd")
    sizes = work.table("sizes", parsed.groupBy("host").agg(F.sum("chars").alias("chars")))
    large = sizes.where(F.col("chars") > shard_chars).select("host", F.ceil(F.col("chars") / shard_chars).alias("shards"))
    n_large, total_chars = large.count(), sizes.agg(F.sum("chars")).first()[0] or 0

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= broadcast_rows else df

    distinct = parsed.where("fresh").select("host", "page", "blocks").join(small(large, n_large), "host", "left")
    shard = F.pmod(F.xxhash64("page"), F.coalesce("shards", F.lit(1)))

    fields = pa.schema([("page", pa.binary()), ("blocks", pa.list_(pa.string()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages of one shard travel together, compressed: one row for each shard in some MB of pages."""
        codec = pa.Codec("zstd", 3)

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            keys = list(zip(table.column("host").to_pylist(), table.column("shard").to_pylist(), strict=True))
            by: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                by.setdefault(key, []).append(i)
            data, sizes = [], []
            for places in by.values():
                part = table.take(pa.array(places, pa.int64())).combine_chunks().to_batches()[0]
                raw = pa.RecordBatch.from_arrays([part.column("page"), part.column("blocks").cast(fields.field("blocks").type)], schema=fields).serialize()
                data.append(codec.compress(raw, asbytes=True))
                sizes.append(len(raw))
            arrays = [pa.array([h for h, _ in by], pa.string()), pa.array([n for _, n in by], pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["host", "shard", "size", "data"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > 16 << 20:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def propose(table: pa.Table) -> pa.Table:
        codec, pages = pa.Codec("zstd"), {}
        for size, data in zip(table.column("size").to_pylist(), table.column("data").to_pylist(), strict=True):
            part = pa.ipc.read_record_batch(codec.decompress(data, size), fields)
            pages.update(zip(part.column("page").to_pylist(), part.column("blocks").to_pylist(), strict=True))
        runs, count = common_runs(page_codes(list(pages.values()), least_tokens), least_tokens, share)
        return pa.table([pa.array([table.column("host")[0].as_py()] * (len(runs) + 1), pa.string()), pa.array([None, *runs.tolist()], pa.int64()), pa.array([len(pages), *count.tolist()], pa.int64())], ["host", "run", "pages"])

    # twice as many tasks as shards, so that few of these meet in one
    dealt = distinct.select("host", shard.cast("long").alias("shard"), "page", "blocks").mapInArrow(pack, "host string, shard long, size long, data binary")
    dealt = dealt.repartition(2 * -(-total_chars // shard_chars) or 1, "host", "shard")
    proposed = work.table("proposed", dealt.groupBy("host", "shard").applyInArrow(propose, "host string, run long, pages long"))
    total = proposed.where("run is null").groupBy("host").agg(F.sum("pages").alias("total"))
    counted = proposed.where("run is not null")
    if n_large:
        # a host of several shards: count what any of them proposed on all its pages
        several = counted.join(small(large, n_large), "host", "left_semi").groupBy("host").agg(F.collect_set("run").alias("runs"))
        several = HostRuns(work.table("several", several), ("runs",), 10 * broadcast_rows)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = []
                coded = page_codes(batch.column("blocks").to_pylist(), least_tokens)
                for (codes, lengths), (runs,) in zip(coded, several.of(batch), strict=True):
                    hashes, within = window_hashes(codes, lengths, least_tokens)
                    hits.append(np.unique(hashes[within & np.isin(hashes, runs)]).tolist())
                yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(hits, pa.list_(pa.int64()))], ["host", "page", "hits"])

        again = several.beside(distinct.where("shards is not null").select("host", "page", "blocks"))
        hits = again.mapInArrow(count, "host string, page binary, hits array<long>")
        exact = hits.dropDuplicates(["host", "page"]).select("host", F.explode("hits").alias("run")).groupBy("host", "run").agg(F.count("*").alias("pages"))
        counted = counted.join(small(large, n_large), "host", "left_anti").unionByName(exact)
    common = counted.join(total, "host").where((F.col("pages") >= least_pages) & (F.col("pages") >= share * F.col("total")))
    firm = F.collect_list(F.when(F.col("pages") >= firm_share * F.col("total"), F.col("run")))
    common = common.groupBy("host").agg(F.collect_list("run").alias("runs"), firm.alias("firm"))
    common = HostRuns(work.table("common", common), ("runs", "firm"), 10 * broadcast_rows)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, inside, (runs, firm) in zip(batch.column("blocks"), batch.column("inside"), common.of(batch), strict=True):
                texts.append(kept_text(blocks.as_py(), inside.as_py(), runs, firm, least_tokens))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    rows = common.beside(parsed.select("id", "url", "host", "blocks", "inside"))
    return rows.mapInArrow(clean, f"`{id_col}` {kind}, `{url_col}` string, text string")
