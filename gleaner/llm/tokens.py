"""Token ids of whole texts by the tokenizers library, encoding each distinct word once.

A byte-pair tokenizer treats its pre-tokens apart, so a text may be cut wherever the
pre-tokenizer always cuts; the ids of the pieces, joined, are the ids of the text. Pieces recur,
so the texts of a chunk are cut and their pieces made distinct by Arrow, and each worker keeps the
ids of short pieces in a table of bounded bytes. Special tokens' strings are found by the library
inside the pieces, as in whole texts.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Trailing signs that may be cut off after a letter or digit; the apostrophe is not among them.
_TRAIL = ",.;:!?*#$%&)"
#: A word of letters that are one sign each in every normal form and in lower case.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ž]+")
#: Runs of white space without the sign before the next word, words with a leading space, and that sign.
_WORD = re.compile(r"\s+(?=\s\S)|\s+\Z| ?\S+|\s")
#: White space for Python but not for the tokenizers.
_OTHER_SPACE = "[\x1c-\x1f]"
#: How byte-level tokenizers write a space, and how words end in vocabularies that say so.
_SPACE_SIGN, _WORD_END = "Ġ", "</w>"
#: Bytes that an entry of the table takes besides its key and ids, about.
_ENTRY = 170
#: Longer pieces are encoded each time.
_LONGEST_KEY = 64
CHUNK_BYTES = 2_500_000
_loaded: dict[tuple[str, int], "WordEncoder"] = {}


class WordEncoder:
    """``flat(texts)``: the ids of all texts one after another, and how many each has."""

    def __init__(self, path: str, cache_bytes: int = 64_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.half = cache_bytes // 2
        # the table has two halves: when the newer is full, it becomes the older one, and what recurs moves on
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.cut = self._rule(path)
        #: With one of these in it, a text is not cut at runs of white space.
        self.uncut = re.compile("|".join([_OTHER_SPACE, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())]))
        names = self.tokenizer.get_vocab()
        #: Ids that begin a word (where words keep their space) or end one.
        self.border = np.zeros(max(names.values()) + 1, bool)
        for name, i in names.items():
            self.border[i] = name.startswith(_SPACE_SIGN) if self.cut == "led" else name.endswith(_WORD_END)

    @staticmethod
    def _rule(path: str) -> str:
        """'led': words keep the space before them; 'bare': white space is dropped; else ''."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = pre.get("pretokenizers", [pre])
        if parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex", True) and not parts[0].get("add_prefix_space") and not norm:
            return "led"
        drops = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
        steps = {n.get("type") for n in (norm or {}).get("normalizers", [norm or {}])}
        if drops and r"\s" in str(parts[0].get("pattern")) and steps <= {"NFC", "Replace", "Lowercase", None}:
            return "bare" if (spec.get("model") or {}).get("end_of_word_suffix") == _WORD_END else ""
        return ""

    # A key of the table is, in a 'led' text, what follows a space, but for the text's first piece and
    # for pieces within a word or after a line end, which have a space put before them to tell them from those.

    def _text(self, key: str) -> str:
        """The piece of text that a key stands for."""
        if self.cut == "bare":
            return key
        return key[1:] if key.startswith(" ") else " " + key

    def _pieces(self, text: str) -> list[str]:
        """The keys of a 'led' text with runs of white space: of a run before a word the last sign
        stands alone, or leads the word if it is a space."""
        if self.uncut.search(text):
            return [" " + text]
        return [p[1:] if len(p) > 1 and p[0] == " " and not p[1].isspace() else " " + p for p in _WORD.findall(text)]

    def _encode_all(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode_keys(self, keys: list[str], at_once: int = 1000) -> dict[str, bytes]:
        """Words of common letters only are one pre-token each: many are encoded as one text, and
        the ids tell where a word begins or ends."""
        plain = [k for k in keys if _LATIN.fullmatch(k)]
        rest = list(set(keys).difference(plain)) if len(plain) < len(keys) else []
        out: dict[str, bytes] = {}
        for lo in range(0, len(plain), at_once):
            some = plain[lo : lo + at_once]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            marks = 4 * np.flatnonzero(self.border[ids])
            cuts = [*marks.tolist(), 4 * len(ids)] if self.cut == "led" else [0, *(marks + 4).tolist()]
            if len(cuts) == len(some) + 1:
                raw = ids.tobytes()
                out.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
            else:  # not reached with the two rules above
                rest += some
        out.update(zip(rest, self._encode_all([self._text(k) for k in rest]), strict=True))
        return out

    def _lookup(self, keys: list[str]) -> list[bytes]:
        """The ids of every key; what the table lacks is encoded, and kept if it is short."""
        if self.size > self.half:
            self.older, self.newer, self.size = self.newer, {}, 0
        newer, older = self.newer, self.older
        missing = [k for k in keys if k not in newer]
        known = {k: older[k] for k in missing if k in older}
        added = known | self._encode_keys([k for k in missing if k not in known])
        newer.update(added)
        found = list(map(newer.__getitem__, keys))
        self.size += _ENTRY * len(added) + sum(map(len, added)) + sum(map(len, added.values()))
        for key in [k for k in added if len(k) > _LONGEST_KEY]:
            self.size -= _ENTRY + len(key) + len(newer.pop(key))
        return found

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (a null has none), and the number of each."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if not self.cut:
            each = self._encode_all(texts.to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], np.int64)
        led = self.cut == "led"
        spaced = pc.replace_substring(texts, "\n", " \n" if led else " ")
        for sign in "" if led else "\t\r":
            spaced = pc.replace_substring(spaced, sign, " ")
        pieces = pc.split_pattern(spaced, " ")  # one at least for every text
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], pieces.flatten()
        begins, n = offsets[:-1], len(flat)
        if led:
            flat = pa.concat_arrays([flat, pc.binary_join_element_wise(pa.scalar(" "), flat.take(pa.array(begins)), pa.scalar(""))])
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy().copy()
        respaced = None
        if led:
            at[begins] = at[n:]
            at = at[:n]
            lines, alone, odd = self._spaces(coded.dictionary)
            gap = odd[at]
            gap[begins] = False
            last = offsets[1:] - 1
            gap[last[alone[at[last]]]] = False  # one line end at the end of a text
            if gap.any():
                rows = np.flatnonzero(np.logical_or.reduceat(gap, begins))
                respaced = rows, [self._pieces(texts[i].as_py()) for i in rows.tolist()]
        else:
            lines = None
        data, starts, lengths = self._piece_ids(coded.dictionary, lines)
        if respaced is not None:
            data, starts, lengths, at, begins = self._respace(*respaced, data, starts, lengths, at, offsets)
        own = lengths[at]
        return data[stretches(starts[at], own)], np.add.reduceat(own, begins)

    @staticmethod
    def _spaces(pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces begin with a line end, which are no more than that, and which do not begin with a
        word, after one line end at most."""
        two = pc.utf8_slice_codeunits(pieces, 0, 2).dictionary_encode()
        heads = two.dictionary.to_pylist()
        lines = np.array([h[:1] == "\n" for h in heads])
        odd = np.array([not h.removeprefix("\n")[:1].strip() for h in heads])
        alone = np.array([h == "\n" for h in heads])
        codes = two.indices.to_numpy()
        return lines[codes], alone[codes], odd[codes]

    def _piece_ids(self, pieces: pa.StringArray, lines: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces, with where each piece's begin and how many they are.

        A piece is a line end or nothing, a stem, and trailing signs or nothing; stems and signs recur
        more often than pieces, so it is those that the table holds.
        """
        if lines is not None and lines.any():
            pieces = pc.if_else(pa.array(lines), pc.utf8_replace_slice(pieces, 0, 1, " "), pieces)
        trimmed = pc.utf8_rtrim(pieces, _TRAIL).dictionary_encode()
        stems, stem_at = trimmed.dictionary.to_numpy(zero_copy_only=False).tolist(), trimmed.indices.to_numpy().astype(np.int64)
        fine = np.array([k[-1:].lower().isalnum() for k in stems], bool)  # a dotted capital I ends with a mark
        signs = pc.binary_length(pieces).to_numpy() - pc.binary_length(trimmed.dictionary).to_numpy()[stem_at]
        whole = np.flatnonzero(~fine[stem_at] & (signs > 0))
        signs[whole] = 0
        stem_at[whole] = len(stems) + np.arange(len(whole))
        tailed = np.flatnonzero(signs)
        keys = stems + pieces.take(pa.array(whole)).to_pylist()
        tails = _ends_of(pieces, tailed, signs[tailed]).dictionary_encode()
        within = " " if lines is not None else ""
        none = np.int64(len(keys) + len(tails.dictionary))
        places = np.full((len(pieces), 3), none, np.int64)
        places[:, 1] = stem_at
        places[tailed, 2] = len(keys) + tails.indices.to_numpy()
        if lines is not None:
            places[lines, 0] = none + 1
        ids = [*self._lookup([*keys, *(within + t for t in tails.dictionary.to_pylist())]), b"", self._lookup([within + "\n"])[0]]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        own = size[places].ravel()
        where = stretches(begin[places].ravel(), own)
        lengths = own.reshape(-1, 3).sum(1)
        return np.frombuffer(b"".join(ids), "<u4")[where], np.cumsum(lengths) - lengths, lengths

    def _respace(self, rows: np.ndarray, keys: list[list[str]], data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pieces of all texts with those of ``rows`` in place of what the cut at spaces gave."""
        number = {k: len(starts) + i for i, k in enumerate(dict.fromkeys(k for own in keys for k in own))}
        ids = self._lookup(list(number))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, lengths = np.concatenate([starts, len(data) + np.cumsum(size) - size]), np.concatenate([lengths, size])
        # an empty piece, so that no text is without one
        starts, lengths = np.append(starts, 0), np.append(lengths, 0)
        parts, sizes, done = [], np.diff(offsets), 0
        for row, own in zip(rows.tolist(), keys, strict=True):
            parts += [at[done : offsets[row]], np.array([number[k] for k in own] or [len(starts) - 1], np.int64)]
            done, sizes[row] = offsets[row + 1], max(1, len(own))
        return np.concatenate([data, np.frombuffer(b"".join(ids), "<u4")]), starts, lengths, np.concatenate([*parts, at[done:]]), np.cumsum(sizes) - sizes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit bytes."""
        out: list[bytes] = []
        for _, ids, counts in chunked(self, pa.array(texts, pa.string())):
            raw, ends = ids.tobytes(), 4 * np.cumsum(counts)
            out += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out


def stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    ends = np.cumsum(lengths)
    kind = np.int32 if len(ends) and max(int(ends[-1]), int(starts.max())) < 1 << 31 else np.int64
    where = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    where += np.arange(len(where), dtype=kind)
    return where


def _ends_of(strings: pa.StringArray, rows: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    """The last ``sizes`` bytes of the strings of ``rows``."""
    some = strings.take(pa.array(rows))
    ends = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64))
    data = np.frombuffer(some.buffers()[2] or b"", np.uint8)
    offsets = np.cumsum([0, *sizes.tolist()])
    where = np.repeat(ends - offsets[1:], sizes) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[where].tobytes()))


def chunked(words: WordEncoder, texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, ids, counts) of stretches of equal size, of ``limit`` bytes at most; a
    longer text stands alone."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    even = -(-int(ends[-1]) // max(1, -(-int(ends[-1]) // limit))) if len(ends) else 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + even, "right")))
        yield lo, *words.flat(texts.slice(lo, hi - lo))
        pa.default_memory_pool().release_unused()
        lo = hi


def encoder(path: str, cache_bytes: int = 64_000_000) -> WordEncoder:
    """This process's encoder for ``path``; kept between tasks."""
    key = (path, cache_bytes)
    if key not in _loaded:
        _loaded[key] = WordEncoder(path, cache_bytes)
    return _loaded[key]


def release() -> None:
    """Give back to the system what this process's encoders and Arrow's pool hold; tasks of other
    operators call it, as they may run in a worker that has tokenised before."""
    if _loaded:
        _loaded.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def vocabulary(name: str) -> str:
    """Where the named public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
