"""Word hashing over whole batches of UTF-8 text with numpy.

A chunk of documents is one byte array. Words are maximal runs of word bytes. A word's hash takes its bytes
eight at a time, each step through a mixing function that is not linear, from a start that depends on a seed and
on the length; longer words go through XXH3. So no Python code runs for each word of usual length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK_BYTES = 256_000

#: Word bytes of the two word rules in use.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) of about ``limit`` bytes; a longer text stands alone."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


#: Longer words are hashed one by one.
LANES = 8
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words:
    """The words of ``docs`` (A-Z lower-cased): their hashes, where they lie in ``low``, and where each document's
    words begin among them (one more entry than documents)."""

    def __init__(self, docs: list[bytes], word_bytes: np.ndarray, seed: int = 0):
        low = _LOWER[np.frombuffer(b" ".join(docs) + b" " * 9, np.uint8)]
        edge = np.diff(word_bytes[low].view(np.int8), prepend=np.int8(0))
        self.low, self.starts, self.ends = low, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.lengths = self.ends - self.starts
        self.begin = np.searchsorted(self.starts, np.cumsum([0, *(len(d) + 1 for d in docs)]))
        hashes = mix(self.lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
        for lane in range(LANES):
            some = slice(None) if lane == 0 else np.flatnonzero(self.lengths > 8 * lane)
            at, left = self.starts[some] + 8 * lane, np.minimum(self.lengths[some] - 8 * lane, 8)
            if not len(at):
                break
            value = low[np.minimum(at[:, None] + np.arange(8), len(low) - 1)].view("<u8").ravel() & _TAIL[left]
            hashes[some] = mix(hashes[some] ^ value)
        for k in np.flatnonzero(self.lengths > 8 * LANES).tolist():
            hashes[k] = xxhash.xxh3_64_intdigest(low[self.starts[k] : self.ends[k]].tobytes(), seed)
        self.hashes = hashes


def word_hashes(docs: list[bytes], word_bytes: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``docs``, and where each document's words begin in them."""
    words = Words(docs, word_bytes, seed)
    return words.hashes, words.begin


def shingle_sets(texts: list[str | None], width: int = 5, seed: int = 0) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole word sequence as the only one; no words, no shingle.
    """
    salt = [mix(np.array([n], np.uint64))[0] for n in range(width + 1)]
    factor = [np.uint64(pow(0xA24BAED4963EE407, j, 1 << 64)) for j in range(width)]
    for _, docs in chunks(texts):
        words, begin = word_hashes(docs, NOT_SPACE, seed)
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width):
            rolled += words[j : j + len(rolled)] * factor[j]
        rolled = mix(rolled + salt[width])
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                one = np.zeros(1, np.uint64)
                for j in range(b - a):
                    one += words[a + j : a + j + 1] * factor[j]
                yield mix(one + salt[b - a])
            else:
                yield np.zeros(0, np.uint64)
