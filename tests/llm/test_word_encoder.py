"""The word encoder against the library on whole texts."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleaner.llm.tokens import WordEncoder, vocabulary

SIGNS = [" ", "  ", "\n", " \n", "\n\n", "\t", "\x85", "\u3000", "&&&", "\u0301", "²", "'s", "a", "É", "ß,", "1", ".", "<|endoftext|>", "中", "Word", " x", "\x1c", "é", "İ", "-"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("kept", [10, 64_000_000])
def test_same_ids_as_whole_texts(name, kept):
    rng = random.Random(7)
    texts = ["", " ", "İ.", "x İÉ  \nWordİ.", "\n", "a\n", "a\n\n", "\na", " a", "\n" * 5000, " " * 3000, "x.\ny" * 2000] + ["".join(rng.choices(SIGNS, k=rng.randint(1, 14))) for _ in range(3000)]
    whole = Tokenizer.from_file(vocabulary(name)).encode_batch_fast(texts, add_special_tokens=False)
    words = WordEncoder(vocabulary(name), kept)
    found = [ids for lo in range(0, len(texts), 100) for ids in words.encode(texts[lo : lo + 100])]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [e.ids for e in whole]
    assert words.encode([None]) == [b""]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("text", ["a\n" * 1_500, "a\n" * 100_000, "ab.\n" * 1_000_000, "x" * 50_000, "a\n\nb, " * 100_000], ids=["lines", "more lines", "most lines", "one word", "paragraphs"])
def test_long_texts_without_spaces(name, text):
    words = WordEncoder(vocabulary(name))
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == Tokenizer.from_file(vocabulary(name)).encode(text, add_special_tokens=False).ids
    assert sum(map(len, words.newer)) < 1_000


def test_the_table_is_bounded_by_bytes():
    words = WordEncoder(vocabulary("byte_bpe_50k.json"), 1_000_000)
    for k in range(20):
        words.encode([" ".join(f"w{k}x{i}" for i in range(2000))])
        assert sum(170 + len(w) for t in (words.newer, words.older) for w in t) < 2_500_000
