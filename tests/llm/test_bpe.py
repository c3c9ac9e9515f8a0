"""Tokenizer operators against the installed library."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from scrivener.llm.op1_token_counts import splice_count
from scrivener.llm.op9_bpe import BPE
from scrivener.llm.units import units

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "é", "Σ", "ΑΣ ", "İ", "ß", "я", "日本",
            "\U0001f642", "1", "23", "½", "'s", "'LL", "'", "\x1c", "\x85", "\xa0", "​", " ", "　", "́", "<|endoftext|>",
            "<|startoftext|>", "<|end", "oftext|>", "...", "_", "-", "\0", "ǅ"]


def texts(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    with open(WORD, encoding="utf-8") as f:
        return BPE(f.read())


def test_segment_tree_equals_library(bpe):
    tok = Tokenizer.from_file(WORD)
    for t in [*texts(1, 800, 40), "", "x" * 5000, "abcdefgh" * 700, "é" * 300]:
        ids = [i for x in bpe.encode_units(units(t)) for i in x]
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids == want, t
        assert bpe.decode(ids) == tok.decode(want, skip_special_tokens=False)


def test_forest_and_long_tree_agree(bpe):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 129))).encode() for _ in range(400)]
    assert bpe.encode_words(words) == [bpe._long(w) for w in words]


@pytest.mark.parametrize("chunk,overlap", [(50, 10), (64, 3), (33, 32), (500, 1)])
def test_spliced_count_equals_whole(chunk, overlap):
    tok = Tokenizer.from_file(BYTE)
    for t in [*texts(2, 200, 300), "a" * 900, " " * 700, "\n \n" * 200, "word " * 300, "<|endoftext|>" * 60, "日本語" * 200]:
        if len(t) > chunk:
            assert splice_count(tok, t, chunk, overlap) == len(tok.encode(t, add_special_tokens=False).ids), t
