"""Ids by pieces of units against the library on whole texts."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scrivener.llm.op10_token_files import _ids, encode_ids, piece_encoder, pieces
from scrivener.llm.units import Memo

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Contractions, capitals, letters beyond the known ones, marks that compose, odd white space, special strings, numbers.
TEXTS = ["The cat's THE Cat, it's 'tis 'S'T we'Re y'all'd've can''t 1234 x2y __a_b__ ...!? (a)", "ÀÉî Straße ŒUVRE ŸŽ İstanbul ıſ ŉ ŀ × ÷ ªº² ½", "é Éa ́ á̧ ẛ̣ ΣΑΣ Σ",
         "a b c\u0085d\x1ce \x1f  f 　 g", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|> <| endoftext |>", "“Quoted” – it’s … ‘so’ «¿qué?» ¡ya! a·b", "漢字 カタカナ 😀👍🏽 Привет МИР١٢", "", "  ", "\t\n lead and trail \r\n",
         "a" * 300 + "!" * 80 + " " + "9" * 70, "\x00\x01 \x7f\x1b", "don't DON'T Don'T don’t 's ' '' '-"]


def library(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


def test_pieces_give_the_library_ids():
    tok = Tokenizer.from_file(WORD_BPE)
    split = pieces(tok)
    for t in TEXTS:
        found = t.split()
        pool, begin = _ids("".join(u + "\n" for u in found), split, Memo(piece_encoder(tok, 3), len))
        got = [pool[a:b].tolist() for a, b in zip(begin, begin[1:])]
        assert got == [library(tok, u) for u in found], t


def test_every_known_character_keeps_its_place():
    tok = Tokenizer.from_file(WORD_BPE)
    split, memo = pieces(tok), Memo(piece_encoder(tok), len)
    chars = [chr(c) for c in range(0x21, 0x2200) if not 0xD800 <= c < 0xE000 and not chr(c).isspace()]
    found = [f"{a}{c}{b}" for c in chars for a, b in (("", ""), ("A", "e"), (".", "'"), ("7", "'S"))]
    pool, begin = _ids("".join(u + "\n" for u in found), split, memo)
    for u, a, b, e in zip(found, begin, begin[1:], tok.encode_batch(found, add_special_tokens=False)):
        assert pool[a:b].tolist() == e.ids, ascii(u)


def test_units_that_differ_in_case_and_punctuation_are_encoded_once():
    tok = Tokenizer.from_file(WORD_BPE)
    asked = []
    encode = piece_encoder(tok)
    memo = Memo(lambda xs: asked.extend(xs) or encode(xs), len)
    _ids("Word\nword\nWORD,\n(word)\nword's\n", pieces(tok), memo)
    assert sorted(asked) == ["'s", "(", ")", ",", "word"]


def test_other_tokenizers_are_not_cut():
    from tokenizers import AddedToken

    assert pieces(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))) is None
    tok = Tokenizer.from_file(WORD_BPE)
    tok.add_tokens([AddedToken("word", normalized=False)])
    assert pieces(tok) is None


@pytest.mark.parametrize("end_id", [1, None])
def test_encoded_column_equals_the_library(spark, end_id):
    tok = Tokenizer.from_file(WORD_BPE)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)], "id long, text string").coalesce(1)
    rows, before = encode_ids(df, WORD_BPE, end_id).collect(), 0
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        want = library(tok, (TEXTS * 2)[r.id]) + ([] if end_id is None else [end_id])
        assert (r.ids, r.n_tokens, r.before) == (want, len(want), before), r.id
        before += len(want)
