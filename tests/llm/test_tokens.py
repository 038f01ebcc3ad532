"""Ids by pieces equal the tokenizer's ids of the whole text, on any text."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import textvec as V
from quarry.llm.packing import WordTokenizer

PIECES = ["a", "Z", "é", "É", "ß", "ÿ", "×", "÷", "ñ", "́", "’", "'", "'s", "'LL", "don't", "the", " ", " ", "\n", "\t", " ", "　", "\x01", "\x85", "1", "23", "٣", "_", "-", ".", "!?", "«", "…", "<|endoftext|>", "<|", "ﬁ", "Σ", "ς", "İ", "中", "🙂", "ing", "tion", "#", "\x00"]
TEXTS = st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.text(max_size=12)), min_size=1, max_size=6)
PATH = public_tokenizers.path("word_bpe_49k.json")


def by_pieces(tok, texts):
    ids = []
    for a, b, raw, offsets in V.chunks(pa.array(texts, pa.string())):
        w, got, end = tok.encode(raw, offsets)
        bounds = [0, *end.tolist()]
        ids += [got[bounds[w.first[i]] : bounds[w.first[i + 1]]].tolist() for i in range(b - a)]
    return ids


@pytest.fixture(scope="module")
def toks():
    plain = WordTokenizer(PATH)
    plain.ranked = None
    return WordTokenizer.load(PATH), plain, Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(texts=TEXTS)
def test_ids_equal_the_tokenizers(toks, texts):
    fast, plain, tok = toks
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert by_pieces(fast, texts) == want
    assert by_pieces(plain, texts) == want


@settings(max_examples=30, deadline=None)
@given(texts=TEXTS)
def test_a_tokenizer_that_keeps_white_space(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = WordTokenizer.load(path)
    assert tok.ranked is None
    assert by_pieces(tok, texts) == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
