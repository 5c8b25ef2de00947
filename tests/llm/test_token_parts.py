"""Words are encoded in parts, each part once, with the ids of the whole text."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from contentloom.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def assert_ids(texts):
    own = tokens.encoder(PATH)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.dtype).tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text


def test_parts_reach_the_tokenizer_once(monkeypatch):
    own, given_words = tokens.Encoder(PATH), []
    for name in ("_joined", "_one_by_one"):
        plain = getattr(own, name)
        monkeypatch.setattr(own, name, lambda words, plain=plain: given_words.extend(words) or plain(words))
    own.encode(["mente ciónmente los"])
    assert sorted(given_words) == sorted({"mente", "ciónmente", "los", ""})
    del given_words[:]
    texts = ["Mente*** CIóNMENTE. los,", "LOS mente, Los***", "ciónmente*** Mente"]
    found = [ids for text in texts for ids in own.encode([text])]
    assert sorted(given_words) == sorted({"***", ".", ","})
    assert [np.frombuffer(i, own.dtype).tolist() for i in found] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


# A capital that becomes a letter and a mark, a letter that is normalized into two, a mark after a
# letter, a sigma at the end, jamo that are put together, a circled and a Roman number, Thai, a ligature.
@pytest.mark.parametrize("word", ["Lİ", "क़", "H̱", "ΟΔΟΣ", "한", "①", "Ⅻ", "ก็", "ﬁn", "ǅ", "ª", "𐐀𞤀", "ᲉꟚᲊ"])
def test_signs_after_any_letters(word):
    assert_ids([f"{word}{end} x{word}{end} {word}x{end}" for end in ("", ".", ",", "***", "'s", ".'s", "<|", "!?", "1.", "̱.")])


@given(st.lists(st.text(st.sampled_from("aBséİΣ #*.,'<|>1̱\t\n하"), max_size=30), max_size=5))
@settings(max_examples=100, deadline=None)
def test_any_words(texts):
    assert_ids(texts)


@given(st.lists(st.text(max_size=30), max_size=5))
@settings(max_examples=100, deadline=None)
def test_any_texts(texts):
    assert_ids(texts)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_of_columns(kind):
    own = tokens.encoder(PATH)
    texts = ["one", "", "two three.", " \n", "four", "<|endoftext|>"]
    column = pa.array(texts, kind)
    assert own.encode_column(column.slice(1, 4)).to_pylist() == own.encode(texts[1:5])
    assert own.encode_column(column.slice(6)).to_pylist() == own.encode([]) == []
    assert own.counts(own.encode_column(column)).to_pylist() == [len(WHOLE.encode(t, add_special_tokens=False).ids) for t in texts]
