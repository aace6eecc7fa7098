import random
import unicodedata

import pyarrow as pa
import pytest

from shotlab.llm import tokens
from shotlab.llm.tokens import WordEncoder, tokenizer, word_bpe
from tests.llm import data

PIECES = ["'", "'s", "'S", "'ll", "don't", "WE'VE", "the", "Quick", "2024", "x²", "½", "É", "É", "J̌", "ǰ", "H̱", "≠", "≮", "İ", "Ⱥ", "Ə", "ß", "한국", "하", "日本",
          "٣", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "\x85", "\xa0", " ", "\x0b", "\x0c", "\x1c", "\x7f", "\x00", *" \n\t\r.,!-_`~|=<" * 3]


@pytest.mark.parametrize("chunk", [1, 60, 1 << 22])
def test_columns_of_texts_equal_the_library(chunk, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    rnd, tok = random.Random(chunk), tokenizer(word_bpe())
    marks = [c for c in map(chr, range(0x3000)) if unicodedata.combining(c)]
    for k in range(60):
        texts = [None if rnd.random() < 0.05 else "".join(rnd.choice(PIECES if rnd.random() < 0.9 else marks) for _ in range(rnd.choice([0, 1, 3, 30]))) for _ in range(rnd.randrange(30))]
        column = pa.array(texts, pa.string() if k % 2 else pa.large_string()).slice(k % 3)
        got = [ids.tolist() for ids in WordEncoder(word_bpe(), memo=rnd.choice([4, 40, 4000])).each(column)]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts[k % 3:]]


def test_a_chunk_looks_up_each_distinct_word_once(monkeypatch):
    """The cost of a text is that of its new words: copies and repeated words add no lookups."""
    looked = []

    class Counted(tokens.Memo):
        def __getitem__(self, run):
            looked.append(run)
            return super().__getitem__(run)

    monkeypatch.setattr(tokens, "Memo", Counted)
    texts = [data.PROSE, f"{data.PROSE.upper()}. Over, the\nriver!"] * 200
    got = [ids.tolist() for ids in WordEncoder(word_bpe()).each(pa.array(texts))]
    assert got == [tokenizer(word_bpe()).encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(looked) == sorted({*data.PROSE.split(), ".", ",", "!"})


def test_the_memo_is_bounded():
    enc = WordEncoder(word_bpe(), memo=100)
    for ids in enc.each(pa.array([" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}x, 日{i}" for i in range(600)) + " 日本" * 500])):
        assert len(ids)
    assert len(enc.known) + len(enc.known.old) <= 100
