import os
import random

import pytest

from tickloom.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.TOKENIZERS), reason="no tokenizers")


def test_same_as_the_reference_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(T.TOKENIZERS, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in ("", "Hello, wörld!\n\n  two  spaces <|endoftext|>", "It's 3.14 — “quoted”…", "a" * 3000):
        assert T.encoder()(text) == other.encode(text, add_special_tokens=False).ids


def test_long_texts_are_counted_whole():
    line = "The late mill reported every idle farmer beside this widow.\n"
    text = line * 5000
    assert len(T.encoder()(text)) == 5000 * len(T.encoder()(line))
    assert len(T.encoder()("x" * 400_000)) > 1000


def test_pieces_of_long_texts_have_the_tokens_of_the_whole(monkeypatch):
    rng = random.Random(1)
    parts = ["word", "  ", " ", "\n", "\n\n", "don't", "'s", "it'll", "123", "3.14", "...", "“q”", "é", "漢字", "a1b2", "!?", "\t ", "''", "'1", "e\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(4000)) for _ in range(5)] + ["two  spaces " * 11_000, "no,blanks;at:all" * 8_000, "  \n" * 500 + "x"]
    whole = []
    for longest in (10**9, 977, 64):
        monkeypatch.setattr(T, "LONGEST_RUN", longest)
        whole.append([T.encoder()(t) for t in texts])
    assert whole[0] == whole[1]
    assert whole[0][:5] == whole[2][:5]
    monkeypatch.setattr(T, "LONGEST_RUN", 50_000)
    assert [T.encoder()(t) for t in texts] == whole[0]
