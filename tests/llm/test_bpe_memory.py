"""What an encoder remembers is bounded in bytes, whatever the texts."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from quern.llm import bpe


def test_texts_without_white_space():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, lib, rng = bpe.WordBpe(path), Tokenizer.from_file(path), random.Random(2)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(20)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(5000)) for _ in range(20)]
    texts += ["x" * 20_000, "http://a.example/" + "path/" * 300, "plain words " * 2000]
    for text, ids in zip(texts, tok.encode_batch(texts), strict=True):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert set(tok.memo) == {"plain", "words"} and tok.held < 1000


def test_memory_of_many_pieces():
    tok = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"), max_memo=100_000)
    for at in range(0, 20_000, 500):
        list(tok.encode_batch([f"word{i} w{i}x" for i in range(at, at + 500)]))
        size = lambda memo: sum(4 * len(c) + len(v) + bpe.ENTRY for c, v in memo.items())
        # a batch may go over by what it holds itself, about 250,000
        assert size(tok.memo) <= 360_000 and size(tok.older) <= 360_000


def test_very_long_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = " ".join(f"w{i % 977}, Some longer{i % 31} text" for i in range(150_000))
    assert len(text) > 3_000_000
    assert bpe.WordBpe(path).encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
