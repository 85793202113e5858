"""Chunks that come back are not encoded again while a worker may remember them."""

from itertools import islice, product

from corpusmill.llm import bpe
from corpusmill.llm.queries import tokenizer


def test_chunks_that_come_back_are_looked_up():
    coder = bpe.WordBpe(tokenizer("word_bpe_49k.json"))
    text = " ".join("".join(x) for x in islice(product("etaoinsh", repeat=6), 120_000))
    first = coder.encode_decoded(text)
    asked, word = [], coder.word
    coder.word = lambda chunk: asked.append(chunk) or word(chunk)
    assert coder.encode_decoded(text) == first
    assert not asked
