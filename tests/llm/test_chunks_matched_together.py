"""Chunks that a worker hasn't seen are matched as one text, and give the ids they give one by one."""

import public_tokenizers
import pytest
import regex

from phenogrid.llm import byte_bpe

RANKS = {bytes([b]): b for b in range(256)} | {b" a": 256, b"ab": 257, b" ab": 258, b"  ": 259, "é".encode(): 260}
TEXTS = ["ab  cd\t\nab\x1cab it's 12ab!! ", "\x1c x", None, "", "  ", "é　é ab", " ".join(f"w{i}b" for i in range(2_000)), "a\n\n  b   c"]


class Counted:
    def __init__(self, pattern):
        self.pattern, self.calls = regex.compile(pattern), 0

    def findall(self, text):
        self.calls += 1
        return self.pattern.findall(text)


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, "[a-z]+", r"\s*\S+"])
def test_same_ids_as_one_by_one(pattern):
    coder = byte_bpe.Coder(RANKS, pattern, byte_bpe.Known([], []))
    match = regex.compile(pattern)
    for text, ids in zip(TEXTS, coder.encode_all(TEXTS)):
        words = [w for c in byte_bpe._CHUNK.findall(text or "") for w in match.findall(c)]
        assert ids.tolist() == [i for w in words for i in byte_bpe.merge_word(w.encode(), RANKS)]


def test_few_calls():
    coder = byte_bpe.Coder(RANKS, public_tokenizers.PATTERN, byte_bpe.Known([], []))
    coder.match = Counted(public_tokenizers.PATTERN)
    coder.encode_all(TEXTS)
    # before, one for each of some 2,000 chunks
    assert coder.match.calls < 20
