"""Words of one length are merged together, by the same rule as one by one."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from phenogrid.llm import byte_bpe


def _words(n: int) -> list[bytes]:
    draw = random.Random(7)
    return [bytes(draw.choices("aeinrst é漢xq".encode(), k=draw.randint(1, 45))) for _ in range(n)]


def test_the_same_ids_as_one_by_one():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    words = [*_words(4000), b"", b"a", bytes(range(256)), b"\xff\xfe"]
    packed = byte_bpe.Merges(ranks)(words)
    assert packed == [np.array(byte_bpe.merge_word(w, ranks) if w else [], dtype="<i4").tobytes() for w in words]


def test_a_byte_without_a_rank_may_be_merged_but_not_left():
    ranks = {b"a": 0, b"ab": 1}
    merges = byte_bpe.Merges(ranks)
    assert [np.frombuffer(x, "<i4").tolist() for x in merges([b"aab"] * 9)] == [[0, 1]] * 9
    with pytest.raises(KeyError):
        merges([b"bab"] * 9)


def test_short_words_of_a_batch_are_not_merged_one_by_one(monkeypatch):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    calls, one = [], byte_bpe.merge_word
    monkeypatch.setattr(byte_bpe, "merge_word", lambda word, ranks: calls.append(word) or one(word, ranks))
    coder = byte_bpe.Coder(ranks, public_tokenizers.PATTERN, byte_bpe.Known([], []))
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("aeinrst", k=9)) for _ in range(50)) for _ in range(20)]
    assert [coder.decode(coder.encode(t)).decode() for t in texts[:2]] == texts[:2]
    del calls[:]
    found = coder.encode_all(texts)
    assert [coder.decode(f).decode() for f in found] == texts
    assert len(calls) < 50


def test_the_dictionary_gives_the_ids_of_its_words_only():
    known = byte_bpe.Known([b" the", b"", "é".encode()], [b"\1\0\0\0", b"", b"\2\0\0\0\3\0\0\0"])
    assert known.find(["é".encode(), b"the", b" the", b""]) == [b"\2\0\0\0\3\0\0\0", None, b"\1\0\0\0", b""]


def test_a_task_leaves_no_chunks_in_its_worker():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = byte_bpe.Coder(ranks, public_tokenizers.PATTERN, byte_bpe.Known([], []))
    found = coder.encode("some words, some more")
    assert coder.young
    coder.forget()
    assert not coder.young and not coder.old and coder.encode("some words, some more").tolist() == found.tolist()
