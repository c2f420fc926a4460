"""The near-duplicates stage takes candidates from SimHash fingerprints, measured like those of the bands."""

import pytest

from phenogrid.llm import near_copies, simhash


def texts():
    base = [f"w{k}" for k in range(3000)]
    near = [" ".join([*base[:-1], f"x{i}"]) for i in range(40)]
    return [" ".join(base), *near, "one two three", "four five six"]


@pytest.mark.parametrize("led", [7, 1000])
def test_pairs_of_one_class(spark, docs_of, led):
    rows = list(enumerate(texts()))
    got = [(x["a"], x["b"]) for x in simhash.candidate_pairs(docs_of(rows), led=led).collect()]
    prints = {near_copies.text_id(t): simhash.simhash(t) for _, t in rows}
    assert len({a for a, _ in got}) == len(got) >= 41 - 41 // led * 2 - 1
    assert all(a != b and (prints[a] ^ prints[b]).bit_count() <= 4 for a, b in got)


def test_fingerprints_link_without_bands(spark, docs_of, monkeypatch):
    none = spark.createDataFrame([], "gid long, text_id long")
    monkeypatch.setattr(near_copies, "candidate_groups", lambda classes, paired: none)
    assert {x["doc_id"] for x in simhash.keep_one(docs_of(list(enumerate(texts())))).collect()} == {0, 41, 42}
