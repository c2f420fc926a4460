"""Groups of near copies against a comparison of all pairs by whole shingle sets."""

import random

import pytest

from phenogrid.llm import near_copies, simhash
from tests_llm_plain import plain_kept


def mutated(r, words, edits):
    words = list(words)
    for k in range(edits):
        words[r.randrange(len(words))] = f"new{r.random()}"
    return " ".join(words)


@pytest.mark.parametrize("paired", [10, 1000])
def test_near_copies_leave_one(spark, docs_of, paired):
    r = random.Random(paired)
    bases = [[f"w{b}x{r.randrange(300)}" for _ in range(r.choice([4, 5, 30, 150, 400]))] for b in range(12)]
    rows = [(i, mutated(r, bases[i % 12], r.choice([0, 0, 1, 1, 2, 4, 9]))) for i in range(240)]
    # one hot group, linked by pairs of its own only
    rows += [(1000 + i, mutated(r, [f"hot{k}" for k in range(150)], r.randint(0, 4))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, "one three")]
    expected = plain_kept(rows)
    found = near_copies.near_copies(docs_of(rows), paired=paired).collect()
    assert len(found) == len(rows) and {x["component_id"] for x in found} == expected
    assert {x["doc_id"] for x in simhash.keep_one(docs_of(rows)).collect()} == expected


def test_documents_of_the_pipeline_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = plain_kept([(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()])
    assert {x["doc_id"] for x in simhash.keep_one(docs).select("doc_id").collect()} == expected
