"""SimHash groups against a comparison of all fingerprints, with copies, hot buckets and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from phenogrid.llm import simhash
from phenogrid.llm.components import components
from tests_llm_plain import plain_fingerprint, plain_groups


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check(rows, found):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    root = plain_groups(set(prints.values()))
    first = {}
    for i, p in prints.items():
        first[root[p]] = min(i, first.get(root[p], i))
    assert {r["doc_id"]: (r["fp"], r["component_id"]) for r in found} == {
        i: (signed(p), first[root[p]]) for i, p in prints.items()}


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], simhash.near_duplicates(docs).collect())


def test_edges(spark, docs_of):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    long = " ".join(r.choice(words) for _ in range(70_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b"), (7, "a b c"), (8, "ÀÉ ß x"), (9, long), (10, long + " end"), (11, "A  b\nC")]
    check(rows, simhash.near_duplicates(docs_of(rows)).collect())


def test_repeated_rows_null_ids_and_empty_table(spark, docs_of):
    docs = docs_of([(5, "x y z w"), (5, "x y z w"), (None, "x y z w"), (None, "lone text here now"), (None, "lone text here now"), (9, "other words are here")])
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 6
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (0, 0), (0, 5), (5, 5), (5, 5), (9, 9)]
    kept = simhash.keep_one(docs).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [
        (0, "lone text here now"), (5, "x y z w"), (9, "other words are here")]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.keep_one(docs.limit(0)).collect() == []


@pytest.mark.parametrize("paired", [2, 64])
def test_hot_buckets_link_the_same(spark, paired):
    r = random.Random(paired)
    prints = set()
    for centre in [r.getrandbits(64) for _ in range(4)]:
        for _ in range(60):
            p = centre
            for _ in range(r.randint(0, 4)):
                p ^= 1 << r.randrange(64)
            prints.add(p)
    fps = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = simhash.fingerprint_links(fps, paired).distinct()
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).isEmpty()
    root = {x["node"]: x["root"] for x in components(links).collect()}
    expected = plain_groups(prints)
    by = {}
    for p, q in expected.items():
        by.setdefault(q, set()).add(signed(p))
    got = {}
    for p in prints:
        got.setdefault(root.get(signed(p), signed(p)), set()).add(signed(p))
    assert {frozenset(x) for x in by.values()} == {frozenset(x) for x in got.values()}


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(7, 7), (1000, 1001), (1001, 1000)], "a long, b long")
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    assert root == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
