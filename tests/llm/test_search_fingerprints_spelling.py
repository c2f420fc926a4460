"""Ranked search, min-hash fingerprints and spelling variants against brute force, on odd and skewed rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phenogrid.llm import minhash_bins, queries, ranked_search, spelling

LOW = {c: c + 32 for c in range(65, 91)}
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Ünïcode ß 漢字 \U0001f600 é naïve ÉCOLE"), (5, "a" * 5000), (6, "x\x1cy\x85z　w v"),
       (None, "no id here, no ID"), (7, "it's 12 o'clock"), (7, "it's 12 o'clock")]


# ranked search

def plain_search(docs, items, k):
    words = lambda t: re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", (t or "").translate(LOW))
    held = [(i, words(t)) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, score int")
    return d, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, _q string")


@pytest.mark.parametrize("block", [7, 10_000])
def test_search_equals_scoring_everything(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    rnd = random.Random(block)
    words = [f"w{i}" for i in range(60)]
    docs = ODD + [(i, " ".join(rnd.choices(words, range(60, 0, -1), k=rnd.randint(1, 40)))) for i in range(100, 400)]
    docs += [(i, docs[20][1]) for i in range(500, 620)]  # a group of copies: ties by id
    items = [(1, None), (2, ""), (3, "ABSENT"), (4, "NO id it's É"), (4, "no id it's é"), (None, "w1 w1 w59")]
    items += [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(10, 30)] + [(40, docs[20][1])]
    d, q = frames(spark, docs, items)
    got = ranked_search.search(d.repartition(3), q, k=5).collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(docs, items, 5)


def test_search_query_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = [(i, f"alpha beta{i % 7} gamma{i}") for i in range(50)], [(i, f"alpha beta{i} gamma{i}") for i in range(9)]
    d, q = frames(spark, docs, items)
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", 5)
    assert sorted(map(tuple, ranked_search.search(d, q, k=3).collect()), key=repr) == plain_search(docs, items, 3)
    assert ranked_search.search(d.limit(0), q).collect() == [] == ranked_search.search(d, q.limit(0)).collect()
    with pytest.raises(ValueError):
        ranked_search.search(d, q.withColumnRenamed("item_id", "doc_id"), query_id="doc_id")


def test_accumulators_are_limited():
    """Rare terms decide; a common term then only updates survivors, which keeps scores exact."""
    seen, rows = [], np.arange(1000)

    class Gains(np.ndarray):
        """Notes how many accumulators a term touches."""

        def __rmul__(self, w):
            seen.append(w)
            return w * np.asarray(self)

    postings = {0: (rows[:30], np.full(30, 900_000)), 1: (rows, np.full(1000, 300_000).view(Gains))}
    best = {1: ranked_search.Best(20)}
    ranked_search.search_block([(1, [0, 1], [8000, 10])], postings, 1000, pa.array(rows), rows, best)
    assert [(s, i) for s, _, i in best[1].rows] == [(8000 * 900_000 + 10 * 300_000, i) for i in range(20)]
    # a second block whose bounds stay below the 20th score is left at once
    ranked_search.search_block([(1, [1], [10])], postings, 1000, pa.array(rows + 5000), rows, best)
    assert [i for _, _, i in best[1].rows] == list(range(20)) and seen == [10]


# fingerprints

def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_densification_takes_the_first_full_bin():
    for size in (1, 2, 3, 40, 5000):
        hashes = np.random.default_rng(size).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        least = {}
        for h in hashes.tolist():
            b = h >> 55
            least[b] = min(h, least.get(b, h))
        got = minhash_bins.densified(hashes)
        for b in range(512):
            if b in least:
                assert got[b] == least[b]
                continue
            for r in range(200):
                tried = [x for x in minhash_bins._donors(np.array([b]), r)[0].tolist() if x in least]
                if tried:
                    assert got[b] == least[tried[0]]
                    break
            else:
                assert size == 1 and got[b] == hashes[0]


def test_likeness_estimates_the_similarity(spark):
    rnd, errors = random.Random(5), []
    for size in (3, 20, 200, 3000):
        words = [str(rnd.random()) for _ in range(size)]
        for cut in (0, size // 4, size // 2, size):
            other = words[:size - cut] + [str(rnd.random()) for _ in range(cut)]
            a, b = " ".join(words), " ".join(other).upper()
            got = minhash_bins.likeness(minhash_bins.low_bits(a), minhash_bins.low_bits(b))
            errors.append(got - jaccard(a, b))
    assert np.abs(errors).max() < 0.12 and abs(np.mean(errors)) < 0.02
    bits = minhash_bins.low_bits("some words to pack into bits")
    assert len(minhash_bins.pack(bits)) == 256 and (minhash_bins.unpack(minhash_bins.pack(bits)) == bits).all()
    assert minhash_bins.likeness(minhash_bins.low_bits(""), minhash_bins.low_bits(None)) == 1.0
    assert minhash_bins.likeness(minhash_bins.low_bits(""), bits) == 0.0
    row = spark.createDataFrame([("some words to pack into bits",), (None,)], "t string").select(minhash_bins.fingerprint(F.col("t"))).collect()
    assert bytes(row[0][0]) == minhash_bins.pack(bits) and bytes(row[1][0]) == b""


def check_edited(rows, docs):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    assert len(rows) == len(docs)
    expected = Counter()
    for at, i in enumerate(order):
        text, following = docs[i][1] or "", docs[order[(at + 1) % len(order)]][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, e, n = (minhash_bins.low_bits(t) for t in (text, edited, following))
        expected[docs[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest(), minhash_bins.pack(a), minhash_bins.pack(e),
                 minhash_bins.likeness(a, e), minhash_bins.likeness(a, n)] += 1
    assert Counter((r[0], r[1], r[2], bytes(r[3]), bytes(r[4]), r[5], r[6]) for r in rows) == expected


def test_edited_texts(spark, sf):
    def run(docs):
        frame = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id long, text string, part int, place string")
        return minhash_bins.edited_likeness(frame).collect()

    rnd = random.Random(2)
    docs = ODD + [(i, " ".join(rnd.choices(["Aé", "b", "漢字", "dd"], k=rnd.randint(0, 60)))) for i in range(300, 10, -1)]
    check_edited(run(docs), docs)
    check_edited(run([(5, "only one document here, nothing more")]), [(5, "only one document here, nothing more")])
    assert run([]) == []
    table = spark.read.parquet(f"{sf}/documents.parquet")
    check_edited(minhash_bins.edited_likeness(table).collect(), [(r["doc_id"], r["text"]) for r in table.collect()])


def test_estimates_on_the_table(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op12(spark, sf).collect()}
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    errors = []
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        errors += [rows[i]["near_edited"] - jaccard(text, text[:len(text) - half] + following[:half]), rows[i]["near_next"] - jaccard(text, following)]
    assert np.abs(errors).max() < 0.15 and np.abs(errors).mean() < 0.03


# spelling

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_counts(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def plain_variants(n, wild=lambda w: [w[:i] + "*" + w[i + 1:] for i in range(len(w))] + [w[:i] + "*" + w[i:] for i in range(len(w) + 1)]):
    near, shared = {w: set() for w in n}, {}
    for w in n:
        for key in wild(w):
            shared.setdefault(key, []).append(w)
    for ws in shared.values():
        for a in ws:
            near[a].update(b for b in ws if b != a and one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def test_bitsets_find_every_edit():
    rnd = random.Random(9)
    for size in (1, 5, 70, 400):
        words = sorted({"".join(rnd.choices("abÿ", k=rnd.randint(1, 7))) for _ in range(size)} | {"a" * 300, "a" * 301})
        got = spelling.near_in_set(words)
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}


@pytest.mark.parametrize("limit", [3, 2048])
def test_variants_equal_brute_force(spark, monkeypatch, limit):
    """With a small limit most files are halved down to one letter."""
    monkeypatch.setattr(spelling, "FILE", limit)
    monkeypatch.setattr(spelling, "SET", 20)
    rnd = random.Random(limit)
    n = {"".join(rnd.choices("abé", k=rnd.randint(1, 8))): rnd.choice([5, 6, 30, 200, 5000, 10**6]) for _ in range(500)}
    words = spark.createDataFrame([(w, c, "x") for w, c in n.items()], "word string, n long, form string").select("word", "n", "form")
    assert sorted(map(tuple, spelling.variants(words).collect()), key=repr) == plain_variants(n)
    assert spelling.variants(words.limit(0)).collect() == []


def test_word_counts_on_odd_rows(spark):
    docs = ODD + [(i, "Spelling ÉCOLES÷x spellimg" + " naïvely" * 3) for i in range(2000)] + [(None, "Spelling")] * 9
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = {r["word"]: r["n"] for r in spelling.word_counts(frame).collect()}
    assert got == plain_counts(docs)
    assert spelling.word_counts(frame.limit(0)).collect() == []


def test_spelling_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    expected = plain_variants(plain_counts([(r["doc_id"], r["text"]) for r in rows]))
    assert sorted(map(tuple, queries.op13(spark, sf).collect()), key=repr) == expected and len(expected) > 500
