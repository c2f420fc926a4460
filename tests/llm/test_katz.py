"""Katz scores against a plain model over all n-grams, and its probabilities against one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.llm import katz, toxicity


class Plain:
    """Counts of all n-grams in dictionaries, and the probability by plain recursion."""

    def __init__(self, texts, order):
        self.order, self.count, self.after = order, [Counter() for _ in range(order + 1)], defaultdict(list)
        for t in texts:
            self.count[1].update((w,) for w in t)
            padded = ("<s>", *t)
            for k in range(2, order + 1):
                self.count[k].update(padded[i:i + k] for i in range(len(padded) - k + 1))
        self.uni = {w: c for (w,), c in self.count[1].items()}
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.discounts = [None, *([float(x) for x in katz.good_turing([Counter(c.values())[r] for r in range(1, 7)])] for c in self.count[1:])]
        self.rest = 1 - sum(self.d(1, c) * c for c in self.uni.values()) / (self.n + katz.FLOOR)
        for c in self.count[2:]:
            for gram, n in c.items():
                self.after[gram[:-1]].append((gram[-1], n))
        self.weights = {}

    def d(self, k, c):
        return self.discounts[k][c] if c <= katz.KEPT else 1.0

    def p(self, h, w):
        if not h:
            c = self.uni.get(w, 0)
            return self.d(1, c) * c / (self.n + katz.FLOOR) if c else self.rest
        if h not in self.after:
            return self.p(h[1:], w)
        c, total = self.count[len(h) + 1].get((*h, w), 0), sum(n for _, n in self.after[h])
        if c:
            return self.d(len(h) + 1, c) * c / (total + katz.FLOOR)
        if h not in self.weights:
            left = 1 - sum(self.d(len(h) + 1, n) * n for _, n in self.after[h]) / (total + katz.FLOOR)
            self.weights[h] = left / (1 - sum(self.p(h[1:], x) for x, _ in self.after[h]))
        return self.weights[h] * self.p(h[1:], w)

    def score(self, t):
        padded = ("<s>", *t)
        return sum(math.log10(self.p(padded[max(0, i + 1 - self.order):i], padded[i])) for i in range(1, len(padded)))


def tokens(text):
    return [*(text or "").encode().lower().split(), "</s>"]


def compare(rows, learn, found, order):
    model = Plain([tokens(t) for (i, t), x in zip(rows, learn) if x], order)
    for h in [h for k in range(1, order) for h in [h for h in model.after if len(h) == k][:20]]:
        assert abs(sum(model.p(h, w) for w in model.uni) + model.p(h, "never") - 1) < 1e-9
    got = sorted((r["doc_id"], round(r["score"], 5), round(r["base_score"], 5), r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found)
    want = []
    for i, text in rows:
        t = tokens(text)
        want.append((i, round(model.score(t), 5),
                     round(sum(math.log10((model.uni.get(w, 0) + 0.1) / (model.n + 0.1 * (model.v + 1))) for w in t), 5),
                     len(t), sum(1 for w in t if model.uni.get(w)), model.n))
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    for g, w in zip(got, sorted(want)):
        assert g[1:] == pytest.approx(w[1:], abs=2e-5)


@pytest.mark.parametrize("order", [2, 3])
def test_documents(spark, sf, learns, order):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = katz.score(docs, toxicity.in_part("doc_id", 10) != 0, bucket_tokens=9000, order=order).collect()
    compare(rows, [learns(i, 10) for i, _ in rows], found, order)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_hot_words_pairs_blocks_and_edges(spark, docs_of, order):
    """A pair of words that makes a third of all tokens, contexts split over buckets, several blocks."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words) if r.random() < 0.5 else "the" for _ in range(r.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "THE the \x1c\x85 the"), (203, "never seen words"), (204, " ".join(["the"] * 3000)), (205, "ß é \U0001f600")]
    found = katz.score(docs_of(rows).repartition(5), F.col("doc_id") % 3 != 0, bucket_tokens=300, order=order).collect()
    compare(rows, [i % 3 != 0 for i, _ in rows], found, order)


def test_a_pair_is_one_entry_a_block_and_counts_are_stored(spark, docs_of, monkeypatch):
    made, keep = {}, katz.materialise
    monkeypatch.setattr(katz, "materialise", lambda df, name: made.setdefault(name, keep(df, name)))
    rows = [(1, "a b " * 300 + "c"), (2, "a b c")]
    katz.score(docs_of(rows).coalesce(1), F.lit(True), bucket_tokens=10_000, order=3).collect()
    assert made["grams-of-2"].where("kind = 'reply'").count() == 1  # one block, one bucket
    words = katz._unpack(made["grams-of-1"].where("kind = 'counts'").first()["data"])
    name = {w: i for i, w in enumerate(zlib.decompress(words["words"]).split(b" "))} | {"<s>": katz.START}
    pairs = {(r["context"], r["word"]): (r["count"], r["name"]) for r in katz.counted(made["grams-of-2"]).collect()}
    of = lambda x, y: (name[x], name[y])
    assert {k: c for k, (c, _) in pairs.items()} == {
        of("<s>", b"a"): 2, of(b"a", b"b"): 301, of(b"b", b"a"): 299, of(b"b", b"c"): 2, of(b"c", b"\n"): 2}
    triples = {(r["context"], r["word"]): r["count"] for r in katz.counted(made["grams-of-3"]).collect()}
    assert triples[(pairs[of(b"a", b"b")][1], name[b"a"])] == 299 and triples[(pairs[of(b"a", b"b")][1], name[b"c"])] == 2


def test_repeated_rows_null_ids_and_empty_tables(spark, docs_of):
    docs = docs_of([(1, "a b"), (1, "a b"), (None, "a c")])
    found = katz.score(docs, F.lit(True)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in found) == [(0, 3, 3), (1, 3, 3), (1, 3, 3)]
    assert all(np.isfinite(r["score"]) for r in found)
    none = katz.score(docs, F.lit(False)).collect()
    assert [r["score"] for r in none] == [0.0] * 3 and {r["train_tokens"] for r in none} == {0}
    assert katz.score(docs.limit(0), F.lit(True)).collect() == []


@pytest.mark.parametrize("n", [[100, 40, 20, 12, 8, 5], [1, 2, 3, 4, 5, 6], [5, 0, 0, 0, 0, 0], [], [1000, 10, 500, 20, 3, 1]])
def test_discounts_lie_between_zero_and_one(n):
    d = katz.good_turing((n + [0] * 6)[:6])
    assert len(d) == katz.KEPT + 1 and ((d[1:] > 0) & (d[1:] < 1)).all()
