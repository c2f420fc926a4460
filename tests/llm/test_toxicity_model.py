"""The toxicity model against plain Kneser-Ney probabilities, and its counts against the labelled texts."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from phenogrid.llm import toxicity

D = toxicity.DISCOUNT


class Plain:
    """Probabilities by their definition; ``side`` is 0 for toxic and 1 for ordinary."""

    def __init__(self, counts):
        self.counts, self.held = counts, {}
        grams = set(counts)
        while len(next(iter(grams))) > 1:
            before = Counter(g[1:] for g in grams)
            self.held[len(next(iter(before)))] = before
            grams = set(before)
        self.letters = sorted(self.held[1])

    def shared(self, g):
        if not g:
            return 1 / (len(self.letters) + 1)
        same = {x: c for x, c in self.held[len(g)].items() if x[:-1] == g[:-1]}
        n = sum(same.values())
        if not n:
            return self.shared(g[1:])
        return max(same.get(g, 0) - D, 0) / n + D * len(same) / n * self.shared(g[1:])

    def left(self, side, h):
        own = [both[side] for g, both in self.counts.items() if g[:-1] == h]
        return sum(min(D, c) for c in own) / sum(own) if sum(own) else 1.0

    def p(self, side, g):
        total = sum(both[side] for x, both in self.counts.items() if x[:-1] == g[:-1])
        own = max(self.counts.get(g, (0, 0))[side] - D, 0) / total if total else 0.0
        return own + self.left(side, g[:-1]) * self.shared(g[1:])


def grams_of(words):
    return [f"^^^{w}$"[i:i + 4] for w in words for i in range(len(w) + 1)]


def test_probabilities_are_plain_ones_and_sum_to_one():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 7))) for _ in range(60)]
    counts = {}
    for i, w in enumerate(words):
        for g in grams_of([w]):
            t, o = counts.get(g, (0, 0))
            counts[g] = (t + (i % 3 == 0), o + (i % 3 > 0))
    plain = Plain(counts)
    for side in (0, 1):
        for h in {g[:-1] for g in counts} | {"zzz"}:
            assert sum(plain.p(side, h + x) for x in [*plain.letters, "?"]) == pytest.approx(1)
    grams, contexts = toxicity._ratios(counts, D)
    assert set(grams) == set(counts) and set(contexts) == {g[:-1] for g in counts}
    for g, value in grams.items():
        assert value == pytest.approx(math.log(plain.p(0, g) / plain.p(1, g)), abs=1e-9)
    for h, value in contexts.items():
        assert value == pytest.approx(math.log(plain.left(0, h) / plain.left(1, h)), abs=1e-9)


def test_fit_counts_each_labelled_text_once(spark, docs_of):
    """Copies count once, texts that the curve is fitted on aren't counted, evidence is the mean over words."""
    texts = {i: f"{'bad' if i % 2 else 'good'} word{'s' * (i % 3)} {chr(97 + i % 26) * 3} {chr(98 + i % 11)}x" for i in range(120)}
    rows = [*texts.items(), *[(1000 + i, texts[i]) for i in range(0, 120, 7)], (2000, None), (2001, "")]
    labels = spark.createDataFrame([(i, i % 2 if i < 1000 else (i - 1000) % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(rows), labels)
    counts = {}
    for i, t in texts.items():
        if any(texts[j] == t and j % 2 == i % 2 for j in range(i)):
            continue
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        if (h - (1 << 64) if h >> 63 else h) % toxicity.HELD_FOR_CURVE:
            for g in grams_of(set(toxicity.words_of(t))):
                x, y = counts.get(g, (0, 0))
                counts[g] = (x + i % 2, y + 1 - i % 2)
    plain = Plain(counts)
    assert set(model.grams) == set(counts)
    for g, value in model.grams.items():
        assert value == pytest.approx(math.log(plain.p(0, g) / plain.p(1, g)), abs=1e-9)
    new = [(1, "bad words"), (2, "good xx"), (3, "qqq"), (4, None)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(new), model).collect()}
    for i, t in new:
        words = toxicity.words_of(t)
        x = sum(math.log(plain.p(0, g) / plain.p(1, g)) for g in grams_of(words)) / len(words) if words else 0.0
        z = min(max(model.slope * x + model.offset, -35), 35)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
