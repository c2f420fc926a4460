"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each class, toxic and ordinary, has a model of the next letter given the ``ORDER - 1`` before it
inside a word, so inflected and compound forms of an expression share its evidence. Only the
highest order is the class's own; it is discounted and backs off to Kneser-Ney continuation
counts shared by both classes, so a letter sequence too rare to tell the classes apart gives
nearly the same probability in both. A text's evidence is the difference of the two
log-likelihoods divided by its number of words; a logistic curve fitted on labelled rows that
were kept out of the counts turns it into a score.

Counts are numbers of distinct labelled texts that hold a word, so copies of a text and repeated
words don't add evidence. Fitting reads at most about ``PER_CLASS`` labelled rows of each class,
drawn by a hash of the id, of at most ``FIT_CHARS`` code points; this bounds the model, which is
broadcast. Scoring reads every row and whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.session import materialise

ORDER = 4
DISCOUNT = 0.75
PER_CLASS = 16384
FIT_CHARS = 20_000
HELD_FOR_CURVE = 5
_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 300_000


@dataclass
class Model:
    """Log-likelihood ratios of letter sequences and of contexts alone, and the logistic curve."""

    grams: dict[str, float]
    contexts: dict[str, float]
    slope: float = 0.0
    offset: float = 0.0
    order: int = ORDER


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _distinct_words(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(set(words_of(t))) for t in texts])


def _ratios(counts: dict[str, tuple[int, int]], discount: float) -> tuple[dict, dict]:
    """ln P_toxic - ln P_ordinary of each seen sequence, and of a context with an unseen letter."""
    levels, low = [], set(counts)
    while low and len(next(iter(low))) > 1:
        cont = Counter(g[1:] for g in low)
        n, types = Counter(), Counter()
        for g, c in cont.items():
            n[g[:-1]] += c
            types[g[:-1]] += 1
        levels.append((cont, n, types))
        low = set(cont)
    letters = len(levels[-1][0]) + 1 if levels else 1
    known: dict[str, float] = {"": 1 / letters}

    def shared(g: str, at: int) -> float:
        if g not in known:
            cont, n, types = levels[at]
            below = shared(g[1:], at + 1)
            h = g[:-1]
            known[g] = (max(cont[g] - discount, 0) + discount * types[h] * below) / n[h] if n[h] else below
        return known[g]

    total, mass = (Counter(), Counter()), (Counter(), Counter())
    for g, both in counts.items():
        for side, c in enumerate(both):
            total[side][g[:-1]] += c
            mass[side][g[:-1]] += min(discount, c)
    backoff = lambda side, h: mass[side][h] / total[side][h] if total[side][h] else 1.0

    def p(side: int, g: str) -> float:
        h, below = g[:-1], shared(g[1:], 0)
        own = max(counts[g][side] - discount, 0) / total[side][h] if total[side][h] else 0.0
        return own + backoff(side, h) * below

    grams = {g: math.log(p(0, g) / p(1, g)) for g in counts}
    return grams, {h: math.log(backoff(0, h) / backoff(1, h)) for h in {g[:-1] for g in counts}}


def _evidence(model) -> callable:
    """Column function: mean ln ratio over the words of a text, NULL without words."""

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        m: Model = model.value
        seen: dict[str, float] = {}
        pad, k = "^" * (m.order - 1), m.order

        def of(word: str) -> float:
            s = f"{pad}{word}$"
            value = 0.0
            for i in range(len(s) - k + 1):
                g = s[i:i + k]
                r = m.grams.get(g)
                value += m.contexts.get(g[:-1], 0.0) if r is None else r
            if len(seen) >= _CACHED:
                seen.clear()
            seen[word] = value
            return value

        out = []
        for t in texts:
            words = words_of(t)
            out.append(sum([seen[w] if w in seen else of(w) for w in words]) / len(words) if words else None)
        return pd.Series(out, dtype="float64")

    return evidence


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps with a small penalty."""
    scale = float(np.std(x)) or 1.0
    design, b = np.column_stack([x / scale, np.ones_like(x)]), np.zeros(2)
    penalty = np.diag([0.01, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (weight * (y - p)) - penalty @ b
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hess, grad)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        may_learn: Column | None = None, per_class: int = PER_CLASS, fit_chars: int = FIT_CHARS) -> Model:
    """Model learned from the labelled rows for which ``may_learn`` holds.

    Rows without a text, id or label aren't learned from; repeated texts count once. Without rows
    of both classes there is no evidence: every score is then 0 (no toxic example) or 1. A row that
    is there several times with the same id and text counts as often.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where(
        "_id is not null and _toxic in (0, 1)").distinct()
    if may_learn is not None:
        marked = marked.withColumnRenamed("_id", id_col).where(may_learn).withColumnRenamed(id_col, "_id")
    sizes = {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model({}, {}, 0.0, 30.0 if sizes.get(1) else -30.0)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("_toxic") == 1, per_class / sizes[1]).otherwise(per_class / sizes[0])
    chosen = marked.where(draw < share)
    # about two times ``per_class`` ids, whatever the size of the tables: they are broadcast, so no text is shuffled
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h")).where(
        F.length("_text").between(1, fit_chars))
    first = materialise(texts.join(F.broadcast(chosen), "_id").groupBy("_toxic", "_h").agg(F.min("_id").alias("_id")), "chosen")
    rows = texts.join(F.broadcast(first), ["_id", "_h"])
    curve_row = F.pmod(F.col("_h"), F.lit(HELD_FOR_CURVE)) == 0

    words = rows.where(~curve_row).select("_toxic", F.explode(_distinct_words("_text")).alias("word")).groupBy("word").agg(
        F.sum("_toxic").alias("t"), F.sum(1 - F.col("_toxic")).alias("o"))
    padded = F.concat(F.lit("^" * (ORDER - 1)), "word", F.lit("$"))
    grams = words.select("t", "o", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))).alias("g")).groupBy("g").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o"))
    table = grams.toArrow().to_pydict()
    ratios = _ratios({g: (t, o) for g, t, o in zip(table["g"], table["t"], table["o"])}, DISCOUNT)
    model = Model(*ratios)
    value = docs.sparkSession.sparkContext.broadcast(model)
    held = rows.where(curve_row).select("_toxic", _evidence(value)("_text").alias("x")).dropna().toPandas()
    if held["_toxic"].nunique() == 2:
        y = held["_toxic"].to_numpy(float)
        # halfway between the classes' own shares and equal ones: missing a toxic text weighs more than its share
        weight = np.where(y == 1, (sizes[1] / y.sum()) * (sizes[0] / sizes[1]) ** 0.5, sizes[0] / (1 - y).sum())
        weight *= len(y) / weight.sum()
        model.slope, model.offset = _curve(held["x"].to_numpy(float), y, weight)
    else:
        model.slope, model.offset = 10.0, -2.0
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; texts without a word, NULL ones included, have no evidence.

    Rows stay as they are, repeated ones too; a column that already has the name is replaced.
    """
    value = docs.sparkSession.sparkContext.broadcast(model)
    x = F.coalesce(_evidence(value)(F.col(text_col)), F.lit(0.0))
    z = F.greatest(F.least(F.lit(model.slope) * x + F.lit(model.offset), F.lit(35.0)), F.lit(-35.0))
    return docs.withColumn(into, 1 / (1 + F.exp(-z)))


def in_part(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
