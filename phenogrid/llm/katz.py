"""Katz backoff model of n-grams (of two words unless told otherwise): counts over all training texts, scores for all texts.

    P(w | h) = d_r · c(h w) / (c(h) + FLOOR)          if the n-gram was seen, r its count
             = a(h) · P(w | h without its first word) else; a(h) makes the sum over all w exactly one
    P(w)     = d_r · c(w) / (N + FLOOR), and what is left over for the one class of unknown words

A context that was never seen is shortened too, with weight one. ``d_r`` are Good-Turing discounts
for counts up to five, for each length of n-grams its own; ``FLOOR`` (0.01 of an event) keeps
something over for unseen words where every count is above five. Each text starts with a start
context and ends with an end token.

How the work is spread: texts are packed into blocks of at most ``BLOCK_TOKENS`` tokens (a longer
text is a block of its own) with their own word lists, stored once. Then there is one round for
each length of n-grams, words first. A block sends its distinct n-grams, each once with its count
in the block's training texts, to a bucket, of the word or of the context; so an n-gram of any
frequency is one entry a block. Contexts with more than a fair share of the tokens are split over
several buckets by the next word. A bucket adds the counts up, stores them (a table for each
length, a row for each bucket; ``counted`` reads it), and answers each block with the counts of
its n-grams, in the order in which they came, and with the sums that the weights of contexts with
unseen n-grams follow from. Sums of split contexts are added up and joined to the blocks that need
them. An n-gram's place in its bucket is its name as a context of the next round, so keys stay two
numbers at every length. The block then evaluates its tokens from the shortest n-grams to the
longest. No count, word or text is dropped, and only a few sums come to the driver.
"""

from __future__ import annotations

import math
import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.session import materialise

BLOCK_TOKENS = 2_000_000
BUCKET_TOKENS = 2_000_000
_SOME = 1 << 18
KEPT = 5
ORDER = 2
FLOOR = 0.01
#: The end token: words have no blanks, so no word is equal to it.
END = b"\n"
UNKNOWN, START = 1 << 62, (1 << 62) + 1
PIECE = "kind string, level int, bucket long, block long, context long, nums array<double>, data binary"
# numbers that a row doesn't have are -1: pandas would turn a column with gaps into doubles
PIECES = ["kind", "level", "bucket", "block", "context", "nums", "data"]
DOC = ("doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, "
       "base_score double, score double")


def _pack(**parts) -> bytes:
    return pickle.dumps(parts, protocol=5)


def _unpack(data: bytes) -> dict:
    return pickle.loads(data)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of the same weight together: sorted differences then compress well."""
    if not len(values):
        return zlib.compress(b"")
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def _blocks(batches):
    """Packs texts into blocks: per token the place of its word in the block's word list."""
    ids, learn, lengths, codes, index, size, number = [], [], [], [], {}, 0, 0
    task = TaskContext.get().partitionId()

    def emit():
        n = np.array(lengths, dtype=np.int64)
        data = _pack(docs=ids, learn=learn, lengths=_planes(n), codes=_planes(np.concatenate(codes)), words=zlib.compress(b" ".join(index), 1))
        return _arrow([("text", 0, -1, task << 32 | number, -1, [float(n[learn].sum()), float(sum(learn))], data)])

    for batch in batches:
        for doc, text, may in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or "").encode("utf-8", "replace")
            words = words.lower().split()
            words.append(END)
            codes.append(np.array([index.setdefault(w, len(index)) for w in words], dtype="<u4"))
            ids.append(doc)
            learn.append(bool(may))
            lengths.append(len(words))
            size += len(words)
            if size >= BLOCK_TOKENS:
                yield emit()
                ids, learn, lengths, codes, index, size, number = [], [], [], [], {}, 0, number + 1
    if ids:
        yield emit()


def _words_sent(buckets: int):
    """From a block, a row for each bucket: its words and their counts in training texts."""
    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                x = _unpack(data.as_py())
                words = zlib.decompress(x["words"]).split(b" ")
                doc = np.repeat(np.array(x["learn"], dtype=bool), _unplanes(x["lengths"], "<i8"))
                trained = np.bincount(_unplanes(x["codes"], "<u4")[doc], minlength=len(words))
                order, to = _word_buckets(words, buckets)
                for a, b in _cuts(to):
                    own = order[a:b]
                    yield _arrow([("grams", 1, int(to[a]), block, -1, None, _pack(
                        words=zlib.compress(b" ".join([words[i] for i in own.tolist()]), 1), counts=_planes(trained[own])))])
    return run


def _word_buckets(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in the order of their buckets, and these."""
    to = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)).astype(np.int64) % buckets
    order = np.argsort(to, kind="stable")
    return order, to[order]


def _count_words(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of words: their counts, and answers to the blocks that sent them; frequent words come first."""
    rows = rows.sort_values("block")
    bucket, index, at, trained = int(rows["bucket"].iloc[0]), {}, [], []
    for data in rows["data"]:
        x = _unpack(data)
        at.append(np.array([index.setdefault(w, len(index)) for w in zlib.decompress(x["words"]).split(b" ")], dtype=np.int64))
        trained.append(_unplanes(x["counts"], "<i8"))
    c = np.bincount(np.concatenate(at), np.concatenate(trained), len(index)).astype(np.int64)
    order = np.argsort(-c, kind="stable")
    place = np.empty(len(order), dtype="<u4")
    place[order] = np.arange(len(order))
    words = list(index)
    seen = order[:int((c > 0).sum())]
    out = [("counts", 1, bucket, -1, -1, [*[float((c == r).sum()) for r in range(1, KEPT + 2)], float(len(seen))], _pack(
        words=zlib.compress(b" ".join([words[i] for i in seen.tolist()]), 1), counts=_planes(c[seen])))]
    out += [("reply", 1, bucket, int(block), -1, None, _pack(counts=_planes(c[own]), places=_planes(place[own])))
            for block, own in zip(rows["block"], at)]
    return _frame(out)


def good_turing(of_count: list[float], kept: int = KEPT) -> np.ndarray:
    """Discounts d_0..d_kept from the numbers of types with counts 1..kept+1; d_0 isn't used.

    Where these numbers as they are give no discount between 0 and 1 for some count (small or
    copied corpora), they are smoothed by a line through their logarithms, as simple Good-Turing
    does, which makes d_r a power of 1 + 1/r; and if that line isn't steep enough for a discount,
    half an event is taken off each count.
    """
    n = np.array([0.0, *of_count])
    r = np.arange(1, kept + 1)
    if (n[1:] > 0).all():
        tail = (kept + 1) * n[kept + 1] / n[1]
        d = ((r + 1) * n[2:] / (r * n[1:-1]) - tail) / (1 - tail) if tail < 1 else np.zeros(kept)
        if ((d > 0) & (d < 1)).all():
            return np.append(1.0, d)
    there = np.flatnonzero(n > 0)
    slope = np.polyfit(np.log(there), np.log(n[there]), 1)[0] if len(there) > 1 else 0.0
    return np.append(1.0, (1 + 1 / r) ** (slope + 1) if slope < -1 else (r - 0.5) / r)


@dataclass
class Unigrams:
    """What P(w) takes besides the count of w."""

    total: int
    types: int
    texts: int
    of_count: list[float]

    def __post_init__(self):
        self.discounts = good_turing(self.of_count)
        r = np.arange(1, KEPT + 1)
        low = np.array(self.of_count[:KEPT]) * r
        self.unknown = 1.0 - (float((low * self.discounts[1:]).sum()) + self.total - float(low.sum())) / (self.total + FLOOR)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, _discounted(count, self.discounts) / (self.total + FLOOR), self.unknown)


def _mix(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _buckets_of(context: np.ndarray, word: np.ndarray, parts: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of n-grams, some at a time; a context of several parts is divided by the next word."""
    to = np.empty(len(word), dtype=np.int32)
    for i in range(0, len(word), _SOME):
        own = slice(i, i + _SOME)
        part = (_mix(word[own].astype(np.uint64) + np.uint64(7)) >> np.uint64(20)) % parts[own].astype(np.uint64)
        h = _mix(_mix(context[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part))
        to[own] = (h >> np.uint64(24)) % np.uint64(buckets)
    return to


def _cuts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(sorted_values):
        return []
    at = [0, *(np.flatnonzero(np.diff(sorted_values)) + 1).tolist(), len(sorted_values)]
    return list(zip(at, at[1:]))


def _discounted(count: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return np.where(count <= KEPT, discounts[np.minimum(count, KEPT)], 1.0) * count


class Tokens:
    """A block's tokens and, length by length, their contexts, n-grams and scores.

    Of a token only its word ``code``, its context ``own`` (-1 if that wasn't seen) and its n-gram
    ``kind`` (-1 without a context) are kept, as places in lists, and ``score``, the log10
    probability by what is known so far. The lists are in the order of the global numbers: ``words``
    and their counts, ``names`` of contexts, their counts ``totals`` and those of the shorter
    contexts ``belows``, and ``counts`` of the n-grams one word shorter than those to come.
    """

    def __init__(self, rows: pd.DataFrame, uni: Unigrams, buckets: int):
        x = _unpack(rows["data"][rows["kind"] == "text"].iloc[0])
        self.uni, self.buckets = uni, buckets
        self.docs, self.may, self.lengths = x["docs"], x["learn"], _unplanes(x["lengths"], "<i8")
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        words = zlib.decompress(x["words"]).split(b" ")
        names, counts = np.full(len(words), UNKNOWN, dtype=np.int64), np.zeros(len(words), np.int64)
        order, to = _word_buckets(words, buckets)
        del words
        first = rows[(rows["level"] == 1) & (rows["kind"] == "reply")]
        data = dict(zip(first["bucket"], first["data"]))
        for a, b in _cuts(to):
            y = _unpack(data.pop(int(to[a])))
            c = counts[order[a:b]] = _unplanes(y["counts"], "<i8")
            names[order[a:b]] = np.where(c > 0, int(to[a]) << 32 | _unplanes(y["places"], "<u4").astype(np.int64), UNKNOWN)
        order = np.argsort(names, kind="stable")
        known = int((counts > 0).sum())
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.minimum(np.arange(len(order)), known)  # all unknown words are one
        self.words = np.append(names[order[:known]], UNKNOWN)
        self.code = self.kind = place[_unplanes(x["codes"], "<u4")]
        self.counts = np.append(counts[order[:known]], 0)
        self.score = np.log10(uni.p(self.counts))[self.code]
        # the start context is behind all words, unknown ones aren't seen
        self.names = np.append(self.words, START)
        self.totals = np.append(self.counts, uni.texts)
        self.belows = np.full(len(self.names), uni.total, dtype=np.int64)
        self._shift(np.where(self.totals > 0, np.arange(len(self.names), dtype=np.int32), np.int32(-1)), len(self.words))

    def _shift(self, place: np.ndarray, start: int) -> None:
        """Each token's context is the n-gram before it; ``place`` of the one ``start`` at the start of a text."""
        self.own = np.empty(len(self.kind), dtype=np.int32)
        self.own[1:] = np.where(self.kind[:-1] >= 0, place[self.kind[:-1]], np.int32(-1))
        self.own[self.starts] = place[start] if start >= 0 else -1

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(values) else np.zeros(0)

    def find(self) -> np.ndarray:
        """The block's distinct n-grams, in the order of their buckets; gives the tokens that have one."""
        at = np.flatnonzero(self.own >= 0).astype(np.int32)
        key = self.own[at].astype(np.int64) << 32 | self.code[at]
        keys, kind = np.unique(key, return_inverse=True)
        del key
        self.of, self.next = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)
        self.lower = np.zeros(len(keys), np.int64)
        self.lower[kind] = np.where(self.kind[at] >= 0, self.counts[self.kind[at]], 0)
        self.kind = np.full(len(self.code), -1, dtype=np.int32)
        self.kind[at] = kind
        self.parts = np.maximum(1, np.ceil(self.totals / max(1.0, self.uni.total / (4 * self.buckets)))).astype(np.int64)
        to = _buckets_of(self.names[self.of], self.words[self.next], self.parts[self.of], self.buckets)
        self.order = np.argsort(to.astype(np.uint16) if self.buckets <= 1 << 16 else to, kind="stable").astype(np.int32)
        self.to = to[self.order]
        return at

    def sent(self, level: int, block: int):
        """A row for each bucket: contexts, next words, counts in training texts, counts after the shorter context."""
        at = self.find()
        doc = np.repeat(np.array(self.may, dtype=bool), self.lengths)[at]
        trained = np.bincount(self.kind[at[doc]], minlength=len(self.of))
        for a, b in _cuts(self.to):
            own = self.order[a:b]
            split = np.unique(self.of[own][self.parts[self.of[own]] > 1])
            yield ("grams", level, int(self.to[a]), block, -1, None, pickle.dumps((
                _planes(np.diff(self.names[self.of[own]], prepend=0)), _planes(self.words[self.next[own]]),
                _planes(trained[own].astype("<u4")), _planes(self.lower[own]), self.names[split])))

    def learn(self, replies: pd.DataFrame, discounts: np.ndarray) -> None:
        """Takes the buckets' answers to what ``sent`` sent, and goes on to contexts one word longer."""
        at = self.find()
        count, name = np.zeros(len(self.of), np.int64), np.zeros(len(self.of), np.int64)
        sums = np.zeros((KEPT + 2, len(self.names)))
        data = dict(zip(replies["bucket"][replies["kind"] == "reply"], replies["data"][replies["kind"] == "reply"]))
        for a, b in _cuts(self.to):
            own, bucket = self.order[a:b], int(self.to[a])
            c, place, stats = _unpack(data.pop(bucket)).values()
            count[own] = _unplanes(c, "<i8")
            name[own] = bucket << 32 | np.cumsum(_unplanes(place, "<u4").astype(np.int64))
            sums[:, np.unique(self.of[own][count[own] == 0])] = _unplanes(stats, "<f8").reshape(KEPT + 2, -1)
        for context, nums in zip(replies["context"][replies["kind"] == "sums"], replies["nums"][replies["kind"] == "sums"]):
            sums[:, np.searchsorted(self.names, context)] = nums
        weight = np.log10(backoff(sums, self.totals, self.belows, discounts))
        with np.errstate(divide="ignore"):
            seen = np.log10(_discounted(count, discounts) / (self.totals[self.of] + FLOOR))
        kind = self.kind[at]
        self.score[at] = np.where(count[kind] > 0, seen[kind], weight[self.of[kind]] + self.score[at])
        self.counts = count
        longer = np.flatnonzero(count > 0)
        longer = longer[np.argsort(name[longer], kind="stable")]
        place = np.full(max(1, len(count)), -1, dtype=np.int32)
        place[longer] = np.arange(len(longer))
        self.names, self.totals, self.belows = name[longer], count[longer], self.lower[longer]
        self._shift(place, -1)


def backoff(sums: np.ndarray, totals: np.ndarray, belows: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """a(h): what the seen words leave over, divided by what the shorter context gives to all others.

    ``sums`` has, over the words seen after h: how many have each low count, the events of the
    others, and their discounted counts after the shorter context.
    """
    r = np.arange(1, KEPT + 1)[:, None]
    used = (sums[:KEPT] * r * discounts[1:, None]).sum(axis=0) + sums[KEPT]
    return (1.0 - used / (totals + FLOOR)) / (1.0 - sums[KEPT + 1] / (belows + FLOOR))


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(PIECES, r)) for r in rows], schema=_PIECES)


_PIECES = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()),
                     ("context", pa.int64()), ("nums", pa.list_(pa.float64())), ("data", pa.binary())])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=PIECES)


def _catch_up(tokens: Tokens, rows: pd.DataFrame, discounts: list[np.ndarray]) -> Tokens:
    """The block's tokens after all rounds so far."""
    for level, d in enumerate(discounts[1:], 2):
        tokens.learn(rows[rows["level"] == level], d)
    return tokens


def _sent(uni, buckets: int, discounts: list[np.ndarray]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = _catch_up(Tokens(rows, uni.value, buckets), rows, discounts)
        return _frame(list(tokens.sent(len(discounts) + 1, int(rows["block"].iloc[0]))))
    return run


def _count_bucket(level: int, shorter: np.ndarray):
    """One bucket: its n-grams' counts, and answers to the blocks that sent them."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        bucket, sizes, contexts, words, trained, lower, split = int(rows["bucket"].iloc[0]), [], [], [], [], [], []
        for data in rows["data"]:
            h, w, n, c, s = pickle.loads(data)
            contexts.append(np.cumsum(_unplanes(h, "<i8")))
            words.append(_unplanes(w, "<i8"))
            trained.append(_unplanes(n, "<u4"))
            lower.append(_unplanes(c, "<i8"))
            split.append(s)
            sizes.append(len(words[-1]))
        contexts, of = np.unique(np.concatenate(contexts), return_inverse=True)
        words, word = np.unique(np.concatenate(words), return_inverse=True)
        keys, at = np.unique(of.astype(np.int64) << 32 | word, return_inverse=True)
        del word
        c = np.bincount(at, np.concatenate(trained), len(keys)).astype(np.int64)
        below = np.empty(len(keys), np.int64)
        below[at] = np.concatenate(lower)
        of, seen, split = keys >> 32, c > 0, np.isin(contexts, np.concatenate(split))
        sums = np.stack([np.bincount(of, c == r, len(contexts)) for r in range(1, KEPT + 1)] + [
            np.bincount(of, np.where(c > KEPT, c, 0), len(contexts)),
            np.bincount(of, np.where(seen, _discounted(below, shorter), 0.0), len(contexts))])
        out = [("counts", level, bucket, -1, -1, [float((c == r).sum()) for r in range(1, KEPT + 2)], _pack(
            contexts=_planes(np.diff(contexts[of[seen]], prepend=0)), words=_planes(words[keys[seen] & 0xFFFFFFFF]),
            places=_planes(np.diff(np.flatnonzero(seen), prepend=0).astype("<u4")), counts=_planes(c[seen])))]
        out += [("split", level, bucket, -1, int(contexts[i]), sums[:, i].tolist(), None) for i in np.flatnonzero(split)]
        start = 0
        for block, n in zip(rows["block"], sizes):
            own = at[start:start + n]
            start += n
            unseen = np.unique(of[own][c[own] == 0])
            out.append(("reply", level, bucket, int(block), -1, None, _pack(
                counts=_planes(c[own]), places=_planes(np.diff(own, prepend=0).astype("<u4")), sums=_planes(sums[:, unseen].ravel()))))
            out += [("need", level, bucket, int(block), int(contexts[i]), None, None) for i in unseen[split[unseen]]]
        return _frame(out)
    return run


def counted(table: DataFrame) -> DataFrame:
    """(level, context, word, name, count) for every seen n-gram of two words or more in a stored table of counts.

    ``word`` and, at level two, ``context`` are names of words, above that ``context`` is the ``name``
    of an n-gram one word shorter. A name is the bucket above 32 bits and the place in it below.
    """
    def run(batches):
        for batch in batches:
            for level, bucket, data in zip(batch.column("level").to_pylist(), batch.column("bucket").to_pylist(), batch.column("data")):
                x = _unpack(data.as_py())
                words = _unplanes(x["words"], "<i8")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(words), level, np.int32)), pa.array(np.cumsum(_unplanes(x["contexts"], "<i8"))), pa.array(words),
                    pa.array(bucket << 32 | np.cumsum(_unplanes(x["places"], "<u4").astype(np.int64))),
                    pa.array(_unplanes(x["counts"], "<i8"))], names=["level", "context", "word", "name", "count"])
    return table.where("kind = 'counts'").mapInArrow(run, "level int, context long, word long, name long, count long")


def _finished(uni, buckets: int, discounts: list[np.ndarray]):
    """One block: the values of its texts."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        u: Unigrams = uni.value
        tokens = Tokens(rows, u, buckets)
        known = tokens.per_doc((tokens.counts > 0)[tokens.code].astype(np.int64))
        base = tokens.per_doc(np.log10((tokens.counts + 0.1) / (u.total + 0.1 * (u.types + 1)))[tokens.code])
        _catch_up(tokens, rows, discounts)
        return pd.DataFrame({
            "doc_id": pd.array(tokens.docs, dtype="Int64"), "learned": tokens.may, "n_tokens": tokens.lengths, "n_known": known,
            "train_tokens": u.total, "base_score": base, "score": tokens.per_doc(tokens.score)})
    return run


def score(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
          bucket_tokens: int = BUCKET_TOKENS, order: int = ORDER) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The model has n-grams of up to ``order`` words (two at least) and learns from the rows for which ``may_learn`` is true. NULL and empty texts are an
    end token only; repeated rows count and are scored each; a NULL id stays NULL (and its row is
    learned from only if ``may_learn`` says so). Without training rows every word is unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(may_learn, F.lit(False)).alias("_learn"))
    known = materialise(rows.mapInArrow(_blocks, PIECE), "blocks")
    size = known.agg(F.sum(F.get("nums", F.lit(0))).alias("tokens"), F.sum(F.get("nums", F.lit(1))).alias("texts")).first()
    total, texts = int(size["tokens"] or 0), int(size["texts"] or 0)
    buckets = max(1, math.ceil(total / bucket_tokens))

    discounts, uni = [], None
    for level in range(1, order + 1):
        if level == 1:
            sent, count = known.mapInArrow(_words_sent(buckets), PIECE), _count_words
        else:
            sent = known.groupBy("block").applyInPandas(_sent(uni, buckets, list(discounts)), PIECE)
            count = _count_bucket(level, discounts[-1])
        counts = materialise(sent.groupBy("bucket").applyInPandas(count, PIECE), f"grams-of-{level}")
        of_count = {r["pos"]: r["n"] for r in counts.where("kind = 'counts'").select(F.posexplode("nums")).groupBy("pos").agg(
            F.sum("col").alias("n")).collect()}
        known = known.unionByName(counts.where("kind = 'reply'"))
        if level == 1:
            unigrams = Unigrams(total, int(of_count.get(KEPT + 1, 0)), texts, [of_count.get(i, 0) for i in range(KEPT + 1)])
            uni = spark.sparkContext.broadcast(unigrams)
            discounts.append(unigrams.discounts)
            continue
        discounts.append(good_turing([of_count.get(i, 0) for i in range(KEPT + 1)]))
        whole = counts.where("kind = 'split'").groupBy("context").agg(F.array(*[
            F.sum(F.get("nums", F.lit(i))) for i in range(KEPT + 2)]).alias("nums"))
        known = known.unionByName(counts.where("kind = 'need'").select("block", "context").distinct().join(whole, "context").select(
            F.lit("sums").alias("kind"), F.lit(level).alias("level"), F.lit(-1).cast("long").alias("bucket"), "block", "context", "nums",
            F.lit(None).cast("binary").alias("data")))
    return known.groupBy("block").applyInPandas(_finished(uni, buckets, discounts), DOC).withColumnRenamed("doc_id", id_col)
