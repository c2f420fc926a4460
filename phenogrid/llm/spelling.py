"""Spelling variants: words that differ by one edit, found with a bit-sliced position index.

Words are counted over all documents (summed in each task first). For the search every word is a bit:
the index of a set of words holds, for each position and letter, the bitset of the words with that letter
there. A query word is read letter by letter, for all words of the set at once: one bitset tracks the words without an
error so far, three others those with one error, after which the words are in step (replaced letter), one letter
ahead (inserted) or one behind (deleted), so they meet the index at the same, the next or the
previous position. 64 words take one machine word.

The sets stay small however large the vocabulary is, and no near pair is lost. Two words whose shorter has length
m and whose edit falls into the letters [a, b) share the first a and the last m-b letters. Each
word is filed under these for both halves of its length, once as the shorter and once as the longer partner;
files are joined to sets of about ``SET`` words. A file of more than ``FILE`` words is divided by halving
the interval of the edit, down to one letter, at which a file holds no more than the alphabet's square. So
nothing grows into one task, and no two parts of a file are paired.

NULL and empty texts have no words. A NULL id counts as an empty one in the hash below; repeated rows count
again. Further columns are ignored, and an empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.session import materialise

LETTERS = "A-Za-zÀ-ÿ"
SET = 1024
FILE = 2048
_INDEX_LETTERS = 1 << 16
_HELD = 300_000


def damaged(run: str, seed: int, every: int) -> str:
    """The run without one letter where the hash of document and run is a multiple of ``every``."""
    h = zlib.crc32(run.encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, min_letters: int = 6, min_count: int = 5, damage_every: int = 199,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with enough letters and occurrences, stored.

    Words are maximal runs of letters, A-Z in lower case; one in ``damage_every`` pairs of document and run loses
    a letter, chosen by the crc32 of ``<id>:<run>``.
    """
    find = re.compile(f"[{LETTERS}]{{{min_letters},}}").findall

    def packed(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{doc}:".encode())
                for run, times in Counter(find(text.encode("utf-8", "replace").lower().decode())).items():
                    word = damaged(run, seed, damage_every)
                    if len(word) >= min_letters:
                        held[word] += times
                if len(held) > _HELD:
                    yield packed(held)
                    held = Counter()
        yield packed(held)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("_text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counted.where(F.col("n") >= min_count), "word-counts")


class PositionIndex:
    """Bitsets of a set of words by position and letter; words are columns of uint64 lanes."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words])
        self.longest = int(self.lengths.max())
        self.lanes = -(-len(words) // 64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), self.lengths)
        at = np.arange(len(points)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.slots, row = np.unique(at << 21 | points, return_inverse=True)
        # the last row is that of letters which no word has there
        self.bits = np.zeros((len(self.slots) + 1, self.lanes), dtype=np.uint64)
        np.bitwise_or.at(self.bits, (row, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))

    def among(self, chosen: np.ndarray) -> np.ndarray:
        """Bitset of the words for which ``chosen`` is true."""
        padded = np.zeros(self.lanes * 64, dtype=np.uint8)
        padded[: len(chosen)] = chosen
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def letters(self, at: int, points: np.ndarray) -> np.ndarray:
        """For each query, the words with its letter at a position."""
        if not 0 <= at < self.longest:
            return self.bits[np.full(len(points), len(self.slots))]
        wanted = at << 21 | points
        place = np.minimum(np.searchsorted(self.slots, wanted), len(self.slots) - 1)
        return self.bits[np.where(self.slots[place] == wanted, place, len(self.slots))]

    def one_edit(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) by number that are one edit apart; all queries have the same length."""
        length = len(queries[0])
        points = np.frombuffer("".join(queries).encode("utf-32-le"), dtype="<u4").astype(np.int64).reshape(-1, length)
        shape = (len(queries), self.lanes)
        same = np.broadcast_to(self.among(self.lengths > -1), shape).copy()
        replaced, inserted, deleted = (np.zeros(shape, dtype=np.uint64) for _ in range(3))
        for i in range(length):
            letter = points[:, i]
            longer = self.among(self.lengths > i)
            inserted = (inserted | same & longer) & self.letters(i + 1, letter)
            deleted = deleted & self.letters(i - 1, letter) | same
            here = self.letters(i, letter)
            replaced = replaced & here | same & longer & ~here
            same = same & here
        inserted |= same & self.among(self.lengths > length)
        near = (replaced & self.among(self.lengths == length) | inserted & self.among(self.lengths == length + 1)
                | deleted & self.among(self.lengths == length - 1))
        query, lane = np.nonzero(near)
        flags = np.unpackbits(near[query, lane].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(flags)
        return query[row], lane[row] * 64 + bit


def near_in_set(words: list[str]) -> list[tuple[int, int]]:
    """Ordered pairs of distinct words of a set, by number, that are one edit apart."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    found, at = [], 0
    while at < len(words):
        # a part of the index is bounded in words and letters, also where words are very long
        to, letters = at, 0
        while to < len(words) and (to == at or to - at < 2 * FILE and letters + len(words[to]) <= _INDEX_LETTERS):
            letters += len(words[to])
            to += 1
        index = PositionIndex(words[at:to])
        for length, asked in by_length.items():
            if not np.any(np.abs(index.lengths - length) <= 1):
                continue
            for some in range(0, len(asked), 1024):
                numbers = asked[some:some + 1024]
                q, w = index.one_edit([words[i] for i in numbers])
                found += zip([numbers[i] for i in q.tolist()], (w + at).tolist())
        at = to
    return found


def _files(words: DataFrame) -> DataFrame:
    """(word, n, file) such that any two words one edit apart share a file, and no file is large."""
    def filed(rows):
        return rows.withColumn("file", F.expr("xxhash64(m, a, b, left(word, a), right(word, m - b))"))

    def halved(rows):
        middle = F.expr("(a + b) div 2").cast("int")
        parts = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
        return filed(rows.withColumn("_part", F.explode(parts)).select("word", "n", "m", F.col("_part.a").alias("a"), F.col("_part.b").alias("b")))

    partner = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = halved(words.select("word", "n", partner.alias("m")).where("m > 0").withColumns({"a": F.lit(0), "b": F.col("m")}))
    done = None
    while True:
        rows = materialise(rows, "spelling-files")
        large = rows.where("b - a > 1").groupBy("file").count().where(F.col("count") > FILE).select("file")
        large = materialise(large, "large-files")
        small = rows.join(large, "file", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done.select("word", "n", "file")
        rows = halved(rows.join(large, "file", "left_semi"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): every ordered pair of words one inserted, deleted or replaced letter apart, once."""
    filed = _files(words)
    sets = max(1, -(-filed.count() // SET))

    def search(table: pa.Table) -> pa.Table:
        held = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
        listed = sorted(held)
        pairs = near_in_set(listed)
        return pa.table({"word": pa.array([listed[a] for a, _ in pairs], pa.string()),
                         "other": pa.array([listed[b] for _, b in pairs], pa.string()),
                         "other_n": pa.array([held[listed[b]] for _, b in pairs], pa.int64())})

    placed = filed.select("word", "n", F.pmod("file", F.lit(sets)).alias("_set"))
    found = placed.groupBy("_set").applyInArrow(search, "word string, other string, other_n long")
    return found.dropDuplicates(["word", "other"])


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of (word, n); words must be distinct and not NULL.

    The form of a word is its near word of largest n, the first in code-point order among equals, if that n is at least
    ``times`` its own; the root is where its forms end.
    """
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("_best"))
    formed = F.col("_best.less") <= -times * F.col("n")
    known = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("_best.form")).alias("form"), F.when(formed, -F.col("_best.less")).alias("form_n")), "spelling-forms")
    # counts grow by ``times`` with every step, which bounds a chain; each round doubles the steps taken
    most, steps = known.agg(F.max("n")).first()[0] or 1, 0
    while times ** steps < most:
        steps += 1
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = materialise(roots.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
