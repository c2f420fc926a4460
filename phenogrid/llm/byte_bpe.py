"""Byte-level BPE: encoding by ranked merges, decoding by putting the ids' bytes together.

``fold_merges`` is a column expression of higher-order functions: a word becomes an array of its
bytes, and a fold merges the neighbours whose concatenation has the lowest rank, leftmost first,
until no neighbours have one. Ranks are a literal: an array of small maps, dealt by a hash of the
sequence, because Spark scans the keys of a map one after the other. The ranks of the current
neighbours are carried along, so a merge looks up two sequences at most. Bytes are written as
Latin-1 characters inside these expressions.

It is applied to distinct words, of which text repeats most: those in chunks that a task meets
twice, the ``FREQUENT`` most frequent ones over all rows at most, each of ``LONGEST`` bytes at most.
This bounded dictionary is broadcast. Every other word is folded where it stands by the same
merges: words of one length together in ``Merges``, long ones in ``merge_word``; folding all of them
by the expression costs several times the time.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.session import materialise

FREQUENT = 1 << 18
LONGEST = 64
MAPS = 16384
_NONE = 1 << 30
_CACHED = 250_000
# chunks kept by a worker in each of two generations, and characters of texts that it encodes together
_KEPT = 100_000
_TOGETHER = 1 << 18
# words of more bytes, or of a length that few others have, are merged one by one
_SHORT, _FEW = 32, 8
# cuts only where a run of white space begins, so no match of a pattern of this family crosses a cut
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
_BLANKS = frozenset(filter(re.compile(f"[{_BLANK}]").match, map(chr, range(0x3001))))
ENCODED = "struct<token_ids: array<int>, decoded: binary>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 sequence and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _rank_maps(ranks: dict[bytes, int]) -> Column:
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for sequence, rank in ranks.items():
        s = sequence.decode("latin-1")
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        maps[(h - (1 << 64) if h >> 63 else h) % MAPS][s] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """array<int>: the ids of one word (a match of the pattern). NULL gives NULL, '' an empty array."""
    none = F.array().cast("array<int>")

    def with_maps(maps: Column) -> Column:
        def rank(s: Column) -> Column:
            return F.coalesce(F.get(maps, F.pmod(F.xxhash64(s), F.lit(MAPS)).cast("int"))[s], F.lit(_NONE))

        def merge(state: Column, _: Column) -> Column:
            parts, held = state["parts"], state["ranks"]
            best = F.array_min(held)

            def at(j: Column) -> Column:
                def put(new: Column) -> Column:
                    left = F.when(j > 1, F.array(rank(F.concat(F.get(parts, j - 2), new)))).otherwise(none)
                    right = F.when(j < F.size(held), F.array(rank(F.concat(new, F.get(parts, j + 1))))).otherwise(none)
                    before = F.when(j > 2, F.slice(held, 1, j - 2)).otherwise(none)
                    return F.struct(
                        F.concat(F.slice(parts, 1, j - 1), F.array(new), F.slice(parts, j + 2, F.size(parts))).alias("parts"),
                        F.concat(before, left, right, F.slice(held, j + 2, F.size(parts))).alias("ranks"))
                return _let(F.concat(F.get(parts, j - 1), F.get(parts, j)), put)

            return F.when(best < _NONE, _let(F.array_position(held, best).cast("int"), at)).otherwise(state)

        def folded(parts: Column) -> Column:
            pairs = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts)),
                               lambda a, b: rank(F.concat(a, b)))
            start = F.struct(parts.alias("parts"), pairs.alias("ranks"))
            return F.when(F.size(parts) < 2, parts).otherwise(F.aggregate(
                F.sequence(F.lit(2), F.size(parts)), start, merge, lambda s: s["parts"]))

        return F.transform(_let(F.array_remove(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), ""), folded), rank)

    return _let(_rank_maps(ranks), with_maps)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the same merges; a heap of neighbours keeps long words in n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        # stale unless both parts are as they were when the pair was entered
        if ends[i] != j or j >= n or ends[j] != end:
            continue
        ends[i], ends[j] = end, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            r = ranks.get(word[i:ends[after[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end, ends[after[i]]))
        if i > 0:
            p = before[i]
            r = ranks.get(word[p:end])
            if r is not None:
                heapq.heappush(heap, (r, p, i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:ends[i]]])
        i = ends[i]
    return out


class Merges:
    """Merges words of the same length together: each round joins the first best neighbours of every word left.

    A sequence is known by its rank. Bytes without a rank have numbers above all ranks, and may not be left in the end.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.top = ranks, max(ranks.values()) + 1
        number = {bytes([b]): self.top + b for b in range(256)} | ranks
        self.many = self.top + 256
        pairs = {number[a] * self.many + number[b]: rank for s, rank in ranks.items() for i in range(1, len(s))
                 if (a := s[:i]) in number and (b := s[i:]) in number}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([*[pairs[k] for k in self.keys.tolist()], _NONE], dtype=np.int32)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.of_byte = np.array([number[bytes([b])] for b in range(256)], dtype=np.int32)
        every = self.of_byte.astype(np.int64)
        self.of_bytes = self._rank(every[:, None], every[None, :])

    def _rank(self, left, right):
        key = left * self.many + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE).astype(np.int32)

    def _same_length(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)
        rows, ids, held = np.arange(len(words)), self.of_byte[raw], self.of_bytes[raw[:, :-1], raw[:, 1:]]
        while len(rows):
            n = held.shape[1]
            line = np.arange(len(rows))
            j = held.argmin(axis=1) if n else np.zeros(len(rows), dtype=np.int64)
            best = held[line, j] if n else np.full(len(rows), _NONE, dtype=np.int32)
            ended = best == _NONE
            if ended.any():
                if (ids[ended] >= self.top).any():
                    raise KeyError("a byte without a rank")
                blob, size = ids[ended].astype("<i4").tobytes(), 4 * ids.shape[1]
                for k, row in enumerate(rows[ended].tolist()):
                    out[row] = blob[k * size:(k + 1) * size]
                going = ~ended
                rows, ids, held, j, best = rows[going], ids[going], held[going], j[going], best[going]
                if not len(rows):
                    break
                line = np.arange(len(rows))
            # the two become one at j; the pair at j goes, and those on both sides are new
            ids[line, j] = best
            later = np.arange(n)[None, :] > j[:, None]
            ids = np.where(later, ids[:, 1:], ids[:, :-1])
            held = np.where(later[:, 1:] | (np.arange(n - 1)[None, :] == j[:, None]), held[:, 1:], held[:, :-1])
            wide = ids.astype(np.int64)
            left, right = np.flatnonzero(j > 0), np.flatnonzero(j < n - 1)
            held[left, j[left] - 1] = self._rank(wide[left, j[left] - 1], wide[left, j[left]])
            held[right, j[right]] = self._rank(wide[right, j[right]], wide[right, j[right] + 1])
        return out

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed."""
        out: list[bytes] = [b""] * len(words)
        alike: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            rank = self.ranks.get(w)
            if rank is None:
                alike.setdefault(len(w), []).append(i)
            else:
                out[i] = rank.to_bytes(4, "little")
        for length, places in alike.items():
            if 0 < length <= _SHORT and len(places) >= _FEW:
                found = self._same_length([words[i] for i in places])
            else:
                found = [np.array(merge_word(words[i], self.ranks), dtype="<i4").tobytes() for i in places]
            for i, ids in zip(places, found):
                out[i] = ids
        return out


def _count_chunks(batches):
    """(chunk, n) of a task's texts, for chunks that come twice before the counter is emptied."""
    chunks: Counter = Counter()

    def emit():
        kept = [(c, n) for c, n in chunks.items() if n > 1 and len(c) <= LONGEST]
        chunks.clear()
        return pd.DataFrame(kept, columns=["chunk", "n"])

    for batch in batches:
        for text in batch.iloc[:, 0]:
            if text:
                chunks.update(_CHUNK.findall(text))
            if len(chunks) > _CACHED:
                yield emit()
    if chunks:
        yield emit()


def frequent_words(docs: DataFrame, pattern: str, text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """(word, n): the pattern's distinct matches that occur most often, at most ``most``.

    The least count that leaves no more than ``most`` words is found from a histogram of counts
    (bins an eighth of a doubling apart), so nothing is sorted or gathered.
    """
    chunks = docs.select(text_col).mapInPandas(_count_chunks, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    words = chunks.select("n", F.explode(F.regexp_extract_all("chunk", F.lit(f"(?U){pattern}"), 0)).alias("word"))
    counts = materialise(words.where(F.octet_length("word").between(1, LONGEST)).groupBy("word").agg(F.sum("n").alias("n")), "words")
    bins = counts.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count("*").alias("words")).collect()
    left, least = most, None
    for row in sorted(bins, key=lambda r: -r["bin"]):
        left -= row["words"]
        if left < 0:
            break
        least = row["bin"]
    return counts.where(F.floor(F.log2("n") * 8) >= (1 << 30 if least is None else least))


def _smaller_batches(spark) -> None:
    """Texts go to the workers some megabytes at a time, unless the session says otherwise."""
    for name, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", "8m")):
        key = f"spark.sql.execution.arrow.{name}"
        if key not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
            spark.conf.set(key, value)


class Known:
    """Ids of the dictionary's words, as a few arrays: a worker's dict of as many words takes four times the memory."""

    def __init__(self, words: list[bytes], ids: list[bytes]):
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.words, self.word_ends = self._packed([words[i] for i in order.tolist()])
        self.ids, self.id_ends = self._packed([ids[i] for i in order.tolist()])

    @staticmethod
    def _packed(items: list[bytes]):
        return b"".join(items), np.cumsum([0, *map(len, items)])

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Packed ids of each word; None for a word that isn't in the dictionary."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.hashes):
            return out
        wanted = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        hits = np.flatnonzero(self.hashes[at] == wanted)
        at = at[hits]
        for i, a, b, c, d in zip(hits.tolist(), self.word_ends[at].tolist(), self.word_ends[at + 1].tolist(),
                                 self.id_ends[at].tolist(), self.id_ends[at + 1].tolist()):
            if self.words[a:b] == words[i]:
                out[i] = self.ids[c:d]
        return out


class Coder:
    """Encodes texts in a worker; chunks seen lately are kept in two generations until the task ends."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: Known):
        self.merges, self.match, self.known = Merges(ranks), regex.compile(pattern), known
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for sequence, rank in ranks.items():
            self.bytes_of[rank] = sequence
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _matches(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """Matches of all chunks, one after the other, and where those of each end.

        Chunks that begin with blanks and end with none are matched as one text: what follows each is a blank, as where it was cut.
        """
        words = self.match.findall("".join(chunks))
        sizes = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        ends = np.cumsum(np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)))
        at = np.searchsorted(sizes, ends)
        if len(words) and sizes[-1] == ends[-1] and (sizes[at] == ends).all():
            return words, (at + 1).tolist()
        # a pattern that leaves characters out or crosses a cut
        split = [self.match.findall(c) for c in chunks]
        return [w for some in split for w in some], np.cumsum([len(some) for some in split]).tolist()

    def _encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        cut = [c[0] in _BLANKS and c[-1] not in _BLANKS for c in chunks]
        some = [c for c, blank in zip(chunks, cut) if blank]
        flat, ends = self._matches(some) if some else ([], [])
        for c in (c for c, blank in zip(chunks, cut) if not blank):
            flat += self.match.findall(c)
            some.append(c)
            ends.append(len(flat))
        distinct = list(set(flat))
        raw = [w.encode("utf-8", "replace") for w in distinct]
        found = self.known.find(raw)
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(rest, self.merges([raw[i] for i in rest])):
            found[i] = ids
        ids = list(map(dict(zip(distinct, found)).__getitem__, flat))
        return {c: ids[a] if b - a == 1 else b"".join(ids[a:b]) for c, a, b in zip(some, [0, *ends], ends)}

    def _encode_some(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [_CHUNK.findall(t) if t else [] for t in texts]
        kept, old = self.young, self.old
        fresh = set().union(*split).difference(kept)
        for c in fresh.intersection(old):
            kept[c] = old[c]
        new = list(fresh.difference(old))
        kept.update(self._encode_chunks(new))
        out = [np.frombuffer(b"".join(map(kept.__getitem__, chunks)), dtype="<i4") for chunks in split]
        for c in new:
            if len(c) > LONGEST:
                del kept[c]
        if len(kept) > _KEPT:
            self.old, self.young = kept, {}
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; the words of some texts that none before had are merged together."""
        out: list[np.ndarray] = []
        some: list[str | None] = []
        size = 0
        for t in texts:
            some.append(t)
            size += len(t) if t else 0
            if size >= _TOGETHER:
                out += self._encode_some(some)
                some, size = [], 0
        return out + self._encode_some(some)

    def forget(self) -> None:
        """Drops the chunks: idle workers of a session would each keep their own."""
        self.young, self.old = {}, {}

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_coders: dict[str, Coder] = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", into: str = "bpe",
           frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with a struct column ``into``: token_ids of the text and the bytes decoded from them.

    NULL and empty texts give no ids and no bytes. Rows stay as they are, repeated ones too; a
    column that already has the name is replaced. The rank file is read on the driver and sent
    along with the dictionary.
    """
    _smaller_batches(docs.sparkSession)
    ranks = read_ranks(ranks_path)
    words = frequent_words(docs, pattern, text_col, frequent).select(
        "word", fold_merges(F.col("word"), ranks).alias("ids")).toArrow()
    ids = words.column("ids").combine_chunks()
    flat, cuts = np.asarray(ids.values, dtype="<i4").tobytes(), np.asarray(ids.offsets).tolist() if len(ids) else []
    known = Known([w.encode() for w in words.column("word").to_pylist()], [flat[4 * a:4 * b] for a, b in zip(cuts, cuts[1:])])
    sent = docs.sparkSession.sparkContext.broadcast((ranks, known))
    name = uuid.uuid4().hex

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _coders:
            _coders.clear()
            ranks, known = sent.value
            _coders[name] = Coder(ranks, pattern, known)
        coder = _coders[name]
        try:
            for texts in batches:
                found = coder.encode_all(texts.tolist())
                yield pd.DataFrame({"token_ids": found, "decoded": [coder.decode(f) for f in found]})
        finally:
            coder.forget()

    return docs.withColumn(into, run(F.col(text_col)))
