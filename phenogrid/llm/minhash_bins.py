"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

A text's words (between ASCII blanks, A-Z lower-cased) give shingles of five; a shorter text is one shingle. Each
shingle is hashed once: the hash's high bits name one of ``BINS`` bins, and a bin keeps the smallest
hash that falls into it. An empty bin copies a non-empty one, found by trying bins in a
pseudo-random order of its own that is the same for all texts, so that two texts agree in a bin with a probability
equal to the Jaccard similarity of their shingles, filled bins included. Of every bin the lowest ``BITS`` bits
are kept and packed, after the hash was mixed with the bin's number: copies of one hash must not agree by chance all at once,
as they would in short texts. Unrelated values agree once in 2**BITS; the likeness takes that off.

The fingerprint of a text without words is empty; its likeness is 1 to another such text and 0 to
all others. Texts with the same shingles have the same fingerprint.

``edited_likeness`` compares every document with an edited form of itself, whose second half comes from the next document
by id. Documents are sorted by ranges once and read in order by each task, which holds two texts
at a time. Only the first and last document of a task meet their neighbours in a second step: two rows a task,
whatever the table holds. Rows with the same id follow each other by text; a NULL id comes first. A NULL text
counts as empty. Further columns are ignored; an empty table gives no rows, a single document is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.session import materialise

BINS = 512
BITS = 4
SHINGLE = 5
SEED = 42
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_TRIES = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers spread by two multiplications."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _donors(bins: np.ndarray, round_: int) -> np.ndarray:
    """The bins that each of the given ones tries in a round, in order."""
    tries = np.arange(round_ * _TRIES + 1, (round_ + 1) * _TRIES + 1, dtype=np.uint64)
    return (_mixed((bins.astype(np.uint64)[:, None] << np.uint64(32)) + tries[None, :]) % np.uint64(BINS)).astype(np.int64)


_FIRST = _donors(np.arange(BINS), 0)
_SALTS = _mixed(np.arange(1, BINS + 1, dtype=np.uint64))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hash of each shingle, repeats included; none for a text without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, size = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[size - 1:].tolist())), dtype=np.uint64, count=len(starts))


def densified(hashes: np.ndarray) -> np.ndarray:
    """Least hash of every bin; empty bins copy the first non-empty bin that they try."""
    hashes = np.sort(hashes)
    bins = (hashes >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    least, full = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
    least[bins[first]], full[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(first) == 1:
        least[empty] = hashes[0]
        return least
    round_ = 0
    while len(empty):
        tried = _FIRST[empty] if round_ == 0 else _donors(empty, round_)
        hit = full[tried]
        found = hit.any(axis=1)
        least[empty[found]] = least[tried[found, hit[found].argmax(axis=1)]]
        empty, round_ = empty[~found], round_ + 1
    return least


def low_bits(text: str | None) -> np.ndarray:
    """The kept bits of every bin, one byte each; no bytes for a text without words."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return np.zeros(0, dtype=np.uint8)
    return (_mixed(densified(hashes) + _SALTS) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def pack(bits: np.ndarray) -> bytes:
    """Kept bits side by side, highest bit first."""
    return np.packbits((bits[:, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8)) & 1).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).reshape(-1, BITS)
    return (flat << np.arange(BITS - 1, -1, -1, dtype=np.uint8)).sum(axis=1).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity, 0 to 1, of two texts by their kept bits."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0 ** -BITS
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def fingerprint(text):
    """Column: the packed fingerprint of each text."""
    @F.pandas_udf("binary")
    def packed(texts):
        return texts.map(lambda t: pack(low_bits(t)))
    return packed(text)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc, text, bits, following, following_bits):
    """Result of one document, given the next one."""
    edited = _edited(text, following)
    edited_bits = low_bits(edited)
    return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), pack(bits), pack(edited_bits),
            likeness(bits, edited_bits), likeness(bits, following_bits))


_RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def batch_of(rows, id_type, more_names=(), more_types=()):
        names, types = ["_id", *_NAMES, *more_names], [id_type, *_TYPES, *more_types]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    extra = (["part", "place", "text"], [pa.int32(), pa.string(), pa.string()])

    def walk(batches):
        part, last, id_type = TaskContext.get().partitionId(), None, None
        for batch in batches:
            id_type, rows = batch.column(0).type, []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                bits = low_bits(text)
                if last is None:
                    rows.append((doc, None, None, pack(bits), None, None, None, part, "first", text))
                else:
                    rows.append((*_row(*last, text, bits), None, None, None))
                last = (doc, text, bits)
            yield batch_of(rows, id_type, *extra)
        if last is not None:
            doc, text, bits = last
            yield batch_of([(doc, None, None, pack(bits), None, None, None, part, "last", text)], id_type, *extra)

    def finish(batches):
        for batch in batches:
            doc, text, packed, following, following_packed = (c.to_pylist() for c in batch.columns)
            yield batch_of([_row(d, t, unpack(p), f, unpack(q)) for d, t, p, f, q in zip(doc, text, packed, following, following_packed)],
                           batch.column(0).type)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    order = [F.col("_id"), F.xxhash64("_text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "_text")
    stored = materialise(ordered.mapInArrow(walk, f"_id {kind}, {_RESULT}, part int, place string, text string"), "fingerprints")
    # one number a task, whatever the tasks hold
    parts = sorted(r["part"] for r in stored.where("place = 'first'").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    firsts = stored.where("place = 'first'").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    borders = (stored.where("place = 'last'").join(follows, "part").join(firsts, "next_part")
               .select("_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(finish, f"_id {kind}, {_RESULT}"))
    inner = stored.where("place is null").select("_id", *_NAMES)
    return inner.unionByName(borders).withColumnRenamed("_id", id_col)
