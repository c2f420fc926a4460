"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits. Cut into four blocks of 16 bits, two fingerprints that differ in at
most two bits agree in two whole blocks, so for each of the six pairs of blocks they are joined
on those 32 bits and the Hamming distance is verified. Only distinct fingerprints are compared:
copies of a text count once, whatever their number. A bucket of more than ``PAIRED`` distinct
fingerprints isn't paired: inside it the difference lies in the other 32 bits, and two values at
distance two or less have a value in common that is at most one bit away from both. Such a bucket
is split by these values, each of which at most 33 fingerprints share, and hung on the smallest
one; this costs 33 rows a fingerprint, links exactly what the pairs would link, and loses none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.llm import near_copies
from phenogrid.llm.components import components
from phenogrid.session import materialise

SEED = 42
SHINGLE = 3
BLOCK_BITS, BLOCKS = 16, 4
DISTANCE = 2
PAIRED = 64
#: Texts that one text of their class stands for when near copies are measured.
LED = 1000
_CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one text; zero if it has no word or is NULL."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(line, SEED)).astype(np.int64))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), len(starts)
    ends = ends[shingle - 1:].tolist()
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])],
                          dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0].astype(np.uint64).astype(np.int64))


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    return _fingerprint(text)


def fingerprint_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _distance(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _block(i: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), i * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1)


def fingerprint_links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) that join exactly the distinct fingerprints ``fps(fp)`` within DISTANCE bits.

    Every pair within the distance is connected by them, directly or through others, and no
    other pair is.
    """
    blocks = list(combinations(range(BLOCKS), 2))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), (F.shiftleft(_block(i), BLOCK_BITS) + _block(j)).alias("v"))
                     for k, (i, j) in enumerate(blocks)])
    keyed = fps.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialise(keyed.join(sizes, ["k", "v"]), "blocks")

    few = rows.where(F.col("n") <= paired)
    x, y = few.select("k", "v", F.col("fp").alias("a")), few.select("k", "v", F.col("fp").alias("b"))
    pairs = x.join(y, ["k", "v"]).where((F.col("b") < F.col("a")) & (_distance("a", "b") <= DISTANCE)).select("a", "b")

    many = rows.where(F.col("n") > paired)
    flips = None
    for k, held in enumerate(blocks):
        free = [b for i in range(BLOCKS) if i not in held for b in range(i * BLOCK_BITS, (i + 1) * BLOCK_BITS)]
        masks = F.array(*[F.lit(0).cast("long")], *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in free])
        flips = F.when(F.col("k") == k, masks) if flips is None else flips.when(F.col("k") == k, masks)
    near = many.select("k", "fp", F.explode(flips).alias("mask")).select(
        "k", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"))
    # at most 33 fingerprints lie within one bit of a centre in the free blocks
    hung = near.groupBy("k", "centre").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(
        F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
    stars = hung.where((F.col("a") > F.col("b")) & (_distance("a", "b") <= DISTANCE)).select("a", "b")
    return pairs.union(stars)


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints with their columns and ``_root``, the smallest one reachable over links."""
    roots = components(fingerprint_links(fps.select("fp")))
    return materialise(fps.join(roots, fps.fp == roots.node, "left").select(*fps.columns, F.coalesce("root", "fp").alias("_root")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links of at most DISTANCE bits. NULL, empty
    and blank texts have fingerprint zero and are linked with each other like any other. Rows
    with a NULL id keep their row and are ignored when the smallest id is taken (NULL if there
    is no other); repeated rows stay repeated; an empty table gives an empty result.
    """
    prints = materialise(docs.select(F.col(id_col).alias(id_col), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    rooted = fingerprint_classes(prints.groupBy("fp").agg(F.min(id_col).alias("_first")))
    least = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(least, "_root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def candidate_pairs(docs: DataFrame, text_col: str = "text", led: int = LED) -> DataFrame:
    """(a, b): text ids (``near_copies``) of texts that the fingerprints put into one class, each with one that stands for it.

    A class of more than ``led`` texts has several of those, so none is in many more pairs than that.
    """
    text = F.col(text_col)
    texts = materialise(docs.select(near_copies.text_id_of(text).alias("text_id"), fingerprint(text).alias("fp")).groupBy("text_id").agg(
        F.first("fp").alias("fp")), "fingerprints")
    classes = fingerprint_classes(texts.select("fp").distinct())
    sizes = texts.join(classes, "fp").groupBy("_root").agg(F.count("*").alias("_n")).where("_n > 1")
    part = F.pmod(F.xxhash64("text_id"), F.ceil(F.col("_n") / led).cast("long"))
    members = materialise(texts.join(classes, "fp").join(sizes, "_root").select("_root", part.alias("_part"), "text_id"), "members")
    leaders = members.groupBy("_root", "_part").agg(F.min("text_id").alias("b"))
    return members.join(leaders, ["_root", "_part"]).where("text_id <> b").select(F.col("text_id").alias("a"), "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies: the row whose id is the component's.

    Texts of one class of fingerprints are candidates, and so are those that agree in a band of min-hashes
    (``near_copies``): two texts of similarity 0.8 differ in some ten bits, which blocks can't find. Every
    candidate is measured by its whole shingle sets, and only similar texts are linked.
    Rows without an id can't represent a group and go, unless their group has no id at all. Of
    rows that repeat the kept id, one stays: the smallest by all columns as text.
    """
    found = materialise(near_copies.near_copies(docs, id_col, text_col, pairs=candidate_pairs(docs, text_col)), "near-copies")
    keep = found.where(F.col(id_col) == F.col("component_id")).select(
        F.col(id_col).alias("_kept")).distinct()
    kept = docs.join(keep, F.col(id_col) == F.col("_kept"), "left_semi")
    one = Window.partitionBy(id_col).orderBy(F.to_json(F.struct(*docs.columns)))
    repeated = found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        kept = kept.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    nameless = docs.where(F.col(id_col).isNull())
    if not nameless.isEmpty():
        groups = found.where("component_id is null").select(F.col("text_id").alias("_text_id"), F.col("root").alias("_root")).distinct()
        tagged = nameless.withColumn("_id", near_copies.text_id_of(F.col(text_col))).join(groups, F.col("_id") == F.col("_text_id"))
        first = Window.partitionBy("_root").orderBy(F.to_json(F.struct(*docs.columns)))
        kept = kept.unionByName(tagged.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*docs.columns))
    return kept
