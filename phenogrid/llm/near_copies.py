"""Near copies of texts: five-word shingles, Jaccard similarity of 0.8 or more.

Texts are compared by their words, in lower case between ASCII blanks; copies of a text count once,
whatever their number. Candidates agree in one of ``BANDS`` bands of ``ROWS`` min-hashes each: two
texts of similarity 0.8 miss all 32 bands with a chance of 3 in a million, more similar ones with
less. Every pair of a bucket is then measured by its whole shingle sets, so no pair below the limit
is linked. Buckets with the same members are measured once. A bucket of more than ``PAIRED`` texts
is cut into parts, and each two parts are measured together, so that a group in memory is bounded
and no pair is left out. Candidates of other methods (``pairs``) are measured beside them. Only as many links leave a group as connect what is similar in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.llm.components import components
from phenogrid.session import materialise

SEED = 42
SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 5
PAIRED = 1000
BIN_ROWS = 1000
_CHUNK = 1 << 12
_FACTORS = np.array([xxhash.xxh64_intdigest(str(i), SEED) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_id(text: str | None) -> int:
    """Signed 64-bit hash of the words; zero if there are none."""
    words = words_of(text)
    return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)) if words else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of SHINGLE words; a shorter text is one window."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(words) - SHINGLE + 1)].tolist()
    ends = ends[min(SHINGLE, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends)), dtype=np.uint64, count=len(starts)))


def bands(text: str | None) -> list[int]:
    """One signed hash for each band; none for a text without words."""
    hashes = shingles(text)
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at:at + _CHUNK]).min(axis=1), out=least)
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), i)) for i, x in enumerate(least.reshape(BANDS, ROWS))]


@F.pandas_udf(T.LongType())
def _text_id(texts: pd.Series) -> pd.Series:
    return pd.Series([text_id(t) for t in texts], dtype="int64")


@F.pandas_udf(T.StructType([T.StructField("text_id", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def _prints(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"text_id": pd.Series([text_id(t) for t in texts], dtype="int64"),
                         "bands": pd.Series([bands(t) for t in texts], dtype="object")})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts], dtype="object")


def text_id_of(text: Column) -> Column:
    return _text_id(text)


def similar_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Square matrix: whether two of the sets have a Jaccard similarity of SIMILAR or more."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) <= 8:
        common = np.diag(sizes)
        for i in range(len(sets)):
            for j in range(i):
                common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, len(values), _CHUNK):
            s, e = np.searchsorted(column, (at, at + _CHUNK))
            held = np.zeros((len(sets), _CHUNK), dtype=np.float32)
            held[row[s:e], column[s:e] - at] = 1
            common += held @ held.T
        common = common.astype(np.int64)
    # in whole numbers: common / union >= 8 / 10
    return 10 * common >= round(10 * SIMILAR) * (sizes[:, None] + sizes[None, :] - common)


def _linked(ids: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``near`` connects: each id with one that was reached before it."""
    links, left = [], np.ones(len(ids), dtype=bool)
    for start in range(len(ids)):
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            i = todo.pop()
            found = np.flatnonzero(near[i] & left)
            left[found] = False
            links += [(int(ids[i]), int(ids[j])) for j in found]
            todo += found.tolist()
    return links


def _links_of_bin(rows: pd.DataFrame) -> pd.DataFrame:
    links = []
    for _, group in rows.groupby("gid", sort=False):
        group = group.drop_duplicates("text_id")
        links += _linked(group["text_id"].to_numpy(), similar_pairs([np.asarray(s) for s in group["shingles"]]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def candidate_groups(classes: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(gid, text_id): groups of at most about ``paired`` texts in which all candidate pairs meet."""
    keyed = classes.select("text_id", F.explode("bands").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialise(keyed.join(sizes, "bucket"), "buckets")
    few = rows.where(F.col("n") <= paired).groupBy("bucket").agg(F.sort_array(F.collect_list("text_id")).alias("ids"))
    few = few.select(F.xxhash64("ids").alias("gid"), "ids").dropDuplicates(["gid", "ids"]).select(
        "gid", F.explode("ids").alias("text_id"))
    parts = F.ceil(F.col("n") * 2 / paired).cast("long")
    many = rows.where(F.col("n") > paired).select("bucket", "text_id", parts.alias("parts"), F.pmod(
        F.xxhash64("text_id"), parts).alias("part"))
    many = many.select("bucket", "text_id", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).where(
        "part <> other").select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("gid"), "text_id")
    return few.union(many)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED,
                pairs: DataFrame | None = None) -> DataFrame:
    """(id, text_id, root, component_id) for every row of ``docs``.

    ``pairs(a, b)`` are more candidates by text id, found by another method; they are measured like those of the bands.
    ``root`` names the group of texts reachable over pairs of similarity SIMILAR or more, and
    component_id is the smallest id in it. NULL, empty and blank texts are one group. A NULL id is
    ignored when the smallest is taken (NULL if there is no other).
    """
    prints = materialise(docs.select(F.col(id_col).alias(id_col), _prints(F.col(text_col)).alias("p")).select(
        id_col, "p.text_id", "p.bands"), "prints")
    classes = prints.groupBy("text_id").agg(F.min(id_col).alias("_first"), F.first("bands").alias("bands"))
    groups = candidate_groups(classes, paired)
    if pairs is not None:
        groups = groups.union(pairs.select(F.xxhash64(F.lit("pair"), "a", "b").alias("gid"), F.explode(F.array("a", "b")).alias("text_id")))
    groups = materialise(groups, "groups")
    named = docs.select(_text_id(F.col(text_col)).alias("text_id"), F.col(text_col).alias("_text"))
    texts = named.join(groups.select("text_id").distinct(), "text_id", "left_semi").groupBy("text_id").agg(F.first("_text").alias("_text"))
    sets = materialise(texts.select("text_id", _shingles("_text").alias("shingles")), "shingles")
    bins = groups.count() // BIN_ROWS + 1
    binned = groups.join(sets, "text_id").withColumn("bin", F.pmod(F.xxhash64("gid"), F.lit(bins)))
    links = binned.groupBy("bin").applyInPandas(lambda rows: _links_of_bin(rows), "a long, b long")
    roots = components(links)
    first = prints.groupBy("text_id").agg(F.min(id_col).alias("_first"))
    rooted = materialise(first.join(roots, first.text_id == roots.node, "left").select(
        "text_id", "_first", F.coalesce("root", "text_id").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    return prints.select(id_col, "text_id").join(rooted.join(least, "root").select("text_id", "root", "component_id"), "text_id").select(
        id_col, "text_id", "root", "component_id")
