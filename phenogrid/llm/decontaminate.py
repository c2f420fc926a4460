"""Benchmark decontamination: one pass of a word-level Aho-Corasick automaton over each text.

The benchmark is normalised to words (A-Z lower-cased; digits, a-z and anything beyond ASCII are
word characters) and cut into windows of ten consecutive words; a shorter item is one window.
The automaton's alphabet is the benchmark's own words, so a document is read once, word by word.
Hits are mapped back to code points of the original text.

The windows go to the workers in blocks of at most ``BLOCK_WINDOWS`` (window, item) rows, each
broadcast on its own; a benchmark of any size needs more blocks, not more memory, and a worker
holds one automaton at a time. Documents aren't shuffled.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.session import materialise

WINDOW = 10
BLOCK_WINDOWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the same words before lower-casing, for their places in the original text
_PLACED = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FOUND = ("n_words long, n_hit long, item_ids array<string>, "
         "spans array<struct<start: int, stop: int>>")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), 0)


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (gram, item) rows; gram is the window's words joined by blanks.

    NULL and wordless texts give no window; an item without an id marks words but isn't counted.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))
    return words.where(F.size("w") > 0).select("item", F.explode(grams).alias("gram")).distinct()


_ready: tuple | None = None


def _automaton(block):
    """This block's automaton, its vocabulary and its items; the last one used is kept."""
    global _ready
    name, grams_of = block
    if _ready is None or _ready[0] != name:
        _ready = None
        grams = grams_of.value
        vocabulary: dict[bytes, int] = {}
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for gram, items in grams.items():
            key = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in gram.encode().split(b" "))
            machine.add_word(key, (len(key), items))
        machine.make_automaton()
        _ready = (name, machine, vocabulary)
    return _ready[1:]


def _scan(words: list[bytes], machine, vocabulary, hit: set, items: set) -> None:
    known = vocabulary.get
    for end, (n, of) in machine.iter(tuple([known(w, 0) for w in words])):
        hit.update(range(end - n + 1, end + 1))
        items.update(of)


def _runs(text: str, hit: set[int]) -> list[tuple[int, int]]:
    """Spans of neighbouring hit words, in code points of the original text."""
    spans: list[list[int]] = []
    last = None
    for i, m in enumerate(_PLACED.finditer(text)):
        if i in hit:
            if last == i - 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last = i
    return [tuple(s) for s in spans]


def finder(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
           block_windows: int = BLOCK_WINDOWS):
    """Column function text -> struct of FOUND for this benchmark."""
    spark = items.sparkSession
    rows = materialise(benchmark_windows(items, id_col, text_col, window), "windows")
    n_blocks = max(1, -(-rows.count() // block_windows))
    blocks = []
    for b in range(n_blocks):
        mine = rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("gram", "item"), F.lit(n_blocks)) == b)
        grams: dict[str, list[str]] = {}
        for row in mine.toLocalIterator():
            held = grams.setdefault(row["gram"], [])
            if row["item"] is not None:
                held.append(row["item"])
        if grams:
            blocks.append((uuid.uuid4().hex, spark.sparkContext.broadcast(grams)))

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        split = [t.encode("utf-8", "surrogatepass").translate(_TABLE).split() if t else [] for t in texts]
        hits: list[set] = [set() for _ in split]
        found: list[set] = [set() for _ in split]
        for block in blocks:
            machine, vocabulary = _automaton(block)
            for words, hit, items in zip(split, hits, found):
                if words:
                    _scan(words, machine, vocabulary, hit, items)
        return pd.DataFrame({
            "n_words": [len(w) for w in split], "n_hit": [len(h) for h in hits],
            "item_ids": [sorted(i) for i in found],
            "spans": [[{"start": a, "stop": b} for a, b in _runs(t, h)] if h else [] for t, h in zip(texts, hits)]})

    return find


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", into: str = "contamination",
                       **benchmark) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, item_ids (sorted strings), spans.

    NULL, empty and wordless texts have no words and no hits. Rows are kept as they are, repeated
    ones too; an empty benchmark hits nothing. A column that already has the name is replaced.
    """
    return docs.withColumn(into, finder(items, **benchmark)(F.col(text_col)))


SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS gram
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM grams),
placed AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, n, item_id FROM placed JOIN grams USING (n, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
