"""Ranked lexical search: term-at-a-time over document blocks, with a limit on accumulators.

A batch of queries is answered against all documents. Texts become rows of (query term, occurrences)
once, stored in the shared folder; counts over all documents give the term weights. Then each task takes its
documents in blocks of bounded size, inverts a block to posting lists, and runs every query over
them: its terms come rarest first, and each posting adds to its document's accumulator. As soon as
the largest contributions of the remaining terms together lie below the ``k``-th best partial score, no
document without an accumulator can be among the best; no more are created, and the remaining
terms only update the survivors, exactly. A task carries the best ``k`` of its earlier blocks along
(their ``k``-th score starts the limit of the next block) and returns no others, so what is shuffled is
``k`` rows a query and task. Scores are 64-bit integers, so results don't depend on the order of sums.

Queries go in blocks of about ``QUERY_TERMS`` (query, term) rows, which bounds what is collected and
broadcast; every block of queries sees all documents.

Terms are the maximal runs of ASCII digits, ASCII letters and all other code points above 127; only A-Z are
lower-cased. A NULL, empty or termless text, document or query, gives no rows and counts nowhere. A repeated
document row is a document of its own, a repeated query row a query of its own; a NULL id is kept and comes before
all others among equal scores. Further columns are ignored. With an empty table there are no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.session import materialise

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
QUERY_TERMS = 500_000
BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 4_000_000


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.encode("utf-8", "replace").lower().decode()) if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Contribution of occurrences for a weight of one, before the weight; int64 throughout."""
    m = 75 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_q, query id, term, repeats), one row per query and distinct term, stored."""
    def split(batches):
        for batch in batches:
            q, ids, terms, repeats = [], [], [], []
            for i, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                for term, times in Counter(terms_of(text)).items():
                    q.append(row)
                    ids.append(i)
                    terms.append(term)
                    repeats.append(times)
            yield pa.RecordBatch.from_arrays([
                pa.array(q, pa.int64()), batch.column(1).take(pa.array(ids, pa.int64())), pa.array(terms, pa.string()),
                pa.array(repeats, pa.int64())], names=["_q", "_id", "term", "repeats"])

    rows = queries.select(F.monotonically_increasing_id().alias("_q"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = queries.schema[id_col].dataType.simpleString()
    # stored at once, since the numbers of the rows must not change
    return materialise(rows.mapInArrow(split, f"_q long, _id {kind}, term string, repeats long"), "query-terms")


def _counted(docs: DataFrame, numbers, id_col: str, text_col: str) -> DataFrame:
    """(_id, n, terms, tfs) of documents with terms; only the query terms are listed, by number."""
    def count(batches):
        known = numbers.value
        for batch in batches:
            keep, n, ids, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                keep.append(i)
                n.append(len(words))
                for term, times in Counter(words).items():
                    number = known.get(term)
                    if number is not None:
                        ids.append(number)
                        tfs.append(times)
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))], names=["_id", "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return materialise(rows.mapInArrow(count, f"_id {kind}, n long, terms array<int>, tfs array<int>"), "counted-terms")


def _document_frequencies(counted: DataFrame, n_numbers: int) -> dict[int, int]:
    """Documents holding each query term: summed in each task, then over the tasks."""
    def count(batches):
        df = np.zeros(n_numbers, dtype=np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_numbers)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])

    found = counted.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in found.collect()}


class Best:
    """The best ``k`` documents of a query so far: (score, place of the id in its order, id)."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple[int, tuple, object]] = []

    @property
    def limit(self) -> int:
        """The k-th score; a document below it is out, one equal to it may still win by its id."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, found: list[tuple[int, object]]) -> None:
        self.rows += [(s, (i is not None, i), i) for s, i in found]
        self.rows.sort(key=lambda r: (-r[0], r[1]))
        del self.rows[self.k:]


def search_block(queries, postings, n_rows: int, ids, id_places: np.ndarray, best: dict[int, Best]) -> None:
    """Runs every query over the posting lists of one block of documents.

    ``queries`` are (number, terms rarest first, weights times repeats); ``postings`` gives for a term its documents
    and their impacts; ``id_places`` ranks the block's ids.
    """
    for q, terms, weights in queries:
        lists = [(w, *postings[t]) for t, w in zip(terms, weights) if t in postings]
        bounds = [w * int(gains.max()) for w, _, gains in lists]
        remaining, top = sum(bounds), best[q]
        limit, creating = top.limit, True
        if remaining < limit:
            continue
        scores, k = np.zeros(n_rows, dtype=np.int64), top.k
        for (w, rows, gains), bound in zip(lists, bounds):
            if creating and remaining < limit:
                creating = False
            if creating:
                scores[rows] += w * gains
            else:
                scores[rows] += np.where(scores[rows] > 0, w * gains, 0)
            remaining -= bound
            if creating and remaining and n_rows >= k:
                # the k-th partial score, looked for only where it could end the creation
                above = scores[scores > remaining]
                if len(above) >= k:
                    limit = max(limit, int(np.partition(above, len(above) - k)[len(above) - k]))
        held = np.flatnonzero(scores >= limit)
        if len(held) > k:
            held = held[np.lexsort((id_places[held], -scores[held]))[:k]]
        top.add(list(zip(scores[held].tolist(), ids.take(pa.array(held)).to_pylist())))


def _blocks(batches):
    """Record batches joined or cut to blocks of bounded rows and postings."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            rows += part.num_rows
            size += len(part.column(2).flatten())
            if rows >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _invert(block: pa.Table, n_docs: int, n_terms: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Posting lists (rows of the block, impacts) by term."""
    lists = block.column(2).combine_chunks() if block.column(2).num_chunks != 1 else block.column(2).chunk(0)
    term, tf = lists.flatten().to_numpy(), block.column(3).combine_chunks().flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(block.num_rows), pc.list_value_length(lists).to_numpy())
    order = np.argsort(term, kind="stable")
    term, row = term[order], row[order]
    gains = impacts(tf[order], block.column(1).to_numpy()[row], n_docs, n_terms)
    cuts = np.flatnonzero(np.diff(term, prepend=-1))
    return {int(term[a]): (row[a:b], gains[a:b]) for a, b in zip(cuts, [*cuts[1:], len(term)])}


def _answer(docs: DataFrame, asked: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """(_q, _id, score): the best ``k`` of every task for each query of one block of queries."""
    spark = docs.sparkSession
    number: dict[str, int] = {}
    for r in asked:
        number.setdefault(r["term"], len(number))
    counted = _counted(docs, spark.sparkContext.broadcast(number), id_col, text_col)
    n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
    df = _document_frequencies(counted, len(number))
    by_query: dict[int, list] = {}
    for r in asked:
        t = number[r["term"]]
        if df.get(t):
            by_query.setdefault(r["_q"], []).append((df[t], t, r["repeats"] * weight(n_docs, df[t])))
    queries = [(q, [t for _, t, _ in rows], [w for _, _, w in rows]) for q, rows in
               ((q, sorted(rows)) for q, rows in by_query.items())]
    shared = spark.sparkContext.broadcast(queries)
    id_type = counted.schema["_id"].dataType.simpleString()

    def search(batches):
        queries = shared.value
        best = {q: Best(k) for q, _, _ in queries}
        kind = None
        for block in _blocks(batches):
            ids = block.column(0).combine_chunks()
            kind = ids.type
            places = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            search_block(queries, _invert(block, n_docs, n_terms), block.num_rows, ids, places, best)
        found = [(q, i, s) for q, top in best.items() for s, _, i in top.rows]
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], kind),
                pa.array([r[2] for r in found], pa.int64())], names=["_q", "_id", "score"])

    return counted.mapInArrow(search, f"_q long, _id {id_type}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", query_id: str = "item_id",
           text_col: str = "text", query_text: str = "text") -> DataFrame:
    """(query id, rank, document id, score): the ``k`` best documents of every query, scores above zero only."""
    if doc_id == query_id:
        raise ValueError("the ids of documents and queries need different names")
    asked = _query_terms(queries, query_id, query_text)
    n_blocks = max(1, -(-asked.count() // QUERY_TERMS))
    found = None
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("_q"), F.lit(n_blocks)) == b).select("_q", "term", "repeats").collect()
        some = _answer(docs, rows, k, doc_id, text_col)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_first("_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.groupBy("_q").agg(F.first("_id").alias("_query"))
    return top.join(names, "_q").select(
        F.col("_query").alias(query_id), F.col("rank"), F.col("_id").alias(doc_id), F.col("score"))


SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
held AS MATERIALIZED (SELECT doc_id, d, len(w)::BIGINT AS n, w FROM words WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
asked AS MATERIALIZED (
  SELECT i, item_id, term, count(*)::BIGINT AS repeats FROM (
    SELECT i, item_id, unnest(w) AS term FROM (
      SELECT row_number() OVER () AS i, item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM benchmark)) GROUP BY ALL),
postings AS MATERIALIZED (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS term FROM held)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), totals),
gains AS (
  SELECT p.d, h.doc_id, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS gain
  FROM postings p JOIN held h USING (d) JOIN weights w USING (term), totals),
scores AS (
  SELECT i, item_id, d, doc_id, sum(repeats * gain)::BIGINT AS score
  FROM asked JOIN gains USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
  FROM scores WHERE score > 0) WHERE rank <= 20
"""
