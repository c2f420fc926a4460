"""Quality rules with cross-document line frequency, in DataFrame functions only.

A line is normalised (lower case, blanks collapsed) and hashed; per host (``source``) the distinct
documents that hold it are counted. Lines in more than ``MAX_DOCS`` of them are removed, and a document of
which less than ``MIN_LEFT`` of its word characters stay is rejected. A document is an id; a row without one is a
document of its own. Only line hashes and ids are shuffled, never texts; counting is in two steps, so a host or
line that is everywhere is combined before it meets, and the join back is salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOCS = 20
MIN_LEFT = 0.2
MIN_WORDS = 50
SALTS = 16
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Helper columns beside a caller's own ones start with this.
OWN = "__line_quality_"
LOST = ["_id", "_content", "host", "removed", "lines"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, ""))


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first time included.

    Windows are compared by a 64-bit hash chained over their words. Most texts repeat none, which
    a set of the hashes tells; otherwise (hash, place) is sorted, equal neighbours give the
    repeated places, and each covers the words up to the next one, three at most.
    """
    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(F.transform(s, lambda x, k: F.when(
                (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
            return F.array_sort(again)

        return _let(_let(placed, places), lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(3)), F.lit(3))),
            F.lit(0), lambda a, b: a + b))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: word_chars(x) > 0)
    words, split = f"{OWN}words", f"{OWN}split"
    wide = docs.withColumns({words: words_of(text), split: lines})
    wide = wide.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars(text).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(split) - F.size(F.array_distinct(split))).cast("long"),
        "n_repeat_words": repeated_words(F.col(words)).cast("long")}).drop(words, split)
    return wide.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _normal(line: Column) -> Column:
    return F.array_join(words_of(F.lower(line)), " ")


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
                   max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line, n_docs): hashes of normalised lines in more than ``max_docs`` distinct documents of a host.

    A NULL host is a host of its own (''). Rows with the same id are one document, each row with a NULL id is one.
    NULL, empty and blank texts have no lines; an empty table gives no rows.
    """
    lines = F.array_distinct(F.transform(F.split(F.col(text_col), "\n"), _normal))
    rows = docs.select(
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(id_col).alias("id"),
        F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("place"),
        F.explode(F.transform(F.array_remove(lines, ""), lambda x: F.xxhash64(x))).alias("line"))
    once = rows.distinct()
    return once.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def removed_chars(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", host_col: str = "source",
                  text_col: str = "text") -> DataFrame:
    """Word characters and line hashes that each document loses, by id, hash of the text, and host.

    Documents that lose none have no row; NULL, empty and blank texts lose none.
    """
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.struct(
        F.xxhash64(_normal(x)).alias("line"), word_chars(x).alias("chars"))), lambda x: x["chars"] > 0)
    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_content"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.posexplode(lines).alias("at", "x")).select(
        "_id", "_content", "host", "at", F.col("x.line").alias("line"), F.col("x.chars").alias("chars"),
        F.pmod(F.xxhash64("_id", "_content", "at"), F.lit(SALTS)).alias("salt"))
    salted = frequent.select("host", "line", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt"))
    # repeated rows of a table are one document: its lines are told apart by their place
    return rows.join(salted, ["host", "line", "salt"]).groupBy("_id", "_content", "host", "at").agg(
        F.max("chars").alias("chars"), F.max("line").alias("line")).groupBy("_id", "_content", "host").agg(
        F.sum("chars").alias("removed"), F.collect_set("line").alias("lines")).withColumnsRenamed({c: f"{OWN}{c}" for c in LOST})


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
          max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """``docs`` with the base measures, ``kept``, and ``clean_text`` without the frequent lines.

    NULL, empty and blank texts have no words and fail; a NULL id or host is a value like others;
    repeated rows get the same verdict each. Columns named like the new ones are replaced.
    ``clean_text`` is computed only if it is used.
    """
    frequent = frequent_lines(docs, id_col, host_col, text_col, max_docs)
    lost = removed_chars(docs, frequent, id_col, host_col, text_col)
    key, host, lines = (f"{OWN}{c}" for c in ("key", "of", "lines"))
    base = base_measures(docs, text_col).withColumns({
        key: F.xxhash64(text_col), host: F.coalesce(F.col(host_col).cast("string"), F.lit(""))})
    out = base.join(lost, (base[id_col].eqNullSafe(lost[f"{OWN}_id"])) & (base[key] == lost[f"{OWN}_content"])
                    & (base[host] == lost[f"{OWN}host"]), "left")
    left = F.col("word_chars") - F.coalesce(f"{OWN}removed", F.lit(0))
    clean = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(
        F.col(lines), F.xxhash64(_normal(x)))), "\n")
    return out.withColumns({
        "kept": ~F.col("base_failed") & (left >= min_left * F.col("word_chars")),
        "clean_text": F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(clean)}).drop(
        key, host, *(f"{OWN}{c}" for c in LOST))


_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'row ' || row_number() OVER ()) AS d, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
grams AS (SELECT doc_id, p, array_to_string(words[p:p + 2], ' ') AS g
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) > 2)),
again AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
repeated AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM again WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, d, host, line, length(array_to_string(regexp_extract_all(line, '{_WORD}'), '')) AS chars,
                 array_to_string(regexp_extract_all(lower(line), '{_WORD}'), ' ') AS normal
          FROM (SELECT doc_id, d, host, unnest(string_split(t, chr(10))) AS line FROM w)),
worded AS (SELECT * FROM lines WHERE chars > 0),
frequent AS (SELECT host, normal FROM worded GROUP BY host, normal HAVING count(DISTINCT d) > {MAX_DOCS}),
per_doc AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
                   sum(CASE WHEN frequent.normal IS NOT NULL THEN chars ELSE 0 END) AS removed
            FROM worded LEFT JOIN frequent USING (host, normal) GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed
         FROM w LEFT JOIN per_doc USING (doc_id) LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars - removed >= {MIN_LEFT} * word_chars AS kept
FROM judged
"""
