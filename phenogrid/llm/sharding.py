"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size, given by a start
and a step from hashes of its name. The shards take turns claiming their most preferred free
slot until the table is full, so they hold equal shares (within one slot), and adding or
removing a shard moves few other slots. A row's key is hashed to a slot; the table, whose size
is a parameter, is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 64
#: A prime; some hundred slots a shard keep the shares within a percent.
TABLE = 8191


def _digits(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(names: list[str], size: int = TABLE) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"the table's size has to be a prime, not {size}")
    if not 0 < len(set(names)) == len(names) <= size:
        raise ValueError("shard names have to be distinct, one at least and no more than slots")
    start = [_digits(f"{n}/start") % size for n in names]
    step = [_digits(f"{n}/step") % (size - 1) + 1 for n in names]
    owner, turn, tried = [-1] * size, 0, [0] * len(names)
    for _ in range(size):
        while True:
            slot = (start[turn] + tried[turn] * step[turn]) % size
            tried[turn] += 1
            if owner[slot] < 0:
                break
        owner[slot] = turn
        turn = (turn + 1) % len(names)
    return owner


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot_of(key: Column, size: int = TABLE) -> Column:
    return (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: Column, names: list[str], size: int = TABLE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with its slot and shard; equal keys, repeated rows among them, go to the same shard, no row moves.

    A NULL key counts as an empty one, so its rows stay; ``document_key`` spreads rows without an id. An empty
    table gives an empty one. Columns named like the new ones are replaced, all others stay, whatever their
    names. The broadcast table has exactly ``size`` rows of two numbers and a name.
    """
    spark = df.sparkSession
    names_taken = {c.lower() for c in [*df.columns, slot, shard]}
    by, owner = (f"_{c}{'_' * sum(x.startswith(f'_{c}') for x in names_taken)}" for c in ("slot", "shard"))
    table = spark.createDataFrame([(i, names[o]) for i, o in enumerate(fill_table(names, size))], f"{by} int, {owner} string")
    placed = df.withColumn(slot, slot_of(F.coalesce(key, F.lit("")), size)).drop(shard)
    return placed.join(F.broadcast(table), placed[slot] == table[by]).drop(by).withColumnRenamed(owner, shard)


def document_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id; for rows without one the text's hash, so that they don't all meet in one shard."""
    return F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")), F.lit(""))


def write_shards(placed: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard. Rows are brought together by shard, and a shard with more rows than
    others (a hot key) is written by several tasks, as many as its size asks for."""
    placed.hint("rebalance", shard).write.partitionBy(shard).parquet(path)


SQL = f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 5, '0') AS name FROM range({SHARDS}) t(i)),
orders AS (SELECT list(CAST(('0x' || md5(name || '/start')[1:15])::BIGINT % {TABLE} AS BIGINT) ORDER BY i) AS starts,
                  list(CAST(('0x' || md5(name || '/step')[1:15])::BIGINT % {TABLE - 1} + 1 AS BIGINT) ORDER BY i) AS steps FROM names),
claims AS (
  SELECT 0 AS turn, CAST(-1 AS BIGINT) AS slot, repeat('0', {TABLE})::BIT AS taken, list_transform(starts, lambda x: 0::BIGINT) AS tried FROM orders
  UNION ALL
  SELECT turn + 1, (starts[s] + j * steps[s]) % {TABLE}, set_bit(taken, CAST((starts[s] + j * steps[s]) % {TABLE} AS INTEGER), 1),
         list_concat(list_append(tried[:s - 1], j + 1), tried[s + 1:])
  FROM (SELECT *, list_filter(range(tried[s], {TABLE}), lambda x: get_bit(taken, CAST((starts[s] + x * steps[s]) % {TABLE} AS INTEGER)) = 0)[1] AS j
        FROM (SELECT *, turn % {SHARDS} + 1 AS s FROM claims, orders WHERE turn < {TABLE}))),
owners AS (SELECT slot, name AS shard FROM claims JOIN names ON names.i = (claims.turn - 1) % {SHARDS} WHERE turn > 0)
SELECT doc_id, CAST(d.slot AS INTEGER) AS slot, shard
FROM (SELECT doc_id, ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), ''))[1:15])::BIGINT % {TABLE} AS slot FROM documents) d
JOIN owners ON owners.slot = d.slot
"""
