"""Placement keeps rows without a key and any column of the caller."""

from pyspark.sql import functions as F

from phenogrid.llm import sharding

NAMES = sharding.shard_names(3)


def test_null_keys_repeated_rows_and_clashing_names(spark):
    rows = [("a", 1, 2, 3, 4, "x"), ("a", 1, 2, 3, 4, "x"), (None, 5, 6, 7, 8, "y"), ("", 9, 9, 9, 9, "z")]
    df = spark.createDataFrame(rows, "k string, _slot int, _shard int, __slot int, _slot_ int, shard string")
    out = sharding.place(df, F.col("k"), NAMES, 31)
    assert out.columns == ["k", "_slot", "_shard", "__slot", "_slot_", "slot", "shard"]
    got = out.collect()
    assert sorted((str(r["k"]), r["_slot"], r["_shard"], r["__slot"], r["_slot_"]) for r in got) == sorted((str(x[0]), *x[1:5]) for x in rows)
    owner = sharding.fill_table(NAMES, 31)
    assert all(r["shard"] == NAMES[owner[r["slot"]]] for r in got)
    by = {r["k"]: r["slot"] for r in got}
    assert by[None] == by[""]


def test_key_from_a_replaced_column(spark):
    df = spark.createDataFrame([("a", "old"), ("b", "older")], "k string, shard string")
    by_old = sharding.place(df, F.col("shard"), NAMES, 31).collect()
    want = {x: n for x, n in spark.sql("select 'old' k union select 'older'").select("k", sharding.slot_of(F.col("k"), 31)).collect()}
    assert sorted(r["slot"] for r in by_old) == sorted(want.values())


def test_empty(spark):
    df = spark.createDataFrame([], "k string")
    assert sharding.place(df, F.col("k"), NAMES, 31).collect() == []
