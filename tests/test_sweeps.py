"""Sweeps go on after a kill, try again only what may succeed, and keep the latest attempt."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from phenogrid.operators import sweeps
from phenogrid.session import scratch_path

DAY = date(2000, 1, 3)
#: status of each location in sweeps 1, 2, 3
PLAN = {"a": ["OK", "x", "x"], "b": ["ERROR: timeout", "OK", "x"], "c": ["ERROR: timeout", "ERROR: quota", "ERROR: timed out"],
        "d": ["ERROR: no quarterly tile", "OK", "OK"], "e": [None, "ERROR: no actual NDVI at target", "OK"], "f": ["gone", "gone", "OK"]}
WANT = {"a": ("OK", 1, 1.0), "b": ("OK", 2, 2.0), "c": ("ERROR: timed out", 3, 3.0), "d": ("ERROR: no quarterly tile", 1, 1.0),
        "e": ("ERROR: no actual NDVI at target", 2, 2.0), "f": ("OK", 1, 3.0), "none": ("ERROR: not evaluated", 0, None)}


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(m, DAY) for m in [*PLAN, "none", "a"]], "mws_id string, target_date date")


def plan(spark, asked=None, stop=None):
    rows = spark.createDataFrame([(m, k + 1, s) for m, all_ in PLAN.items() for k, s in enumerate(all_)], "mws_id string, n int, status string")

    def evaluate(left, sweep):
        if asked is not None:
            asked.append(sorted(r["mws_id"] for r in left.collect()))
        out = left.join(rows.where((F.col("n") == sweep) & ~F.coalesce(F.col("status") == "gone", F.lit(False))).drop("n"), "mws_id") \
            .withColumn("value", F.lit(float(sweep)))
        if stop == sweep:
            bad = F.when(F.col("mws_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("value"))
            return out.withColumn("value", bad.cast("double"))
        return out
    return evaluate


def result(df):
    return {r["mws_id"]: (r["status"], r["attempts"], r["value"]) for r in df.collect()}


def test_latest_attempt_and_early_stop(spark, pairs):
    asked = []
    path = scratch_path(spark, "sweeps")
    out = sweeps.sweep_until_settled(pairs, plan(spark, asked), path, 3)
    assert result(out) == WANT and out.count() == 7
    assert asked == [["a", "b", "c", "d", "e", "f", "none"], ["b", "c", "e", "f", "none"], ["c", "f", "none"]]
    again = []
    only = pairs.where("mws_id in ('a', 'b', 'd')")
    assert sweeps.finished_sweeps(spark, path) == [1, 2, 3]
    assert set(result(sweeps.sweep_until_settled(only, plan(spark, again), path, 5))) == {"a", "b", "d"} and again == []


def test_a_killed_sweep_is_repeated_alone(spark, pairs):
    path = scratch_path(spark, "sweeps")
    with pytest.raises(Exception, match="lost"):
        sweeps.sweep_until_settled(pairs, plan(spark, stop=2), path, 3)
    assert sweeps.finished_sweeps(spark, path) == [1]
    asked = []
    assert result(sweeps.sweep_until_settled(pairs, plan(spark, asked), path, 3)) == WANT
    assert len(asked) == 2
    assert result(sweeps.sweep_until_settled(pairs, plan(spark), path, 3)) == WANT


def test_a_folder_without_marker_does_not_count(spark, pairs):
    path = scratch_path(spark, "sweeps")
    spark.createDataFrame([("c", DAY, "OK", 9.0, 1)], "mws_id string, target_date date, status string, value double, sweep int").write.parquet(f"{path}/attempts/1")
    assert result(sweeps.sweep_until_settled(pairs, plan(spark), path, 3)) == WANT


def test_empty(spark, pairs):
    path = scratch_path(spark, "sweeps")
    assert sweeps.sweep_until_settled(pairs.limit(0), plan(spark), path, 3).collect() == [] and sweeps.finished_sweeps(spark, path) == []
