"""Rounding, scaling and storing the panel's wide rows: plans that the JVM compiles, and the same rows as the plain functions give."""

import math

from pyspark.sql import functions as F

from phenogrid.functions.columns import rounded
from phenogrid.operators import scaling
from phenogrid.plans import features as fplan
from phenogrid.schema import SCALED
from phenogrid.sources import tables as t

SF = "/root/testdata/sf0.001"


def test_rounded_counts_units_and_makes_no_decimals(spark):
    values = [0.0, -0.0, 1.0000005, -1.0000025, 0.1234564, -2e-7, -4.0000012, 123456.7890125, 1e17, -3.5e300, None, math.nan, math.inf, -math.inf]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = rows.select("i", rounded("v").alias("new"), F.round(F.col("v") + 1e-9, 6).alias("plain")).orderBy("i").collect()
    assert [repr(r["new"]) for r in got] == [repr(r["plain"]) for r in got]
    assert "floor(" in rows.select(rounded("v"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_steps_without_observation_are_not_made_to_be_dropped(spark):
    whole, observed = t.source_panel(spark, SF), t.source_panel(spark, SF, False)
    assert observed.columns == whole.columns and "generate" not in observed._jdf.queryExecution().optimizedPlan().toString().lower()
    cols = [*(c for c in whole.columns if dict(whole.dtypes)[c] != "double"), "NDVI", "sm_surface", F.round("baseline_ndvi_std", 9)]
    assert sorted(map(str, whole.where("n_obs is not null").select(*cols).collect())) == sorted(map(str, observed.select(*cols).collect()))


def test_scaler_fits_and_applies_within_a_hundred_columns(spark):
    df = spark.range(40).select(*[(F.col("id") * (i + 1) + i).cast("double").alias(c) for i, c in enumerate(SCALED)])
    scaler = scaling.fit_scaler(df)
    row = scaler.first()
    assert scaler.columns == [f"{c}_mu" for c in SCALED] + [f"{c}_sd" for c in SCALED]
    assert all(abs(row[f"{c}_mu"] - (19.5 * (i + 1) + i)) < 1e-9 for i, c in enumerate(SCALED))
    plan = scaler._jdf.queryExecution().executedPlan().toString()
    scaled = scaling.apply_scaler(df, scaler)
    assert plan.count("BroadcastNestedLoopJoin") >= -(-len(SCALED) // scaling.COLUMNS_AT_ONCE) - 1
    assert "NDVI_sd#" not in scaled._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert abs(scaled.agg(F.stddev_pop("et")).first()[0] - 1.0) < 1e-9


def test_long_loops_are_not_interpreted(spark):
    t.table(spark, SF, "region")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_the_split_panel_of_a_stored_history_is_that_of_the_observations(spark):
    from phenogrid.plans import serving

    own, shared = fplan.stored_panel(spark, SF), fplan.stored_panel(spark, SF, serving.serving_history(spark, SF))
    assert own.count() == shared.count()
    cols = ["mws_id", "date", "split", F.round("NDVI", 9), F.round("et", 9), F.round("baseline_ndvi_std", 9), "sm_surface"]
    assert sorted(map(str, own.select(*cols).collect())) == sorted(map(str, shared.select(*cols).collect()))
