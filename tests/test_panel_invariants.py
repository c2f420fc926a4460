"""Properties the pipeline must keep, on the smallest test data."""

import re

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phenogrid.operators import anomaly, gaps, grid, windows
from phenogrid.plans import features as fplan
from phenogrid.plans import outlook
from phenogrid.plans import panel as pplan
from phenogrid.plans import windows as wplan
from phenogrid.sources import tables as t


def test_split_is_chronological_and_sized(spark, sf):
    df = fplan.split_panel(spark, sf)
    per = df.groupBy("mws_id").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("tr"),
                                   F.max(F.when(F.col("split") == "train", F.col("date"))).alias("last"),
                                   F.min(F.when(F.col("split") != "train", F.col("date"))).alias("next")).collect()
    for r in per:
        assert r.tr == int(r.n * 0.7) and r.last < r.next


def test_samples_never_mix_splits(spark, sf):
    panel = fplan.split_panel(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("mws_id").orderBy("date")))
    s = wplan.plain_samples(spark, sf)
    pos = panel.select("mws_id", F.col("date").alias("target_date"), F.col("rn").alias("t"))
    lead = s.join(pos, ["mws_id", "target_date"]).withColumn("rn", F.explode(F.sequence(F.col("t") - 6, F.col("t")))) \
        .join(panel.select("mws_id", "rn", F.col("split").alias("lead_split")), ["mws_id", "rn"])
    assert lead.where("lead_split <> split").count() == 0
    assert lead.count() == 7 * s.count() > 0


def test_gap_columns_agree_and_index_is_not_filled(spark, sf):
    h = pplan.history(spark, sf)
    e = gaps.enrich(h)
    assert e.where("NDVI_steps_since_observed <> ndvi_gap_length").count() == 0
    assert e.where("NDVI is not null").count() == h.where("NDVI is not null").count()
    assert e.where("not sensor_reliability between 0 and 1").count() == 0


def test_baseline_ignores_rows_from_the_cutoff_on(spark, sf):
    p = outlook.panel(spark, sf).select("mws_id", "date", "NDVI")
    req = outlook.requests(spark, sf).select("mws_id", "anchor", "target")
    spoilt = p.withColumn("NDVI", F.when(F.col("date") >= F.lit("1999-01-01"), 99.0).otherwise(F.col("NDVI")))
    early = req.where("year(target) = 1999")
    a = anomaly.seasonal_baseline(early, p)
    b = anomaly.seasonal_baseline(early, spoilt)
    assert early.count() > 0 and a.exceptAll(b).count() == 0


def test_compat_constants(spark, sf):
    out = grid.fortnight_panel(t.grid(spark, sf), t.observations(spark, sf), compat=True)
    assert out.where("NDVI is null or precipitation is null or sm_surface is null").count() == 0
    assert out.where("precipitation = -9999").count() > 0


def test_samples_name_missing_features_and_skip_null_lead_rows(spark):
    rows = [("a", f"2000-01-{i + 1:02d}", "train", 0.1 * i, 1.0 if i != 5 else None, 2.0) for i in range(7)]
    df = spark.createDataFrame(rows, "mws_id string, date string, split string, NDVI double, precipitation double, temperature_2m double")
    with pytest.raises(ValueError, match="et"):
        windows.split_samples(df, window=2, lead=2, dynamic=["NDVI", "et"], static=[])
    got = {r["target_date"]: r["forecast_precip_sum"] for r in windows.split_samples(df, 2, 2, ["NDVI"], [], arrays=False).collect()}
    assert got == {"2000-01-04": 2.0, "2000-01-05": 2.0, "2000-01-06": 1.0, "2000-01-07": 1.0}


def test_masking_keeps_the_last_row(spark):
    df = spark.createDataFrame([(str(i), f"2000-01-{i % 28 + 1:02d}", [[1.0, 2.0], [3.0, 4.0]]) for i in range(200)],
                               "mws_id string, target_date string, history array<array<double>>")
    out = windows.mask_history(df, p=0.5)
    # the choice is the sample's, however rows are dealt out
    again = windows.mask_history(df.repartition(7), p=0.5)
    assert sorted(r["mws_id"] for r in out.where("masked").collect()) == sorted(r["mws_id"] for r in again.where("masked").collect())
    assert 0 < out.where("masked").count() < 200
    assert out.where("history[1][0] <> 3.0 or (masked and history[0][0] <> 0.0) or history[0][1] <> 2.0").count() == 0


ROWS_ONLY = {"e06_sample_debug_records", "f04_learned_residual_forecast", "f05_validated_boosting", "plot_advisory_end_to_end"}


def test_every_query_has_a_twin():
    own = {q for q in entry.queries() if not re.match(r"op[0-9]+_|pipeline$", q)}
    assert own - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _cell(v):
    if v is None:
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 5) + 0.0
    return str(v)


@pytest.mark.parametrize("name", [
    "b05_temporal_split", "c05_ndvi_overlapping_median", "c13_provenance", "c22_quality_flags", "c26_climatology_historical", "d10_precip_cum_3",
    "d19_apply_scaler", "e02_lead_aggregates", "e09_covered_walkback", "f10_sampling_stand_ins", "g04_median_location_r2", "h01_seasonal_baseline",
    "j01_area_outlook", "j13_message", "k01_streaming_fortnights", "k03_streaming_reliability"])
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    want = sorted(repr([_cell(v) for v in row]) for row in rel.fetchall())
    got = sorted(repr([_cell(v) for v in row]) for row in entry.queries()[name](spark, sf).select(*names).collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
