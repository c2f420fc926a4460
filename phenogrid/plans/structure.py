"""Named queries: cleaning, dates and time structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.functions import dates as D
from phenogrid.functions import geo
from phenogrid.functions.columns import round_cols
from phenogrid.operators import clean
from phenogrid.plans.registry import query
from phenogrid.schema import WEATHER
from phenogrid.sources import tables as t

TODAY = "2001-06-01"


@query("b01_rename_columns")
def b01(spark, d):
    out = clean.rename_source(t.source_panel(spark, d)).select("mws_id", "step", "precipitation", "runoff", "et")
    return round_cols(out, ["precipitation", "runoff", "et"])


@query("b02_sentinel_to_null")
def b02(spark, d):
    out = clean.null_sentinels(clean.rename_source(t.source_panel(spark, d)))
    return round_cols(out.select("mws_id", "step", *WEATHER), WEATHER)


@query("b03_drop_unobserved")
def b03(spark, d):
    out = clean.rename_and_clean(t.source_panel(spark, d))
    return round_cols(out.select("mws_id", "step", "NDVI", "temperature_2m", "et"), ["NDVI", "temperature_2m", "et"])


@query("b04_parse_dates")
def b04(spark, d):
    text = t.source_panel(spark, d).select("mws_id", F.date_format("date", "yyyy-MM-dd").alias("date"))
    return clean.parse_dates(text)


@query("b05_temporal_split")
def b05(spark, d):
    out = clean.assign_split(clean.rename_and_clean(t.source_panel(spark, d)))
    return out.select("mws_id", "date", "split")


def dated_requests(spark, d):
    """Forecast requests with a text date: one per order, some without, malformed or in the future."""
    return t.table(spark, d, "orders").selectExpr(
        "o_orderkey request_id", "o_custkey plot_id",
        "case o_orderkey % 10 when 0 then null when 1 then concat(date_format(o_orderdate, 'yyyy'), '/01/01') "
        "when 2 then date_format(date_add(cast(o_orderdate as date), 1500), 'yyyy-MM-dd') "
        "when 3 then concat(date_format(o_orderdate, 'yyyy'), '-02-30') "
        "else date_format(o_orderdate, 'yyyy-MM-dd') end as_of_text")


@query("b06_snap_to_grid")
def b06(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).select(
        "o_orderkey", "d", D.snap_to_grid("d").alias("snapped"))


@query("b07_resolve_forecast_dates")
def b07(spark, d):
    return D.resolve_forecast_dates(dated_requests(spark, d), "as_of_text", TODAY)


@query("b08_quarter_window")
def b08(spark, d):
    start, end = D.quarter_bounds("d")
    return t.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).select(
        "o_orderkey", D.quarter_label("d").alias("quarter"), start.alias("quarter_start"), end.alias("quarter_end"))


@query("b09_half_year")
def b09(spark, d):
    return t.table(spark, d, "orders").select(
        "o_orderkey", D.half_year_label(F.to_date("o_orderdate")).alias("half"))


@query("b10_calendar_features")
def b10(spark, d):
    return D.calendar_features(t.grid(spark, d)).drop("step")


@query("b11_days_since_start")
def b11(spark, d):
    return D.days_since_start(clean.rename_and_clean(t.source_panel(spark, d)).select("mws_id", "date"))


@query("b12_cyclic_features")
def b12(spark, d):
    out = D.cyclic_features(D.calendar_features(t.grid(spark, d)))
    cols = ["month_sin", "month_cos", "doy_sin", "doy_cos"]
    return round_cols(out.select("mws_id", "date", *cols), cols)


@query("b13_location_key")
def b13(spark, d):
    return t.plots(spark, d).select("plot_id", geo.location_key("lat", "lon").alias("loc_key"))


@query("b14_utm_zone")
def b14(spark, d):
    shifted = t.plots(spark, d).withColumn("lat2", F.when(F.col("plot_id") % 2 == 0, -F.col("lat")).otherwise(F.col("lat")))
    return shifted.select("plot_id", geo.utm_epsg("lat2", "lon").alias("epsg"))


@query("b15_days_ahead_mode")
def b15(spark, d):
    req = t.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("target"))
    return D.fetch_plan(req, "target", "2000-06-01")
